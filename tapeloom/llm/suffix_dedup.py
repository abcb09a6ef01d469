"""Exact substring deduplication by a hash-compared suffix sort.

Every byte covered by a ``length``-byte string that also starts earlier (in a
smaller document, or earlier in the same one) is removed.

Sorting all suffixes of a corpus in one place is out of the question, so
suffixes that can share ``length`` bytes are brought together first:

* Every window of ``length`` bytes has an anchor, the ``GRAM``-byte string with
  the smallest hash in it.  Equal windows have equal anchors.  Consecutive windows with
  one anchor form a block; blocks are dealt by their anchor.
* Equal blocks (same anchor, same text by a second hash) are one class; all but the
  first of a class repeat in full.  They are reduced inside each map task
  before anything is shuffled, so a hot passage sends a record per task.
* Blocks that share an anchor but differ (the edges of a shared passage) send
  their bytes.  There the suffixes of their windows are sorted: prefix polynomial
  hashes and a binary search give the common extension of two suffixes, so a
  comparison takes log2(length) steps; a mergesort orders them; suffixes that
  agree over ``length`` bytes are verified byte by byte, and all but the earliest repeat.

Removal spans are joined to the documents once more and cut out.  Nothing is
collected to the driver, and documents are cut nowhere: texts of any size are
handled in segments that only share blocks, never windows, between them.

Documents are known by (id, hash of the text).  Nulls: a null text is empty; a
null id sorts before all others; rows equal in id and text are one document and get equal
results; rows with one id but different texts are two documents in hash order.  Texts
shorter than ``length`` bytes stay whole.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.util import bucket_count, ranges, shuffle_partitions, slices, staged

LENGTH = 100
GRAM = 24
#: Window starts of one hashing segment; also the most of one slice of an Arrow batch.
SEGMENT = 1 << 20
#: Text of a map task that is reduced together before it is shuffled.
REDUCE_BYTES = 24 << 20
#: Suffixes sorted at once.
SORT_ROWS = 1 << 19

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20_240_601))
#: A random odd base and a random number for each byte, twice.
BASES = [_U(int(x) | 1) for x in _rng.integers(1 << 62, 1 << 63, 2)]
TABLES = [_rng.integers(0, 1 << 63, 256).astype(_U) for _ in range(2)]
INVERSES = [_U(pow(int(b), -1, 1 << 64)) for b in BASES]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    had = _powers.get((which, inverse))
    if had is None or len(had) < n:
        size = max(n, 2 * SEGMENT)
        x = np.full(size, (INVERSES if inverse else BASES)[which])
        x[0] = 1
        _powers[which, inverse] = had = np.cumprod(x, dtype=_U)
        if size > 8 * SEGMENT:
            del _powers[which, inverse]
    return had[:n]


class PrefixHash:
    """Polynomial prefix hashes modulo 2**64; equal strings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.prefix = np.zeros(len(data) + 1, _U)
        np.cumsum(TABLES[which][data] * powers(which, len(data)), out=self.prefix[1:])
        self.inverse = powers(which, len(data) + 1, True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by minima from both ends of blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    full = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


#: A block: anchor and text hashes, document, first window's start, number of windows, anchor's place.
BLOCK = np.dtype([("anchor", "<u8"), ("text", "<u8"), ("doc", "<i8"), ("h", "<u4"), ("start", "<u4"), ("n", "u1"), ("at", "u1")])


def find_blocks(data: np.ndarray, ends: np.ndarray, docs: np.ndarray, hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Blocks of the documents whose texts end at ``ends`` in ``data``."""
    begins = np.concatenate(([0], ends[:-1]))
    last = np.maximum(ends - length + 1, begins)  # window starts of a document: [begin, last)
    out = []
    for lo in range(0, max(0, len(data) - length + 1), SEGMENT):
        hi = min(lo + SEGMENT, len(data) - length + 1)
        part = data[lo : hi + length - 1]
        grams = len(part) - gram + 1
        first, second = PrefixHash(part), PrefixHash(part, 1)
        g = mixed(first.of(np.arange(grams), np.arange(gram, gram + grams)))
        key = (g & ~_U(0xFFFFFF)) | np.arange(grams, dtype=_U)
        anchor = (sliding_min(key, length - gram + 1) & _U(0xFFFFFF)).astype(np.int64)
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(begins, hi, "left")
        s, e = np.maximum(begins[a:b], lo) - lo, np.minimum(last[a:b], hi) - lo
        some = e > s
        owner = np.flatnonzero(some) + a
        s, e = s[some], e[some]
        w = ranges(s, e - s)  # all valid window starts
        if not len(w):
            continue
        who = np.repeat(owner, e - s)
        new = np.concatenate(([True], (anchor[w[1:]] != anchor[w[:-1]]) | (who[1:] != who[:-1])))
        i = np.flatnonzero(new)
        start, n, own = w[i], np.diff(np.append(i, len(w))), who[i]
        rec = np.zeros(len(i), BLOCK)
        rec["anchor"] = g[anchor[start]]
        rec["text"] = mixed(second.of(start, start + n + length - 1)) ^ n.astype(_U)
        rec["doc"], rec["h"] = docs[own], hashes[own]
        rec["start"] = start + lo - begins[own]
        rec["n"], rec["at"] = n, anchor[start] - start
        out.append(rec)
    return np.concatenate(out) if out else np.zeros(0, BLOCK)


def repeats_row_before(rows: np.ndarray) -> np.ndarray:
    """Rows of a sorted record array that equal the row before in every field: repeated rows of the input."""
    same = np.ones(max(0, len(rows) - 1), bool)
    for k in rows.dtype.names:
        same &= rows[k][1:] == rows[k][:-1]
    return np.concatenate(([False], same))[: len(rows)]


def split_repeats(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block of each class, all further ones), sorted by anchor, text and place."""
    blocks = blocks[np.lexsort((blocks["start"], blocks["h"], blocks["doc"], blocks["text"], blocks["anchor"]))]
    blocks = blocks[~repeats_row_before(blocks)]
    same = np.zeros(len(blocks), bool)
    same[1:] = (blocks["anchor"][1:] == blocks["anchor"][:-1]) & (blocks["text"][1:] == blocks["text"][:-1])
    return blocks[~same], blocks[same]


class SuffixSort:
    """Mergesort of suffixes inside groups; comparisons by prefix hashes, over ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.hash = data, length, PrefixHash(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes at a and b, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.hash.of(a, a + mid) == self.hash.of(b, b + mid)
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)

    def sort(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of suffixes ``at``, given in groups and by place in them; and whether each equals the one before it."""
        n = len(at)
        order = np.arange(n)
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, n))
        gb, ge = np.repeat(begin, size), np.repeat(begin + size, size)

        def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a, b = at[x], at[y]
            c = self.common(a, b)
            differ = c < self.length
            c = np.minimum(c, self.length - 1)
            return np.where(differ, self.data[a + c] < self.data[b + c], x < y)

        width, most = 1, int(size.max()) if n else 0
        local = np.arange(n) - gb
        while width < most:
            run = local // width
            pair = gb + (run // 2) * 2 * width
            middle = np.minimum(pair + width, ge)
            stop = np.minimum(pair + 2 * width, ge)
            # Runs already in order are left alone
            heads = np.flatnonzero((local % (2 * width) == 0) & (middle < stop))
            if len(heads):
                m = middle[heads]
                bad = heads[less(order[m], order[m - 1])]
                if len(bad):
                    i = ranges(bad, stop[bad] - bad)
                    left = run[i] % 2 == 0
                    lo = np.where(left, middle[i], pair[i])
                    hi = np.where(left, stop[i], middle[i])
                    base = lo.copy()
                    x = order[i]
                    while True:
                        todo = np.flatnonzero(lo < hi)
                        if not len(todo):
                            break
                        mid = (lo[todo] + hi[todo]) >> 1
                        up = less(order[mid], x[todo])
                        lo[todo] = np.where(up, mid + 1, lo[todo])
                        hi[todo] = np.where(up, hi[todo], mid)
                    own = np.where(left, i - pair[i], i - middle[i])
                    moved = order.copy()
                    moved[pair[i] + own + (lo - base)] = x
                    order = moved
            width *= 2
        equal = np.zeros(n, bool)
        if n > 1:
            equal[1:] = (group[order[1:]] == group[order[:-1]]) & (self.common(at[order[1:]], at[order[:-1]]) >= self.length)
            self._verify(at, order, equal)
        return order, equal

    def _verify(self, at: np.ndarray, order: np.ndarray, equal: np.ndarray) -> None:
        """Compare bytes where hashes agree; a collision sends its run to a sort by the bytes themselves."""
        hits = np.flatnonzero(equal)
        step = np.arange(self.length)
        for lo in range(0, len(hits), 1 << 15):
            k = hits[lo : lo + (1 << 15)]
            wrong = (self.data[at[order[k]][:, None] + step] != self.data[at[order[k - 1]][:, None] + step]).any(axis=1)
            for x in k[wrong]:
                b = e = int(x)
                while equal[b]:
                    b -= 1
                while e < len(equal) and (equal[e] or e == b):
                    e += 1
                text = lambda o: self.data[at[o] : at[o] + self.length].tobytes()
                run = sorted(order[b:e].tolist(), key=lambda o: (text(o), o))
                order[b:e] = run
                equal[b + 1 : e] = [text(p) == text(q) for p, q in zip(run, run[1:])]


def repeated_windows(blocks: np.ndarray, offsets: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first window, windows) of runs of windows that occur earlier; blocks come sorted by anchor, then place."""
    n = blocks["n"].astype(np.int64)
    sorter = SuffixSort(data, length)
    own = np.repeat(np.arange(len(blocks)), n)
    j = ranges(np.zeros(len(n), np.int64), n)
    at = offsets[own] + j
    # Windows of one anchor at one distance from it form a group.  A window whose fingerprint no other in its group has is unique.
    group = blocks["anchor"][own] * _U(512) + (blocks["at"][own].astype(np.int64) - j + 256).astype(_U)
    mark = mixed(group) ^ mixed(sorter.hash.of(at, at + length))
    _, inverse, count = np.unique(mark, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[inverse] > 1)
    some = some[np.argsort(group[some], kind="stable")]
    order, equal = sorter.sort(at[some], group[some])
    again = np.sort(some[order[equal]])
    if not len(again):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate(([True], (np.diff(again) > 1) | (own[again[1:]] != own[again[:-1]])))
    i = np.flatnonzero(new)
    return own[again[i]], j[again[i]], np.diff(np.append(i, len(again)))


_SPAN = "doc long, h long, start long, n int, anchor long, at int"
_SPAN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]


def _rows(blocks: np.ndarray, length: int, flagged: bool) -> pa.RecordBatch:
    """Removal spans (anchor null, n in bytes), or blocks whose suffixes must be sorted (n in windows)."""
    n = blocks["n"].astype(np.int32)
    cols = [blocks["doc"], blocks["h"].astype(np.int64), blocks["start"].astype(np.int64), n if flagged else n + np.int32(length - 1)]
    arrays = [pa.array(c, t) for c, t in zip(cols, _SPAN_TYPES)]
    if flagged:
        arrays += [pa.array(blocks["anchor"].view(np.int64)), pa.array(blocks["at"].astype(np.int32))]
    else:
        arrays += [pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "h", "start", "n", "anchor", "at"])


def _dealt(kind: int, bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(rows) else []
    for lo, hi in zip(at, np.append(at[1:], len(rows)) if len(rows) else []):
        yield int(bucket[lo]), kind, rows[lo:hi].tobytes()


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=["bucket", "kind", "data"])


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[int, list[bytes]]]:
    """Blobs by kind of each bucket; rows come sorted by bucket."""
    now, held = None, {}
    for batch in batches:
        for b, k, d in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if b != now and held:
                yield held
                held = {}
            now = b
            held.setdefault(k, []).append(d)
    if held:
        yield held


def removal_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(prepared documents (doc, h, text), spans (doc, h, start, n in bytes))."""
    if not gram <= length <= 120:
        raise ValueError("length must be at least the anchor's and 120 at most")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = bucket_count(docs, "text")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def reduced() -> Iterator[pa.RecordBatch]:
            first, more = split_repeats(np.concatenate(held))
            rows = [*_dealt(0, (first["anchor"] >> _U(20)).astype(np.int64) % buckets, first), *_dealt(1, (more["anchor"] >> _U(20)).astype(np.int64) % buckets, more)]
            for lo in range(0, len(rows), 64):
                yield _blobs(rows[lo : lo + 64])

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                data, ends = flat_bytes(part.column("text"))
                held.append(find_blocks(data, ends, part.column("doc").to_numpy(), part.column("h").to_numpy().astype(np.uint32), length, gram))
                size += len(data)
                if size >= REDUCE_BYTES:
                    yield from reduced()
                    held, size = [], 0
        if held:
            yield from reduced()

    def classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            for d in held.get(1, []):
                yield _rows(np.frombuffer(d, BLOCK), length, False)
            first, more = split_repeats(np.frombuffer(b"".join(held.get(0, [])), BLOCK))
            yield _rows(more, length, False)
            same = first["anchor"][1:] == first["anchor"][:-1]
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(first) else np.zeros(0, bool)
            yield _rows(first[shared], length, True)

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ship the bytes of flagged blocks: a record array, then the texts end to end."""
        held, size = [], 0

        def out() -> pa.RecordBatch:
            rec = np.concatenate([x for x, _ in held])
            text = np.concatenate([x for _, x in held])
            n = rec["n"].astype(np.int64) + length - 1
            begin = np.cumsum(n) - n
            bucket = (rec["anchor"] >> _U(20)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            rows = []
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for lo, hi in zip(cut, np.append(cut[1:], len(order))):
                i = order[lo:hi]
                rows.append((int(bucket[i[0]]), len(i), rec[i].tobytes() + text[ranges(begin[i], n[i])].tobytes()))
            return _blobs(rows)

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                data, ends = flat_bytes(part.column("text"))
                begins = np.concatenate(([0], ends[:-1]))
                flags = part.column("flags")
                of = np.repeat(np.arange(part.num_rows), np.diff(flags.offsets.to_numpy()))
                f = flags.flatten()
                rec = np.zeros(len(of), BLOCK)
                if not len(rec):
                    continue
                rec["doc"], rec["h"] = part.column("doc").to_numpy()[of], part.column("h").to_numpy()[of]
                rec["anchor"] = f.field("anchor").to_numpy().view(_U)
                for k in ("start", "n", "at"):
                    rec[k] = f.field(k).to_numpy()
                held.append((rec, data[ranges(begins[of] + rec["start"], rec["n"].astype(np.int64) + length - 1)]))
                size += len(held[-1][1])
                if size >= 8 << 20:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def sorted_suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            recs, texts = [], []
            for count, blobs in held.items():
                for d in blobs:
                    recs.append(np.frombuffer(d, BLOCK, count))
                    texts.append(np.frombuffer(d, np.uint8, offset=count * BLOCK.itemsize))
            rec, text = np.concatenate(recs), np.concatenate(texts)
            n = rec["n"].astype(np.int64) + length - 1
            begin = np.cumsum(n) - n
            order = np.lexsort((rec["start"], rec["h"], rec["doc"], rec["anchor"]))
            rec, begin, n = rec[order], begin[order], n[order]
            fresh = ~repeats_row_before(rec)
            rec, begin, n = rec[fresh], begin[fresh], n[fresh]
            # Whole anchors, about SORT_ROWS suffixes at a time
            starts = np.flatnonzero(np.concatenate(([True], rec["anchor"][1:] != rec["anchor"][:-1])))
            stops = np.append(starts[1:], len(rec))
            total = np.cumsum(rec["n"], dtype=np.int64)[stops - 1]
            k = 0
            while k < len(starts):
                until = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + SORT_ROWS, "right")))
                lo, hi, k = int(starts[k]), int(stops[until - 1]), until
                r = rec[lo:hi]
                piece = text[ranges(begin[lo:hi], n[lo:hi])]
                own, j, count = repeated_windows(r, np.cumsum(n[lo:hi]) - n[lo:hi], piece, length)
                cols = [r["doc"][own], r["h"][own].astype(np.int64), r["start"][own].astype(np.int64) + j, (count + length - 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SPAN_TYPES)], names=["doc", "h", "start", "n"])

    x = docs.select("doc", "h", "text")
    dealt = x.mapInArrow(blocks, "bucket int, kind int, data binary")
    found = staged(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(classes, _SPAN), "suffix-blocks")
    flagged = found.where("anchor is not null").groupBy("doc", "h").agg(F.collect_list(F.struct("start", "n", "anchor", "at")).alias("flags"))
    shipped = x.join(flagged, ["doc", "h"]).select("doc", "h", "text", "flags").mapInArrow(edges, "bucket int, kind int, data binary")
    more = shipped.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(sorted_suffixes, "doc long, h long, start long, n int")
    return x, found.where("anchor is null").select("doc", "h", "start", "n").unionByName(more)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and where each text ends; nulls are empty."""
    column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def merge_spans(starts: Iterable[int], lengths: Iterable[int]) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of possibly overlapping or touching spans."""
    out: list[list[int]] = []
    for s, n in sorted(zip(starts, lengths)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(s, e) for s, e in out]


RESULT = "spans array<struct<start:long,end:long>>, n_bytes long, n_removed long, n_spans long, kept_text binary, kept_sha256 string"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """(id, spans, n_bytes, n_removed, n_spans, kept_text, kept_sha256) of every row; ``kept_text`` is null unless asked for."""
    docs = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    x, spans = removal_spans(docs, length, gram)
    per_doc = spans.groupBy("doc", "h").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows = []
                for t, cuts in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("cuts").to_pylist()):
                    merged = merge_spans([c["start"] for c in cuts or []], [c["n"] for c in cuts or []])
                    kept, at = [], 0
                    for s, e in merged:
                        kept.append(t[at:s])
                        at = e
                    left = b"".join([*kept, t[at:]])
                    rows.append(([{"start": s, "end": e} for s, e in merged], len(t), len(t) - len(left), len(merged), left if with_text else None, hashlib.sha256(left).hexdigest()))
                kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), *made], names=["doc", "spans", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"])

    out = x.join(per_doc, ["doc", "h"], "left").select("doc", "text", "cuts").mapInArrow(cut, "doc long, " + RESULT)
    return out.select(F.when(F.col("doc") != -(2**63), F.col("doc")).alias(id_col), "spans", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256")
