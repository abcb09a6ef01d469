"""Benchmark decontamination with an FM-index per training shard.

Test phrases are the 13-word windows of benchmark items (an item of fewer words
is one window).  A shard is a run of whole documents of one task, as large as ``shard_words``
allows.  Its words are coded with the benchmark's vocabulary; a stretch that
holds no two neighbouring words of any window, in that order, cannot be part of
an occurrence, so only the stretches that do are indexed, with separators
between them.  This loses no occurrence and keeps the index small.

The index: a suffix array by prefix doubling, its Burrows-Wheeler transform in
a wavelet matrix with popcount ranks, and text positions sampled every
``SAMPLE`` symbols and at each stretch's start.  All phrases are searched
backwards at once; occurrences are located by walking to a sampled position;
their spans are merged to removal spans per document.

Documents never leave their task: there is no shuffle.  The benchmark side is a
fixed query set that is read in blocks of ``block_bytes``; each block is
broadcast and applied to every shard in turn, so a larger benchmark means more
blocks, not larger ones.  With more than ``HELD_BLOCKS`` blocks a task drops each one after use and loads it
again for its next shard, so its memory does not grow with the benchmark.

Nulls: a null text has no words, a null item text gives no window; a null item_id
is kept as an item of its own whose id is written as an empty string.  Equal
items are counted apart.  Kept columns with the name of a result are called ``<name>_in``.  A document without hits has the digest of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.util import aside, ranges, raw_texts, slices

WIDTH = 13
SAMPLE = 8
#: Blocks of the benchmark that a task keeps.
HELD_BLOCKS = 4
#: Lower-cases A-Z and turns every byte that is no word character into a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_TO_WORDS).split() if text else []


@dataclass
class Phrases:
    """Distinct windows of a block of items, coded; code 0 ends the text, 1 separates, words follow."""

    vocab: dict[bytes, int]
    codes: np.ndarray  # (windows, WIDTH), left-aligned
    lengths: np.ndarray
    items: list[list[int]]  # per window: numbers of the items that have it
    names: list[str]  # per item: its id as a string
    pairs: np.ndarray  # sorted codes a * size + b of neighbouring words
    singles: np.ndarray  # sorted codes of one-word windows

    @classmethod
    def of(cls, rows: Iterable[tuple[object, bytes | None]], width: int = WIDTH) -> Phrases:
        vocab: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], list[int]] = {}
        names: list[str] = []
        for name, text in rows:
            ws = [vocab.setdefault(w, len(vocab) + 2) for w in words(text)]
            if not ws:
                continue
            names.append("" if name is None else str(name))
            for i in range(max(1, len(ws) - width + 1)):
                had = windows.setdefault(tuple(ws[i : i + width]), [])
                if not had or had[-1] != len(names) - 1:
                    had.append(len(names) - 1)
        keys = list(windows)
        codes = np.zeros((len(keys), width), np.int32)
        lengths = np.array([len(k) for k in keys], np.int64)
        for i, k in enumerate(keys):
            codes[i, : len(k)] = k
        size = len(vocab) + 2
        inner = np.arange(width - 1)[None, :] + 1 < lengths[:, None] if keys else np.zeros((0, width - 1), bool)
        pairs = np.unique((codes[:, :-1].astype(np.int64) * size + codes[:, 1:])[inner])
        return cls(vocab, codes, lengths, list(windows.values()), names, pairs, np.unique(codes[lengths == 1, 0]))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling.  Separators (1) and the end (0) count as distinct symbols in text order."""
    n = len(text)
    ends = text <= 1
    key = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    # The final 0 must be the smallest of all
    key[-1] = -1
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[sa] = np.cumsum(np.concatenate(([0], (np.diff(key[sa]) != 0).astype(np.int64))))
    k = 1
    while rank[sa[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        sa = np.argsort(key, kind="stable")
        rank[sa] = np.cumsum(np.concatenate(([0], (np.diff(key[sa]) != 0).astype(np.int64))))
        k *= 2
    return sa


class WaveletMatrix:
    """Ranks and access over a sequence of small numbers, one bit plane per level."""

    def __init__(self, seq: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        seq = seq.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            word = np.zeros(len(bit) // 64 + 1, np.uint64)
            word.view(np.uint8)[: len(packed)] = packed
            self.bits.append(word)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(word), dtype=np.int64))))
            self.zeros.append(int(len(bit) - bit.sum(dtype=np.int64)))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def _rank1(self, d: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[d][w] + np.bitwise_count(self.bits[d][w] & mask).astype(np.int64)

    def rank(self, c: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """Occurrences of c before each of the positions ``at``."""
        begin, at = np.zeros(len(c), np.int64), list(at)
        for d in range(self.levels):
            one = (c >> (self.levels - 1 - d) & 1).astype(bool)
            for j, i in enumerate([begin, *at]):
                r = self._rank1(d, i)
                moved = np.where(one, self.zeros[d] + r, i - r)
                if j:
                    at[j - 1] = moved
                else:
                    begin = moved
        return [i - begin for i in at]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, its occurrences before i)."""
        c, begin, i = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i.copy()
        for d in range(self.levels):
            one = (self.bits[d][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            c = c << 1 | one
            r, b = self._rank1(d, i), self._rank1(d, begin)
            i, begin = np.where(one, self.zeros[d] + r, i - r), np.where(one, self.zeros[d] + b, begin - b)
        return c, i - begin


class FMIndex:
    """FM-index of a coded text that ends with 0; ``starts`` are positions where a stretch begins."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, size: int, sample: int = SAMPLE):
        sa = suffix_array(text)
        self.bwt = WaveletMatrix(text[sa - 1], size)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        kept = np.zeros(len(text), bool)
        kept[::sample] = True
        kept[starts] = True
        self.sampled = kept[sa]
        self.where = np.cumsum(self.sampled) - 1
        self.position = sa[self.sampled]

    def search(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of every phrase, found backwards; lo == hi where it does not occur."""
        n = len(codes)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.below[-1])
        live = np.arange(n)
        for step in range(codes.shape[1]):
            live = live[(step < lengths[live]) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = codes[live, lengths[live] - 1 - step].astype(np.int64)
            a, b = self.bwt.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.below[c] + a, self.below[c] + b
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled row, count the steps."""
        out, at, todo, steps = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            done = self.sampled[at[todo]]
            end = todo[done]
            out[end] = self.position[self.where[at[end]]] + steps
            todo = todo[~done]
            c, r = self.bwt.access_rank(at[todo])
            at[todo] = self.below[c] + r
            steps += 1
        return out


def find_spans(codes: np.ndarray, doc: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every occurrence of a phrase in the coded words of a shard's documents; code 0 is no benchmark word."""
    none = np.zeros(0, np.int64)
    if len(codes) == 0 or not len(p.lengths):
        return none, none
    size = len(p.vocab) + 2
    linked = np.zeros(len(codes), bool)  # word i and i + 1 may be inside one occurrence
    if len(p.pairs):
        both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0) & (doc[:-1] == doc[1:]))
        pair = codes[both].astype(np.int64) * size + codes[both + 1]
        linked[both] = p.pairs[np.minimum(np.searchsorted(p.pairs, pair), len(p.pairs) - 1)] == pair
    kept = linked.copy()
    kept[1:] |= linked[:-1]
    if len(p.singles):
        kept |= np.isin(codes, p.singles)
    at = np.flatnonzero(kept)
    if not len(at):
        return none, none
    new = np.concatenate(([True], ~linked[at[1:] - 1] | (np.diff(at) > 1)))
    run = np.cumsum(new) - 1
    length = np.bincount(run)
    long_enough = (length >= int(p.lengths.min()))[run]
    at, run = at[long_enough], run[long_enough]
    if not len(at):
        return none, none
    new = np.concatenate(([True], np.diff(run) > 0))
    place = np.arange(len(at)) + np.cumsum(new) - 1  # one separator between stretches
    text = np.ones(place[-1] + 2, np.int64)
    text[place], text[-1] = codes[at], 0
    back = np.zeros(len(text), np.int64)
    back[place] = at
    index = FMIndex(text, place[new], size)
    lo, hi = index.search(p.codes, p.lengths)
    found = np.flatnonzero(hi > lo)
    window = np.repeat(found, (hi - lo)[found])
    return back[index.locate(ranges(lo[found], (hi - lo)[found]))], window


def scan_shard(texts: list[bytes | None], blocks: Iterable[Phrases]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, merged removal spans in words, ids of the items that occur) of each document of a shard."""
    split = [words(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(split), dtype=np.int32), counts)
    edge = np.zeros(len(doc) + 1, np.int32)
    names: list[set[str]] = [set() for _ in split]
    seen: list[list[str]] = [[] for _ in split]
    for p in blocks:
        flat: list[int] = []
        for ws in split:
            flat.extend(map(p.vocab.get, ws, repeat(0)))
        start, window = find_spans(np.array(flat, np.int32), doc, p)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + p.lengths[window], -1)
        pairs = np.unique(doc[start].astype(np.int64) * len(p.lengths) + window) if len(start) else []
        per_doc: dict[int, set[int]] = {}
        for x in pairs:
            d, w = divmod(int(x), len(p.lengths))
            per_doc.setdefault(d, set()).update(p.items[w])
        for d, items in per_doc.items():
            seen[d] += [p.names[i] for i in items]
    hit = np.cumsum(edge)[:-1] > 0 if len(doc) else np.zeros(0, bool)
    del names
    for i in range(len(split)):
        b = int(ends[i] - counts[i])
        mine = hit[b : int(ends[i])].astype(np.int8)
        step = np.diff(np.concatenate(([0], mine, [0])))
        spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
        yield int(counts[i]), spans, sorted(seen[i])


def phrase_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int, width: int) -> Iterator[Phrases]:
    held, size = [], 0
    for r in benchmark.select(F.col(item), F.col(text).cast("string")).toLocalIterator():
        raw = None if r[1] is None else r[1].encode("utf-8", "surrogatepass")
        held.append((r[0], raw))
        size += len(raw or b"")
        if size >= block_bytes:
            yield Phrases.of(held, width)
            held, size = [], 0
    if held:
        yield Phrases.of(held, width)


RESULT = "spans array<struct<start:int,end:int>>, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    min_percent: int = 5,
    shard_words: int = 1 << 20,
    block_bytes: int = 8 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``RESULT``.

    ``contaminated``: some word is hit and hit words are ``min_percent`` per cent of all or more.
    """
    keep = docs.columns if keep is None else keep
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(p) for p in phrase_blocks(benchmark, item, item_text, block_bytes, width)]
    carried = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    result = T.StructType.fromDDL(RESULT)
    kinds = T.StructType([T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)] + result.fields)

    def blocks() -> Iterator[Phrases]:
        for b in shared:
            yield b.value
            if len(shared) > HELD_BLOCKS:
                b.__dict__.pop("_value", None)

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts = [t for part in parts for t in raw_texts(part, "_text")]
        rows = list(scan_shard(texts, blocks()))
        table = pa.Table.from_batches(parts).drop_columns(["_text"]).combine_chunks()
        hits = [sum(e - s for s, e in spans) for _, spans, _ in rows]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        made = {
            "spans": pa.array([[{"start": s, "end": e} for s, e in spans] for _, spans, _ in rows], span),
            "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
            "n_hit": pa.array(hits, pa.int64()),
            "n_items": pa.array([len(x) for _, _, x in rows], pa.int64()),
            "items": pa.array([x for _, _, x in rows], pa.list_(pa.string())),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for _, _, x in rows], pa.string()),
            "contaminated": pa.array([h > 0 and 100 * h >= min_percent * n for h, (n, _, _) in zip(hits, rows)], pa.bool_()),
        }
        cols = [table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0) for c in table.column_names]
        return pa.RecordBatch.from_arrays([*cols, *made.values()], names=[*table.column_names, *made])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                held.append(part)
                size += part.column("_text").nbytes
                if size >= 6 * shard_words:  # about six bytes a word
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    out = carried.mapInArrow(run, kinds)
    own = aside(docs.select(*keep), result.names).columns
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], *result.names)
