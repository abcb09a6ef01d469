"""Near-duplicate passages by compact windows.

A text is a sequence of five-word shingles.  Under one hash function, all
subsequences whose smallest hash stands at one place form a compact window: in
the Cartesian tree of the hashes it is a node with the span of its subtree.
Only nodes whose span holds ``passage`` shingles matter; they are the places
that are smallest in some run of that length, about 2 n / passage of n, and their
spans follow from a stack over those places alone.

1. Each window sends (smallest hash, place, which runs of ``passage`` shingles it
   covers, a hash of the shingles these runs span).  Windows with one key and one
   content are one class: all but its first are exact repeats, which is settled in the map task
   where possible.  Keys with several contents are candidates.
2. Interval join: in each document, runs covered by candidate windows of at
   least ``enough`` of the ``hashes`` hash functions stay candidates and send their words.
3. Verification, per key: two runs are near duplicates if their shingles, repeats counted, have a Jaccard
   similarity of ``similarity`` or more, that is 41 of 46 in common at 0.8.  A word that is changed, put in or left out takes
   neighbouring shingles only, so such runs share 41 shingles that stand end to end or around one gap of at most five.  Each
   such part goes by the sum of its shingles' hashes, whatever their order; runs with an equal part are linked to
   the first that has it.  That takes time in proportion to the runs of a key and not to their pairs, drops no candidate and
   keeps all that are linked connected.  Of every linked pair of windows one pair of runs is counted shingle by shingle.

Not found are runs that are similar only because shingles repeat inside them in another order.  Windows of one key that differ are
one task's work, about two kilobytes each.

Links go from a document to earlier ones it repeats, at least one for each run and those of the forest;
``class_id`` is the smallest document reachable over them.

Nulls and texts shorter than a run have no passages and are their own class; a
null id sorts before all others and never names a class.  Rows equal in id and text are one
document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.components import connected_components
from tapeloom.llm.suffix_dedup import _blobs, _by_bucket, _dealt, mixed, powers, repeats_row_before, sliding_min
from tapeloom.llm.util import bucket_count, ranges, raw_texts, shuffle_partitions, slices, staged

SHINGLE, PASSAGE, HASHES, ENOUGH, SIMILARITY = 5, 46, 4, 1, 0.8
REDUCE_BYTES = 24 << 20
#: Windows verified at once, whole keys, and parts of their runs that are sorted at once.
VERIFY_ROWS, MAX_PARTS = 4_096, 1 << 20
_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Of XXH64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
NO_ID = -(2**63)

#: key: smallest hash with the function's number in its last bits; runs of the window start at [c - back, c - back + n).
WINDOW = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("h", "<u4"), ("c", "<u4"), ("back", "u1"), ("n", "u1")])


class _WordHash(dict):
    """Hash of each long word; forgets all when it has grown large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[w] = x = xxhash.xxh64_intdigest(w, 5)
        return x


def split_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the words of all texts in lower case, each with one space after it, where they begin and where all end, words of each text)."""
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    raw = np.frombuffer(b"".join(x for t in texts for x in (t or b"", b" ")).translate(_LOWER), np.uint8)
    word = ~_GAP[raw]
    kept = word.copy()
    kept[1:] |= word[:-1]  # of the bytes after a word the first
    inside = word[kept]
    flat = np.where(inside, raw[kept], np.uint8(32))
    begins = np.concatenate(([0], np.flatnonzero(~inside) + 1))
    of_text = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)[np.cumsum(sizes) - 1])) if len(texts) else np.zeros(1, np.int64)
    return flat, begins, np.diff(np.searchsorted(begins, of_text))


def word_hashes(flat: np.ndarray, begins: np.ndarray, cache: _WordHash) -> np.ndarray:
    """XXH64 (seed 5) of each word, those of one length at a time; words of 32 bytes and more go through ``cache``."""
    turned = lambda x, by: (x << _U(by)) | (x >> _U(64 - by))
    size = np.minimum(np.diff(begins) - 1, 32).astype(np.uint8)
    padded = np.concatenate((flat, np.zeros(8, np.uint8)))
    at = lambda i, kind: np.ndarray(len(flat), kind, padded, 0, (1,))[i].astype(_U)
    order = np.argsort(size, kind="stable")
    stops = np.cumsum(np.bincount(size, minlength=33))
    out = np.zeros(len(size), _U)
    for n in range(1, 32):
        mine = order[stops[n - 1] : stops[n]]
        if not len(mine):
            continue
        i = begins[mine]
        h = np.full(len(i), (5 + _P5 + n) % (1 << 64), _U)
        for _ in range(n // 8):
            h ^= turned(at(i, "<u8") * _U(_P2), 31) * _U(_P1)
            h = turned(h, 27) * _U(_P1) + _U(_P4)
            i = i + 8
        if n % 8 >= 4:
            h ^= at(i, "<u4") * _U(_P1)
            h = turned(h, 23) * _U(_P2) + _U(_P3)
            i = i + 4
        for k in range(n % 4):
            h ^= padded[i + k] * _U(_P5)
            h = turned(h, 11) * _U(_P1)
        h = (h ^ (h >> _U(33))) * _U(_P2)
        h = (h ^ (h >> _U(29))) * _U(_P3)
        out[mine] = h ^ (h >> _U(32))
    for k in order[stops[31] :].tolist():
        out[k] = cache[flat[begins[k] : begins[k + 1] - 1].tobytes()]
    return out


def shingles(texts: list[bytes | None], cache: _WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes end to end, where each text's end, words of each text)."""
    flat, begins, counts = split_words(texts)
    return *shingles_of(word_hashes(flat, begins, cache), counts), counts


def shingles_of(w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes end to end, where each text's end) of the words' hashes."""
    m = np.maximum(counts - SHINGLE + 1, 0)
    n = max(0, len(w) - SHINGLE + 1)
    s = np.zeros(n, _U)
    for k in range(SHINGLE):
        s *= _U(0x9E3779B97F4A7C15)
        s += w[k : k + n]
    begin = np.cumsum(counts) - counts
    return mixed(s)[ranges(begin, m)], np.cumsum(m)


def compact_windows(s: np.ndarray, ends: np.ndarray, docs: np.ndarray, h: np.ndarray, passage: int, hashes: int) -> np.ndarray:
    """The compact windows of at least ``passage`` shingles, cut to the runs around their smallest hash."""
    begins = np.concatenate(([0], ends[:-1]))
    runs = np.maximum(ends - begins - passage + 1, 0)
    if not runs.sum():
        return np.zeros(0, WINDOW)
    w = ranges(begins, runs)
    who = np.repeat(np.arange(len(ends)), runs)
    p, inv = powers(0, len(s)), powers(0, len(s) + 1, True)
    prefix = np.concatenate((np.zeros(1, _U), np.cumsum(s * p, dtype=_U)))
    out = []
    for f in range(hashes):
        g = mixed(s ^ _U(0x51_7C_C1_B7_27_22_0A_95 * (f + 1) % (1 << 64)))
        key = (g & ~_U(0xFFFFFFF)) | np.arange(len(g), dtype=_U)
        c = (sliding_min(key, passage) & _U(0xFFFFFFF)).astype(np.int64)[w]
        i = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (who[1:] != who[:-1]))))
        own, node, start, n = who[i], c[i], w[i], np.diff(np.append(i, len(w)))
        rec = np.zeros(len(i), WINDOW)
        rec["key"] = (g[node] & ~_U(7)) | _U(f)
        stop = start + n + passage - 1
        rec["content"] = mixed((prefix[stop] - prefix[start]) * inv[start]) ^ n.astype(_U)
        rec["doc"], rec["h"], rec["c"] = docs[own], h[own], node - begins[own]
        rec["back"], rec["n"] = node - start, n
        out.append(rec)
    return np.concatenate(out)


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, first place of each, which of them each value is); ``np.unique`` takes several times as long."""
    order = np.argsort(x)
    y = x[order]
    new = np.concatenate(([True], y[1:] != y[:-1]))[: len(x)]
    head = np.flatnonzero(new)
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return y[head], np.minimum.reduceat(order, head) if len(x) else order, which


def split_classes(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window of each class of equal key and content, the further ones, and the document each of those repeats)."""
    order = np.argsort(rec["key"])
    key = rec["key"][order]
    tie = np.concatenate(([False], key[1:] == key[:-1]))[: len(rec)]
    tie[:-1] |= tie[1:]
    some = rec[order[tie]]
    order[tie] = order[tie][np.lexsort((some["c"], some["h"], some["doc"], some["content"], some["key"]))]
    rec = rec[order]
    rec = rec[~repeats_row_before(rec)]
    same = np.zeros(len(rec), bool)
    same[1:] = (rec["key"][1:] == rec["key"][:-1]) & (rec["content"][1:] == rec["content"][:-1])
    leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(rec)))) if len(rec) else np.zeros(0, np.int64)
    return rec[~same], rec[same], rec["doc"][leader][same]


REPEAT = np.dtype([("doc", "<i8"), ("h", "<u4"), ("start", "<u4"), ("n", "u1"), ("of", "<i8")])


def by_columns(rows: np.ndarray) -> bytes:
    """The bytes of records field by field, which packs better than row by row."""
    return b"".join(np.ascontiguousarray(rows[k]).tobytes() for k in rows.dtype.names)


def of_columns(data: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(data) // kind.itemsize, 0
    rows = np.zeros(n, kind)
    for k in kind.names:
        rows[k] = np.frombuffer(data, kind[k], n, at)
        at += n * kind[k].itemsize
    return rows


def _repeats(rec: np.ndarray, of: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rec), REPEAT)
    out["doc"], out["h"], out["start"], out["n"], out["of"] = rec["doc"], rec["h"], rec["c"] - rec["back"], rec["n"], of
    return out


_ROW = "doc long, h long, start long, n int, of long, key long, back int"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
_NAMES = ["doc", "h", "start", "n", "of", "key", "back"]


def _row_batch(rep: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(rep[k].astype(t.to_pandas_dtype())) for k, t in zip(REPEAT.names, _TYPES)]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(rep), pa.int64()), pa.nulls(len(rep), pa.int32())], names=_NAMES)


def _flag_batch(rec: np.ndarray) -> pa.RecordBatch:
    start = rec["c"].astype(np.int64) - rec["back"]
    cols = [pa.array(rec["doc"]), pa.array(rec["h"].astype(np.int64)), pa.array(start), pa.array(rec["n"].astype(np.int32)), pa.nulls(len(rec), pa.int64())]
    return pa.RecordBatch.from_arrays([*cols, pa.array(rec["key"].view(np.int64)), pa.array(rec["back"].astype(np.int32))], names=_NAMES)


def joined_intervals(start: np.ndarray, n: np.ndarray, function: np.ndarray, hashes: int, enough: int) -> np.ndarray:
    """Which windows cover a run that windows of ``enough`` hash functions cover; all of one document."""
    if enough <= 1:
        return np.ones(len(start), bool)
    size = int((start + n).max()) + 1
    count = np.zeros(size, np.int64)
    for f in range(hashes):
        edge = np.zeros(size + 1, np.int64)
        np.add.at(edge, start[function == f], 1)
        np.add.at(edge, (start + n)[function == f], -1)
        count += np.cumsum(edge)[:size] > 0
    good = np.concatenate(([0], np.cumsum(count >= enough)))
    return good[start + n] > good[start]


def _repeated_cells(cells: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Which of the chosen cells have a mark that another one has too; a few others pass as well (two small count tables)."""
    bits = max(16, int(cells.sum()).bit_length() + 1)
    at = np.flatnonzero(cells)
    m = mark.ravel()[at]
    again = np.ones(len(at), bool)
    for shift in (64 - bits, 32 - bits // 2):
        slot = ((m >> _U(shift)) & _U((1 << bits) - 1)).astype(np.int64)
        again &= np.bincount(slot, minlength=1 << bits)[slot] > 1
    out = np.zeros(cells.size, bool)
    out[at[again]] = True
    return out.reshape(cells.shape)


def _covered(lead: np.ndarray, length: int, passage: int) -> np.ndarray:
    """For each start of ``length`` cells whether they lie in one of the chosen runs."""
    starts = 2 * passage - length
    total = np.zeros((len(lead), passage + 1), np.int16)
    np.cumsum(lead, axis=1, out=total[:, 1:])
    k = np.arange(starts)
    return total[:, np.minimum(k, passage - 1) + 1] > total[:, np.clip(k - (passage - length), 0, passage)]


def common_shingles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles row i of x has in common with row i of y, repeats counted; 0 stands for none."""

    def ranked(z: np.ndarray) -> np.ndarray:
        z = np.sort(z, axis=1)
        rank = np.zeros(z.shape, np.int64)
        for k in range(1, z.shape[1]):
            rank[:, k] = np.where(z[:, k] == z[:, k - 1], rank[:, k - 1] + 1, 0)
        return np.where(z == 0, _U(0), mixed(z + rank.astype(_U) * _U(0x9E3779B97F4A7C15)))

    both = np.sort(np.concatenate((ranked(x), ranked(y)), axis=1), axis=1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != 0)).sum(axis=1)


def _branches(grid: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders j between cells j - 1 and j where the left (right) shingle has other neighbours elsewhere in its key.

    Small tables of the least and the greatest neighbour; shingles that share a slot only add borders.
    """
    bits = max(16, int(grid.size).bit_length())
    slot = (mark >> _U(64 - bits)).astype(np.int64)
    out = []
    for mine, other in ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))):
        there = (grid[:, :-1] != 0) & (grid[:, 1:] != 0)
        at, x = slot[:, mine][there], mark[:, other][there]
        least, most = np.full(1 << bits, ~_U(0)), np.zeros(1 << bits, _U)
        np.minimum.at(least, at, x)
        np.maximum.at(most, at, x)
        border = np.zeros(grid.shape, bool)
        border[:, 1:][there] = (least != most)[at]
        out.append(border)
    return out[0], out[1]


class _Parts:
    """Parts of runs under the sums of their shingles: ``need`` cells end to end, or around a gap of up to ``passage - need``.

    A gap begins and ends where the key's windows branch: what two windows share is taken as long as it goes.
    """

    def __init__(self, grid: np.ndarray, mark: np.ndarray, salt: np.ndarray, lead: np.ndarray, good: np.ndarray, passage: int, need: int) -> None:
        self.rows = np.flatnonzero(lead.any(axis=1))
        self.passage, self.need, self.width = passage, need, grid.shape[1]
        cells = grid[self.rows]
        self.sums = np.zeros((len(self.rows), self.width + 1), _U)
        np.cumsum(cells, axis=1, out=self.sums[:, 1:])
        # Good cells that end just before each border, and that begin at it
        good = good[self.rows]
        self.before, self.after = np.zeros(good.shape, np.int16), np.zeros(good.shape, np.int16)
        for k in range(1, self.width):
            self.before[:, k] = (self.before[:, k - 1] + 1) * good[:, k - 1]
        self.after[:, -1] = good[:, -1]
        for k in range(self.width - 2, -1, -1):
            self.after[:, k] = (self.after[:, k + 1] + 1) * good[:, k]
        self.lead, self.salt = lead[self.rows], salt[self.rows]
        self.opens, self.closes = _branches(cells, mark[self.rows])

    def each(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(gap, flat place of the part's first cell, sum) of all parts without a bad cell."""
        for gap in range(self.passage - self.need + 1):
            length = self.need + gap
            covered = _covered(self.lead, length, self.passage)
            starts = covered.shape[1]
            whole = self.sums[:, length:] - self.sums[:, :starts] + self.salt[:, None]
            hole = self.sums[:, gap:] - self.sums[:, : self.width + 1 - gap]
            if not gap:
                at = np.flatnonzero(covered & (self.after[:, :starts] >= length))
                yield 0, self.rows[at // starts] * self.width + at % starts, whole.ravel()[at]
                continue
            # Good cells before the gap and after it must be ``need`` together
            row, j = np.nonzero(self.opens[:, : self.width - gap] & self.closes[:, gap:] & (self.before[:, : self.width - gap] + self.after[:, gap:] >= self.need))
            for lo in range(0, len(row), 1 << 15):
                r, x = row[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
                first = np.maximum(0, np.maximum(x - self.before[r, x], x - self.need + 1))
                last = np.minimum(np.minimum(x, starts), x + gap + self.after[r, x + gap] - length + 1)
                n = np.maximum(last - first, 0)
                k, r, x = ranges(first, n), np.repeat(r, n), np.repeat(x, n)
                at = r * starts + k
                ok = covered.ravel()[at]
                at, k, r, x = at[ok], k[ok], r[ok], x[ok]
                yield gap, self.rows[r] * self.width + k, whole.ravel()[at] - hole[r, x]


def _shared_parts(parts: _Parts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, gap, first place, its gap) of parts that have the same sum as one that stands before."""
    rounds, turn = 1, 0
    while turn < rounds:
        sums, places, held = [], [], 0
        for gap, at, s in parts.each():
            if rounds > 1:
                mine = np.flatnonzero((s >> _U(8)) % _U(rounds) == _U(turn))
                at, s = at[mine], s[mine]
            sums.append(s)
            places.append(at * 8 + gap)
            held += len(s)
            if held > 2 * MAX_PARTS and not turn:
                break
        if held > 2 * MAX_PARTS and not turn:  # too many at once: by remainders of the sum
            rounds *= 4
            continue
        turn += 1
        s, place = np.concatenate(sums), np.concatenate(places)
        if not len(s):
            continue
        # Sorted by leading bits, with the number of the part in the last ones; those alone with theirs are left out
        low = _U((1 << max(1, len(s).bit_length())) - 1)
        packed = np.sort((s & ~low) | np.arange(len(s), dtype=_U))
        same = (packed[1:] & ~low) == (packed[:-1] & ~low)
        twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        i = (packed[twice] & low).astype(np.int64)
        if not len(i):
            continue
        i = i[np.argsort(s[i], kind="stable")]
        head = np.flatnonzero(np.concatenate(([True], s[i[1:]] != s[i[:-1]])))
        first = np.repeat(np.minimum.reduceat(place[i], head), np.diff(np.append(head, len(i))))
        later = first // 8 != place[i] // 8
        every = int(place.max()) + 1  # below 2 ** 31 as long as a key has fewer than three million windows
        both = np.sort(place[i][later] * every + first[later])
        mine, theirs = np.divmod(both[np.diff(both, prepend=-1) > 0], every)
        yield mine // 8, mine % 8, theirs // 8, theirs % 8


def verify_groups(rec: np.ndarray, grid: np.ndarray, passage: int, similarity: float) -> tuple[np.ndarray, ...]:
    """(member, first run, runs, earlier member) of near duplicates among windows that come sorted by key, then place.

    ``grid`` has the shingles by offset from the smallest hash, 0 where there are none.  Runs of ``passage``
    with x shingles in common have similarity x / (2 passage - x), so ``need`` common ones are enough.  A word that is changed, put in or left
    out takes neighbouring shingles only; so runs that are similar share ``need`` shingles that stand end to
    end or around one gap in either.  All such parts of the distinct runs go by the sum of their shingles; runs that share
    one are linked to the first that has it.  This takes time in proportion to the runs, however many of a key are similar or nearly so.
    """
    none = (np.zeros(0, np.int64),) * 4
    need = int(np.ceil(2 * passage * similarity / (1 + similarity) - 1e-9))
    if passage - need > 7:
        raise ValueError("passage and similarity leave gaps of more than 7 shingles")
    group = np.cumsum(np.concatenate(([True], rec["key"][1:] != rec["key"][:-1]))) - 1
    salt = mixed((group + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
    first = passage - 1 - rec["back"].astype(np.int64)  # runs are grid columns [first, first + n)
    column = np.arange(passage)
    owns = (column >= first[:, None]) & (column < (first + rec["n"])[:, None])
    start = rec["c"].astype(np.int64) - (passage - 1)  # place of grid column 0 in the document

    def apart(row: np.ndarray, col: np.ndarray, of: np.ndarray, of_col: np.ndarray) -> np.ndarray:
        """In one document runs that overlap share the text itself and do not count."""
        one = (rec["doc"][row] == rec["doc"][of]) & (rec["h"][row] == rec["h"][of])
        return ~one | (np.abs(start[row] + col - start[of] - of_col) >= passage)

    # Equal runs: all but the first repeat it
    sums = np.zeros((len(rec), 2 * passage), _U)
    np.cumsum(grid, axis=1, out=sums[:, 1:])
    row, col = np.nonzero(owns)
    whole = (sums[:, passage:] - sums[:, :passage] + salt[:, None])[row, col]
    _, lead, which = grouped(whole)
    of, of_col = row[lead][which], col[lead][which]
    again = (of != row) & apart(row, col, of, of_col)
    leads = np.zeros(owns.shape, bool)
    leads[row[lead], col[lead]] = True
    del sums, whole
    out = [_runs_of(row[again], col[again], col[again] + 1, of[again], passage)]

    # Only runs with enough shingles that others of the key have can be similar to one of them
    mark = mixed(grid + salt[:, None])
    good = grid != 0
    for _ in range(2):
        good = _repeated_cells(good, mark)
        bad = np.zeros((len(rec), 2 * passage), np.int8)
        np.cumsum(~good, axis=1, out=bad[:, 1:])
        leads &= bad[:, passage:] - bad[:, :passage] <= passage - need
        edge = np.zeros((len(rec), 2 * passage), np.int8)
        edge[:, :passage] += leads
        edge[:, passage:] -= leads
        good &= np.cumsum(edge[:, :-1], axis=1) > 0
    parts = _Parts(grid, mark, salt, leads, good, passage, need)
    del mark, bad, edge, good
    for at, gap, of, of_gap in _shared_parts(parts):
        width = grid.shape[1]
        (row, k), (of, of_k) = np.divmod(at, width), np.divmod(of, width)
        # The runs that hold the part, as far as the window has them
        lo = np.maximum(k - (passage - need - gap), first[row])
        hi = np.minimum(k + 1, first[row] + rec["n"][row])
        of_lo = np.maximum(of_k - (passage - need - of_gap), first[of])
        ok = (row != of) & (lo < hi) & apart(row, lo, of, of_lo)
        row, lo, hi, of, of_lo = (x[ok] for x in (row, lo, hi, of, of_lo))
        # Verification: one pair of runs of each pair of windows is counted
        pair, one, which = grouped(row * len(rec) + of)
        true = np.zeros(len(pair), bool)
        for x in range(0, len(pair), 4096):
            i = one[x : x + 4096]
            mine, other = (grid[r[:, None], c[:, None] + column] for r, c in ((row[i], lo[i]), (of[i], of_lo[i])))
            true[x : x + 4096] = common_shingles(mine, other) >= need
        ok = true[which]
        out.append(_runs_of(row[ok], lo[ok], hi[ok], of[ok], passage))
    found = tuple(np.concatenate(x) for x in zip(*out))
    return (found[0], found[1] - first[found[0]], found[2], found[3]) if len(found[0]) else none


def _runs_of(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, of: np.ndarray, passage: int) -> tuple[np.ndarray, ...]:
    """(row, first run, runs, of): the runs [lo, hi) of each pair of windows put together."""
    if not len(row):
        return (np.zeros(0, np.int64),) * 4
    every = int(of.max()) + 1
    pair, _, which = grouped(row * every + of)
    parts = []
    for at in range(0, len(pair), 1 << 15):
        n = min(1 << 15, len(pair) - at)
        mine = (which >= at) & (which < at + n) if len(pair) > n else slice(None)
        edge = np.zeros(n * (passage + 2), np.int32)
        base = (which[mine] - at) * (passage + 2)
        np.add.at(edge, base + lo[mine] + 1, 1)
        np.add.at(edge, base + hi[mine] + 1, -1)
        on = (np.cumsum(edge.reshape(n, -1), axis=1, dtype=np.int32) > 0).astype(np.int8)
        step = np.diff(on, axis=1)
        who, begin = np.nonzero(step == 1)
        stop = np.nonzero(step == -1)[1]
        parts.append((pair[who + at] // every, begin, stop - begin, pair[who + at] % every))
    return tuple(np.concatenate(x) for x in zip(*parts))


def repeated_runs(docs: DataFrame, passage: int = PASSAGE, hashes: int = HASHES, enough: int = ENOUGH, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc, h, start, n, of): runs of ``passage`` shingles from start, n of them, that repeat document ``of``; docs is (doc, h, text)."""
    parts = shuffle_partitions(docs.sparkSession)
    buckets = bucket_count(docs, "text")

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size, zip_ = _WordHash(), [], 0, zstandard.ZstdCompressor(level=1)

        def reduced() -> Iterator[pa.RecordBatch]:
            first, more, of = split_classes(np.concatenate(held))
            bucket = lambda x: (x["key"] >> _U(20)).astype(np.int64) % buckets
            rows = [(b, k, zip_.compress(by_columns(np.frombuffer(d, (WINDOW, REPEAT)[k])))) for b, k, d in (*_dealt(0, bucket(first), first), *_dealt(1, bucket(more), _repeats(more, of)))]
            for lo in range(0, len(rows), 64):
                yield _blobs(rows[lo : lo + 64])

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                s, ends, _ = shingles(raw_texts(part, "text"), cache)
                held.append(compact_windows(s, ends, part.column("doc").to_numpy(), part.column("h").to_numpy().astype(np.uint32), passage, hashes))
                size += part.column("text").nbytes
                if size >= REDUCE_BYTES:
                    yield from reduced()
                    held, size = [], 0
        if held:
            yield from reduced()

    def classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for held in _by_bucket(batches):
            for d in held.get(1, []):
                yield _row_batch(of_columns(unzip.decompress(d), REPEAT))
            first, more, of = split_classes(np.concatenate([of_columns(unzip.decompress(d), WINDOW) for d in held.get(0, [])] or [np.zeros(0, WINDOW)]))
            yield _row_batch(_repeats(more, of))
            same = first["key"][1:] == first["key"][:-1]
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(first) else np.zeros(0, bool)
            yield _flag_batch(first[shared])

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Join the flagged windows of each document and ship the words of those that stay, packed by bucket."""
        recs: list[np.ndarray] = []
        said: list[bytes] = []
        size, zip_ = 0, zstandard.ZstdCompressor(level=1)

        def out() -> pa.RecordBatch:
            rec = np.concatenate(recs)
            bucket = (rec["key"] >> _U(20)).astype(np.int64) % buckets
            order = np.lexsort((rec["key"], bucket))
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = []
            for lo, hi in zip(cut, np.append(cut[1:], len(order))):
                i = order[lo:hi]
                rows.append((int(bucket[i[0]]), len(i), zip_.compress(rec[i].tobytes() + b"".join([said[k] for k in i]))))
            return _blobs(rows)

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                flags = part.column("flags")
                offsets = flags.offsets.to_numpy()
                f = flags.flatten()
                start, n, back, key = (f.field(k).to_numpy() for k in ("start", "n", "back", "key"))
                docs_, h = part.column("doc").to_numpy(), part.column("h").to_numpy()
                flat, begins, counts = split_words(raw_texts(part, "text"))
                flat, base = flat.tobytes(), np.cumsum(counts) - counts
                for i in range(part.num_rows):
                    a, b = offsets[i] - offsets[0], offsets[i + 1] - offsets[0]
                    fn = (key[a:b].view(_U) & _U(7)).astype(np.int64)
                    stay = np.flatnonzero(joined_intervals(start[a:b], n[a:b].astype(np.int64), fn, hashes, enough)) + a
                    if not len(stay):
                        continue
                    rec = np.zeros(len(stay), WINDOW)
                    rec["key"], rec["doc"], rec["h"] = key[stay].view(_U), docs_[i], h[i]
                    rec["c"], rec["back"], rec["n"] = start[stay] + back[stay], back[stay], n[stay]
                    recs.append(rec)
                    x = base[i] + start[stay]
                    new = [flat[lo:hi] for lo, hi in zip(begins[x].tolist(), begins[x + n[stay] + passage + SHINGLE - 2].tolist())]
                    said += new
                    size += sum(map(len, new))
                if size >= 16 << 20:
                    yield out()
                    recs, said, size = [], [], 0
        if recs:
            yield out()

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, unzip = _WordHash(), zstandard.ZstdDecompressor()

        def hashed(said: list[bytes]) -> np.ndarray:
            flat = np.frombuffer(b"".join(said), np.uint8)
            return word_hashes(flat, np.concatenate(([0], np.flatnonzero(flat == 32) + 1)), cache)

        for held in _by_bucket(batches):
            recs, data, said, size = [], [], [], 0
            for count, blobs in held.items():
                for d in map(unzip.decompress, blobs):
                    recs.append(np.frombuffer(d, WINDOW, count))
                    said.append(d[count * WINDOW.itemsize :])
                    size += len(said[-1])
                    if size >= 4 << 20:
                        data.append(hashed(said))
                        said, size = [], 0
            data.append(hashed(said))
            rec = np.concatenate(recs)
            n = rec["n"].astype(np.int64) + passage - 1
            s = shingles_of(np.concatenate(data), n + SHINGLE - 1)[0]
            del data, said
            begin = np.cumsum(n) - n
            order = np.lexsort((rec["c"], rec["h"], rec["doc"], rec["key"]))
            fresh = ~repeats_row_before(rec[order])
            order = order[fresh]
            rec, begin, n = rec[order], begin[order], n[order]
            # Whole keys, about VERIFY_ROWS windows at a time
            starts = np.flatnonzero(np.concatenate(([True], rec["key"][1:] != rec["key"][:-1])))
            stops = np.append(starts[1:], len(rec))
            alone = stops - starts < 2
            starts, stops = starts[~alone], stops[~alone]
            total = np.cumsum(stops - starts)
            k = 0
            while k < len(starts):
                until = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + VERIFY_ROWS, "right")))
                i = ranges(starts[k:until], (stops - starts)[k:until])
                k = until
                r = rec[i]
                grid = np.zeros((len(i), 2 * passage - 1), _U)
                row = np.repeat(np.arange(len(i)), n[i])
                grid[row, ranges(passage - 1 - r["back"].astype(np.int64), n[i])] = s[ranges(begin[i], n[i])]
                m, at, count, lead = verify_groups(r, grid, passage, similarity)
                x = r[m]
                cols = [x["doc"], x["h"].astype(np.int64), x["c"].astype(np.int64) - x["back"] + at, count.astype(np.int32), r["doc"][lead]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES[:5])

    dealt = docs.mapInArrow(windows, "bucket int, kind int, data binary")
    found = staged(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(classes, _ROW), "passage-windows")
    flagged = found.where("key is not null").groupBy("doc", "h").agg(F.collect_list(F.struct("start", "n", "back", "key")).alias("flags"))
    shipped = docs.join(flagged, ["doc", "h"]).select("doc", "h", "text", "flags").mapInArrow(candidates, "bucket int, kind int, data binary")
    more = shipped.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(verified, "doc long, h long, start long, n int, of long")
    return found.where("key is null").select("doc", "h", "start", "n", "of").unionByName(more)


def merged_cuts(cuts: pa.ListArray, longer: int) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """(maximal spans, units in them, number of them) of each list of (start, n), where a cut is [start, start + n + longer)."""
    own = np.repeat(np.arange(len(cuts)), np.diff(cuts.offsets.to_numpy()))
    start, n = (cuts.flatten().field(k).to_numpy().astype(np.int64) for k in ("start", "n"))
    order = np.lexsort((start, own))
    own, start, end = own[order], start[order], (start + n + longer)[order]
    base = own * (int(end.max(initial=0)) + 2)  # lists do not touch
    reach = np.maximum.accumulate(end + base)
    new = np.concatenate(([True], (start + base)[1:] > reach[:-1]))[: len(own)]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(own))[: len(head)] - 1
    start, end, n_spans = start[head], (reach - base)[last], np.bincount(own[head], minlength=len(cuts))
    offsets = np.concatenate(([0], np.cumsum(n_spans)))
    words = np.concatenate(([0], np.cumsum(end - start)))
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), np.diff(words[offsets]), n_spans


def near_duplicate_passages(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    passage: int = PASSAGE,
    hashes: int = HASHES,
    enough: int = ENOUGH,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, class_id, n_links, repeats_ids, n_words, n_repeated_words, n_spans, spans) of every row.

    ``spans`` are maximal runs of words that near-duplicate an earlier passage; ``repeats_ids`` are the
    documents they repeat (of each group those that were needed); ``n_links`` counts other documents linked either way.
    """
    if not 1 <= hashes <= 8 or not SHINGLE <= passage <= 120:
        raise ValueError("hashes must be 1 to 8, passage 5 to 120")
    docs = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    runs = repeated_runs(docs, passage, hashes, enough, similarity)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, words, n_spans = merged_cuts(batch.column("cuts"), passage + SHINGLE - 2)
            cols = [*map(batch.column, ("doc", "h", "repeats_ids")), pa.array(words, pa.int64()), pa.array(n_spans, pa.int64()), spans]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "h", "repeats_ids", "n_repeated_words", "n_spans", "spans"])

    grouped = runs.groupBy("doc", "h").agg(F.collect_set(F.struct("start", "n")).alias("cuts"), F.array_sort(F.collect_set("of")).alias("repeats_ids"))
    per_doc = staged(
        grouped.mapInArrow(merged, "doc long, h long, repeats_ids array<long>, n_repeated_words long, n_spans long, spans array<struct<start:long,end:long>>"),
        "passage-spans",
    )
    links = per_doc.select("doc", F.explode("repeats_ids").alias("of")).where(f"doc != of and doc != {NO_ID} and of != {NO_ID}").distinct()
    links = staged(links, "passage-links")
    comps = connected_components(links, "doc", "of")
    either = links.select("doc").union(links.select("of")).groupBy("doc").agg(F.count("*").alias("n_links"))
    narrow = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"),
        F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long").alias("n_words"),
    )
    out = (
        narrow.join(per_doc, ["doc", "h"], "left")
        .join(comps.withColumnRenamed("node", "doc"), "doc", "left")
        .join(either, "doc", "left")
    )
    real = F.when(F.col("doc") != NO_ID, F.col("doc"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        real.alias(id_col),
        F.coalesce("component", real).alias("class_id"),
        zero("n_links"),
        F.coalesce("repeats_ids", F.array().cast("array<long>")).alias("repeats_ids"),
        "n_words",
        zero("n_repeated_words"),
        zero("n_spans"),
        F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
    )
