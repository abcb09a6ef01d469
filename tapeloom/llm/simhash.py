"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits; fingerprints within ``2`` bits are linked.  Take the
first and the last 31 bits apart: of two linked fingerprints at least one half
differs in one bit at most.  The anchors of a half are the words of the perfect
Hamming code of length 31, whose covering radius is 1: every half lies within
1 of an anchor, and a half that differs from it in one more bit lies within
1 + 1 of the same anchor.  So each distinct fingerprint is copied to every
anchor within radius plus threshold (16 of 2**26 anchors a half, 1 if it is an anchor
itself) and compared there.  Nothing is lost and no bucket is capped.

Equal fingerprints are one class before any copying.  At an anchor, members are
compared in blocks and only one link of each to the smallest it reaches there
leaves the task, so large groups of near copies do not give all pairs.  Links of classes are joined
to components by ``connected_components``.

Nulls and texts without words have fingerprint zero and are linked like any
other; texts of one or two words are one shingle.  A row with a null doc_id joins its
component but never names it; a component without any id is null.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.components import connected_components
from tapeloom.llm.util import raw_texts, slices, staged

SEED = 42
THRESHOLD = 2
HALF = 31
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Members of one anchor beyond which links are followed breadth-first.
SMALL = 24
#: Ids from here on stand for classes without an id.
NO_ID = 1 << 62


def shingle_hashes(text: bytes | None, width: int = 3, seed: int = SEED) -> list[int]:
    """XXH64 of each word shingle of the text, A-Z lower-cased, repeats included."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(b" ".join(words), seed)]
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    return [h(flat[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprints(texts: list[bytes | None], width: int = 3, seed: int = SEED) -> np.ndarray:
    """One uint64 per text: a bit is 1 if it is set in over half the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, width, seed), "<u8")
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 4096):
            part = hashes[at : at + 4096]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if len(hashes):
            out[i] = weights[2 * ones > len(hashes)].sum(dtype=np.uint64)
    return out


#: Bits of a wide fingerprint, words of 64.
WIDE_WORDS = 8
#: Odd multiples of the golden ratio's 64 bits: one multiplier a word.
_SPREAD = np.arange(1, 2 * WIDE_WORDS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprints(texts: list[bytes | None], width: int = 5, seed: int = SEED) -> np.ndarray:
    """512 bits per text as eight uint64, by majority over the shingle hashes, each spread to eight words."""
    out = np.zeros((len(texts), WIDE_WORDS), np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, width, seed), np.uint64)
        ones = np.zeros(64 * WIDE_WORDS, np.int64)
        for at in range(0, len(hashes), 2048):
            x = hashes[at : at + 2048, None] * _SPREAD
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if len(hashes):
            out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)
    return out


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = SEED) -> DataFrame:
    """(doc, fp): the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 4 << 20):
                fp = fingerprints(raw_texts(part, "t"), width, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(fp)], names=["doc", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("t")).mapInArrow(run, "doc long, fp long")


def _masks() -> np.ndarray:
    """For each syndrome, the 16 bit masks that lead to the anchors within 2; syndrome 0 leads to itself only."""
    table = np.zeros((32, 16), np.int64)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        table[s] = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs]
    return table


MASKS = _masks()


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all Hamming code words within 2 bits of each 31-bit value."""
    s = np.zeros(len(half), np.int64)
    for b in range(HALF):
        s ^= ((half >> b) & 1) * (b + 1)
    count = np.where(s > 0, 16, 1)
    rows = np.repeat(np.arange(len(half)), count)
    table = half[:, None] ^ MASKS[s]
    return rows, table[np.arange(16)[None, :] < count[:, None]]


def _replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, reps = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
        for at in range(0, len(fps), 8192):
            fp, rep = fps[at : at + 8192], reps[at : at + 8192]
            for side, half in enumerate(((fp >> 33) & 0x7FFFFFFF, fp & 0x7FFFFFFF)):
                rows, anchor = anchors(half)
                yield pa.RecordBatch.from_arrays([pa.array(anchor | (side << HALF)), pa.array(fp[rows]), pa.array(rep[rows])], names=["anchor", "fp", "rep"])


def near(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether fingerprints, of one word or of several in a row, differ in ``threshold`` bits at most."""
    bits = np.bitwise_count((a ^ b).view(np.uint64))
    return (bits if a.ndim < 2 else bits.sum(axis=1, dtype=np.int64)) <= threshold


def _stars(fp: np.ndarray, rep: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """(first, other) of the groups among many members that links join: breadth-first, each step one vector comparison."""
    left = np.arange(len(fp))
    a: list[int] = []
    b: list[int] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        root = int(rep[queue[0]])
        while queue and len(left):
            x = queue.pop()
            hit = near(fp[left], fp[x : x + 1] if fp.ndim > 1 else fp[x], threshold)
            found = left[hit]
            left = left[~hit]
            a += [root] * len(found)
            b += rep[found].tolist()
            queue += found.tolist()
    return a, b


def _smallest_reached(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest that the links (x, y) reach, in vector steps."""
    lab = np.arange(n)
    while len(x):
        new = lab.copy()
        low = np.minimum(lab[x], lab[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def links_of_groups(anchor: np.ndarray, fp: np.ndarray, rep: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the members of each anchor to the smallest they reach there; rows come sorted by anchor and rep."""
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(start, len(anchor)))
    small = np.repeat((size > 1) & (size <= SMALL), size)
    x = np.flatnonzero(small)
    one, two = [x[:0]], [x[:0]]
    for o in range(1, SMALL):
        x = x[x + o < len(anchor)]
        x = x[anchor[x] == anchor[x + o]]
        if not len(x):
            break
        hit = x[near(fp[x], fp[x + o], threshold)]
        one.append(hit)
        two.append(hit + o)
    lab = _smallest_reached(len(anchor), np.concatenate(one), np.concatenate(two))
    moved = np.flatnonzero(lab != np.arange(len(anchor)))
    a, b = [rep[lab[moved]]], [rep[moved]]
    for s, n in zip(start[size > SMALL], size[size > SMALL]):
        p, q = _stars(fp[s : s + n], rep[s : s + n], threshold)
        a.append(np.array(p, np.int64))
        b.append(np.array(q, np.int64))
    return np.concatenate(a), np.concatenate(b)


def _compare(threshold: int, fps: tuple[str, ...] = ("fp",)):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and rep; the last anchor of a batch is carried to the next."""
        held: list[list[np.ndarray]] = []

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links_of_groups(*cols, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            words = [batch.column(c).to_numpy() for c in fps]
            cols = [batch.column("anchor").to_numpy(), words[0] if len(words) == 1 else np.column_stack(words), batch.column("rep").to_numpy()]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut or (held and held[-1][0][-1] != cols[0][0]):
                yield out([np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols])])
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield out([np.concatenate(x) for x in zip(*held)])

    return run


def _joined(copies: DataFrame, threshold: int, fps: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(node, component) over the copies at all anchors.

    A node has one link to a smaller one an anchor at most, so the window holds a few dozen rows: it leaves each node its
    smallest neighbour and ties the other neighbours, which many nodes share, to that one.
    """
    links = copies.repartition("anchor").sortWithinPartitions("anchor", "rep").mapInArrow(_compare(threshold, fps), "a long, b long")
    links = links.distinct().withColumn("low", F.min("a").over(Window.partitionBy("b")))
    return connected_components(links.select(F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b")))


def near_components(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc, fp, component): ``fps`` is (doc, fp); component is the smallest doc reachable over links."""
    if threshold > THRESHOLD:
        raise ValueError("two halves and a radius-1 code cover two differing bits at most")
    fps = staged(fps, "fingerprints")
    # A class without any id takes part under a placeholder above all real ids.
    stand_in = F.xxhash64("fp").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    classes = staged(fps.groupBy("fp").agg(F.min("doc").alias("rep")).select("fp", F.coalesce("rep", stand_in).alias("rep")), "classes")
    copies = classes.select("fp", "rep").mapInArrow(_replicate, "anchor long, fp long, rep long")
    comps = _joined(copies, threshold)
    label = classes.join(comps, classes.rep == comps.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    # A hot fingerprint makes one large join key; adaptive execution can split this join.
    return fps.join(label, "fp").select("doc", "fp", F.when(F.col("component") < NO_ID, F.col("component")).alias("component"))


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row."""
    out = near_components(with_fingerprints(df, id_col, text, width), threshold)
    return out.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# -- copies of a given similarity ----------------------------------------------------------------

WORDS = tuple(f"f{k}" for k in range(WIDE_WORDS))
#: Pieces that are drawn from a wide fingerprint: two blocks of 15 bits each, the length of a perfect Hamming code.
PIECES, BLOCK = 96, 15
_DRAWN = np.random.Generator(np.random.PCG64(5_031)).permuted(np.tile(np.arange(64 * WIDE_WORDS), (PIECES, 1)), axis=1)[:, : 2 * BLOCK]


def differing_bits(similarity: float, bits: int = 64 * WIDE_WORDS) -> int:
    """Bits in which five of six pairs of texts of this Jaccard similarity differ at most.

    A bit differs with the angle between the shingle vectors; one standard deviation is added to the mean.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + np.sqrt(bits * p * (1 - p)))


def nearest_anchors(piece: np.ndarray) -> np.ndarray:
    """Both blocks of each piece moved to the one Hamming code word within 1 bit."""
    for at in (0, BLOCK):
        s = np.zeros(piece.shape, np.int64)
        for b in range(BLOCK):
            s ^= ((piece >> (at + b)) & 1) * (b + 1)
        piece = piece ^ np.where(s > 0, np.int64(1) << np.maximum(at + s - 1, 0), 0)
    return piece


def _to_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = np.int64(1) << np.arange(2 * BLOCK, dtype=np.int64)
    for batch in batches:
        words, rep = np.column_stack([batch.column(c).to_numpy() for c in WORDS]), batch.column("rep").to_numpy()
        for at in range(0, len(rep), 2048):
            w, r = words[at : at + 2048], rep[at : at + 2048]
            bits = np.unpackbits(np.ascontiguousarray(w).view(np.uint8), axis=1, bitorder="little")
            for lo in range(0, PIECES, 8):
                some = np.arange(lo, lo + 8)
                anchor = nearest_anchors(bits[:, _DRAWN[some]] @ weights) | (some << 2 * BLOCK)
                row = np.repeat(np.arange(len(r)), len(some))
                cols = [anchor.ravel(), *(w[row, k] for k in range(WIDE_WORDS)), r[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", *WORDS, "rep"])


def one_of_each_group(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of copies, whatever the columns of ``df``: that with the smallest id, then text hash; rows without an id last.

    Rows are linked if their fingerprints of 512 bits over ``width``-word shingles differ in no more bits than five of six pairs of the
    given similarity do; some pairs a little below it are linked too (README).  Two bits cannot cover that, so anchors are taken more often: of ``PIECES`` drawings of 30 bits
    each goes to its nearest anchor, a pair of Hamming code words (radius 1 in either block); members of an anchor are compared in all 512 bits.
    Equal texts always meet; others meet in one of the pieces with a chance that grows with their similarity (README).
    Groups are all that links reach.  Nulls and texts without words are copies of each other; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 4 << 20):
                fp = wide_fingerprints(raw_texts(part, "t"), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("h"), *(pa.array(fp[:, k].copy()) for k in range(WIDE_WORDS))], names=["i", "h", *WORDS])

    keyed = df.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("t"))
    words = ", ".join(f"{w} long" for w in WORDS)
    fps = keyed.select("i", "h", "t").mapInArrow(run, T.StructType([keyed.schema["i"], keyed.schema["h"]] + T.StructType.fromDDL(words).fields))
    texts = fps.groupBy(*WORDS, "i", "h").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("i").isNull().alias("last"), "i", "h", "n")).alias("best")
    classes = staged(texts.groupBy(*WORDS).agg(best).withColumn("rep", F.monotonically_increasing_id()), "classes")
    copies = classes.select(*WORDS, "rep").mapInArrow(_to_pieces, f"anchor long, {words}, rep long")
    comps = _joined(copies, differing_bits(similarity), WORDS)
    group = classes.join(comps, classes.rep == comps.node, "left").groupBy(F.coalesce("component", "rep").alias("group"))
    winners = staged(group.agg(F.min("best").alias("best")).select("best.i", "best.h", "best.n"), "winners")
    chosen = lambda w: keyed.alias("d").join(w.alias("w"), F.col("d.i").eqNullSafe(F.col("w.i")) & (F.col("d.h") == F.col("w.h")), "left_semi")
    out = chosen(winners.where("n = 1")).select("row.*")
    if winners.where("n > 1").limit(1).count():  # rows equal in id and text: any of them stands for all
        out = out.unionByName(chosen(winners.where("n > 1")).dropDuplicates(["i", "h"]).select("row.*"))
    return out
