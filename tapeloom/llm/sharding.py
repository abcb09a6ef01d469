"""Sharding by sampled splitters: near equal bytes in every shard.

1. Draw a size-weighted sample of composite keys (text hash, doc_id): a row is
   drawn when its hash-uniform number is below ``size * sample / total``, so the
   sample is reproducible and about ``sample`` rows long at any input size.
2. Every ``sample / ranges``-th key of the sorted sample is a splitter; ranges hold near equal bytes.
   The second key part subdivides a range that one hot text would overfill.  Ranges that hold over twice their
   share all the same are subdivided by a sample of their own, until none is left that can be.
3. Inside each range a running sum of bytes in key order, plus the exact bytes
   of the ranges before it, gives each row its place in the whole order; shard
   borders are cut at equal shares of the total, so shards differ by about one
   document however the sample fell.

Equal texts have one key (of the text's MD5) and so lie side by side.  A group of them that holds at most
``1 / WHOLE_GROUP`` of a shard goes whole to the shard in which it starts, and no splitter falls inside it; so
shards are off by such a group at most.  A larger group is cut at the border like other rows.  Rows equal in text and id are counted and placed as one, however
many they are, and take their places one after another.  Only narrow rows (key, id, size) are sorted and
shuffled.  DataFrame functions only.

Nulls: a null text has no bytes and CRC 0; a null doc_id sorts first.  Rows
equal in text and id are interchangeable; each gets its own slot.  An empty
table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.util import hash_key, shuffle_partitions, staged

#: Fixed part of a record's size, for its id.
ID_BYTES = 8
#: Groups of equal texts up to this part of a shard's bytes are kept whole.
WHOLE_GROUP = 50
#: Splitters' ids that come before every row of their key.
FIRST_ID = -(2**63)
#: Times that overfull ranges are subdivided at most.
SUBDIVISIONS = 4


def _last_splitter(keys: list[int], ids: list[int]) -> Column:
    """Number of splitters (key, id) that are not above the row's: a binary search in a foldable array."""
    if not keys:
        return F.lit(0)
    steps, s = [], 1 << (len(keys).bit_length() - 1)
    while s:
        steps.append(s)
        s >>= 1
    k = f"from_json('{json.dumps(keys)}', 'array<bigint>')"
    d = f"from_json('{json.dumps(ids)}', 'array<bigint>')"
    return F.expr(
        f"""
        aggregate(array({", ".join(map(str, steps))}), 0, (lo, s) ->
          if(lo + s <= {len(keys)}
             and (get({k}, lo + s - 1) < _key or (get({k}, lo + s - 1) = _key and get({d}, lo + s - 1) <= _id)),
             lo + s, lo))
        """
    )


def assign_shards(
    df: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text: str = "text",
    ranges: int | None = None,
    oversample: int = 32,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; shards hold near equal bytes, slots are gapless from 0.

    ``ranges`` is the number of sorted pieces (default: four per shard or the session's shuffle
    partitions, whichever is more); the sample holds about ``ranges * oversample`` keys, at most twice that.
    """
    spark = df.sparkSession
    ranges = ranges or max(4 * n_shards, shuffle_partitions(spark))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).cast("long").alias("_doc"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("_id"),
        hash_key(F.coalesce(F.col(text), F.lit(""))).alias("_key"),
        (F.octet_length(raw) + ID_BYTES).cast("long").alias("_one"),
        F.crc32(raw).alias("_crc"),
    )
    counted = rows.groupBy("_doc", "_id", "_key", "_one", "_crc").agg(F.count("*").alias("_rows"))
    narrow = staged(counted.withColumn("_size", F.col("_one") * F.col("_rows")), "shard-keys")
    total = narrow.agg(F.sum("_size")).first()[0] or 0
    m = ranges * oversample

    def drawn(rows: DataFrame, size: int, count: int, turn: int) -> list[tuple[int, int]]:
        """About ``count`` keys by size: 53 random bits in [0, 1); rows over size / count are always drawn, and there are at most ``count`` of those."""
        u = F.shiftrightunsigned(F.xxhash64(F.lit(f"draw {turn}"), "_key", "_id"), 11) / F.lit(float(1 << 53))
        return sorted((r[0], r[1]) for r in rows.where(u * size < F.col("_size").cast("double") * count).select("_key", "_id").distinct().collect())

    small = total / (n_shards * WHOLE_GROUP)

    def at_edges(found: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """Splitters, those inside a small group of equal texts moved to its edge; one row a key comes back."""
        held = narrow.where(F.col("_key").isin(sorted({k for k, _ in found}))).groupBy("_key").agg(F.sum("_size").alias("s")) if found else None
        over_small = {r["_key"] for r in held.where(F.col("s") > small).collect()} if found else set()
        large.update(over_small)
        return {(k, i if k in over_small else FIRST_ID) for k, i in found}

    large: set[int] = set()
    keys = drawn(narrow, total, m, 0)
    cuts = sorted(at_edges(set(keys[max(1, len(keys) // ranges) :: max(1, len(keys) // ranges)])))
    place = lambda: _last_splitter([k for k, _ in cuts], [i for _, i in cuts])
    for turn in range(1, SUBDIVISIONS + 1):
        # At most len(cuts) + 1 rows
        held = narrow.withColumn("_range", place()).groupBy("_range").agg(F.sum("_size").alias("s"), F.count("*").alias("n")).collect()
        over = {r["_range"]: r["s"] for r in held if r["n"] > 1 and r["s"] > 2 * total / ranges}
        if not over:
            break
        size = sum(over.values())
        parts = max(2, -(-size * ranges // max(total, 1)))
        inside = narrow.withColumn("_range", place()).where(F.col("_range").isin(list(over)))
        found = drawn(inside, size, parts * oversample, turn)
        step = max(1, len(found) // parts)
        new = at_edges(set(found[step::step])) - set(cuts)
        if not new:
            break
        cuts = sorted({*cuts, *new})
    ranges = max(ranges, len(cuts) + 1)
    ranged = narrow.withColumn("_range", place())
    ranged = ranged.repartition(max(ranges, shuffle_partitions(spark)), "_range")

    # Range totals: one row per range, so at most ranges + 1 rows; their running sum is a small ordered window.
    sums = narrow.withColumn("_range", place())
    sums = sums.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    in_order = Window.partitionBy("_range").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    # A group in several ranges has a splitter, and its key is in ``large``; all others can be summed inside their range.
    in_group = Window.partitionBy("_range", "_key")
    placed = (
        ranged.withColumn("_in", F.coalesce(F.sum("_size").over(in_order), F.lit(0)))
        .withColumn("_group", F.sum("_size").over(in_group))
        .withColumn("_first", F.min("_in").over(in_group))
        .join(F.broadcast(offsets), "_range")  # at most ranges + 1 rows
        .withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)))
        .withColumn("_start", F.col("_before") + F.col("_in") + F.col("_row") * F.col("_one"))
        .withColumn("_border", F.when((F.col("_group") <= small) & ~F.col("_key").isin(sorted(large)), F.col("_before") + F.col("_first")).otherwise(F.col("_start")))
        .withColumn("shard", F.least(F.expr(f"_border * {n_shards}L div {max(total, 1)}L"), F.lit(n_shards - 1)).cast("int"))
    )
    placed = staged(placed.select("_range", "_doc", F.col("_one").alias("_size"), "_crc", "_start", "shard"), "shard-places")
    # A range meets few shards; (range, shard) pairs number at most ranges + shards.
    pieces = placed.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = pieces.select("shard", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    rank = Window.partitionBy("_range", "shard").orderBy("_start")
    return (
        placed.withColumn("_rank", F.row_number().over(rank))
        .join(F.broadcast(first), ["_range", "shard"])  # at most ranges + shards rows
        .select(
            F.col("_doc").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            "shard",
            (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"),
        )
    )
