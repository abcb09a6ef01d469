"""Mixing sources to target weights.

Every row gets a hash-random key (MD5) of its id and text; within its source, rows are ordered by that
key.  Rows equal in source, id and text are counted first and go as one.  The key's leading bits name a cell, so a
source of any size is sorted in many tasks, the more the more rows there are; the running sum inside a cell plus
the totals of the cells before it is the row's prefix sum of tokens.  Whole epochs are taken from every row,
then the order is cut at the source's exact budget: the row on the cut gives
just the words that are missing.

Targets: ``share`` of all sizes is dealt by weight; a target stops at
``max_epochs`` times the source's size and what is over goes to the others by
weight, until none is above (a water level; found by window sums over one row
per source).  DataFrame functions only; the same input gives the same mix.

Nulls: a null text has size 0, a null source is a source of its own and comes
last; a null id is hashed as such.  Equal rows are interchangeable: each has its own share, in no given order.  A source
without words has target 0.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.util import KEY_BITS, WORD_GAP, hash_key, staged

#: Cells of a source's order are 2 ** bits: as many bits at least, and so many rows to a cell at most if all were of one source.
CELL_BITS, CELL_ROWS = 10, 50_000


def word_count(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP), "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(_null, _source, source_size, target) from one row per source.

    The sorts here run over one row per source, not over documents.
    """
    by_name = Window.orderBy("_null", "_source")
    w = F.lit(None).cast("double")
    rank = F.row_number().over(by_name) - 1
    ranked = sizes.withColumn("_rank", rank)
    for i, x in enumerate(weights):
        w = F.when(F.col("_rank") % len(weights) == i, F.lit(float(x))).otherwise(w)
    t = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    # With the first k sources (by cap / weight) full, the level is (budget - their caps) / (weights of the rest).
    up = Window.orderBy("_ratio", "_rank")
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    t = t.withColumn(
        "_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))) / F.sum("_w").over(rest)
    )
    # The first source that is not full at its own level sets the level of all.
    t = t.withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(whole))
    level = F.col("_water._level")
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))
    return t.select("_null", "_source", "source_size", target.alias("target"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    cell_bits: int | None = None,
) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row."""
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.col(source).isNull().alias("_null"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        word_count(text).alias("size"),
        hash_key(F.concat_ws("/", F.lit(str(seed)), named, F.coalesce(F.md5(text), F.lit("")))).alias("_key"),
    )
    narrow = staged(rows.groupBy("_null", "_source", "_key", "_id", "size").agg(F.count("*").alias("_rows")), "mix-keys")
    if cell_bits is None:
        cell_bits = max(CELL_BITS, int(narrow.count() // CELL_ROWS).bit_length())
    narrow = narrow.withColumn("_cell", F.shiftright("_key", KEY_BITS - cell_bits).cast("int"))
    words = F.col("size") * F.col("_rows")

    cells = staged(narrow.groupBy("_null", "_source", "_cell").agg(F.sum(words).alias("_sum")), "mix-cells")
    sizes = cells.groupBy("_null", "_source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs)
    before = Window.partitionBy("_null", "_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed_cells = cells.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    plan = placed_cells.join(targets, ["_null", "_source"]).drop("_sum")

    in_cell = Window.partitionBy("_null", "_source", "_cell").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("_before") + F.sum(words).over(in_cell) - words
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start") - F.col("_row") * F.col("size")))
    return (
        narrow.join(plan, ["_null", "_source", "_cell"])
        .withColumn("_start", start)
        .withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)))
        .select(
            F.col("_id").alias(id_col),
            F.when(~F.col("_null"), F.col("_source")).alias(source),
            "size",
            "source_size",
            "target",
            (epochs * F.col("size") + last).cast("long").alias("taken"),
        )
    )


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``df``, whatever their columns, as often as the mix takes them; the one on a source's cut is taken whole.

    Rows equal in id, source and words are taken alike: each as often as the one of them that is taken most.
    """
    plan = mix(df.select(id_col, text, source), id_col, text, source, **options).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    plan = plan.groupBy(F.col(id_col).alias("_id"), F.col(source).alias("_source"), "size").agg(F.max(copies).alias("_copies"))
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), F.col(source).cast("string").alias("_s"), word_count(text).alias("_n"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("size"))
    return rows.join(plan, same).select(F.explode(F.array_repeat("_row", F.col("_copies"))).alias("_row")).select("_row.*")
