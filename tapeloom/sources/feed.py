"""Raw feeds as DataFrames.

The plan is scan -> frame -> filter on raw cells -> decode selected cells, all
built-in expressions.  A gzip file (of any number of members) is one task, as
gzip allows nothing else; many files, and plain files of any size, are many tasks.

Every record has a number, ``seq``: the file's place in name order and the record's place in the file.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tapeloom.errors import FeedError
from tapeloom.plans.predicate import compile_where
from tapeloom.sources import storage
from tapeloom.sources.decode import RAW, cell, decode, projection
from tapeloom.sources.layouts import Layout, Version, require_date, require_layout

PROBE_BYTES = 1025
#: ``seq`` is the file's number shifted by so many bits plus the record's number.
SEQ_FILE_BITS = 40


@dataclass
class Feed:
    """A feed that has been opened: its layout version, files and rows."""

    layout: Layout
    version: Version
    day: date
    files: list[str]
    df: DataFrame
    columns: list[str]
    seen: Observation | None = field(default=None, repr=False)
    kept: Observation | None = field(default=None, repr=False)

    def stats(self) -> dict[str, int]:
        """Counts of an action that has run on ``df``."""
        a, b = self.seen.get, self.kept.get
        return {
            "rows_read": a["lines"] - a["malformed"],
            "rows_emitted": b["emitted"],
            "rows_filtered": a["lines"] - a["malformed"] - b["emitted"],
            "rows_malformed": a["malformed"],
            "bytes_decompressed": a["bytes"] or 0,
        }


def probe_record_length(spark: SparkSession, path: str) -> int:
    """Bytes before the first line feed, which must be among the first 1024."""
    at = storage.read_head(spark, path, PROBE_BYTES).find(b"\n")
    if at < 0:
        raise FeedError(f"{path}: no line feed in the first {PROBE_BYTES - 1} bytes; this is no record file")
    return at


def probe(spark: SparkSession, path: str, layout: str | None = None, day: str | date | None = None) -> dict:
    """Record length of a file and the layout version it selects."""
    found, on = require_layout(path, layout), require_date(path, day)
    observed = probe_record_length(spark, path)
    v = found.resolve(on, observed)
    return {"layout": found.id, "session_date": str(on), "observed_record_length": observed, "spec_version": v.spec_version, "verified": v.verified}


def _lines(spark: SparkSession, path: str, number: int, line_length: int) -> DataFrame:
    """(RAW, seq) of one file.  Blocks of a file are tasks of their own, so a row's number in its block is its number in the task."""
    rows = spark.read.option("lineSep", "\n").text(path)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    start = F.col("_metadata.file_block_start")
    # Records begin at multiples of the line length; the block before also reads the one that begins just at a block's start
    first = F.expr(f"if(_block = 0, 0L, _block div {line_length}L + 1)")
    rows = rows.select(F.col("value").cast("binary").alias(RAW), start.alias("_block"), row.alias("_row"))
    return rows.select(RAW, (F.lit(number << SEQ_FILE_BITS) + first + F.col("_row")).alias("seq"))


def _framed(lines: DataFrame, length: int) -> DataFrame:
    """(RAW, seq, malformed): a line that swallowed delimiters is cut at the record stride again.

    All but the last piece of such a line lack their delimiter and are malformed; so is a line of any other length.
    """
    line = length + 1
    n = F.octet_length(RAW)
    pieces = F.when((n > length) & ((n + 1) % line == 0), F.expr(f"sequence(0, cast((octet_length({RAW}) + 1) div {line} as int) - 1)")).otherwise(F.array(F.lit(0)))
    cut = lines.withColumn("_piece", F.explode(pieces))
    piece = F.expr(f"substring({RAW}, _piece * {line} + 1, {length})")
    last = (n + 1) == (F.col("_piece") + 1) * line
    return cut.select(F.when(n > length, piece).otherwise(F.col(RAW)).alias(RAW), F.col("seq"), (~last).alias("malformed"))


def _refuse_misframed(length: int) -> Column:
    n = F.octet_length(RAW)
    crlf = F.expr(f"endswith(cast({RAW} as string), '\\r')") & (n == length + 1)
    why = F.when(crlf, F.lit("records end in carriage return and line feed; convert the file to line feeds")).otherwise(
        F.concat(F.lit(f"expected records of {length} bytes, found one of "), n.cast("string"))
    )
    return F.when(n == length, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed record: "), why)).cast("boolean"))


def open_feed(
    spark: SparkSession,
    path: str | list[str],
    layout: str | None = None,
    day: str | date | None = None,
    where: str | None = "",
    select: list[str] | None = None,
    strict: bool = True,
    verify_trigger: bool = True,
    max_records: int | None = None,
    compat: bool = True,
    with_seq: bool = False,
    observe: bool = False,
) -> Feed:
    """Open files of one layout and session: check, resolve, compile, and build the plan.  Nothing is read but the first record."""
    given = [path] if isinstance(path, str) else list(path)
    files = [f for p in given for f in storage.expand(spark, p)]
    found, on = require_layout(files[0], layout), require_date(files[0], day)
    observed = {probe_record_length(spark, f) for f in files}
    if len(observed) > 1:
        raise FeedError(f"these files have records of different lengths: {sorted(observed)}")
    version = found.resolve(on, observed.pop())
    length = version.record_length
    if max_records is not None and len(files) > 1:
        raise FeedError("max_records counts records of a single file")
    for f in files:
        if verify_trigger:
            storage.check_trigger(spark, f)
        if not f.lower().endswith(".gz") and (size := storage.size_of(spark, f)) % (length + 1):
            raise FeedError(f"{f}: {size} bytes are no whole number of records of {length + 1}; the file is cut short")
    chosen = projection(version, select)
    condition = compile_where(where, version, on, cell, compat)

    rows = reduce(DataFrame.unionAll, [_lines(spark, f, i, length + 1) for i, f in enumerate(files)])
    if max_records is not None:
        rows = rows.where(F.col("seq") < max_records)
    if strict:
        rows = rows.where(_refuse_misframed(length)).withColumn("malformed", F.lit(False))
    else:
        rows = _framed(rows, length)
    seen = kept = None
    if observe:
        seen = Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if("malformed").alias("malformed"), F.sum(F.lit(length + 1)).cast("bigint").alias("bytes"))
    if not strict:
        rows = rows.where("not malformed")
    if condition is not None:
        rows = rows.where(condition)
    if observe:
        kept = Observation()
        rows = rows.observe(kept, F.count(F.lit(1)).alias("emitted"))
    out = decode(rows, chosen, strict, ["seq"])
    out = out.select(*[f.name for f in chosen], *["seq"] * with_seq)
    return Feed(found, version, on, files, out, [f.name for f in chosen], seen, kept)


def read_feed(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """The decoded rows of a feed; options as for ``open_feed``."""
    return open_feed(spark, path, **options).df


def inspect(spark: SparkSession, path: str, layout: str | None = None, day: str | date | None = None, n: int = 5) -> list[dict]:
    """The first ``n`` records, decoded leniently."""
    rows = read_feed(spark, path, layout=layout, day=day, strict=False, verify_trigger=False, max_records=n)
    return [r.asDict() for r in rows.limit(n).collect()]
