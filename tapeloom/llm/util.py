"""Helpers shared by the training-data operators: the shared folder, staged tables, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace of the word pattern ``[^\x20\x09-\x0D]+``; the same set that ``bytes.split()`` uses.
WORD_GAP = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (local tests) a temporary folder is made, once per application.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = sc.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        sc.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tapeloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def aside(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` with columns that have one of the names called ``<name>_in``, or longer where that is taken too."""
    taken, renamed = {*df.columns, *names}, {}
    for c in df.columns:
        if c in names:
            new = c + "_in"
            while new in taken:
                new += "_in"
            taken.add(new)
            renamed[c] = new
    return df.withColumnsRenamed(renamed) if renamed else df


#: Bits of ``hash_key``.
KEY_BITS = 60


def hash_key(value: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a number: any engine can compute it."""
    return F.conv(F.substring(F.md5(value), 1, KEY_BITS // 4), 16, 10).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Text whose records are dealt to one bucket; a task reads one bucket at a time.
BUCKET_BYTES = 16 << 20


def bucket_count(df: DataFrame, text: str) -> int:
    """Buckets for the records made of a text column: enough that one holds those of about ``BUCKET_BYTES``."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(4 * shuffle_partitions(df.sparkSession), int(total) // BUCKET_BYTES + 1)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with about ``max_bytes`` of ``column`` each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + length)`` of each pair."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
