"""Driver-side file access through Hadoop's file systems, so any path Spark reads can be probed."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tapeloom.errors import FeedError


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


_own_dirs: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; on one machine a temporary folder serves."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise FeedError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_dirs.get(sc.applicationId) or _own_dirs.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="tapeloom-"))
    return f"{root.rstrip('/')}/tapeloom/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def size_of(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FeedError(f"{path} does not exist")
    return fs.getFileStatus(p).getLen()


def expand(spark: SparkSession, path: str) -> list[str]:
    """The files a path or glob names, in name order."""
    fs, p = _fs(spark, path)
    found = fs.globStatus(p)
    names = sorted(s.getPath().toString() for s in found or [] if not s.isDirectory())
    if not names:
        raise FeedError(f"{path}: no such file")
    return names


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first ``n`` bytes, inflated where the name ends in .gz."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FeedError(f"{path} does not exist")
    stream = fs.open(p)
    try:
        if path.lower().endswith(".gz"):
            stream = spark._jvm.java.util.zip.GZIPInputStream(stream)
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return read_head(spark, path, min(size_of(spark, path), 1 << 30)).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


@dataclass(frozen=True)
class Trigger:
    """What a ``.trg`` sidecar says of its data file.  The digest is kept, not checked."""

    md5: str | None
    size: int | None


def read_trigger(spark: SparkSession, path: str) -> Trigger | None:
    side = f"{path}.trg"
    if not exists(spark, side):
        return None
    md5 = size = None
    for token in read_text(spark, side).split():
        if len(token) == 32 and all(c in "0123456789abcdefABCDEF" for c in token):
            md5 = token.lower()
        elif token.isdigit():
            size = int(token)
    return Trigger(md5, size)


def check_trigger(spark: SparkSession, path: str) -> Trigger | None:
    """Refuse a data file whose size differs from its sidecar's."""
    found = read_trigger(spark, path)
    if found and found.size is not None and (actual := size_of(spark, path)) != found.size:
        raise FeedError(f"{path} has {actual} bytes, its .trg file says {found.size}: the download is incomplete or damaged")
    return found
