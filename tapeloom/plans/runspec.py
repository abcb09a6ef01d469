"""JSON run specs: one job, or ``{"defaults": {..}, "jobs": [..]}``.

Unknown keys are errors.  A key that is present wins over the defaults, even where it is null:
``"partition_by": null`` means no partitioning, an absent key the default.
Relative paths are taken from the spec file's folder.
"""

from __future__ import annotations

import json
from pathlib import Path, PurePath

from pyspark.sql import SparkSession

from tapeloom.errors import FeedError
from tapeloom.sources.layouts import infer_date, infer_layout, load, parse_date
from tapeloom.sources.sink import ParseRequest, compression_of, run_parse

_OTHER = {"input", "out", "layout", "date", "select", "where", "partition_by", "compression", "note"}
_NUMBERS = {"row_group_rows", "max_buffered_mb", "chunk_mb", "data_page_kb", "threads", "max_records"}
_SWITCHES = {"strict", "verify_trigger"}
KEYS = _OTHER | _NUMBERS | _SWITCHES


def _check(job: object, where: str) -> dict:
    if not isinstance(job, dict):
        raise FeedError(f"{where}: expected an object")
    for k, v in job.items():
        if k not in KEYS:
            raise FeedError(f"{where}: unknown key {k!r}; known keys are {', '.join(sorted(KEYS))}")
        if v is None:
            continue
        wanted = int if k in _NUMBERS else bool if k in _SWITCHES else list if k == "select" else str
        if not isinstance(v, wanted) or wanted is int and isinstance(v, bool):
            raise FeedError(f"{where}: {k!r} must be {wanted.__name__}, not {v!r}")
    return job


def load_spec(path: str) -> list[ParseRequest]:
    """The jobs of a spec, merged with its defaults and checked; nothing is run."""
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise FeedError(f"cannot read run spec {path}: {e}") from None
    try:
        value = json.loads(text)
    except ValueError as e:
        raise FeedError(f"{path} is not JSON: {e}") from None
    if isinstance(value, dict) and "jobs" in value:
        if extra := set(value) - {"jobs", "defaults"}:
            raise FeedError(f"{path}: unknown key {sorted(extra)[0]!r} beside \"jobs\"")
        defaults = _check(value.get("defaults", {}), "defaults")
        jobs = value["jobs"]
        if not isinstance(jobs, list):
            raise FeedError(f"{path}: \"jobs\" must be a list")
    else:
        defaults, jobs = {}, [value]
    if not jobs:
        raise FeedError(f"{path}: \"jobs\" is empty, so there is nothing to run")
    return [_resolve(defaults, _check(job, f"job {i}"), Path(path).parent, i) for i, job in enumerate(jobs)]


def _resolve(defaults: dict, job: dict, base: Path, index: int) -> ParseRequest:
    # Null means absent, except for partition_by
    known = lambda d: {k: v for k, v in d.items() if v is not None or k == "partition_by"}
    merged = known(defaults) | known(job)
    for k in ("input", "out"):
        if k not in merged:
            raise FeedError(f"job {index}: {k!r} is required")
        if "://" not in merged[k] and not PurePath(merged[k]).is_absolute():
            merged[k] = str(base / merged[k])
    try:
        if "date" in merged:
            merged["date"] = parse_date(merged["date"])
        if "compression" in merged:
            compression_of(merged["compression"])
        if "layout" in merged:
            load(merged["layout"])
    except FeedError as e:
        raise FeedError(f"job {index}: {e}") from None
    merged.setdefault("layout", infer_layout(merged["input"]))
    merged.setdefault("date", infer_date(merged["input"]))
    for k in ("layout", "date"):
        if merged[k] is None:
            raise FeedError(f"job {index}: no {k} follows from {PurePath(merged['input']).name!r}; set {k!r}")
    return ParseRequest(**merged)


def run_spec(spark: SparkSession, path: str) -> list[dict]:
    """Run every job in order; one report per job."""
    out = []
    for req in load_spec(path):
        report = run_parse(spark, req)
        keep = ("rows_emitted", "rows_read", "partitions", "elapsed_secs", "manifest")
        out.append({"input": req.input, "layout": report["layout"], **{k: report[k] for k in keep}})
    return out
