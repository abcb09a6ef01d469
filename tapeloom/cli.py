"""Command line: parse, layouts, describe, book, run, inspect, verify, label.

Exit codes: 0 done, 1 an error of the request, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys

from tapeloom import __version__
from tapeloom.errors import FeedError


def _names(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tapeloom", description="Exchange tick data on Spark.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def shared(c: argparse.ArgumentParser) -> None:
        c.add_argument("--date", help="session date as YYYY-MM-DD; inferred from the name where it is left out")
        c.add_argument("-j", "--threads", type=int, help="local cores to use")

    c = sub.add_parser("parse", help="parse a feed file into partitioned Parquet")
    c.add_argument("input")
    c.add_argument("-o", "--out", required=True)
    c.add_argument("--layout")
    shared(c)
    c.add_argument("--select", type=_names, help="fields, separated by commas")
    c.add_argument("--where", default="")
    c.add_argument("--partition-by", default="symbol", help='a text column, or "none"')
    c.add_argument("--compression", choices=("zstd", "snappy", "none"), default="snappy")
    c.add_argument("--row-group-rows", type=int, default=256_000)
    c.add_argument("--data-page-kb", type=int, default=64)
    c.add_argument("--memory-limit-mb", type=int, help="accepted and ignored: Spark manages memory")
    c.add_argument("--chunk-mb", type=int, default=8, help="accepted and ignored")
    c.add_argument("--lenient", action="store_true", help="count malformed records instead of stopping")
    c.add_argument("--no-verify", action="store_true", help="skip the .trg size check")
    c.add_argument("--max-records", type=int)

    sub.add_parser("layouts", help="list the layouts")
    c = sub.add_parser("describe", help="print the fields of a layout")
    c.add_argument("layout")
    c.add_argument("--date")
    c = sub.add_parser("book", help="rebuild order books and write snapshots")
    c.add_argument("input")
    c.add_argument("-o", "--out", required=True)
    shared(c)
    c.add_argument("--symbols", type=_names)
    c.add_argument("--where", default="series == 'EQ'")
    c.add_argument("--interval", type=float, default=1.0)
    c.add_argument("--levels", type=int, default=20)
    c.add_argument("--compression", choices=("zstd", "snappy", "none"), default="snappy")
    c.add_argument("--max-records", type=int)
    c.add_argument("--previous-close", help="CSV of symbol,price in paise")
    c = sub.add_parser("run", help="run the jobs of a JSON spec")
    c.add_argument("spec")
    c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("inspect", help="print the first records of a file")
    c.add_argument("input")
    c.add_argument("--layout")
    c.add_argument("--date")
    c.add_argument("-n", "--n", type=int, default=5)
    c = sub.add_parser("verify", help="compare generated with actual trades under a parsed root")
    c.add_argument("root")
    c.add_argument("--symbols", nargs="*")
    c.add_argument("--dates", nargs="*")
    c.add_argument("--continuous-only", action="store_true")
    c = sub.add_parser("label", help="label trades with the events that caused them")
    c.add_argument("orders")
    c.add_argument("trades")
    c.add_argument("out")
    c = sub.add_parser("validate-layouts", help="check the layout tables")
    return p


def _spark(threads: int | None = None):
    from tapeloom.api import session

    spark = session(threads or "*")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _run(a: argparse.Namespace) -> int:
    from tapeloom import api

    if a.command == "layouts":
        for x in api.layouts():
            print(x)
    elif a.command == "describe":
        d = api.describe(a.layout, a.date)
        print(f"{d['id']} {d['spec_version']}: {d['record_length']} bytes, {'verified' if d['verified'] else 'not verified'}")
        for f in d["fields"]:
            print(f"{f['offset']:4d} {f['len']:3d} {f['type']:10s} {f['name']}" + (f"  scale {f['scale']}" if f["scale"] is not None else ""))
    elif a.command == "validate-layouts":
        from tapeloom.sources.layouts import LAYOUTS, validate_layout

        bad = [x for layout in LAYOUTS.values() for x in validate_layout(layout)]
        print("\n".join(bad) or "all layouts are valid")
        return int(bool(bad))
    elif a.command == "parse":
        report = api.parse(
            _spark(a.threads), a.input, a.out, layout=a.layout, date=a.date, select=a.select, where=a.where, partition_by=a.partition_by, compression=a.compression,
            row_group_rows=a.row_group_rows, data_page_kb=a.data_page_kb, strict=not a.lenient, verify_trigger=not a.no_verify, max_records=a.max_records,
        )
        print(json.dumps(report, indent=2))
    elif a.command == "book":
        from tapeloom.sources.parsed import read_previous_close

        spark = _spark(a.threads)
        close = read_previous_close(spark, a.previous_close) if a.previous_close else None
        print(json.dumps(api.build_books(spark, a.input, a.out, date=a.date, where=a.where, interval_secs=a.interval, levels=a.levels, compression=a.compression, max_records=a.max_records, symbols=a.symbols, previous_close=close), indent=2))
    elif a.command == "run":
        jobs = api.load_spec(a.spec)
        if a.dry_run:
            for i, j in enumerate(jobs):
                print(f"job {i}: {j.layout} {j.date} {j.input} -> {j.out}" + (f" where {j.where}" if j.where else ""))
            return 0
        print(json.dumps(api.run_spec(_spark(), a.spec), indent=2))
    elif a.command == "inspect":
        for i, row in enumerate(api.inspect(_spark(), a.input, a.layout, a.date, a.n)):
            print(f"-- record {i}")
            for k, v in row.items():
                print(f"  {k}: {v}")
    elif a.command == "verify":
        return _verify(a)
    elif a.command == "label":
        from tapeloom.operators.labels import label_trades, write_labels
        from tapeloom.sources.parsed import read_parsed

        spark = _spark()
        write_labels(label_trades(read_parsed(spark, a.trades), read_parsed(spark, a.orders)), a.out)
    return 0


def _verify(a: argparse.Namespace) -> int:
    from tapeloom import api
    from tapeloom.operators.verify import report_lines, verify, with_totals
    from tapeloom.sources.parsed import read_parsed, sessions

    spark = _spark()
    found = [s for s in sessions(spark, a.root) if not a.dates or s[0] in a.dates]
    if not found:
        raise FeedError(f"no sessions with both orders and trades under {a.root}")
    for day, orders, trades in found:
        fills = api.replay_fills(spark, orders, a.symbols)
        report = with_totals(verify(read_parsed(spark, trades, a.symbols), fills, a.continuous_only))
        print("\n".join(report_lines(day, report.collect())))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return _run(a)
    except (FeedError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
