"""Layouts, decoding, framing, filters, sinks, manifests, run specs and the command line."""

import gzip
import json
import warnings
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tapeloom import api, cli
from tapeloom.errors import FeedError, WhereError
from tapeloom.functions import values as V
from tapeloom.sources import layouts as L
from tapeloom.sources.feed import open_feed, probe_record_length, read_feed
from tapeloom.sources.parsed import read_orders, read_parsed, read_previous_close
from tests.oracle import decode_record, encode_record

DAY = date(2022, 1, 27)
CM = L.load("cm_orders").for_date(DAY)
NAME = "CASH_Orders_27012022.DAT"


def order(symbol, series="EQ", volume=76, price=230000, number=1, **more):
    base = {"record_indicator": "RM", "segment": "CASH", "order_number": number, "txn_time": "87014847291575", "buy_sell": "B", "activity_type": 1, "symbol": symbol, "series": series,
            "volume_disclosed": 0, "volume_original": volume, "limit_price": price, "trigger_price": 0, "mkt_order_flag": "N", "stop_loss_flag": "N", "ioc_flag": "N", "algo_indicator": 1, "client_identity": 3}
    return encode_record(CM, base | more)


RECORDS = [order("BALKRISIND", number=11), order("BCG", "BE", 75, number=12), order("CARTRADE", volume=300, number=13), order("M&M", volume=50, number=14)]


def write(path, records, name=NAME, gz=False, tail=b"\n"):
    data = b"\n".join(records) + tail
    f = path / (name + ".gz" * gz)
    f.write_bytes(gzip.compress(data) if gz else data)
    return str(f)


# -- layouts -------------------------------------------------------------------------------------

def test_layouts_are_valid_and_complete():
    assert api.layouts() == ["cm_orders", "cm_trades", "cm_index", "fao_orders", "fao_trades", "cd_orders", "cd_trades"]
    assert [L.validate_layout(x) for x in L.LAYOUTS.values()] == [[]] * 7
    lengths = {(x.id, v.spec_version): v.record_length for x in L.LAYOUTS.values() for v in x.versions}
    assert lengths == {
        ("cm_orders", "1.0"): 87, ("cm_trades", "1.0"): 100, ("cm_index", "1.0"): 38, ("fao_orders", "1.7"): 112, ("fao_orders", "1.6"): 111,
        ("fao_trades", "1.2"): 124, ("fao_trades", "1.1"): 123, ("cd_orders", "1.7"): 112, ("cd_orders", "1.6"): 111, ("cd_trades", "1.0"): 123,
    }


def test_validation_finds_faults():
    bad = L.Layout("x", "CM", "orders", "*", (L.Version("1", 9, (L.Field("a", 4, "price", offset=0), L.Field("a", 4, "bool_yn", offset=5)), DAY), L.Version("2", 9, (), DAY)))
    found = " ".join(L.validate_layout(bad))
    for word in ("twice", "starts at 5", "no scale", "not one byte", "overlap", "records of 9"):
        assert word in found or word == "span"


def test_versions_follow_date_and_observed_length():
    t = L.load("fao_trades")
    assert t.for_date(date(2019, 5, 1)).record_length == 123 and t.for_date(date(2019, 5, 1)).field("symbol").offset == 36
    assert t.for_date(date(2022, 5, 1)).field("symbol").offset == 37
    with pytest.warns(UserWarning, match="mean version"):
        assert t.resolve(date(2022, 5, 1), 123).spec_version == "1.1"
    with pytest.raises(FeedError, match="known lengths"):
        L.load("cm_orders").resolve(DAY, 86)
    with pytest.raises(FeedError, match="no version"):
        t.for_date(date(2020, 9, 5))


def test_inference():
    assert (L.infer_layout("x/CASH_Orders_27012022.DAT.gz"), L.infer_date("x/CASH_Orders_27012022.DAT.gz")) == ("cm_orders", DAY)
    assert L.infer_layout("FAO_Orders_30062022_11.DAT.gz") == "fao_orders" and L.infer_date("FAO_Orders_30062022_11.DAT.gz") == date(2022, 6, 30)
    assert L.infer_date("CASH_Orders_32012022") is None and L.infer_layout("other") is None
    with pytest.raises(FeedError):
        L.require_layout("other", None)


def test_describe_and_table(spark):
    d = api.describe("cd_orders", "2022-01-27")
    assert d["record_length"] == 112 and not d["verified"] and any(f["name"] == "fok_flag" for f in d["fields"])
    assert next(f for f in d["fields"] if f["name"] == "limit_price")["scale"] == 4
    assert L.layouts_df(spark).select("layout", "spec_version").distinct().count() == 10


# -- values --------------------------------------------------------------------------------------

def test_scalar_values(spark):
    rows = [("00000076",), ("bbbbbb12",), ("bbbbbbbb",), ("0000X076",), ("     -5 ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(V.whole_number(F.col("x"))).collect()]
    assert got == [76, 12, None, None, None]
    t = spark.createDataFrame([(87014847291575,)], "j bigint").select(V.micros_of_ticks(F.col("j")).alias("m"))
    t = t.select(V.timestamp_of_micros(F.col("m")).alias("t")).select("t", V.micros_of_timestamp(F.col("t")).alias("m")).first()
    assert t.t == datetime(2022, 1, 27, 9, 0, 0, 127792) and t.m == 1643274000127792
    assert V.ticks_of(DAY, "09:00:00.5") - V.ticks_of(DAY, "09:00:00") == 32768
    dates = spark.createDataFrame([("28JUN2012",), ("28jun2012",), ("b8JUN2012",), ("28XXX2012",), ("31FEB2012",)], "x string").select(V.date_of_dmmmy(F.col("x"))).collect()
    assert [r[0] for r in dates] == [date(2012, 6, 28), date(2012, 6, 28), date(2012, 6, 8), None, None]
    assert spark.range(1).select(V.date_of_ymd(F.lit("20220127"))).first()[0] == DAY
    times = spark.createDataFrame([("09:15:00",), ("25:00:00",), ("09-15-00",)], "x string").select(V.seconds_of_hms(F.col("x"))).collect()
    assert [r[0] for r in times] == [33300, None, None]
    un = spark.createDataFrame([("bbbbbbbM&M",), ("bCOX&KINGS",), ("bbNIFTY-50",)], "x string").select(V.unpad(F.col("x"), "left")).collect()
    assert [r[0] for r in un] == ["M&M", "COX&KINGS", "NIFTY-50"]
    assert spark.range(1).select(V.unpad(F.lit("FAOb"), "right")).first()[0] == "FAO"
    assert V.human_bytes(1536) == "1.5 KiB" and V.throughput(2_000_000, 1) == "2.00 M rows/s"
    with pytest.raises(ValueError):
        V.ticks_of(DAY, "9-15")


# -- reading -------------------------------------------------------------------------------------

def test_golden_records_equal_the_oracle(spark, tmp_path):
    path = write(tmp_path, RECORDS)
    rows = [r.asDict() for r in read_feed(spark, path, with_seq=True).orderBy("seq").collect()]
    assert [r.pop("seq") for r in rows] == [0, 1, 2, 3]
    assert rows == [decode_record(r, CM) for r in RECORDS]
    assert [r["symbol"] for r in rows] == ["BALKRISIND", "BCG", "CARTRADE", "M&M"] and rows[0]["txn_time"] == datetime(2022, 1, 27, 9, 0, 0, 127792)


def test_projection_is_in_layout_order(spark, tmp_path):
    path = write(tmp_path, RECORDS)
    df = read_feed(spark, path, select=["limit_price", "symbol"])
    assert df.columns == ["symbol", "limit_price"] and df.schema["limit_price"].metadata["scale"] == 2
    for bad in (["nope"], []):
        with pytest.raises(FeedError):
            read_feed(spark, path, select=bad)


def test_multi_member_gzip_and_max_records(spark, tmp_path):
    f = tmp_path / (NAME + ".gz")
    f.write_bytes(b"".join(gzip.compress(b"".join(order(f"S{i}", number=i) + b"\n" for i in part)) for part in (range(5), range(5, 12))))
    rows = read_feed(spark, str(f), with_seq=True).orderBy("seq").collect()
    assert [r.order_number for r in rows] == list(range(12))
    assert read_feed(spark, str(f), max_records=7).count() == 7
    assert probe_record_length(spark, str(f)) == 87
    assert api.probe(spark, str(f)) == {"layout": "cm_orders", "session_date": "2022-01-27", "observed_record_length": 87, "spec_version": "1.0", "verified": True}


def test_a_plain_file_in_many_blocks_keeps_its_numbers(spark, tmp_path):
    path = write(tmp_path, [order(f"S{i % 9}", number=i) for i in range(3000)])
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_feed(spark, path, with_seq=True)
        assert df.rdd.getNumPartitions() > 4
        assert all(r.seq == r.order_number for r in df.select("seq", "order_number").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


def test_several_files_are_numbered_in_name_order(spark, tmp_path):
    a = write(tmp_path, RECORDS[:2], "CASH_Orders_27012022_01.DAT")
    b = write(tmp_path, RECORDS[2:], "CASH_Orders_27012022_02.DAT")
    rows = read_feed(spark, [b, a], with_seq=True).orderBy("seq").collect()
    assert {r.order_number for r in rows} == {11, 12, 13, 14} and rows[0].seq == 0 and rows[-1].seq == (1 << 40) + 1
    assert read_feed(spark, f"{tmp_path}/CASH*.DAT").count() == 4


def test_corrupt_delimiter(spark, tmp_path):
    data = bytearray(b"\n".join(RECORDS) + b"\n")
    data[2 * 88 - 1] = ord("X")
    f = tmp_path / NAME
    f.write_bytes(bytes(data))
    feed = open_feed(spark, str(f), strict=False, observe=True)
    assert [r.order_number for r in feed.df.collect()] == [11, 13, 14]
    assert feed.stats() == {"rows_read": 3, "rows_emitted": 3, "rows_filtered": 0, "rows_malformed": 1, "bytes_decompressed": 4 * 88}
    with pytest.raises(Exception, match="malformed record"):
        read_feed(spark, str(f)).collect()


def test_truncated_crlf_and_foreign_files(spark, tmp_path):
    with pytest.raises(FeedError, match="cut short"):
        read_feed(spark, write(tmp_path, RECORDS, tail=b""))
    with pytest.raises(FeedError, match="no line feed"):
        probe_record_length(spark, write(tmp_path, [b"x" * 3000], "blob", tail=b""))
    f = tmp_path / ("CR_" + NAME)
    f.write_bytes(b"\r\n".join(RECORDS) + b"\r\n")
    with pytest.raises(FeedError, match="88 bytes"):
        read_feed(spark, str(f), layout="cm_orders", day=DAY)
    with pytest.raises(FeedError, match="no such file"):
        read_feed(spark, str(tmp_path / "CASH_Orders_27012022.none"))


def test_bad_cells(spark, tmp_path):
    bad = [order("A", volume="0000X076"), order("B", mkt_order_flag="?"), order("C", "BE", volume="bbbbbbbb")]
    path = write(tmp_path, bad)
    rows = read_feed(spark, path, strict=False).collect()
    assert [r.volume_original for r in rows] == [None, 76, None] and rows[1].mkt_order_flag is None
    with pytest.raises(Exception, match="volume_original"):
        read_feed(spark, path).collect()
    # only selected columns of rows that pass can fail
    assert read_feed(spark, path, select=["symbol"]).count() == 3
    assert read_feed(spark, path, where="symbol == 'C'").collect()[0].volume_original is None
    assert read_feed(spark, path, where="volume_original > 1", select=["symbol"]).collect()[0].symbol == "B"
    blank = write(tmp_path, [order("", number=3)], "blank_" + NAME)
    assert read_feed(spark, blank, layout="cm_orders", day=DAY).first().symbol == ""


def test_trigger_sidecar(spark, tmp_path):
    path = write(tmp_path, RECORDS)
    side = tmp_path / (NAME + ".trg")
    side.write_text(f"{'a' * 32} {4 * 88}\n")
    assert read_feed(spark, path).count() == 4
    side.write_text(f"{'a' * 32} 999")
    with pytest.raises(FeedError, match="incomplete"):
        read_feed(spark, path)
    assert read_feed(spark, path, verify_trigger=False).count() == 4


# -- where ---------------------------------------------------------------------------------------

def test_where_counts(spark, tmp_path):
    path = write(tmp_path, RECORDS)
    feed = open_feed(spark, path, where="series == 'EQ'", observe=True)
    assert feed.df.count() == 3 and feed.stats()["rows_filtered"] == 1
    for where, n in (("symbol == 'BCG' or volume_original < 60 and series == 'EQ'", 2), ("(symbol == 'BCG' or volume_original < 60) and series == 'EQ'", 1), ("not (volume_disclosed > 0)", 4),
                     ("txn_time >= '09:00:00.12'", 4), ("txn_time < '09:00:00.12'", 0), ("symbol in ('M&M','BCG')", 2), ("symbol NOT IN ('M&M')", 3), ("volume_disclosed < volume_original", 4), ("ioc_flag == true", 0), ("ioc_flag != true", 4)):
        assert read_feed(spark, path, where=where).count() == n, where


def test_where_is_pushed_below_decoding(spark, tmp_path):
    plan = read_feed(spark, write(tmp_path, RECORDS), where="series == 'EQ'", select=["symbol"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Project") < plan.index("Filter") and "Exchange" not in plan and "Python" not in plan


def test_in_on_numbers_compares_text(spark, tmp_path):
    path = write(tmp_path, RECORDS)
    with pytest.warns(UserWarning, match="as text"):
        assert read_feed(spark, path, where="volume_original in (76)").count() == 0
    assert read_feed(spark, path, where="volume_original in (76)", compat=False).count() == 1
    assert read_feed(spark, path, where="activity_type in (1, 4)").count() == 4


def test_a_large_set_equals_a_scan(spark, tmp_path):
    path = write(tmp_path, [order(f"T{i}", number=i) for i in range(60)])
    names = ", ".join(f"'T{i}'" for i in range(0, 1008, 2))
    assert read_feed(spark, path, where=f"symbol in ({names})").count() == 30


def test_where_errors():
    ok = lambda w, **k: api.check_filter(w, "cm_orders", "2022-01-27")
    assert ok("series == 'EQ'") and ok("") and ok("not symbol = 'A' AND (limit_price >= 5)")
    for bad, why in (("nope == 1", "unknown field"), ("series == 'TOOLONG'", "longer"), ("txn_time > 09:15:00", "quoted"), ("series > 'EQ'", "=="), ("series == 'EQ' series", "follow"), ("symbol in ()", "value"),
                     ("limit_price < symbol", "no number"), ("ioc_flag == ioc_flag", "no number"), ("symbol == true", "no flag"), ("(series == 'EQ'", "expected"), ("series == 'EQ", "quote"), ("limit_price == txn_time", "scales"), ("limit_price >= -5", "cannot read"), ("not", "field")):
        with pytest.raises(WhereError, match=why):
            ok(bad)
    with pytest.raises(WhereError, match="scales"):
        from tapeloom.plans.predicate import compile_where

        mixed = L._version("x", [L.Field("a", 4, "price", scale=2), L.Field("b", 4, "price", scale=4)], DAY)
        compile_where("a < b", mixed, None, lambda f: F.col(f.name))


# -- writing -------------------------------------------------------------------------------------

def test_parse_writes_partitions_and_manifest(spark, tmp_path):
    path = write(tmp_path, RECORDS + [order("BCG", "EQ", number=15)])
    out = str(tmp_path / "out")
    report = api.parse(spark, path, out, where="volume_original >= 75", compression="zstd", note="why")
    assert (report["rows_read"], report["rows_emitted"], report["rows_filtered"], report["partitions"]) == (5, 4, 1, 3)
    root = tmp_path / "out/segment=cm/kind=orders/date=2022-01-27"
    assert sorted(p.name for p in root.glob("symbol=*")) == ["symbol=BALKRISIND", "symbol=BCG", "symbol=CARTRADE"]
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in root.glob("symbol=*"))
    m = json.loads((tmp_path / "out/_manifest.cm_orders.2022-01-27.json").read_text())
    assert m["note"] == "why" and m["rows_emitted"] == 4 and m["partition_by"] == "symbol" and {p["key"]: p["rows"] for p in m["partitions"]}["BCG"] == 2
    assert m["bytes_decompressed"] == 5 * 88 and m["layout_verified"] and m["selected_fields"] == CM.names
    back = read_orders(spark, str(root), ["BCG"])
    assert sorted(r.order_number for r in back.collect()) == [12, 15]
    single = api.parse(spark, path, str(tmp_path / "one"), partition_by=None)
    assert single["partitions"] == 1 and len(list((tmp_path / "one/segment=cm/kind=orders/date=2022-01-27").glob("*.parquet"))) == 1
    for bad in ({"compression": "lzo"}, {"partition_by": "limit_price"}, {"select": ["series"]}):
        with pytest.raises(FeedError):
            api.parse(spark, path, out, **bad)


def test_unsigned_columns_become_longs(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"symbol": ["20"], "order_number": pa.array([7], pa.uint64())}), tmp_path / "x.parquet")
    df = read_parsed(spark, str(tmp_path / "x.parquet"))
    assert dict(df.dtypes) == {"symbol": "string", "order_number": "bigint"}
    with pytest.raises(FeedError, match="missing"):
        read_orders(spark, str(tmp_path / "x.parquet"))


def spec(tmp_path, value):
    f = tmp_path / "spec.json"
    f.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(f)


def test_run_specs(spark, tmp_path):
    write(tmp_path, RECORDS)
    jobs = api.load_spec(spec(tmp_path, {"defaults": {"out": "o", "where": "series == 'EQ'", "partition_by": "symbol"}, "jobs": [{"input": NAME}, {"input": NAME, "where": "", "partition_by": None, "out": "p", "select": ["series"]}]}))
    assert [j.partition_by for j in jobs] == ["symbol", None] and jobs[0].input == str(tmp_path / NAME) and jobs[1].where == ""
    reports = api.run_spec(spark, str(tmp_path / "spec.json"))
    assert [r["rows_emitted"] for r in reports] == [3, 4]
    assert cli.main(["run", str(tmp_path / "spec.json"), "--dry-run"]) == 0
    assert api.load_spec(spec(tmp_path, {"input": NAME, "out": "o"}))[0].partition_by == "symbol"
    for bad, why in (({"input": NAME, "out": "o", "wher": ""}, "unknown key"), ({"jobs": []}, "empty"), ({"jobs": [{"out": "o"}]}, "job 0: 'input'"), ({"jobs": [{"input": NAME, "out": "o"}, {"out": "x"}]}, "job 1"),
                     ({"input": NAME, "out": "o", "date": "27-01-2022"}, "YYYY-MM-DD"), ({"input": "odd", "out": "o"}, "layout"), ("{", "not JSON"), ({"jobs": [{}], "more": 1}, "unknown key"), ({"input": NAME, "out": "o", "strict": 1}, "must be bool")):
        with pytest.raises(FeedError, match=why):
            api.load_spec(spec(tmp_path, bad))


def test_previous_close(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("symbol,price\nA, 100\n\nB,250\n")
    assert read_previous_close(spark, str(f)) == {"A": 100, "B": 250}
    for bad in ("A,100\nB,x\n", "A 100\n"):
        f.write_text(bad)
        with pytest.raises(FeedError):
            read_previous_close(spark, str(f))


def test_tables_and_batches(spark, tmp_path):
    path = write(tmp_path, RECORDS)
    assert api.read_table(spark, path, max_rows=2, select=["symbol"]).num_rows == 2
    assert list(api.to_pandas(spark, path, where="series == 'BE'").symbol) == ["BCG"]
    reader = api.BatchReader(spark, path, batch_rows=3, where="series == 'EQ'")
    assert [b.num_rows for b in reader] == [3] and reader.stats["rows_filtered"] == 1 and reader.record_length == 87
    assert sum(b.num_rows for b in api.iter_batches(spark, path, date="2022-01-27")) == 4
    assert api.memory_estimate(10)["estimated_bytes"] > 0
    assert api.inspect(spark, path, n=1)[0]["symbol"] == "BALKRISIND"


def test_command_line(capsys):
    assert cli.main(["layouts"]) == 0 and "cd_trades" in capsys.readouterr().out
    assert cli.main(["describe", "cm_orders"]) == 0 and "limit_price" in capsys.readouterr().out
    assert cli.main(["describe", "nope"]) == 1 and "unknown layout" in capsys.readouterr().err
    assert cli.main(["validate-layouts"]) == 0
    assert cli.main(["nope"]) == 2
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert cli.main(["--version"]) == 0
