"""All operators and stages on nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import components, decontam, linear_text, mixing, passages, quality_eb, quality_rules, queries, sharding, simhash, suffix_dedup, toxicity, warc

LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [(1, "some words here", "a"), (1, "some words here", "a"), (1, "other words there", "a"), (None, "some words here", None), (None, None, "b"), (2, None, "b"), (3, "", "a"), (4, LONG, None), (5, LONG, "b"), (5, LONG, "b")]


def labels(spark, rows=((1, 1, 0), (1, 0, 1), (4, 0, 1), (None, 1, 1), (9, None, 0))):
    return spark.createDataFrame(list(rows), LABELS)


def benchmark(spark):
    return spark.createDataFrame([(1, "some words here"), (None, None)], "item_id long, text string")


OPERATORS = {
    "quality": lambda spark, d: quality_rules.with_quality(d),
    "warc": lambda spark, d: warc.archive_round_trip(d, key="doc_id", url="source", payload="text"),
    "substrings": lambda spark, d: suffix_dedup.remove_repeats(d),
    "toxicity": lambda spark, d: toxicity.with_toxicity(d, labels(spark), {"toxic": F.col("toxic")}),
    "sites": lambda spark, d: quality_eb.with_site_quality(d, labels(spark), F.col("quality"), F.col("source"), F.col("source")),
    "simhash": lambda spark, d: simhash.simhash_groups(d),
    "shards": lambda spark, d: sharding.assign_shards(d, 4),
    "decontamination": lambda spark, d: decontam.decontaminate(d, benchmark(spark)),
    "passages": lambda spark, d: passages.near_duplicate_passages(d),
    "mix": lambda spark, d: mixing.mix(d),
}
CLASHES = ["_w", "_l", "_first", "_id", "_copies", "_copy", "spans", "n_words", "items", "toxic", "kept", "row", "fp", "_row", "size", "taken", "shard", "rep", "_text", "words"]


def frame(spark, rows=ROWS, clashes=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if clashes else df


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_edge_rows(spark, name):
    f = OPERATORS[name]
    out = f(spark, frame(spark))
    rows = out.collect()
    assert len(rows) == len(ROWS)
    plain = f(spark, frame(spark, clashes=False))
    common = [c for c in plain.columns if c in out.columns and c not in ("file", "offset", "length")]
    key = lambda df: sorted(map(str, df.select(*common).collect()))
    assert key(out) == key(plain) and set(plain.columns) <= set(out.columns)
    if name in ("quality", "toxicity", "decontamination"):  # these carry the input's columns: none is lost
        for c in CLASHES:
            mine = c + "_in" if c + "_in" in out.columns else c
            assert {r[mine] for r in rows} == {f"own {c}"}
    assert f(spark, frame(spark, clashes=False).limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edge_rows(spark, tmp_path, name, stage):
    root = str(tmp_path)
    labels(spark).write.parquet(f"{root}/labels.parquet")
    benchmark(spark).write.parquet(f"{root}/benchmark.parquet")
    docs = frame(spark)
    out = stage(spark, docs, root)
    rows = out.collect()
    if name != "sharding":
        assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    if name == "near_dedup":
        texts = Counter(r.text for r in rows)
        assert max(texts.values()) == 1 and texts[LONG] == 1 and sum(not t for t in texts) == 1
        assert {r.doc_id for r in rows if r.text == "some words here"} == {1} and {r.doc_id for r in rows if r.text == LONG} == {4}
    if name == "sharding":
        assert len(rows) == len(ROWS)
    assert stage(spark, docs.limit(0), root).count() == 0


def test_near_copies_of_a_given_similarity():
    """Recall over the pieces for one changed word in 50 (similarity 0.80), 100 (0.90) and 200 (0.95), and no link between unrelated texts or halves."""
    r = random.Random(3)
    most = simhash.differing_bits(0.8)
    for n, least in ((50, 0.78), (100, 0.95), (200, 0.98)):
        hit = 0
        for _ in range(120):
            w = [f"w{r.randrange(5000)}" for _ in range(n)]
            v = list(w)
            v[r.randrange(5, n - 5)] = "changed"
            fp = simhash.wide_fingerprints([" ".join(x).encode() for x in (w, v)])
            bits = np.unpackbits(fp.view(np.uint8).reshape(2, -1), axis=1, bitorder="little")
            a, b = simhash.nearest_anchors(bits[:, simhash._DRAWN] @ (np.int64(1) << np.arange(2 * simhash.BLOCK, dtype=np.int64)))
            hit += bool((a == b).any()) and simhash.near(fp[:1], fp[1:], most)[0]
        assert hit >= least * 120
    other = simhash.wide_fingerprints([" ".join(f"w{r.randrange(5000)}" for _ in range(100)).encode() for _ in range(200)])
    assert not any(simhash.near(other[i + 1 :], other[i : i + 1], most).any() for i in range(len(other)))
    whole = [[f"w{r.randrange(5000)}" for _ in range(200)] for _ in range(100)]
    half = simhash.wide_fingerprints([" ".join(w[:100]).encode() for w in whole])
    assert not simhash.near(half, simhash.wide_fingerprints([" ".join(w).encode() for w in whole]), most).any()


def test_nearest_anchors_are_code_words_within_one_bit():
    x = np.random.default_rng(1).integers(0, 1 << 30, 5000)
    a = simhash.nearest_anchors(x)
    for at in (0, simhash.BLOCK):
        block = (a >> at) & 0x7FFF
        s = np.zeros(len(x), np.int64)
        for b in range(simhash.BLOCK):
            s ^= ((block >> b) & 1) * (b + 1)
        assert not s.any() and (np.bitwise_count(block ^ ((x >> at) & 0x7FFF)) <= 1).all()


def test_a_hot_anchor_over_many_batches(spark):
    """One large group of near copies: all pairs share anchors, a forest joins them."""
    r = random.Random(8)
    base = r.getrandbits(64)
    vals = sorted({base ^ (1 << r.randrange(64)) for _ in range(400)} | {base})
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(vals)], "doc long, fp long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {x.component for x in simhash.near_components(df).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_labelled_rows_are_bounded_and_ties_follow_a_rule(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(2000)], "doc_id long, text string")
    many = spark.createDataFrame([(i % 20, 1, i % 2) for i in range(400)], LABELS)
    ids, rows, dense, y = linear_text.labelled_features(docs, many, "doc_id", "text", {"toxic": F.col("toxic")}, 10)
    assert len(ids) == len(set(ids)) == len(rows) == 10 and list(y["toxic"]) == [bool(i % 2) for i in ids]


def test_mix_reaches_targets_with_equal_rows_and_null_ids(spark):
    rows = [(None, f"{'x ' * (i % 7 + 1)}", "a") for i in range(2000)] + [(7, "three words here", "b")] * 1000 + [(i, "one", "c") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) < 1 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(2)).collect()))


def test_small_groups_of_equal_texts_stay_whole(spark):
    """However the splitters fall; only groups over a fiftieth of a shard meet two shards."""
    rows = [(i, f"text {i // 7} " + "y" * (i // 7 % 50)) for i in range(21_000)] + [(-i, "hot") for i in range(1, 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = dict(rows)
    for ranges, oversample in ((64, 1), (16, 8)):
        out, shards, sizes = sharding.assign_shards(df, 8, ranges=ranges, oversample=oversample).collect(), {}, Counter()
        for r in out:
            shards.setdefault(texts[r.doc_id], set()).add(r.shard)
            sizes[r.shard] += r.size
        assert len(out) == len(rows) and {t for t, s in shards.items() if len(s) > 1} <= {"hot"}
        mean = sum(sizes.values()) / 8
        assert max(abs(s - mean) for s in sizes.values()) < mean / 25


@pytest.mark.parametrize("name", ["op7_sharding", "op10_mixing"])
def test_sql_agrees_on_repeated_rows_and_nulls(spark, tmp_path, name):
    rows = [(i % 300, f"words of {i % 90} " + "é " * (i % 11), "abcde"[i % 5]) for i in range(600)] + [(None, "x y z", None)] * 40 + [(i, None, "a") for i in range(9)] + [(5, "", "solo")] * 3
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = getattr(queries, name)(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("hot", [3, 1000])
def test_components_with_hubs(spark, monkeypatch, hot):
    """Hubs on both sides of the order, chains and pairs, with and without the hot path."""
    monkeypatch.setattr(components, "HOT_EDGES", hot)
    edges = [(500, i) for i in range(501, 560)] + [(600, i) for i in range(100, 140)] + [(139, 501)] + [(i, i + 1) for i in range(700, 740)] + [(900, 901), (902, 902)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((k, v) for k, v in root.items() if k != 902)


def test_archives_are_rolled_by_size(spark, tmp_path):
    """Every file of a task leads with the dictionary, and all records come back."""
    pages = [(i, f"http://h/{i}", f"page {i} " * (i % 50)) for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/a", row_bytes=2000, archive_rows=3)
    files = [f for f in (tmp_path / "a").glob("part-*") if f.stat().st_size]
    assert len(files) > 5 and all(f.read_bytes()[:4] == warc.DICT_MAGIC.to_bytes(4, "little") for f in files)
    assert {x.row_key for x in warc.read_archives(spark, f"file://{tmp_path}/a").collect()} == set(range(400))


def test_overfull_ranges_are_subdivided(spark):
    """A sample of two keys leaves ranges far too full; equal rows are placed one after another."""
    rows = [(i, f"text {i} " + "y" * (i % 50)) for i in range(3000)] + [(9, "hot")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sharding.assign_shards(df, 8, ranges=64, oversample=1).collect()
    sizes, slots = Counter(), {}
    for r in out:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in out)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("small", [2, simhash.SMALL])
def test_links_of_an_anchor_join_what_brute_force_joins(monkeypatch, small):
    """Chains, bridges and lone members at anchors of 1 to 40 members: one link of each member to the smallest that it reaches."""
    monkeypatch.setattr(simhash, "SMALL", small)
    r = np.random.default_rng(4)
    anchor = np.sort(r.integers(0, 40, 500))
    fp, rep = r.integers(0, 1 << 8, 500), np.arange(500) * 3
    a, b = simhash.links_of_groups(anchor, fp, rep, 1)
    want = {}
    for i in range(500):
        seen, queue = {i}, [i]
        while queue:
            x = queue.pop()
            more = [j for j in np.flatnonzero(anchor == anchor[x]) if j not in seen and int(fp[x] ^ fp[j]).bit_count() <= 1]
            seen.update(more)
            queue += more
        if min(seen) != i:
            want[3 * i] = 3 * min(seen)
    assert dict(zip(b.tolist(), a.tolist())) == want and len(b) == len(want)
