"""The contract queries' operators against brute force on small tables."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tapeloom.llm import decontam, mixing, passages, quality_rules, sharding, simhash, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, n=80):
    r = random.Random(seed)
    vocab = ["the", "of", "and", "in", "Haus", "été", "ñu", "x", "zz#", "A|B", "…", "日本"] + ["w%d" % i for i in range(60)]
    out = [None, "", "   \n\t ", "one", "two words", "a b c", "A B C", "!!", "\x1f\x00odd\x85   sp", "a b c a b c", "line\nline\n\nline \n"]
    for _ in range(n):
        k = r.choice([3, 12, 60, 200])
        ws = [r.choice(vocab) for _ in range(k)]
        if r.random() < 0.3:
            ws += ws[: k // 2]
        out.append("".join(w + r.choice([" ", " ", "  ", "\n", "\t"]) for w in ws))
        if r.random() < 0.3:
            out.append(r.choice(out))
            t = out[-1]
            if t and len(t) > 60:
                i = r.randrange(len(t) - 5)
                out.append(t[:i] + "q" + t[i + 1 :])
    return out


def table(spark, ts, **more):
    rows = [(i * 2, t, f"s{i % 5}" if i % 7 else None, "extra") for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string").repartition(4)


def test_quality_base_figures(spark):
    ts = texts(1)
    got = {r.doc_id: r for r in quality_rules.with_quality(table(spark, ts)).collect()}
    for i, t in enumerate(ts):
        ws = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        hit = {p + k for p, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for k in range(3)}
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        r = got[i * 2]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (t, want)
        failed = len(ws) < 50 or 100 * len(hit) > 50 * len(ws)
        assert r.base_failed == failed and (not r.kept or not failed) and r.kept == (not failed and not r.failed_rules)


def test_quality_plan_has_no_user_function_or_shuffle(spark):
    plan = quality_rules.with_quality(table(spark, ["a"]).coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Aggregate" not in plan and "Join" not in plan


def simhash_brute(ts):
    fps = []
    for t in ts:
        ws = [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(t or "")]
        sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(ts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(ts)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i * 2: (f"{fps[i]:016x}", find(i) * 2) for i in range(len(ts))}


def test_simhash_groups(spark):
    ts = texts(2, 50)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(table(spark, ts)).collect()}
    assert got == simhash_brute(ts)
    nobody = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (None, "other text here")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.simhash_groups(nobody).collect()) == [(0, 0), (0, 4), (0, 4), (4, 4)]
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_lose_no_link(spark):
    """A large cluster of fingerprints within a few bits of each other, and chains."""
    r = random.Random(4)
    base = r.getrandbits(64)
    vals = {base}
    for _ in range(300):
        v = r.choice(sorted(vals))
        vals.add(v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    vals |= {r.getrandbits(64) for _ in range(200)}
    vals = sorted(vals)
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    df = spark.createDataFrame(list(enumerate(signed)), "doc long, fp long")
    got = {x.doc: x.component for x in simhash.near_components(df).collect()}
    root = {i: i for i in range(len(vals))}
    for _ in range(40):
        for a, b in itertools.combinations(range(len(vals)), 2):
            if (vals[a] ^ vals[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_sharding(spark):
    ts = texts(3, 150) + ["hot text of some words"] * 120
    df = table(spark, ts)
    rows = sharding.assign_shards(df, n_shards=24).collect()
    assert len(rows) == len(ts) and {r.doc_id for r in rows} == {2 * i for i in range(len(ts))}
    by = defaultdict(list)
    for r in rows:
        t = ts[r.doc_id // 2] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        by[r.shard].append(r)
    total = sum(r.size for r in rows)
    most = max(r.size for r in rows)
    for s, rs in by.items():
        assert 0 <= s < 24 and sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / 24) <= 2 * most
    again = sharding.assign_shards(df.repartition(7), n_shards=24).collect()
    assert sorted(rows) == sorted(again)
    assert sharding.assign_shards(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "t")] * 50 + [(None, None)] * 3, "doc_id long, text string")
    assert sharding.assign_shards(same, n_shards=4).count() == 53


def targets_brute(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    open_ = list(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing(spark):
    ts = texts(5, 200)
    df = table(spark, ts)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(ts)
    size = {2 * i: len(WORD.findall(t or "")) for i, t in enumerate(ts)}
    total, taken = Counter(), Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        total[r.source] += r.size
        taken[r.source] += r.taken
    want = targets_brute(dict(total))
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
    for s in total:
        assert taken[s] == int(want[s] + 1e-9) or abs(taken[s] - want[s]) < 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(9)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_cuts_a_group_of_equal_rows(spark):
    df = spark.createDataFrame([(None, "two words", "a")] * 1000 + [(i, "one", "b") for i in range(10)], "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix(df, share=0.5).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert set(target) == {"a", "b"} and all(abs(taken[s] - target[s]) < 1 for s in taken)


def decontam_brute(t, items):
    low = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    ws, hit, names = low(t), set(), []
    for name, text in items:
        it = low(text)
        wins = {tuple(it[i : i + 13]) for i in range(max(1, len(it) - 12))} if it else set()
        found = False
        for w in wins:
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    found = True
                    hit |= set(range(i, i + len(w)))
        if found:
            names.append(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(ws), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(ws)


def test_decontamination(spark):
    r = random.Random(8)
    ts = [t for t in texts(6, 40)]
    items = [(i, " ".join("w%d" % r.randrange(30) for _ in range(r.choice([1, 2, 5, 13, 14, 30])))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "Haus, été-ñu"), (15, items[3][1]), (16, "w1 " * 40)]
    for _ in range(40):
        a = r.choice(ts) or ""
        b = r.choice(items)[1] or ""
        ts.append(a[: r.randrange(len(a) + 1)] + " " + b.upper().replace("W", "w") + " " + b + "," + a[:50])
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block, shard in ((8 << 20, 1 << 20), (60, 100)):
        out = decontam.decontaminate(table(spark, ts), bench, block_bytes=block, shard_words=shard, keep=["doc_id", "kept"])
        for x in out.collect():
            want = decontam_brute(ts[x.doc_id // 2], items)
            assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == want
            assert sum(s.end - s.start for s in x.spans) == x.n_hit
    none = decontam.decontaminate(table(spark, ts[:5]), bench.limit(0)).collect()
    assert all(x.n_hit == 0 and not x.contaminated for x in none)
    assert decontam.decontaminate(table(spark, ts).limit(0), bench).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://h/{i % 9}é", ("<p>page %d</p>" % (i % 30)) * (i % 30)) for i in range(80)] + [(80, None, None), (81, "u", ""), (None, "n", "x"), (5, "http://h/5", "twice")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/a"
    warc.write_archives(df, path)
    rows = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(rows) == len(pages)
    first = {}
    for k, _, h in pages:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    by_key = defaultdict(list)
    for k, _, h in pages:
        by_key[k].append((h or "").encode())
    for x in rows:
        bodies = by_key[x.row_key]
        body = next(b for b in bodies if base64.b32encode(hashlib.sha1(b).digest()).decode() == x.payload_digest)
        assert x.payload_bytes == len(body)
        lead = first.get(body.decode(), x.row_key)
        assert (x.record_type, x.refers_to) == (("response", None) if lead == x.row_key else ("revisit", lead))
        assert x.payload == (body if x.record_type == "response" else b"")
    assert any(x.record_type == "revisit" for x in rows)
    warc.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_files_are_plain_zstd_with_a_leading_dictionary(spark, tmp_path):
    import struct

    df = spark.createDataFrame([(i, f"http://h/{i}", f"<html>some page text {i} {i * i}</html>" * 5) for i in range(300)], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/a", min_dedup_bytes=10_000)
    for f in (tmp_path / "a").glob("part-*"):
        data = f.read_bytes()
        if not data:
            continue
        magic, n = struct.unpack_from("<II", data)
        assert magic == warc.DICT_MAGIC and n > 0
        records = list(warc.read_archive(data))
        offset, length, record = records[len(records) // 2]
        import zstandard

        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).decompress(data[offset : offset + length])
        assert one == record and record.startswith(b"WARC/1.1\r\n")


def test_passages_find_planted_repeats(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    say = lambda k: [word() for _ in range(k)]
    p, q = say(60), say(120)
    near = list(q)
    near[100] = "changed"
    ts = [say(200) for _ in range(30)]
    ts[3] += p + say(10)
    ts[9] = say(5) + p + say(90)
    ts[12] += q
    ts[20] = near + say(40)
    ts[25] = list(ts[3])
    ts += [say(10), []]
    rows = [(i, " ".join(t)) for i, t in enumerate(ts)] + [(100, None), (None, " ".join(ts[5]))]
    got = {x.doc_id: x for x in passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert len(got) == len(rows)
    # runs just over the passage's ends are still similar enough
    assert got[9].class_id == 3 and 60 <= got[9].n_repeated_words <= 74 and got[9].spans[0].start <= 5 and got[9].spans[0].end >= 65
    assert got[25].class_id == 3 and got[25].n_repeated_words == got[25].n_words
    assert got[20].class_id == 12 and 90 <= got[20].n_repeated_words <= 120
    assert got[5].n_repeated_words == 200 and got[5].class_id == 5
    for i in set(range(30)) - {3, 5, 9, 12, 20, 25}:
        assert got[i].class_id == i and got[i].n_links == 0 and got[i].n_repeated_words == 0
    assert passages.near_duplicate_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
