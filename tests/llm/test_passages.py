"""Near-duplicate passages against brute force over all pairs of runs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tapeloom.llm import passages
from tapeloom.llm.passages import PASSAGE, SIMILARITY, WINDOW
from tapeloom.llm.suffix_dedup import merge_spans

P = PASSAGE


def similar(a, b):
    x = sum((Counter(a) & Counter(b)).values())
    return x / (2 * len(a) - x) >= SIMILARITY - 1e-9


def runs(ws):
    s = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    return [s[i : i + P] for i in range(len(s) - P + 1)]


def brute(ts):
    """(class, repeated words) of each text; runs of one text are not compared."""
    group, cover = list(range(len(ts))), [set() for _ in ts]
    of = [runs(t) for t in ts]
    for b in range(len(ts)):
        for a in range(b):
            hit = [i for i, x in enumerate(of[b]) if any(similar(x, y) for y in of[a])]
            for i in hit:
                cover[b].update(range(i, i + P + 4))
            if hit:
                lo, hi = sorted((group[a], group[b]))
                group = [lo if g == hi else g for g in group]
    return [(g, len(c)) for g, c in zip(group, cover)]


def found(spark, ts, **more):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(ts)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.class_id, x.n_repeated_words) for x in passages.near_duplicate_passages(df, **more).collect()}
    return [got[i] for i in range(len(ts))]


def one_group(rows):
    """One window of one run for each row of shingles, all with their smallest hash at the same place."""
    rec, grid = np.zeros(len(rows), WINDOW), np.zeros((len(rows), 2 * P - 1), np.uint64)
    rec["key"], rec["doc"], rec["n"], rec["back"] = 1, range(len(rows)), 1, P - 1
    for i, row in enumerate(rows):
        grid[i, :P] = row
    return rec, grid


def edited(row, places, by):
    out = list(row)
    for i in places:
        out[i] = by + i
    return out


BASE = list(range(1 << 41, (1 << 41) + P))
LEFT, RIGHT = edited(BASE, range(1, 5), 1 << 50), edited(BASE, range(20, 24), 1 << 51)


@pytest.mark.parametrize("rows, repeated", [([LEFT, BASE, RIGHT], {1, 2}), ([LEFT, RIGHT, BASE], {2}), ([BASE, LEFT, RIGHT], {1, 2}), ([LEFT, RIGHT, BASE, LEFT], {2, 3})])
def test_chains_and_bridges_stay_connected(rows, repeated):
    assert similar(LEFT, BASE) and similar(BASE, RIGHT) and not similar(LEFT, RIGHT)
    member, _, _, of = passages.verify_groups(*one_group(rows), P, SIMILARITY)
    assert set(member.tolist()) == repeated and (of < member).all()
    reached = {0}
    for _ in rows:
        reached |= {x for a, b in zip(member.tolist(), of.tolist()) if {a, b} & reached for x in (a, b)}
    assert reached == set(range(len(rows)))


def word_edit(r, words, n):
    """The words with ``n`` neighbours changed, put in or left out somewhere, cut or filled to the same length."""
    at, how = r.randrange(len(words) - n), r.choice(["change", "insert", "delete", "double"])
    new = [f"n{r.randrange(10**9)}" for _ in range(n)]
    made = {"change": words[:at] + new + words[at + n :], "insert": words[:at] + new + words[at:], "delete": words[:at] + words[at + n :], "double": words[: at + n] + words[at:]}[how]
    return (made + [f"n{r.randrange(10**9)}" for _ in range(n)])[: len(words)]


@pytest.mark.parametrize("seed, n_rows, most", [(4, 60, 1), (5, 400, 1), (6, 120, 3)])
def test_a_group_of_many_edits_equals_brute_force(seed, n_rows, most):
    """Rows are the shingles of edited word sequences: a single shingle cannot change alone."""
    r = random.Random(seed)
    ts = [[f"w{k}" for k in range(P + 4)]]
    for _ in range(1, n_rows):
        t = word_edit(r, r.choice(ts), r.randint(1, most))
        ts.append(word_edit(r, t, 1) if r.random() < 0.3 else t)
    s, ends, _ = passages.shingles([" ".join(t).encode() for t in ts], passages._WordHash())
    rows = [s[e - P : e].tolist() for e in ends]
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if similar(rows[a], rows[b])]
    member, _, _, of = passages.verify_groups(*one_group(rows), P, SIMILARITY)
    assert len(pairs) > n_rows / 2
    assert set(member.tolist()) == {b for _, b in pairs} and all(similar(rows[a], rows[b]) for a, b in zip(member.tolist(), of.tolist()))
    group, tree = list(range(len(rows))), list(range(len(rows)))
    for names, some in ((group, pairs), (tree, zip(of.tolist(), member.tolist()))):
        for a, b in some:
            lo, hi = sorted((names[a], names[b]))
            names[:] = [lo if x == hi else x for x in names]
    assert group == tree


def test_parts_of_a_large_group_are_sorted_in_turns(monkeypatch):
    r = random.Random(7)
    ts = [[f"w{k}" for k in range(P + 4)]]
    ts += [word_edit(r, r.choice(ts), 1) for _ in range(100)]
    s, ends, _ = passages.shingles([" ".join(t).encode() for t in ts], passages._WordHash())
    rows = [s[e - P : e].tolist() for e in ends]
    found = lambda: set(passages.verify_groups(*one_group(rows), P, SIMILARITY)[0].tolist())
    whole = found()
    monkeypatch.setattr(passages, "MAX_PARTS", 50)
    assert found() == whole and len(whole) > 10


@pytest.mark.parametrize("how", ["change", "insert", "delete"])
def test_recall_against_brute_force(spark, how):
    """Passages of 50 to 90 words with 1 to 3 words changed, put in or left out anywhere; the truth is the Jaccard of all runs."""
    r = random.Random(how)
    say = lambda k: ["w%d" % r.randrange(10**6) for _ in range(k)]
    ts = []
    for _ in range(60):
        w, n = say(r.randint(50, 90)), r.randint(1, 3)
        at = r.randrange(len(w) - n)
        ts += [say(r.randint(0, 9)) + w + say(3), say(r.randint(0, 9)) + w[:at] + (say(n) if how != "delete" else []) + w[at + (n if how != "insert" else 0) :] + say(2)]
    pairs = [(k, k + 1) for k in range(0, len(ts), 2)]
    true = [any(similar(x, y) for x in runs(ts[a]) for y in runs(ts[b])) for a, b in pairs]
    got = found(spark, ts)
    linked = [got[a][0] == got[b][0] for a, b in pairs]
    assert sum(true) > 20 and all(t or not g for t, g in zip(true, linked))
    assert sum(t and g for t, g in zip(true, linked)) >= 0.97 * sum(true)


def test_insertions_and_deletions_equal_brute_force(spark):
    r = random.Random(6)
    say = lambda k: ["w%d" % r.randrange(100_000) for _ in range(k)]
    ts = []
    for k, n in enumerate((50, 60, 75, 88, 120)):
        w = say(n)
        at = n // 2
        ts += [w, w[:at] + ["new"] + w[at:], w[:at] + w[at + 1 :], say(k + 3) + w[: at - 3] + w[at:] + say(4)]
    want, got = brute(ts), found(spark, ts, hashes=8, enough=1)
    assert sum(x[1] > 0 for x in want) >= 8
    assert got == want


def test_common_shingles_count_repeats():
    r = random.Random(2)
    x, y = (np.array([[r.choice([0, 0, *range(1, 9)]) for _ in range(P)] for _ in range(50)], np.uint64) for _ in range(2))
    for a, b, n in zip(x, y, passages.common_shingles(x, y)):
        assert n == sum((Counter(a[a > 0].tolist()) & Counter(b[b > 0].tolist())).values())


def test_pairs_just_over_the_threshold_become_candidates():
    r = random.Random(11)
    n, ts = 1000, []
    for k in range(n):
        w = ["w%d" % r.randrange(10**6) for _ in range(P + 4)]
        at = r.randrange(4, P)
        ts += [w, [*w[:at], f"new{k}", *w[at + 1 :]]]
    assert similar(runs(ts[0])[0], runs(ts[1])[0])
    s, ends, _ = passages.shingles([" ".join(t).encode() for t in ts], passages._WordHash())
    rec = passages.compact_windows(s, ends, np.arange(2 * n), np.zeros(2 * n, np.uint32), P, passages.HASHES)
    key = np.zeros((2 * n, passages.HASHES), np.uint64)
    key[rec["doc"], (rec["key"] & np.uint64(7)).astype(int)] = rec["key"]
    lost = ((key[::2] == key[1::2]).sum(axis=1) < passages.ENOUGH).sum()
    assert lost <= 0.005 * n


class CountedHash(passages._WordHash):
    """The cache of words' hashes with the words it was asked for."""

    def __init__(self):
        self.asked = []

    def __getitem__(self, w):
        self.asked.append(w)
        return super().__getitem__(w)


def test_words_are_hashed_in_arrays_not_one_by_one():
    """Of 3,000 words only those of 32 bytes and more may be looked up one at a time; all have their XXH64."""
    r = random.Random(12)
    ws = [bytes(r.choice(b"abcXYZ09\xc3\xa9") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    gaps = [r.choice([b" ", b"\n", b"\t \r", b"\x0b\x0c"]) for _ in ws]
    texts = [b"", b" \n ", None] + [b"".join(x for k in range(a, a + 100) for x in (gaps[k], ws[k])) + b" " * (a % 3) for a in range(0, 3000, 100)]
    low = [w.translate(passages._LOWER) for w in ws]
    cache = CountedHash()
    s, ends, counts = passages.shingles(texts, cache)
    assert sorted(cache.asked) == sorted(w for w in low if len(w) >= 32)
    assert counts.tolist() == [0, 0, 0] + [100] * 30 and ends.tolist() == [0, 0, 0] + [96 * k for k in range(1, 31)]
    x = [xxhash.xxh64_intdigest(w, 5) for w in low]
    power = [0x9E3779B97F4A7C15**k for k in (4, 3, 2, 1, 0)]
    want = [sum(p * h for p, h in zip(power, x[a + k : a + k + 5])) % 2**64 for a in range(0, 3000, 100) for k in range(96)]
    assert s.tolist() == passages.mixed(np.array(want, np.uint64)).tolist()


@pytest.mark.parametrize("passage", [8, P])
def test_windows_are_the_runs_of_one_smallest_hash(passage):
    """Each run stands in one window of each function, that of its smallest hash."""
    r = np.random.default_rng(13)
    sizes = [0, 3, passage - 1, passage, passage + 1, 300]
    s, ends = r.integers(0, 1 << 63, sum(sizes)).astype(np.uint64), np.cumsum(sizes)
    s[-200:-150] = s[-100:-50]
    rec = passages.compact_windows(s, ends, np.arange(len(sizes)), np.zeros(len(sizes), np.uint32), passage, 3)
    got = Counter((int(x["doc"]), int(x["key"]) & 7, int(x["c"]), w) for x in rec for w in range(int(x["c"]) - int(x["back"]), int(x["c"]) - int(x["back"]) + int(x["n"])))
    want = Counter()
    for f in range(3):
        g = passages.mixed(s ^ np.uint64(0x51_7C_C1_B7_27_22_0A_95 * (f + 1) % (1 << 64)))
        for d, (n, end) in enumerate(zip(sizes, ends.tolist())):
            for w in range(n - passage + 1):
                want[d, f, min(range(w, w + passage), key=lambda k: (int(g[end - n + k]) >> 28, k)), w] += 1
    assert got == want


@pytest.mark.parametrize("longer", [0, 49])
def test_cuts_merge_like_spans_one_by_one(longer):
    r = random.Random(longer)
    lists = [[{"start": r.randrange(300), "n": r.randint(1, 40)} for _ in range(r.choice([0, 1, 2, 9]))] for _ in range(200)]
    made = pa.array([[{"start": 1, "n": 1}], *lists], pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int32())])))[1:]
    spans, words, n_spans = passages.merged_cuts(made, longer)
    want = [merge_spans([c["start"] for c in x], [c["n"] + longer for c in x]) for x in lists]
    assert [[(x["start"], x["end"]) for x in one] for one in spans.to_pylist()] == want
    assert words.tolist() == [sum(e - s for s, e in x) for x in want] and n_spans.tolist() == list(map(len, want))
    assert all(len(x) == 0 for x in passages.merged_cuts(made[:0], longer))
