import hashlib
import random

import numpy as np
import pytest

from tapeloom.llm import suffix_dedup as sd


def brute(rows, length):
    """rows: (id, text) in id order; every window of bytes against all earlier ones."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [say(r.randint(15, 80)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = say(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            if r.random() < 0.3:
                k = r.randrange(len(p))
                p = p[:k] + "X" + p[k + 1 :]
            t += " " + p + " " + say(r.randint(0, 20))
        if rows and r.random() < 0.15:
            t = r.choice(rows)[1]
        rows.append((i * 3, t))
    rows += [(1000, None), (1001, ""), (1002, "ab" * 300), (1003, "x" * 400), (1004, say(4000) + shared[0])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # many segments and small reductions
        monkeypatch.setattr(sd, "SEGMENT", 512)
        monkeypatch.setattr(sd, "SORT_ROWS", 200)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df).collect()}
    assert got == brute(rows, 100)


def test_shorter_length_and_texts(spark):
    rows = corpus(5, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in sd.remove_repeats(df, length=40, gram=10).collect()}
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in out.items()} == brute(rows, 40)
    assert all(hashlib.sha256(r.kept_text).hexdigest() == r.kept_sha256 for r in out.values())


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, long, 1), (7, long, 2), (7, long, 3), (8, "other", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in sd.remove_repeats(df).collect())
    n = len(long)
    assert out == [(False, 0, 0), (True, 7, n), (True, 7, n), (True, 8, 0)]


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_sort_orders_and_survives_collisions(monkeypatch):
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    at = np.sort(r.choice(2900, 500, replace=False))
    for weak in (False, True):
        if weak:  # every hash equal: only the bytes decide
            monkeypatch.setattr(sd.PrefixHash, "of", lambda self, s, e: np.zeros(len(s), np.uint64))
        order, equal = sd.SuffixSort(data, 12).sort(at, np.zeros(len(at), np.int64))
        texts = [data[at[o] : at[o] + 12].tobytes() for o in order]
        groups = {}
        for o in range(len(at)):
            groups.setdefault(data[at[o] : at[o] + 12].tobytes(), []).append(o)
        assert sorted(texts) == texts
        assert {int(o) for o, e in zip(order, equal) if not e} == {g[0] for g in groups.values()}
