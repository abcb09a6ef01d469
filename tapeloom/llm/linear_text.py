"""Hashed-word logistic models for the text classifiers: features, selection and training.

Models are fitted from a bounded sample of labelled rows (``MAX_LABELLED``);
scoring runs in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.decontam import words
from tapeloom.llm.util import raw_texts, slices, staged

#: The most labelled rows a model is fitted on, chosen by the hash of their id.
MAX_LABELLED = 20_000
HASH_BITS = 20
#: Least absolute z score and count of a word to become a feature, and the most words that do.
MIN_Z, MIN_COUNT, MAX_WORDS = 4.0, 4, 256
N_DENSE = 7
_SYMBOLS = bytes(range(256)).translate(None, b"#*$%&|<>!")
_NOT_UPPER = bytes(range(256)).translate(None, bytes(range(65, 91)))


class _Ids(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[w] = x = xxhash.xxh32_intdigest(w) & ((1 << HASH_BITS) - 1)
        return x


def dense_features(text: bytes | None, ws: list[bytes], distinct: int) -> list[float]:
    """Length, symbols, capitals, variety, word length and line repetition of a text."""
    raw = text or b""
    n, size = max(len(ws), 1), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(len(ws)) / 10,
        min(len(raw.translate(None, _SYMBOLS)) / n, 3.0),
        len(raw.translate(None, _NOT_UPPER)) / size * 2,
        distinct / n,
        distinct / n * np.log1p(len(ws)) / 5,
        min(size / n, 30.0) / 10,
        1 - len(set(lines)) / max(len(lines), 1),
    ]


def featurise(texts: Iterable[bytes | None], ids: _Ids) -> Iterator[tuple[np.ndarray, list[float]]]:
    """(hashed distinct words, dense features) of each text; a null text has none."""
    for t in texts:
        ws = words(t)
        own = set(ws)
        yield np.fromiter(map(ids.__getitem__, own), np.int32, len(own)), dense_features(t, ws, len(own))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Weights of chosen hashed words, dense features and earlier probabilities."""

    words: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    earlier: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << HASH_BITS)
        out[self.words] = self.weights
        return out

    def score(self, table: np.ndarray, ids: np.ndarray, dense: np.ndarray, earlier: np.ndarray) -> float:
        return float(table[ids].sum() + dense @ self.dense + earlier @ self.earlier + self.bias)


def choose_words(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashed words whose presence differs most between the classes, by z score of two proportions."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    label = np.repeat(y, [len(r) for r in rows])
    k1 = np.bincount(flat[label], minlength=1 << HASH_BITS)
    k = np.bincount(flat, minlength=1 << HASH_BITS)
    p = k / len(y)
    z = np.abs(k1 / n1 - (k - k1) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[k < MIN_COUNT] = 0
    best = np.argsort(-z, kind="stable")[:MAX_WORDS]
    return np.sort(best[z[best] >= MIN_Z])


def fit(rows: list[np.ndarray], dense: np.ndarray, earlier: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 12) -> Logistic:
    """Ridge logistic regression by Newton steps on the chosen words; one class only gives the smoothed base rate."""
    pos, n = int(y.sum()), len(y)
    base = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    if not pos or pos == n:
        return Logistic(np.zeros(0, np.int64), np.zeros(0), np.zeros(N_DENSE), np.zeros(earlier.shape[1]), base)
    chosen = choose_words(rows, y)
    x = np.zeros((n, len(chosen) + N_DENSE + earlier.shape[1] + 1))
    for i, r in enumerate(rows):
        if len(chosen):
            at = np.searchsorted(chosen, r)
            at[at == len(chosen)] = 0
            x[i, at[chosen[at] == r]] = 1
    x[:, len(chosen) : len(chosen) + N_DENSE] = dense
    x[:, len(chosen) + N_DENSE : -1] = earlier
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    w[-1] = base
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = np.diag(penalty)
        for at in range(0, n, 4096):  # no second copy of all rows
            part, weight = x[at : at + 4096], (p * (1 - p))[at : at + 4096]
            hessian += (part.T * weight) @ part
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    a, b = len(chosen), len(chosen) + N_DENSE
    return Logistic(chosen, w[:a], w[a:b], w[b:-1], float(w[-1]))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, targets: dict[str, Column], limit: int = MAX_LABELLED) -> DataFrame:
    """(_id, words, dense, one 0/1 a target) of at most ``limit`` labelled documents.

    Labels with a null id or target are left out.  Of several labels of an id the smallest counts, target by
    target; of several texts the smallest.
    """
    names = [f"_y{i}" for i in range(len(targets))]
    known = labels.select(F.col(id_col).alias("_id"), *[t.cast("int").alias(n) for n, t in zip(names, targets.values())]).dropna()
    chosen = known.groupBy("_id").agg(*[F.min(n).alias(n) for n in names]).orderBy(F.xxhash64(F.lit("fit"), "_id"), "_id").limit(limit)
    chosen = staged(chosen, "chosen")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                rows = list(featurise(raw_texts(part, "_text"), ids))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([r.tobytes() for r, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.list_(pa.float64()))], names=["_id", "words", "dense"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))
    matched = rows.join(F.broadcast(chosen.select("_id")), "_id", "left_semi")  # at most ``limit`` ids
    matched = matched.groupBy("_id").agg(F.min("_text").alias("_text"))
    made = matched.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, words binary, dense array<double>")
    return made.join(F.broadcast(chosen), "_id").select("_id", "words", "dense", *names)


def training_set(found: list[tuple], targets: Iterable[str]) -> tuple[list, list[np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """(ids, rows, dense, {target: 0/1}) of ``labelled_rows``."""
    found.sort(key=lambda r: (r[0], r[1]))
    y = {t: np.array([r[3 + i] for r in found], bool) for i, t in enumerate(targets)}
    dense = np.array([r[2] for r in found], float).reshape(len(found), N_DENSE)
    return [r[0] for r in found], [np.frombuffer(r[1], np.int32) for r in found], dense, y


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text: str, targets: dict[str, Column], limit: int = MAX_LABELLED):
    """``training_set`` of the labelled documents, on the driver."""
    return training_set(labelled_rows(docs, labels, id_col, text, targets, limit).collect(), targets)


def folds_of(ids: list, k: int) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(str(i).encode()) % k for i in ids], np.int64)


def predict(model: Logistic, rows: list[np.ndarray], dense: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    table = model.table()
    return np.array([model.score(table, r, d, e) for r, d, e in zip(rows, dense, earlier)])
