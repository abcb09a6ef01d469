"""Toxicity by a classifier chain.

Categories are predicted in order.  Each has a linear model over words, text
figures and the log-odds of all earlier categories.  For training, the earlier log-odds are
out-of-fold predictions, so a later model sees earlier ones as wrong as they
will be on new text.

Models are fitted in one task on at most ``max_labelled`` labelled rows.  A null or empty text
has the base probability.  Without labels, or with labels of one class only, every text has the
(smoothed) base rate.  Further columns pass through ``with_toxicity``; one with the name of a result is
called ``<name>_in``.  Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.linear_text import MAX_LABELLED, Logistic, _Ids, featurise, fit, folds_of, labelled_rows, predict, sigmoid, training_set
from tapeloom.llm.util import aside, discard, raw_texts, slices, staged

FOLDS = 4
THRESHOLD = 0.5


def fit_chain(ids: list, rows: list[np.ndarray], dense: np.ndarray, targets: dict[str, np.ndarray], folds: int = FOLDS) -> tuple[list[Logistic], dict[str, np.ndarray]]:
    """One model per category in order, and the out-of-fold log-odds of each."""
    fold = folds_of(ids, folds)
    earlier = np.zeros((len(rows), 0))
    chain, held_out = [], {}
    for name, y in targets.items():
        oof = np.zeros(len(rows))
        for f in range(folds):
            out = np.flatnonzero(fold == f)
            inn = np.flatnonzero(fold != f)
            m = fit([rows[i] for i in inn], dense[inn], earlier[inn], y[inn])
            oof[out] = predict(m, [rows[i] for i in out], dense[out], earlier[out])
        chain.append(fit(rows, dense, earlier, y))
        held_out[name] = oof
        earlier = np.column_stack([earlier, np.clip(oof, -8, 8)])
    return chain, held_out


def chain_of(rows: DataFrame, targets: list[str], folds: int = FOLDS) -> list[Logistic]:
    """``fit_chain`` of ``labelled_rows`` in one task: the driver gets the models only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_chain(*training_set(found, targets), folds)[0])], pa.binary())], names=["chain"])

    rows = staged(rows, "labelled")  # else the one task would make the features too
    chain = rows.coalesce(1).mapInArrow(run, "chain binary").first()[0]
    discard(rows)
    return pickle.loads(chain)


def score_chain(chain: list[Logistic], tables: list[np.ndarray], ids: np.ndarray, dense: np.ndarray) -> list[float]:
    """Probabilities of all categories of one text, each fed to the later ones."""
    scores: list[float] = []
    for m, table in zip(chain, tables):
        scores.append(m.score(table, ids, dense, np.clip(np.array(scores), -8, 8)))
    return [float(sigmoid(s)) for s in scores]


def with_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    id_col: str = "doc_id",
    text: str = "text",
    reject: str | None = None,
    threshold: float = THRESHOLD,
    max_labelled: int = MAX_LABELLED,
    folds: int = FOLDS,
) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category, ``toxic`` and ``kept``.

    ``categories``: 0/1 columns of ``labels`` in chain order; ``reject`` (the last by default) decides ``toxic``.
    """
    names = list(categories)
    reject = reject or names[-1]
    chain = chain_of(labelled_rows(docs, labels, id_col, text, categories, max_labelled), names, folds)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most MAX_WORDS weights a category

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, models = _Ids(), shared.value
        tables = [m.table() for m in models]
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                p = [score_chain(models, tables, w, np.array(d)) for w, d in featurise(raw_texts(part, "_text"), cache)]
                rest = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, pa.float64()) for c in zip(*p))], names=[*(f"_c{i}" for i in range(len(rest))), *(f"_p{i}" for i in range(len(names)))])

    own = aside(docs, [*(f"p_{n}" for n in names), "toxic", "kept"]).columns
    carried = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col(text).cast("string").alias("_text"))
    kinds = T.StructType([T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [T.StructField(f"_p{i}", T.DoubleType()) for i in range(len(names))])
    out = carried.mapInArrow(run, kinds)
    made = out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], *[F.col(f"_p{i}").alias(f"p_{n}") for i, n in enumerate(names)])
    return made.withColumn("toxic", F.col(f"p_{reject}") >= threshold).withColumn("kept", ~F.col("toxic"))
