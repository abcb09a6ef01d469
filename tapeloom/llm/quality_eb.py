"""Quality by hierarchical empirical Bayes: document evidence with host and path posteriors.

A logistic model gives each document a probability of being good.  These soft
votes are summed per path, host and over all (grouped aggregation, pre-summed in
each task).  A beta prior with the global mean, whose strength is estimated
from the spread between hosts by the method of moments, shrinks sparse hosts; the
host's posterior is in turn the prior of its paths.  A document's own vote is left out of its
site's sums.  Its final log-odds are its own plus the shift of its path's posterior from the global mean.

The model is fitted on at most ``max_labelled`` labelled rows; every sum is over all documents.
Sites are joined by key: one row per site, so a hot site is one large key
that adaptive execution can split.  Nulls: a null text has the features of an
empty one; a null host or path is a site of its own.  Without labels every document has the base rate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.linear_text import MAX_LABELLED, _Ids, featurise, fit, labelled_features, sigmoid
from tapeloom.llm.util import raw_texts, slices, staged


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def prior_strength(n: float, n2: float, groups: float, between: float, mean: float) -> float:
    """Beta prior strength from the spread of group means around ``mean``.

    n, n2: sums of group sizes and their squares; between: sum of n_g (p_g - mean)^2.
    """
    unit = max(mean * (1 - mean), 1e-9)
    room = n - n2 / max(n, 1) - (groups - 1)
    rho = (between / unit - (groups - 1)) / room if room > 0 else 0.0
    rho = min(max(rho, 1e-3), 0.9)
    return 1 / rho - 1


def with_site_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: Column,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: float = 0.5,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """(id, p_document, p_host, p_path, p_quality, kept) of every row."""
    ids, rows, dense, y = labelled_features(docs, labels, id_col, text, {"good": label}, max_labelled)
    model = fit(rows, dense, np.zeros((len(rows), 0)), y["good"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_WORDS weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = _Ids(), shared.value
        table, none = m.table(), np.zeros(0)
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                p = [float(sigmoid(m.score(table, w, np.array(d), none))) for w, d in featurise(raw_texts(part, "_text"), cache)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(p, pa.float64())], names=["_id", "_host", "_path", "_p"])

    raw = docs.select(F.col(id_col).alias("_id"), F.to_json(F.struct(host.alias("h"))).alias("_host"), F.to_json(F.struct(host.alias("h"), path.alias("p"))).alias("_path"), F.col(text).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = staged(raw.mapInArrow(run, f"_id {kind}, _host string, _path string, _p double"), "site-votes")
    paths = staged(scored.groupBy("_host", "_path").agg(F.sum("_p").alias("_s"), F.count("*").alias("_n")), "site-paths")
    hosts = paths.groupBy("_host").agg(F.sum("_s").alias("_hs"), F.sum("_n").alias("_hn"))
    whole = paths.agg(F.sum("_s"), F.sum("_n")).first()
    n = float(whole[1] or 0)
    mean = (float(whole[0] or 0) + 0.5) / (n + 1)

    def moments(groups: DataFrame, size: str, rate: Column, around: Column) -> tuple[float, ...]:
        r = groups.agg(F.sum(size), F.sum(F.col(size).cast("double") ** 2), F.count("*"), F.sum(F.col(size) * (rate - around) ** 2)).first()
        return tuple(float(x or 0) for x in r)

    k_host = prior_strength(*moments(hosts, "_hn", F.col("_hs") / F.col("_hn"), F.lit(mean)), mean)
    both = paths.join(hosts, "_host")
    k_path = prior_strength(*moments(both, "_n", F.col("_s") / F.col("_n"), F.col("_hs") / F.col("_hn")), mean)

    # A hot path makes one large join key; adaptive execution can split this join.
    d = scored.join(both.drop("_host"), "_path")
    p_host = (F.lit(k_host * mean) + F.col("_hs") - F.col("_p")) / (F.lit(k_host) + F.col("_hn") - 1)
    p_path = (F.lit(k_path) * F.col("p_host") + F.col("_s") - F.col("_p")) / (F.lit(k_path) + F.col("_n") - 1)
    d = d.withColumn("p_host", p_host).withColumn("p_path", p_path)
    odds = _logit(F.col("_p")) + _logit(F.col("p_path")) - _logit(F.lit(mean))
    d = d.withColumn("p_quality", 1 / (1 + F.exp(-odds)))
    return d.select(F.col("_id").alias(id_col), F.col("_p").alias("p_document"), "p_host", "p_path", "p_quality", (F.col("p_quality") >= threshold).alias("kept"))
