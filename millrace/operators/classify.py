"""Diagonal-Gaussian classification with a reject class of fixed distance; conformal intervals."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaussian_posterior(df: DataFrame, key: list[str], features: list[str], signatures: DataFrame, label: str, reject_distance: float | None = None) -> DataFrame:
    """Posterior per row and class, long form (key, label, posterior). No shuffle: a row's scores are expressions over its own features.

    ``signatures``: label, feature, mean, var, one row per class and feature; classes times features are few and
    become literals. A missing feature adds nothing; a row without any gives no rows. The reject class stands at
    ``reject_distance`` standard deviations per feature from every class.
    """
    held: dict[str, dict[str, tuple[float, float]]] = {}
    for r in signatures.orderBy(label, "feature").collect():
        if r["feature"] in features:
            held.setdefault(r[label], {})[r["feature"]] = (float(r["mean"]), float(r["var"]))
    x = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    add = lambda terms: sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    score = {c: add(-0.5 * ((x[f] - m) * (x[f] - m) / v + math.log(v)) for f, (m, v) in own.items()) for c, own in held.items()}
    known = sum((x[f].isNotNull().cast("int") for f in features), F.lit(0))
    scores = [F.struct(F.lit(c).cast("string").alias(label), s.alias("score")) for c, s in score.items()]
    if reject_distance is not None and held:
        spread = F.least(*[add(F.when(x[f].isNotNull(), math.log(v)) for f, (_, v) in own.items()) for own in held.values()], F.lit(math.inf))
        scores.append(F.struct(F.lit("unknown").alias(label), (-0.5 * (known * float(reject_distance) ** 2 + spread)).alias("score")))
    if not scores:
        return df.select(*key, F.lit(None).cast("string").alias(label), F.lit(None).cast("double").alias("posterior")).where("false")
    rows = df.where(known > 0).select(*key, F.array(*scores).alias("_s")).withColumn("_top", F.array_max(F.transform("_s", lambda s: s["score"])))
    rows = rows.withColumn("_all", F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.exp(s["score"] - F.col("_top"))))
    return rows.select(*key, "_top", "_all", F.inline("_s")).select(*key, label, (F.exp(F.col("score") - F.col("_top")) / F.col("_all")).alias("posterior"))


def top_causes(posterior: DataFrame, key: list[str], label: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("posterior"), label)
    return posterior.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: Fixed value, which must match for equal results: past the last score, a quantile is the last score times this.
WIDEN = 1.5


def conformal_quantile(scores: DataFrame, by: list[str], score: str, alpha: float, widen: float = WIDEN) -> DataFrame:
    """Split-conformal quantile: the ceil((n + 1)(1 - alpha))-th smallest score; past the last one, the last times ``widen``."""
    w = Window.partitionBy(*by).orderBy(score)
    ranked = scores.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*by))})
    rank = F.ceil((F.col("_n") + 1) * (1 - alpha))
    at = F.least(rank, F.col("_n"))
    return ranked.where(F.col("_r") == at).select(*by, (F.col(score) * F.when(rank > F.col("_n"), widen).otherwise(1.0)).alias("q"), F.col("_n").alias("n"))


def adaptive_conformal(df: DataFrame, by: list[str], order: list[str], score: str, alpha: float, gamma: float, keep: int = 500, widen: float = WIDEN) -> DataFrame:
    """Adaptive conformal inference (Gibbs and Candes 2021): alpha moves after every label; (by, order, q, alpha_t, covered).

    The quantile of a row is taken over the scores before it, the last ``keep`` of them.
    """
    schema = df.select(*by, *order).schema.simpleString()[7:-1].replace(":", " ") + ", q double, alpha_t double, covered boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        level, ranked, out = alpha, [], []
        scores = pdf[score].tolist()
        for t, s in enumerate(scores):
            if t > keep:
                del ranked[bisect_left(ranked, scores[t - keep - 1])]
            if ranked:
                rank = math.ceil((len(ranked) + 1) * (1 - level))
                q = ranked[min(max(rank, 1), len(ranked)) - 1] * (widen if rank > len(ranked) else 1.0)
            else:
                q = math.inf
            covered = s <= q
            out.append((None if math.isinf(q) else q, level, covered))
            level = min(max(level + gamma * (alpha - (not covered)), 0.001), 0.999)
            insort(ranked, s)
        return pd.concat([pdf[[*by, *order]].reset_index(drop=True), pd.DataFrame(out, columns=["q", "alpha_t", "covered"])], axis=1)

    return df.groupBy(*by).applyInPandas(run, schema)


def interval(mean: Column, sd: Column, q: Column) -> Column:
    return F.struct((mean - q * sd).alias("low"), (mean + q * sd).alias("high"))
