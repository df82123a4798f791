"""Quality rules: fixed rules first, then robust multivariate outliers per language and source.

Every text is reduced to counts and a vector of six transformed statistics. Each (language, source) group
gets a minimum-covariance-determinant estimate in the manner of FAST-MCD (Rousseeuw and Van Driessen, 1999):

1. Starts. Random subsets of seven vectors, improved on a sample of ``SAMPLE`` different vectors of the
   group (chosen by hash), give the ``BEST`` candidates of least determinant; median and quartiles give one more.
2. Concentration over all rows: distances under a candidate's centre and covariance, the group's h-quantile
   of them, then centre and covariance of the rows below it. After two steps the candidate of the least
   determinant goes on until determinants settle.
3. Reweighting: centre and covariance anew from all rows within the chi-square quantile of 0.975.

A row is rejected where the logarithm of its squared distance lies ``MADS`` robust standard deviations
(1.4826 times the median absolute deviation, over all rows) above the median, and above the chi-square
quantile of 0.999: ratios of short texts have heavier tails than a normal vector, and the corpus says how heavy.

A concentration step is two mergeable aggregates over the compact statistics table, so a hot group costs its
rows once and sends one partial sum per task. Centres and covariances stay a table that is joined; the
planner broadcasts it when its files are small. Groups with fewer than ``min_rows`` rows are pooled by
language, and what is still too small is pooled over all.

Defined cases: a null or empty text has no words and fails the base rules. A null language or source is a
value of its own. Rows of a pool that stays under ``min_rows`` keep the verdict of the base rules. Repeated
rows are judged each. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import release_memory, write_table

SYMBOLS = "#*$%&|<>"
VECTOR = ["v0", "v1", "v2", "v3", "v4", "v5"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_marks long, n_chars long"
#: Pseudo-counts (words, characters, lines) that draw short texts to the corpus mean, so that their ratios don't scatter more.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 60.0, 300.0, 8.0
#: Different vectors of a group that starts are searched on, random starts, candidates that concentrate over all rows.
SAMPLE, STARTS, BEST = 600, 50, 2
MADS = 3.0
#: Standard deviations below which a statistic is taken as constant.
FLOOR = (0.03, 0.03, 0.03, 0.08, 0.10, 0.03)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    coded = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size = len(ids)
    if size == len(words):
        return 0
    key = coded[:n].copy()
    span = size
    for k in range(1, width):
        if span > (1 << 62) // size:  # the windows so far get numbers below n again
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            span = n
        key = key * size + coded[k : k + n]
        span *= size
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _classes() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        table[c] = 1 if ch.isupper() else 2 if ch.isalpha() else 3 if ch.isspace() else 4
    return table


def _count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    table, names = _classes(), [x.split()[0] for x in COUNTED.split(", ")]
    for batch in texts:
        rows = []
        for text in batch:
            text = text or ""
            raw = text.encode("utf-8")
            words = raw.split()  # the six ASCII white spaces part words
            blanks = sum(raw.count(b) for b in b" \t\n\v\f\r")
            lines = [x for x in raw.split(b"\n") if x.strip()]
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            kinds = np.bincount(table[np.minimum(codes, 0xFFFF)], minlength=5)
            rows.append((len(words), len(text) - blanks, sum(raw.count(s) for s in SYMBOLS.encode()), len(lines) - len(set(lines)), repeated_words(words), len(lines), kinds[1], kinds[1] + kinds[2], kinds[4], len(text)))
        yield pd.DataFrame(rows, columns=names, dtype="int64")
    release_memory()


def text_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with the column ``_q``: language, source and counts of the text."""
    counted = docs.withColumn("_q", F.pandas_udf(_count, COUNTED)(F.col(text_col)))
    names = [x.split()[0] for x in COUNTED.split(", ")]
    return counted.withColumn("_q", F.struct(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), *[F.col(f"_q.{n}").alias(n) for n in names]))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


RATIOS = [("word_chars", "n_words"), ("n_symbols", "n_chars"), ("n_upper", "n_letters"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_marks", "n_chars")]
PRIORS = [PRIOR_WORDS, PRIOR_CHARS, PRIOR_CHARS, PRIOR_WORDS, PRIOR_LINES, PRIOR_CHARS]


def _means(stats: DataFrame) -> list[float]:
    """The corpus mean of each ratio over the rows that pass the base rules."""
    sums = [(F.sum(a) / F.greatest(F.sum(b), F.lit(1))).alias(f"m{i}") for i, (a, b) in enumerate(RATIOS)]
    return [m or 0.0 for m in stats.where(~base_failed()).agg(*sums).first()]


def _vectors(mean: list[float]) -> dict[str, Column]:
    """Ratios drawn to their means, then logarithm or arcsine root."""

    def drawn(i: int) -> Column:
        return (F.col(RATIOS[i][0]) + PRIORS[i] * mean[i]) / (F.col(RATIOS[i][1]) + PRIORS[i])

    def root(i: int) -> Column:
        return F.asin(F.sqrt(F.least(F.greatest(drawn(i), F.lit(0.0)), F.lit(1.0))))

    return {"v0": F.log(F.greatest(drawn(0), F.lit(1e-6)))} | {f"v{i}": root(i) for i in range(1, 6)}


def _pooled(rows: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source) -> group, by the number of rows."""
    n = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.col("n") >= min_rows
    by_lang = n.where(~own).groupBy("lang").agg((F.sum("n") >= min_rows).alias("_pool"))
    n = n.join(by_lang.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left")
    name = F.when(own, F.to_json(F.struct("lang", "source"))).when(F.col("_pool"), F.to_json(F.struct("lang"))).otherwise("all")
    return write_table(n.select("lang", "source", name.alias("grp")), "groups")


def _distance(k: int) -> Column:
    d = [F.col(VECTOR[i]) - F.col(f"c{i}") for i in range(k)]
    return sum((F.col(f"p{i}_{j}") * d[i] * d[j] * (1 if i == j else 2) for i in range(k) for j in range(i, k)), F.lit(0.0))


PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]
FIT = "grp string, start int, rows long, logdet double, fell double, " + ", ".join([f"c{i} double" for i in range(len(VECTOR))] + [f"p{i}_{j} double" for i, j in PAIRS])


def _estimates(out: pd.DataFrame, centre: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """``out`` (grp, start, rows) with centres, inverse covariances and their determinants; no statistic's deviation is taken below its floor."""
    k = len(VECTOR)
    cov = cov.copy()
    cov[:, range(k), range(k)] = np.maximum(cov[:, range(k), range(k)], 0) + np.square(FLOOR)
    inverse = np.linalg.inv(cov)
    logdet = np.linalg.slogdet(cov)[1]
    more = {"logdet": logdet, "fell": out["before"].to_numpy(float) - logdet if "before" in out else np.full(len(out), math.inf)} | {f"c{i}": centre[:, i] for i in range(k)} | {f"p{i}_{j}": inverse[:, i, j] for i, j in PAIRS}
    return out.assign(**more)[[x.split()[0] for x in FIT.split(", ")]]


def _inverted(moments: DataFrame, groups: int) -> DataFrame:
    """Estimates from one row of moments a group and start."""
    k = len(VECTOR)

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["rows"].to_numpy(float)
            mean = b[[f"s{i}" for i in range(k)]].to_numpy() / n[:, None]
            cov = np.zeros((len(b), k, k))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = b[f"s{i}_{j}"] / n - mean[:, i] * mean[:, j]
            yield _estimates(b[["grp", "start", "rows", "before"]], mean + b[[f"o{i}" for i in range(k)]].to_numpy(), cov)

    return write_table(moments.mapInPandas(invert, FIT), "mcd", rows=groups)


def _moments(rows: DataFrame) -> DataFrame:
    """Sums and products around the group's present centre (columns c0..)."""
    k = len(VECTOR)
    d = [F.col(VECTOR[i]) - F.col(f"c{i}") for i in range(k)]
    sums = [F.sum(d[i]).alias(f"s{i}") for i in range(k)] + [F.sum(d[i] * d[j]).alias(f"s{i}_{j}") for i, j in PAIRS]
    return rows.groupBy("grp", "start").agg(F.count("*").alias("rows"), F.first("logdet").alias("before"), *sums, *[F.first(f"c{i}").alias(f"o{i}") for i in range(k)])


def concentrated(x: np.ndarray, w: np.ndarray, centre: np.ndarray, cov: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """One concentration step: centre and covariance of the nearest rows that have the part ``h`` of the weight."""
    d = x - centre
    order = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov + np.diag(np.square(FLOOR))), d), kind="stable")
    near = order[: np.searchsorted(np.cumsum(w[order]), h * w.sum()) + 1]
    total = w[near].sum()
    centre = w[near] @ x[near] / total
    d = x[near] - centre
    return centre, (d * w[near, None]).T @ d / total


def best_starts(x: np.ndarray, w: np.ndarray, h: float, seed: int, starts: int = STARTS, best: int = BEST) -> list[tuple[np.ndarray, np.ndarray]]:
    """The candidates of least determinant that random subsets lead to."""
    rng, k = np.random.default_rng(seed), x.shape[1]
    det = lambda f: np.linalg.slogdet(f[1] + np.diag(np.square(FLOOR)))[1]
    found = []
    for _ in range(starts):
        own = x[rng.choice(len(x), min(len(x), k + 1), replace=False)]
        fit = own.mean(axis=0), np.cov(own.T, bias=True).reshape(k, k)
        for _ in range(2):
            fit = concentrated(x, w, *fit, h)
        found.append(fit)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for fit in sorted(found, key=det)[: 3 * best]:
        before = math.inf
        while det(fit) < before - 1e-6:
            before, fit = det(fit), concentrated(x, w, *fit, h)
        out.append(fit)
    out.sort(key=det)
    kept = out[:1]
    for fit in out[1:]:
        if len(kept) < best and min(abs(det(fit) - det(f)) for f in kept) > 1e-3:
            kept.append(fit)
    return kept


def chi2_quantile(q: float, k: int) -> float:
    def below(x: float) -> float:
        a, x = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < q else (low, mid)
    return low


def _candidates(rows: DataFrame, sizes: DataFrame, h: float, groups: int) -> DataFrame:
    """First estimates of each group: by quartiles (start 0), and by random subsets of a sample of its different vectors."""
    k = len(VECTOR)
    quartiles = rows.join(_small(sizes.select("grp"), groups), "grp", "left_semi").groupBy("grp").agg(F.count("*").alias("rows"), *[F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q_{v}") for v in VECTOR])
    spread = [F.greatest((F.col(f"q_{v}")[2] - F.col(f"q_{v}")[0]) / 1.349, F.lit(FLOOR[i])) for i, v in enumerate(VECTOR)]
    inverse = [(1 / (spread[i] * spread[i]) if i == j else F.lit(0.0)).alias(f"p{i}_{j}") for i, j in PAIRS]
    plain = quartiles.select("grp", F.lit(0).alias("start"), "rows", F.lit(math.inf).alias("logdet"), F.lit(math.inf).alias("fell"), *[F.col(f"q_{v}")[1].alias(f"c{i}") for i, v in enumerate(VECTOR)], *inverse)

    place = F.pmod(F.xxhash64(F.lit(5), "grp", *VECTOR), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(_small(sizes, groups), "grp").where(place < F.lit(float(SAMPLE)) / F.col("different")).groupBy("grp", *VECTOR).agg(F.count("*").alias("w"))

    def search(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(VECTOR)
        x, w = b[VECTOR].to_numpy(float), b["w"].to_numpy(float)
        fits = best_starts(x, w, h, zlib.crc32(key[0].encode()))
        out = pd.DataFrame({"grp": [key[0]] * len(fits), "start": np.arange(1, len(fits) + 1, dtype="int32"), "rows": len(b)})
        return _estimates(out, np.array([c for c, _ in fits]), np.array([v for _, v in fits]))

    return write_table(plain.unionByName(some.groupBy("grp").applyInPandas(search, FIT)), "mcd", rows=groups)


def mcd(rows: DataFrame, h: float = 0.75, steps: int = 12, min_rows: int = 50) -> DataFrame:
    """One row per group of ``min_rows`` rows or more: grp, start (0: quartiles won), rows, logdet, centre c*, inverse covariance p*_*, and ``scale``, which makes squared distances chi-square like at the median."""
    k, by = len(VECTOR), ["grp", "start"]
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*VECTOR)).alias("different"))
    sizes = write_table(sizes.where(F.col("n") >= min_rows), "sizes")
    groups = sizes.count()
    fit = _candidates(rows, sizes, h, groups)

    def at(f: DataFrame) -> DataFrame:
        return rows.join(_small(f.drop("rows"), groups * (BEST + 1)), "grp").withColumn("d2", _distance(k))

    def quantile(f: DataFrame, q: float) -> DataFrame:
        return write_table(at(f).groupBy(*by).agg(F.percentile_approx("d2", q, 5000).alias("cut")), "cut", rows=groups)

    for step in range(steps):
        after = _inverted(_moments(at(fit).join(_small(quantile(fit, h), groups * (BEST + 1)), by).where(F.col("d2") <= F.col("cut"))), groups)
        if step == 1:  # the candidate of the least determinant goes on
            won = after.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
            after = write_table(after.join(_small(won, groups), by), "mcd", rows=groups)
        fit = after
        if step > 1 and (fit.agg(F.max(F.abs("fell"))).first()[0] or 0.0) < 0.01:
            break
    # reweighting: all rows that are near by the chi-square quantile, distances being scaled at their h-quantile
    scaled = at(fit).join(_small(quantile(fit, h), groups), by).where(F.col("d2") * chi2_quantile(h, k) <= F.greatest("cut", F.lit(1e-12)) * chi2_quantile(0.975, k))
    fit = _inverted(_moments(scaled), groups)
    scale = F.lit(chi2_quantile(0.5, k)) / F.greatest("cut", F.lit(1e-12))
    return write_table(fit.join(_small(quantile(fit, 0.5), groups), by).withColumn("scale", scale).drop("cut", "fell"), "fit", rows=groups)


def distance_limit(far: DataFrame, mads: float = MADS) -> float:
    """The squared distance beyond which a row is rejected; ``far``: column distance."""
    logs = far.where("distance is not null").select(F.log(F.greatest("distance", F.lit(1e-9))).alias("x"))
    middle = logs.agg(F.percentile_approx("x", 0.5, 10_000)).first()[0]
    if middle is None:
        return math.inf
    deviation = logs.agg(F.percentile_approx(F.abs(F.col("x") - middle), 0.5, 10_000)).first()[0]
    return max(math.exp(min(700.0, middle + mads * 1.4826 * deviation)), chi2_quantile(0.999, len(VECTOR)))


def _small(table: DataFrame, rows: int | None = None, most: int = 20_000) -> DataFrame:
    """A written table, marked for broadcast if it has few rows; beyond that the planner joins it by a shuffle. ``rows``: a known bound."""
    return F.broadcast(table) if (table.limit(most + 1).count() if rows is None else rows) <= most else table


def _fitted(stats: DataFrame, h: float, min_rows: int, mads: float) -> tuple[list[float], DataFrame, DataFrame, DataFrame, float]:
    """Means, groups, rows with their vectors, the estimates, and the limit of the squared distance."""
    mean = _means(stats)
    good = stats.where(~base_failed()).withColumns(_vectors(mean))
    groups = _small(_pooled(good, min_rows))
    rows = write_table(_grouped(good, groups).select("doc_id", "grp", *COUNTS, *VECTOR), "vectors")
    fit = _small(mcd(rows, h, min_rows=min_rows).drop("rows", "start", "logdet"))
    limit = distance_limit(rows.join(fit, "grp").select((F.col("scale") * _distance(len(VECTOR))).alias("distance")), mads)
    return mean, groups, rows, fit, limit


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    named = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "grp")
    return rows.join(named, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")


def _stats(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return write_table(text_counts(docs, text_col, lang_col, source_col).select(F.col(id_col).cast("long").alias("doc_id"), "_q.*"), "stats")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the five counts and base_failed of every row."""
    return _stats(docs, id_col, text_col, lang_col, source_col).select("doc_id", *COUNTS, base_failed().alias("base_failed"))


def judge(docs: DataFrame, h: float = 0.75, min_rows: int = 50, mads: float = MADS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the five counts, base_failed, kept, distance (squared, scaled; null where the base rules failed or no estimate exists)."""
    stats = _stats(docs, id_col, text_col, lang_col, source_col)
    _, _, rows, fit, limit = _fitted(stats, h, min_rows, mads)
    far = F.col("scale") * _distance(len(VECTOR))
    passed = rows.join(fit, "grp", "left").select("doc_id", *COUNTS, F.lit(False).alias("base_failed"), F.coalesce(far <= limit, F.lit(True)).alias("kept"), far.alias("distance"))
    failed = stats.where(base_failed()).select("doc_id", *COUNTS, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return passed.unionByName(failed)


def keep_good(docs: DataFrame, h: float = 0.75, min_rows: int = 50, mads: float = MADS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps; same columns. Texts are counted a second time rather than shuffled to their verdicts."""
    mean, groups, _, fit, limit = _fitted(_stats(docs, id_col, text_col, lang_col, source_col), h, min_rows, mads)
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col), F.col(text_col), F.col(lang_col), F.col(source_col))
    rows = text_counts(held, text_col, lang_col, source_col).select("_row", "_q.*").where(~base_failed()).withColumns(_vectors(mean))
    judged = _grouped(rows, groups).join(fit, "grp", "left")
    return judged.where(F.coalesce(F.col("scale") * _distance(len(VECTOR)) <= limit, F.lit(True))).select("_row.*")
