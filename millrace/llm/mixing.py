"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic with their token weight. Raking multiplies
the cells by one factor per value of each dimension until every margin has its target share; a document
is then kept with its cell's calibrated probability, drawn from a hash of its id and the seed, so a rerun
or a lost executor gives the same sample. A kept document has weight 1, so the factors need a scale: the
least one at which cells that would need a probability above 1 (they get 1) fall short of the calibrated
tokens by at most ``slack`` (1 %) of all of them, and by at most that part of each value's own target
where a target is given. A rare cell so costs itself alone, unless a given target asks for it.

Cells are sums, combined before the shuffle, so a hot source costs its rows. Up to ``DRIVER_CELLS`` cells
(counted first) are raked on the driver; more are raked as a table, by the same steps, with the same
result.

Defined cases: a null source, language or topic is a value of its own. A null or empty text weighs one
token. A value without a target keeps its natural share among the values without one; targets of values
that do not occur are spread over the others. Repeated rows with the same id are kept or left together; a
null id is drawn by its text. An empty table gives an empty result. ``sample`` returns the input's columns
whatever their names; ``mix`` adds columns that begin with ``_mix``, which replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import release_memory, write_table

DIMS = ["source", "lang", "topic"]
DRIVER_CELLS = 200_000
NULL_VALUE = "\0null"
#: Powers that flatten the natural shares of dimensions without targets; 1 leaves them as they are.
POWERS = {"source": 0.9, "lang": 0.9, "topic": 1.0}
#: Part of the calibrated tokens that cells with a probability of 1 may fall short by; 0 scales by the largest factor.
SLACK = 0.01
Targets = Mapping[str, Mapping[str | None, float]] | None


WEIGHED = "tokens double, topic string"


def _weigh(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Token weight (words, counted by the gaps between them, at least one) and form topic of each text."""
    for batch in texts:
        tokens, topics = [], []
        for text in batch:
            raw = (text or "").encode("utf-8")
            breaks = raw.count(b"\n")
            words = raw.count(b" ") + raw.count(b"\t") + breaks + 1
            digits = sum(raw.count(d) for d in b"0123456789")
            tokens.append(float(words))
            topics.append("tiny" if words < 40 else "listing" if words < 6 * (breaks + 1) else "numeric" if 25 * digits > len(raw) else "long" if words > 1500 else "prose")
        yield pd.DataFrame({"tokens": tokens, "topic": topics})
    release_memory()


def weighed(text: Column) -> Column:
    """(tokens, topic). The topic is a stand-in from a text's form, for tables without a topic column: tiny, listing, numeric, long or prose."""
    return F.pandas_udf(_weigh, WEIGHED)(text)


def tempered(shares: Mapping[str | None, float], power: float) -> dict[str | None, float]:
    """Targets that flatten natural shares: share ** power, made to sum to one."""
    raised = {v: s**power for v, s in shares.items() if s > 0}
    total = sum(raised.values())
    return {v: s / total for v, s in raised.items()}


def _targets(given: Targets, natural: dict[str, dict[str, float]], power: Mapping[str, float]) -> dict[str, dict[str, float]]:
    out = {}
    for d in DIMS:
        share = natural[d]
        if given and d in given:
            want = {NULL_VALUE if k is None else k: v for k, v in given[d].items()}
            named = {v: want[v] for v in share if v in want}
            rest = {v: s for v, s in share.items() if v not in want}
            left = max(0.0, 1 - sum(named.values())) if rest else 0.0
            out[d] = named | {v: left * s / sum(rest.values()) for v, s in rest.items()}
        else:
            out[d] = tempered(share, power[d])
        total = sum(out[d].values()) or 1.0
        out[d] = {v: s / total for v, s in out[d].items()}
    return out


def rake(codes: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """A factor per cell so that the weighted tokens have the target share in every margin. ``codes``: cells x dimensions."""
    factor, total = np.ones(len(tokens)), tokens.sum()
    if not len(tokens):
        return factor
    for _ in range(rounds):
        off = 0.0
        for d, want in enumerate(targets):
            have = np.bincount(codes[:, d], weights=tokens * factor, minlength=len(want)) / total
            step = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            off = max(off, float(np.abs(have - want).max()))
            factor = factor * step[codes[:, d]]
        if off < tolerance:
            break
    return factor


def _rake_table(cells: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    """``rake`` on a table of cells; every round is written."""
    total = cells.agg(F.sum("_mix_tokens")).first()[0]
    now = cells.withColumn("_mix_factor", F.lit(1.0))
    for _ in range(rounds):
        off = 0.0
        for d in DIMS:
            have = now.groupBy(f"_mix_{d}").agg((F.sum(F.col("_mix_tokens") * F.col("_mix_factor")) / total).alias("_mix_have"))
            step = write_table(have.join(targets[d], f"_mix_{d}").withColumn("_mix_step", F.when(F.col("_mix_have") > 0, F.col("_mix_want") / F.col("_mix_have")).otherwise(0.0)), "step")
            off = max(off, step.agg(F.max(F.abs(F.col("_mix_have") - F.col("_mix_want")))).first()[0] or 0.0)
            now = now.join(step.select(f"_mix_{d}", "_mix_step"), f"_mix_{d}").withColumn("_mix_factor", F.col("_mix_factor") * F.col("_mix_step")).drop("_mix_step")
        now = write_table(now, "cells")
        if off < 1e-9:
            break
    return now


def _scale(above: Callable[[float], dict[object, tuple[float, float]]], slack: float) -> float:
    """The least scale at which no group's cells fall short by more than ``slack`` of the group's calibrated tokens.

    ``above(s)``: calibrated and natural tokens of each group's cells with a factor beyond s. The shortfall is convex
    and piecewise linear in s, so Newton's steps from 0 rise to the solution and end there.
    """
    groups, scale = above(0.0), 0.0
    spare = {g: slack * mass for g, (mass, _) in groups.items()}
    while True:
        steps = [(mass - spare[g]) / tokens for g, (mass, tokens) in groups.items() if tokens > 0]
        if max(steps, default=0.0) <= scale * (1 + 1e-12):
            return scale or 1.0
        scale = max(steps)
        groups = above(scale)


def with_probability(docs: DataFrame, targets: Targets = None, power: Mapping[str, float] = POWERS, rounds: int = 100, source_col: str = "source", lang_col: str = "lang", text_col: str = "text", topic: Column | None = None, driver_cells: int = DRIVER_CELLS, slack: float = SLACK) -> DataFrame:
    """_row (``docs``'s columns), _mix_source, _mix_lang, _mix_topic, _mix_tokens and _mix_probability. Dimensions without targets get their natural shares tempered by ``power``. ``topic``: an expression over ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.struct(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), *([topic.alias("topic")] if topic is not None else [])).alias("_own"), weighed(F.col(text_col)).alias("_form"))
    own = {d: F.col(f"_form.{d}" if d == "topic" and topic is None else f"_own.{d}") for d in DIMS}
    rows = rows.select("_row", *[F.coalesce(c.cast("string"), F.lit(NULL_VALUE)).alias(f"_mix_{d}") for d, c in own.items()], F.col("_form.tokens").alias("_mix_tokens"))
    keys = [f"_mix_{d}" for d in DIMS]
    cells = rows.groupBy(*keys).agg(F.sum("_mix_tokens").alias("_mix_tokens"))
    named = {d: sorted({NULL_VALUE if v is None else v for v in targets[d]}) for d in DIMS if targets and d in targets}
    held = sorted(cells.limit(driver_cells + 1).collect())
    if len(held) <= driver_cells:
        total = sum(r["_mix_tokens"] for r in held) or 1.0
        natural: dict[str, dict[str, float]] = {d: {} for d in DIMS}
        for r in held:
            for d in DIMS:
                natural[d][r[f"_mix_{d}"]] = natural[d].get(r[f"_mix_{d}"], 0.0) + r["_mix_tokens"] / total
        want = _targets(targets, natural, power)
        place = {d: {v: i for i, v in enumerate(want[d])} for d in DIMS}
        codes = np.array([[place[d][r[f"_mix_{d}"]] for d in DIMS] for r in held], dtype=np.int64).reshape(-1, len(DIMS))
        tokens = np.array([r["_mix_tokens"] for r in held], dtype=float)
        factor = rake(codes, tokens, [np.array(list(want[d].values())) for d in DIMS], rounds)

        def above(scale: float) -> dict[object, tuple[float, float]]:
            now = np.where(factor > scale, tokens, 0.0)
            out: dict[object, tuple[float, float]] = {None: (float(now @ factor), float(now.sum()))}
            for i, d in enumerate(DIMS):
                if d in named:
                    mass, size = (np.bincount(codes[:, i], weights=w, minlength=len(place[d])) for w in (now * factor, now))
                    out |= {(d, v): (float(mass[place[d][v]]), float(size[place[d][v]])) for v in named[d] if v in place[d]}
            return out

        scale = _scale(above, slack)
        chance = np.minimum(1.0, factor / scale)
        raked = spark.createDataFrame([(*(r[k] for k in keys), float(p)) for r, p in zip(held, chance, strict=True)], ", ".join(f"{k} string" for k in keys) + ", _mix_probability double")
        raked = F.broadcast(raked)
    else:
        cells = write_table(cells, "cells")
        total = cells.agg(F.sum("_mix_tokens")).first()[0]
        tables = {}
        for d in DIMS:
            share = cells.groupBy(f"_mix_{d}").agg((F.sum("_mix_tokens") / total).alias("_share"))
            if targets and d in targets:
                given = spark.createDataFrame([(NULL_VALUE if k is None else k, float(v)) for k, v in targets[d].items()], f"_mix_{d} string, _given double")
                share = share.join(given, f"_mix_{d}", "left")
                s = share.agg(F.sum("_given").alias("g"), F.sum(F.when(F.col("_given").isNull(), F.col("_share"))).alias("r")).first()
                raw = F.coalesce("_given", F.lit(max(0.0, 1 - (s["g"] or 0.0))) * F.col("_share") / F.lit(s["r"] or 1.0))
            else:
                raw = F.pow("_share", F.lit(power[d]))
            share = write_table(share.select(f"_mix_{d}", raw.alias("_mix_want")), "targets")
            tables[d] = share.withColumn("_mix_want", F.col("_mix_want") / (share.agg(F.sum("_mix_want")).first()[0] or 1.0))
        raked = _rake_table(cells, tables, rounds)

        def above(scale: float) -> dict[object, tuple[float, float]]:
            now = raked.where(F.col("_mix_factor") > scale)
            sums = [F.sum(F.col("_mix_tokens") * F.col("_mix_factor")), F.sum("_mix_tokens")]
            out: dict[object, tuple[float, float]] = {None: tuple(x or 0.0 for x in now.agg(*sums).first())}
            for d, values in named.items():
                out |= {(d, r[0]): (r[1], r[2]) for r in now.where(F.col(f"_mix_{d}").isin(values)).groupBy(f"_mix_{d}").agg(*sums).collect()}
            return out

        scale = _scale(above, slack)
        raked = raked.select(*keys, F.least(F.lit(1.0), F.col("_mix_factor") / scale).alias("_mix_probability"))
    return rows.join(raked, keys)


def _drawn(docs: DataFrame, targets: Targets, power: Mapping[str, float], seed: int, id_col: str, text_col: str, **more) -> DataFrame:
    rows = with_probability(docs, targets, power, text_col=text_col, **more)
    own, text = F.col("_row")[id_col], F.col("_row")[text_col]
    # the seed keeps the draw apart from other hashes of the id
    key = F.xxhash64(F.lit(seed), own, F.when(own.isNull(), text))
    uniform = F.pmod(key, F.lit(1 << 53)).cast("double") / float(1 << 53)
    return rows.withColumn("_mix_kept", uniform < F.col("_mix_probability"))


def mix(docs: DataFrame, targets: Targets = None, power: Mapping[str, float] = POWERS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with _mix_* columns and _mix_kept. Filter on it and drop them to sample."""
    rows = _drawn(docs, targets, power, seed, id_col, text_col, **more)
    new = [c for c in rows.columns if c != "_row"]
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in new], *new)


def sample(docs: DataFrame, targets: Targets = None, power: Mapping[str, float] = POWERS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The kept documents with the columns of ``docs``."""
    return _drawn(docs, targets, power, seed, id_col, text_col, **more).where("_mix_kept").select("_row.*")


def attained(mixed: DataFrame) -> dict[str, DataFrame]:
    """Of each dimension, a table of its values (_mix_*) with their natural share of tokens and the share that the probabilities give them."""
    out = {}
    # partial sums of cells, so that one pass over the rows serves all dimensions
    cells = write_table(mixed.groupBy(*[f"_mix_{d}" for d in DIMS]).agg(F.sum("_mix_tokens").alias("n"), F.sum(F.col("_mix_tokens") * F.col("_mix_probability")).alias("k")), "margins")
    n, k = cells.agg(F.sum("n"), F.sum("k")).first()
    for d in DIMS:
        out[d] = cells.groupBy(f"_mix_{d}").agg((F.sum("n") / F.lit(n or 1.0)).alias(f"{d}_natural"), (F.sum("k") / F.lit(k or 1.0)).alias(f"{d}_share"))
    return out
