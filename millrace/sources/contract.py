"""Signal contracts and configuration trees as small tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT = "signal string, tag string, unit string, rate_hz double, type string, lo double, hi double, allowed array<string>, owner string, kind string, aliases map<string,string>"
_FIELDS = ["signal", "tag", "unit", "rate_hz", "type", "lo", "hi", "allowed", "owner", "kind", "aliases"]


def contract_issues(signals: Mapping[str, Mapping[str, Any]]) -> list[str]:
    """What is inconsistent: repeated tags, ranges out of order, enumerations without values, unknown fields."""
    issues, seen = [], {}
    for name, s in signals.items():
        for k in s.keys() - set(_FIELDS):
            issues.append(f"{name}: unknown field {k}")
        if s.get("tag") in seen:
            issues.append(f"{name}: tag {s['tag']} is also {seen[s['tag']]}'s")
        seen.setdefault(s.get("tag"), name)
        lo, hi = s.get("lo"), s.get("hi")
        if lo is not None and hi is not None and not lo < hi:
            issues.append(f"{name}: range {lo}..{hi}")
        if s.get("type") == "enum" and not s.get("allowed"):
            issues.append(f"{name}: no values")
    return issues


def contract_table(spark: SparkSession, signals: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    if issues := contract_issues(signals):
        raise ValueError("; ".join(issues))
    number = lambda v: None if v is None else float(v)
    rows = [tuple(name if f == "signal" else number(s.get(f)) if f in ("rate_hz", "lo", "hi") else s.get(f) for f in _FIELDS) for name, s in signals.items()]
    return spark.createDataFrame(rows, CONTRACT)


def retagged(contract: DataFrame, pattern: str, replacement: str, overrides: DataFrame | None = None) -> DataFrame:
    """Tags rewritten for a site; ``overrides`` (signal, tag) come first, outputs keep their tags."""
    tag = F.when(F.col("kind") == "output", F.col("tag")).otherwise(F.regexp_replace("tag", pattern, replacement))
    if overrides is None:
        return contract.withColumn("tag", tag)
    o = overrides.select("signal", F.col("tag").alias("_tag"))
    return contract.join(F.broadcast(o), "signal", "left").withColumn("tag", F.when(F.col("kind") == "output", F.col("tag")).otherwise(F.coalesce("_tag", tag))).drop("_tag")


def config_leaves(tree: Mapping[str, Any], prefix: str = "") -> Iterator[tuple[str, Any]]:
    """(dotted key, value) of every leaf; a mapping with a ``value`` entry is a leaf."""
    for k, v in tree.items():
        key = f"{prefix}{k}"
        if isinstance(v, Mapping) and "value" not in v:
            yield from config_leaves(v, f"{key}.")
        else:
            yield key, v["value"] if isinstance(v, Mapping) else v


def config_table(spark: SparkSession, tree: Mapping[str, Any]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in config_leaves(tree)], "key string, value string")


def stable_name(name: str) -> str:
    return re.sub(r"\W+", "_", name).strip("_").lower()
