"""Host and path rules for urls, and redirect equivalence.

Urls that redirect to each other, name one canonical page or differ only in form (scheme, ``www.`` or
``m.``, default document, trailing slash, tracking parameters, fragment) are aliases. Components over
these edges are found with distributed rounds; a block decision on one alias holds for the others. An
explicit allow in the component comes before a block.

Precedence for a url: its own longest rule; else an allow rule of any alias; else a block rule of any
alias; else allow.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule and no aliases of
form; links in its html still count for a non-null url. Null html has no links. Repeated rows are judged
each. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.entities import html5 as HTML5
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.scratch import write_table

#: (rule, verdict): host, then a path prefix.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. Rules are a parameter of the operator, so an expression holds them."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def form_key(url: Column) -> Column:
    """What aliases of form have in common; null where there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^(www\.|m\.|mobile\.|amp\.)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/(index|default)\.(html?|php|aspx?)$", "/"), r"(\.html?)?/*$", "")
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    own = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w+|ref|fbclid|gclid|mc_[ce]id|sessionid|sid)(=|$)")))
    return F.when(url.contains("://"), F.concat(host, path, F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(own, "&"))).otherwise(F.lit(""))))


_TAG = r"(?is)<(?:link|meta)\b[^>]*+>"
_BASE = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def _decoded(href: str) -> str:
    """Character references as in an attribute: a name without a semicolon counts only where no letter, digit or ``=`` follows."""
    return _REFERENCE.sub(lambda m: entities.unescape(m[0]) if m[0][1] == "#" else HTML5.get(m[0][1:], m[0]), href)


def _joined(base: str, href: str) -> str:
    if _SCHEME.match(href):
        return href
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def _resolve(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for hrefs, urls, bases in batches:
        out = []
        for links, url, base in zip(hrefs, urls, bases, strict=True):
            start = _joined(url or "", _decoded(base)) if base else url or ""
            out.append(None if links is None else [_joined(start, _decoded(x)) for x in links])
        yield pd.Series(out, dtype=object)


def links_of(html: Column, url: Column) -> Column:
    """Targets of canonical links and of refresh redirects, resolved against the page's url or its ``base`` element; those without ``://`` are left out."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(_TAG), F.lit(0)), lambda t: t.rlike(r"(?i)\bcanonical\b|\brefresh\b"))
    href = F.transform(tags, lambda t: F.when(t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical"), F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)).when(t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh"), F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*([^\"'\s>]+)", 1)))
    href = F.when(html.rlike(r"(?i)canonical|http-equiv"), F.filter(href, lambda u: u != ""))
    based = F.when(html.rlike(r"(?i)<base\b"), F.regexp_extract(html, _BASE, 1))
    return F.filter(F.pandas_udf(_resolve, "array<string>")(href, url, based), lambda u: u.contains("://"))


def _node(url: Column) -> Column:
    return F.md5(F.encode(form_key(url), "utf-8"))


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, component (null without aliases) for every page.

    ``redirects``: optional edges with columns ``src`` and ``dst``. Aliases of form share a node, so only
    links between nodes are edges; nodes that no edge touches need no component.
    """
    url = F.col("url")
    html = F.col(html_col).cast("string") if html_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rule, verdict = rule_of(host_of(url), path_of(url), rules)
    linked = F.transform(links_of(F.col("html"), url), _node)
    flat = write_table(rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), rule.alias("rule"), verdict.alias("own"), _node(url).alias("node"), linked.alias("links")), "urls")

    edges = flat.where("node is not null and size(links) > 0").select(F.col("node").alias("u"), F.explode("links").alias("v"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_node(F.col("src")).alias("u"), _node(F.col("dst")).alias("v")).where("u is not null and v is not null"))
    comp = write_table(connected_components(edges), "components")
    ruled = flat.where("own is not null and node is not null").groupBy("node").agg(F.max(F.col("own") == "allow").alias("allow"))
    if redirects is not None:  # rules also hold for urls that only redirects name
        ends = redirects.select(F.col("src").alias("url")).unionByName(redirects.select(F.col("dst").alias("url")))
        r, v = rule_of(host_of(url), path_of(url), rules)
        ruled = ruled.unionByName(ends.select(_node(url).alias("node"), v.alias("own")).where("own is not null and node is not null").groupBy("node").agg(F.max(F.col("own") == "allow").alias("allow")))
    named = ruled.join(comp, "node", "left").select(F.coalesce("component", "node").alias("component"), "allow")
    decided = write_table(named.groupBy("component").agg(F.max("allow").alias("allow")), "decided")

    placed = flat.where("node is not null").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    judged = placed.join(decided, "component", "left").select("page_id", "host", "path", "rule", "own", "allow", "component")
    alone = flat.where("node is null").select("page_id", "host", "path", "rule", "own", F.lit(None).cast("boolean").alias("allow"), F.lit(None).cast("string").alias("component"))
    judged = judged.unionByName(alone)
    inherited = F.when(F.col("allow"), "allow").when(~F.col("allow"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", inherited).alias("verdict"), "component")
