"""The ten operators against brute force, exact round trips and the cases that their docstrings define."""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, chunks, components, html, jaccard, media, mixing, packing, pii, quality, urls
from millrace.llm.queries import CONTROL_TEXT, queries, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 2**62 + 3
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def frame(spark, texts, **more):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "one", "a b", "ünï çödé ﬁ 中文 🙂", "same text here", "same text here", "x" * 50_000, LONG]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with the operators' own names."""
    df = frame(spark, ODD).unionByName(spark.createDataFrame([(None, None, None, None, None), (3, "one", None, None, 3), (3, "one", "en", "s", 3), (BIG, "a big id", "en", "s", 8)], DOCS))
    for c in ("n", "digest", "grp", "length", "kept", "segments", "_rank", "block", "at", "base"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 quality


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_base_counts(spark, odd, data):
    for docs in (odd, spark.read.parquet(f"{data}/documents.parquet")):
        want = sorted(((r.doc_id is None, r.doc_id), base_counts(r.text)) for r in docs.select("doc_id", "text").collect())
        got = quality.judge(docs).collect()
        assert sorted(((r.doc_id is None, r.doc_id), tuple(r[c] for c in quality.COUNTS)) for r in got) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_repeated_words_with_many_different_words():
    rng = np.random.default_rng(0)
    for size in (3, 50, 20_000):
        words = [str(i).encode() for i in rng.integers(0, size, 12_000)]
        words += words[:40]
        assert quality.repeated_words(words) == base_counts(b" ".join(words).decode())[4]


def vectors(spark, x):
    return spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{v} double" for v in quality.VECTOR))


def logdet_of_half(x, centre, inverse, h):
    """Log determinant of the covariance of the rows that are nearest under an estimate."""
    d = x - centre
    near = np.argsort(np.einsum("ij,jk,ik->i", d, inverse, d))[: int(np.ceil(h * len(x)))]
    return np.linalg.slogdet(np.cov(x[near].T, bias=True) + np.diag(np.square(quality.FLOOR)))[1]


@pytest.mark.parametrize("kind", ["cluster", "spread", "copies"])
def test_mcd_is_as_small_as_exhaustive_starts_find(spark, kind):
    rng, k, h = np.random.default_rng(1), len(quality.VECTOR), 0.75
    x = rng.standard_normal((600, k)) @ (np.eye(k) + 0.4 * rng.standard_normal((k, k)))
    bad = slice(0, 130)
    x[bad] = {"cluster": 6 + 0.1 * x[bad], "spread": 25 * x[bad], "copies": x[:1] * 0 + 9.0}[kind]
    fit = quality.mcd(vectors(spark, x), h).first()
    centre = np.array([fit[f"c{i}"] for i in range(k)])
    p = np.array([[fit[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    least = np.inf
    for seed in range(6):  # brute force: 300 random starts over all rows, each to its end
        for c, v in quality.best_starts(x, np.ones(len(x)), h, 1000 + seed, starts=50, best=1):
            least = min(least, logdet_of_half(x, c, np.linalg.inv(v + np.diag(np.square(quality.FLOOR))), h))
    assert logdet_of_half(x, centre, p, h) <= least + 0.05
    far = np.einsum("ij,jk,ik->i", x - centre, p, x - centre) * fit["scale"]
    assert far[bad].min() > quality.chi2_quantile(0.999, k) or kind == "spread"
    assert np.median(far[130:]) < quality.chi2_quantile(0.75, k) and (far[130:] < quality.chi2_quantile(0.999, k)).mean() > 0.95


def test_distance_limit_is_three_robust_deviations(spark):
    x = np.exp(np.random.default_rng(2).normal(1.5, 1.2, 4001))
    logs = np.log(x)
    want = np.exp(np.median(logs) + 3 * 1.4826 * np.median(np.abs(logs - np.median(logs))))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "distance double")
    assert quality.distance_limit(df) == pytest.approx(want, rel=0.02)
    assert quality.distance_limit(df.where("distance is null")) == float("inf")


def test_quality_keeps_clean_and_drops_junk(spark):
    d = "/root/testdata/sf0.1"
    found = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rates = {r["quality"]: r["k"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] > 0.99 and rates[0] < 0.1


def test_keep_good_agrees_with_judge(spark, odd, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r.doc_id for r in quality.keep_good(docs).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert quality.keep_good(odd).columns == odd.columns


# 2 chunks


def test_gear_hash_is_the_rolling_hash():
    data, h, table = np.random.default_rng(2).integers(0, 256, 500).astype(np.uint8), 0, chunks.gear_table()
    want = []
    for b in data:
        h = ((h << 1) + int(table[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunks.gear_hashes(data).tolist() == want


def test_chunks_resist_shifts_and_cover():
    raw = LONG.encode()
    ends = chunks.boundaries(raw)
    assert ends[-1] == len(raw) and all(chunks.LEAST <= b - a <= chunks.LARGEST + 3 for a, b in zip([0, *ends[:-2]], ends[:-1], strict=True))
    cut = lambda r: [r[a:b] for a, b in zip([0, *chunks.boundaries(r)[:-1]], chunks.boundaries(r), strict=True)]
    one, two = set(cut(raw)), set(cut(raw[:5000] + b"inserted words " + raw[5000:]))
    assert len(one - two) <= 4


def test_substring_dedup(spark):
    passage = " ".join(f"shared{i}passage" for i in range(60))
    own = [" ".join(f"d{d}w{i}z" for i in range(80)) for d in range(5)]
    docs = frame(spark, [own[0] + " " + passage, passage + " " + own[1], own[2], own[3][:200] + " " + passage + "\n" + own[3][200:], own[4], own[4]])
    found = {r.doc_id: r for r in chunks.dedup_substrings(docs).collect()}
    assert set(found) == {0, 1, 3, 4, 5} and found[0].n_cut == 0 and found[1].first_doc_ids == [0] and found[5].first_doc_ids == [4]
    clean = {r.doc_id: r.text for r in chunks.without_repeats(docs).collect()}
    assert clean[0] == own[0] + " " + passage and clean[2] == own[2] and clean[5] == ""
    assert len(clean[1]) < len(own[1]) + 150 and own[1] in clean[1] and own[3][200:] in clean[3]


def test_documents_without_id_are_told_apart_by_text(spark):
    passage = " ".join(f"shared{i}passage" for i in range(80))
    docs = spark.createDataFrame([(None, "one " + passage), (None, "two " + passage + " end"), (None, "alone " * 3)], "doc_id long, text string").withColumn("_cuts", F.lit(1)).withColumn("_k", F.lit(2)).withColumn("_row", F.lit(3))
    assert [(r.n_repeats > 0, r.n_cut) for r in chunks.dedup_substrings(docs).orderBy("n_cut").collect()] == [(True, 0), (True, 1)]
    clean = chunks.without_repeats(docs)
    assert clean.columns == docs.columns and sorted((len(r.text) < 200, r._cuts) for r in clean.collect()) == [(False, 1), (True, 1), (True, 1)]
    again = frame(spark, [passage + " and between " + passage])
    assert chunks.dedup_substrings(again).count() == 0 and chunks.dedup_substrings(again, across=False).first().n_cut == 1


# 3 urls


def test_url_rules_and_aliases(spark):
    rows = [
        ("https://a.net/x", "a.net", "/x", "net/", "block"),
        ("http://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("x://org", "org", "", None, "allow"),
        ("x://b.org/fr/z", "b.org", "/fr/z", "org/fr/", "allow"),
        ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (None, "", "", None, "allow"),
        ("nothing", "", "", None, "allow"),
        ("http://www.mirror.info/p/", "www.mirror.info", "/p/", None, "block"),
        ("http://mirror.info/p?utm_source=1", "mirror.info", "/p", None, "block"),
        ("http://both.info/", "both.info", "/", None, "allow"),
        ("http://far.info/z", "far.info", "/z", None, "block"),
    ]
    html_of = {8: '<link rel="canonical" href="https://a.net/x">', 10: "<link href='http://b.org/fr/z' rel=canonical><meta http-equiv=refresh content='0;url=http://example.com/de/'>", 11: '<meta http-equiv="refresh" content="5; URL=http://www.mirror.info/p.html">'}
    pages = spark.createDataFrame([(i, r[0], html_of.get(i), 1) for i, r in enumerate(rows)], "page_id long, url string, html string, component int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}
    edge = spark.createDataFrame([("http://b.org/fr/z", "http://far.info/z")], "src string, dst string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, edge).collect()}[11] == "allow"


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500, i) for i in range(501, 700)] + [(i, i + 1) for i in range(800, 840)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_relative_and_escaped_links_are_edges(spark):
    long = "x" * 5000
    tag = {
        "https://a.example/de/p/one": '<link rel="canonical" href="/x/target1">',
        "https://a.example/de/p/two": '<meta http-equiv="refresh" content="0; url=target2.html">',
        "https://a.example/de/p/three": '<link rel=canonical href="//b.example/target3">',
        "https://a.example/de/p/four": '<link rel="canonical" href="https://b.example/q?a=1&amp;b=2&#38;copy=3&copy=4">',
        "https://a.example/de/p/five": f'<link rel="canonical" data-x="{long}" href="../target5">',
        "https://a.example/de/p/six": '<base href="//b.example/d/"><link rel="canonical" href="target6">',
    }
    ends = ["https://a.example/x/target1", "https://a.example/de/p/target2.html", "https://b.example/target3", "https://b.example/q?a=1&b=2&copy=3&copy=4", "https://a.example/de/target5", "https://b.example/d/target6"]
    pages = [(i, u, h) for i, (u, h) in enumerate([*tag.items(), *((e, None) for e in ends), ("no scheme", '<link rel="canonical" href="/x">')])]
    got = {r.page_id: r.component for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == got[i + len(ends)] for i in range(len(ends))) and len({got[i] for i in range(len(ends))}) == len(ends)


# 4 html


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("dense", [3, 10**6])
def test_common_lines_are_a_longest_common_subsequence(dense):
    rng = np.random.default_rng(4)
    for _ in range(300):
        k = int(rng.choice([1, 2, 5, 20]))
        a, b = rng.integers(0, k, rng.integers(0, 14)).tolist(), rng.integers(0, k, rng.integers(0, 14)).tolist()
        found, rest = html.common_lines(a, b, dense), iter(b)
        assert len(found) == lcs(a, b) and all(any(x == y for y in rest) for x in [a[i] for i in sorted(found)])


def test_extracts_the_article(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        lines = (re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", article))
        want = "\n".join(x for x in lines if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


ARTICLE = "<article><h1>T</h1><p>One long text of an article that is here to stay and be read.</p><p>Two</p></article>"
HOSTILE_PAGES = [
    f'<html class="no-js cookie-consent"><body class="ads-enabled">{ARTICLE}</body>',
    f'<div class="social-page">{ARTICLE}</div>',
    f"<body><nav>a b c</nav>{ARTICLE}<footer>x</footer>",
    ARTICLE.replace("<p>Two", '<p class="advert">Buy</p><p hidden>h</p><ol class="commentlist"><li>c1<li>c2</ol><p>Two'),
    ARTICLE.replace("<h1>", "<header>Byline | Share | Print</header><h1>"),
    ARTICLE.replace("<h1>T</h1>", "<header><h1>T</h1><p>By me</p></header>"),
    ARTICLE + "<article><h2><a href=x>Teaser</a></h2></article>",
    f"<main>{ARTICLE}<div>More stuff</div></main>",
    f'<div class="comments"><article>reader says no</article></div>{ARTICLE}',
    f'<ul><li class="ad">x<li>y</ul>{ARTICLE}',
]


@pytest.mark.parametrize("page", HOSTILE_PAGES)
def test_no_article_is_lost_and_no_furniture_kept(page):
    assert html.main_text(html.page_lines(page), set()) == "T\nOne long text of an article that is here to stay and be read.\nTwo"


def test_line_breaks_and_pictures_stay_in_their_paragraph():
    page = "<p>One <img src=a> two<br>three</p><p class=advert>Buy<br>now</p><h2>Head <input> end</h2>"
    assert [(t, zone) for t, zone, _ in html.page_lines(page)] == [("One two", html.FREE), ("three", html.FREE), ("Buy", html.FURNITURE), ("now", html.FURNITURE), ("Head end", html.FREE)]


def test_elements_that_never_end():
    text = lambda page: html.main_text(html.page_lines(page), set())
    assert text("One<p>Two<aside>ad<p>Three") == "One\nTwo\nThree"
    assert text("a < b <c") == "a < b <c" and text("x<b '>'y") == "x'y" and text("p<!-- q") == "p" and text("a<script>b") == "a"


def test_a_small_article_does_not_settle_a_page():
    page = "<body><div><p>A long text in plain blocks, which is what the page is about.</p></div><article><a href=x>See also</a></article>"
    lines = html.page_lines(page)
    assert not html.settled(lines) and html.main_text(lines, set()) == "A long text in plain blocks, which is what the page is about."


@pytest.mark.parametrize("piece", ["<a ", "<b '>'", "<b ='>'", "<!-- ", "<script ", "</", '<a href="', "<p class='ad'>", "<div>", "<ul><li>", "<![CDATA[", "</div>", "<main><article>x"])
def test_pages_take_linear_time(piece):
    import time

    began = time.perf_counter()
    html.page_lines(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 30


def test_differencing_without_markup_hints(spark):
    page = lambda i: f"<body><div>Site name</div><div>Home of news</div><div>Story {i} is told here at some length.</div><p>It ends &amp; {i}</p><div>All rights reserved</div>"
    rows = [(i, f"http://h.org/a/{i}", page(i)) for i in range(30)] + [(90, None, None), (91, "http://h.org/a/0", ""), (92, "http://alone.org/", page(7)), (92, "http://alone.org/", page(7)), (None, "u", "<p>x"), (BIG, "v", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1))
    got = [(r.page_id, r.text) for r in html.extract(pages).collect()]
    assert len(got) == len(rows)
    texts = dict(got)
    assert texts[3] == "Story 3 is told here at some length.\nIt ends & 3" and texts[90] == texts[91] == "" and texts[92].startswith("Site name") and texts[None] == "x" and texts[BIG] == "y"


def test_neighbours_do_not_depend_on_partitions(spark):
    rows = [(f"h{i % 3}", f"/p{(i * 7) % 40}/x{i}", f"k{i:03}") for i in range(200)] + [("lone", "/", "k900")]
    keys = spark.createDataFrame(rows, "host string, path string, key string")
    outs, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        outs.append(sorted((r.key, r.n_key) for r in html.neighbours(keys).collect() if r.n_key))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    by_host, want = {}, []
    for r in sorted(rows):
        by_host.setdefault(r[0], []).append(r)
    for group in by_host.values():
        for i, r in enumerate(group):
            near = [group[k] for k in (i - 1, i + 1) if 0 <= k < len(group)]
            if near:
                want.append((r[2], max(near, key=lambda g: html._common(g[1], r[1]))[2]))
    assert outs[0] == outs[1] == outs[2] == sorted(want)


# 5 pii


def luhn(x):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(x))) % 10 == 0


def base_spans(text):
    shapes = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for i, (kind, shape) in enumerate(shapes.items()):
        for m in re.finditer(shape, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


TRICKY = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "999.1.1.1 é 4491382641088554x", "+1 (372) 555-7739 +44", "0001.2.3.4", "🙂a@b.co@d.ef", "4111 1111-1111 1111 22", "+1+1234567890", "a" * 3_000, "a@b" + ".c" * 2_000, "1" * 3_000, "1." * 2_000, "+1 " * 1_000, "0000000000000255.1.1.1"]


def test_pii_base_spans(spark, odd, data):
    for docs in (frame(spark, TRICKY), odd, spark.read.parquet(f"{data}/documents.parquet")):
        rows = pii.pii_report(docs).collect()
        got = sorted((r.doc_id is None, r.doc_id, r.base_sha256, *[r[f"n_{k}"] for k in pii.KINDS]) for r in rows)
        spans = [(r.doc_id, base_spans(r.text)) for r in docs.collect()]
        assert got == sorted((doc is None, doc, hashlib.sha256(s.encode()).hexdigest(), *[len(re.findall(rf"\b{k}:", s)) for k in pii.KINDS]) for doc, s in spans)
        assert all(r.n_found == sum(r[f"n_{k}"] for k in pii.KINDS) + r.n_added == len([x for x in r.spans.split(",") if x]) for r in rows)


def test_pii_bootstraps_unseen_identifiers(spark):
    texts = [f"some words {i} then reach me at user{i}@mail{i}.org or not" for i in range(40)] + ["other words then reach me at hidden42@localhost or not", "version of hidden43@localhost here"]
    rows = {r.doc_id: r for r in pii.pii_report(frame(spark, texts)).collect()}
    at = texts[40].index("hidden42")
    assert rows[40].spans == f"email:{at}:{at + 18}" and rows[40].n_email == 0 and rows[40].n_added == 1 and rows[41].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, texts)).collect()}
    assert clean[40] == "other words then reach me at <email> or not" and clean[41] == texts[41] and "@" not in clean[7]


def test_pii_bootstraps_spaced_layouts(spark):
    seeds = [f"write to\nphone: +49 30 12345{i:02d} today" for i in range(40)] + [f"pay by\ncard: {n} now" for n in ("4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220", "4000056655665556", "5200828282828210", "4242424242424242")]
    unseen = {"phone: 020 7946 0958 ok": "phone:7:20", "phone: (030) 123 4567.": "phone:7:21", "phone: 030/123 4567": "phone:7:19", "phone: 555-123-4567": "phone:7:19", "card: 4111 1111 1111 1112, ok": "card:6:25", "phone: 1 2 3": "", "phone: 030 123 4567/+49 30 1234567 ok": "phone:7:19,phone:20:34"}
    docs = frame(spark, seeds + list(unseen))
    got = {r.doc_id: r.spans for r in pii.pii_report(docs).collect()}
    assert [got[len(seeds) + i] for i in range(len(unseen))] == list(unseen.values())
    assert pii.redact(docs).where(F.col("doc_id") == len(seeds) + 1).first().text == "phone: <phone>."


def test_pii_finds_hidden_seeds_again_and_what_runs_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    recall = {r.kind: (r.hidden, r.found) for r in pii.held_out_recall(docs).collect()}
    assert set(recall) == set(pii.NAMES) and all(f <= h for h, f in recall.values()) and sum(f for _, f in recall.values()) >= 0.9 * sum(h for h, _ in recall.values()), recall
    rows = {r.doc_id: r for r in pii.pii_report(docs).where("n_added > 0").collect()}
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(*rows)).collect()}
    added = {doc: [x.split(":") for x in r.spans.split(",") if x not in base_spans(texts[doc]).split(",")] for doc, r in rows.items()}
    for doc, spans in added.items():
        for kind, start, end in spans:
            hit = texts[doc][int(start) : int(end)]
            assert {"secret": r"(?i)[0-9a-f]{40}", "phone": r"\+1 \(\d{3}\) 555-\d{4}", "card": r"\d{16}"}[kind] and re.fullmatch({"secret": r"(?i)[0-9a-f]{40}", "phone": r"\+1 \(\d{3}\) 555-\d{4}", "card": r"\d{16}"}[kind], hit), (kind, hit)
    secrets = {r.doc_id for r in docs.collect() if re.search(r'(?i)token = "[0-9a-f]{40}"', r.text or "")}
    assert secrets == {doc for doc, spans in added.items() if any(k == "secret" for k, _, _ in spans)}


def test_pii_patterns_on_the_right_and_columns_with_clashing_names(spark):
    texts = [f"x{chr(97 + i % 26)}q 10.0.{i}.7 gateway of hall {i}" for i in range(30)] + ["yy 10.0.5 gateway of hall 3", "yy 10.0.6 window"]
    docs = frame(spark, texts).withColumn("_spans", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("_row", F.lit(3)).withColumn("_text", F.lit(4))
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[30].text == "yy <ip> gateway of hall 3" and clean[31].text == texts[31] and (clean[3]._spans, clean[3]._text) == (1, 4)


def test_redaction_merges_overlaps_and_keeps_columns(spark, odd):
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    assert pii.redact(frame(spark, ["é 1.2.3.4@mail.org +1 (372) 555-7739 end"])).first().text == "é <email> <phone> end"


# 6 packing


def test_word_encoder_is_the_tokenizer(spark, data):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(vocabulary_path()), packing.WordEncoder(vocabulary_path())
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()] + [x for x in ODD if x] + ["it's l'eau's <|endoftext|> a<|startoftext|>b", "e\u0301 İSTANBUL ΣΑΣ ǅ x\u0085y\u00a0z\u2028w", "a\x1cb 1234 $$$ !!! 'll", "##hash,tag;; foo's. BAR!!"]
    for _ in range(2):
        for x in texts:
            assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x[:80]


def test_word_encoder_takes_unknown_letters_past_the_pattern():
    class Counting:
        def __init__(self, of):
            self.of, self.calls = of, 0

        def encode(self, *args, **kwargs):
            self.calls += 1
            return self.of.encode(*args, **kwargs)

    e = packing.WordEncoder(vocabulary_path())
    t, e.tokenizer = e.tokenizer, Counting(e.tokenizer)
    letters = [chr(i) for i in range(0x41, 0x250) if chr(i).isalpha() and chr(i) != "\u0130"]
    texts = [" ".join(f"{letters[(i * k) % len(letters)]}{letters[i % 40]}Q{letters[k % 300]}{'!?'[k % 2]}" for k in range(40)) for i in range(300)]
    for x in texts:
        assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert e.tokenizer.calls <= 3  # for the punctuation; one for each text before


def test_word_encoder_over_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    monkeypatch.setattr(packing, "WORDS_A_CALL", 7)
    e = packing.WordEncoder(vocabulary_path())
    texts = [f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}ö, {i} (x) J\u030c {'z' * i}" if i % 9 else None for i in range(400)] + ["".join(chr(i) for i in range(0x21, 0x250)), "\x0b\x0c "]
    for at in range(0, len(texts), 100):
        batch = texts[at : at + 100]
        ids, begins = e.encode_all(pa.array(batch, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [e.tokenizer.encode(x or "", add_special_tokens=False).ids for x in batch]
        assert len(e.known) <= 50


def valid_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t, capacity = Tokenizer.from_file(vocabulary_path()), 64
    rows = packing.pack(odd, vocabulary_path(), capacity).collect()
    n = valid_packing(rows, capacity)
    assert n == -(-sum(r.length for r in rows) // capacity)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
    for doc, text in enumerate(ODD):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            p = pieces[doc][k]
            assert (p.start, p.length, p.ids_crc32) == (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    whole = {r.sequence_id: r for r in packing.packed_sequences(frame(spark, ODD[:8]), vocabulary_path(), capacity).collect()}
    assert sum(r.n_tokens for r in whole.values()) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in ODD[:8])


@pytest.mark.parametrize("seed", range(25))
def test_local_search_keeps_pieces_and_helps(seed):
    rng = np.random.default_rng(seed)
    capacity = 60
    lengths = rng.integers(8, 34, rng.integers(5, 60))
    histogram = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    before = packing.best_fit_decreasing(histogram, capacity)
    square = lambda g: sum((capacity - room) ** 2 * n for room, c in g.by_room.items() for n in c.values())
    n, s = before.bins(), square(before)
    after = packing.local_search(before, capacity)
    assert after.bins() <= n and (square(after) > s or after.bins() == n)
    kept = {}
    for c in after.by_room.values():
        for pattern, times in c.items():
            assert sum(x * k for x, k in pattern) <= capacity
            for x, k in pattern:
                kept[x] = kept.get(x, 0) + k * times
    assert kept == histogram


def test_local_search_empties_bins():
    better = 0
    rng = np.random.default_rng(9)
    for _ in range(200):
        lengths, n = np.unique(rng.integers(8, 34, 24), return_counts=True)
        histogram = dict(zip(lengths.tolist(), n.tolist(), strict=True))
        better += packing.best_fit_decreasing(histogram, 60).bins() - sum(n for _, n in packing.plan_bins(histogram, 60))
    assert better > 0


def test_swaps_save_sequences_on_large_pieces():
    lengths, n = np.unique(np.random.default_rng(0).choice([1110, 1210, 1333, 1405, 1501, 1689], 3000), return_counts=True)
    histogram = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    before, after = packing.best_fit_decreasing(histogram, 4096).bins(), sum(n for _, n in packing.plan_bins(histogram, 4096))
    assert packing.least_bins(histogram, 4096) <= after < 0.96 * before


def test_swaps_through_the_query_path(spark):
    # three of 20 and one of 31 tokens a bin can't be had by best fit decreasing alone
    rng = np.random.default_rng(9)
    for _ in range(200):
        lengths = rng.integers(8, 34, 24).tolist()
        histogram = {x: lengths.count(x) for x in lengths}
        best = sum(n for _, n in packing.plan_bins(histogram, 60))
        if best < packing.best_fit_decreasing(histogram, 60).bins():
            break
    docs = frame(spark, [" ".join(["the"] * (x - 1)) for x in lengths])
    rows = packing.pack(docs, vocabulary_path(), 60).collect()
    assert sorted(r.length for r in rows) == sorted(lengths) and valid_packing(rows, 60) == best
    whole = packing.packed_sequences(docs.withColumn("doc_id", F.lit(None).cast("long")), vocabulary_path(), 60).collect()
    assert len(whole) == best and sum(r.n_tokens for r in whole) == sum(lengths)


@pytest.mark.parametrize("seed", range(8))
def test_least_bins_is_a_bound(seed):
    rng = np.random.default_rng(seed)
    lengths, n = np.unique(rng.integers(5, 60, rng.integers(3, 12)), return_counts=True)
    histogram = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    items, best = sorted(np.repeat(lengths, n).tolist(), reverse=True), [99]

    def place(k, rooms):  # all packings
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[k]}:
            rest = list(rooms)
            rest.remove(room)
            place(k + 1, [*rest, room - items[k]])
        place(k + 1, [*rooms, 60 - items[k]])

    place(0, [])
    found = packing.local_search(packing.best_fit_decreasing(histogram, 60), 60).bins()
    assert packing.least_bins(histogram, 60) <= best[0] <= found


def test_ranks_over_salts(spark):
    rows = packing.pack(frame(spark, [f"w{i % 7}" for i in range(900)]), vocabulary_path(), 32).collect()
    assert len(rows) == 900 and {r.length for r in rows} == {3} and valid_packing(rows, 32) == 90


# 7 media


def png(payload=b"\0\xff"):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(payload)) + chunk(b"IEND", b"")


def test_sniffing_confirms_corrects_and_carves(spark):
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    wav = media.wav_of(b"silence " * 8 + png() + b"tail")
    values = [(1, png(), "image/gif"), (2, gif + b"junk", "image/gif"), (3, wav, "image/png"), (4, b"text about RIFF, BM, GIF89a and %PDF-1.7", "text/plain"), (5, None, None), (6, b"", ""), (7, png()[:-3], "image/png")]
    df = spark.createDataFrame(values, "id int, value binary, declared string").withColumn("media", F.lit(0))
    got = {r.id: r for r in media.sniff(df, "value", "declared", carve=True).collect()}
    assert got[1].media_type == "image/png" and got[1].type_was_wrong and not got[2].type_was_wrong
    assert [m.length for m in got[2].media] == [len(gif)]
    assert got[3].media_type == "audio/wav" and [bytes(m.bytes) for m in got[3].media if m.type == "image/png"] == [png()]
    assert all(got[i].media == [] and got[i].media_type == media.UNKNOWN for i in (4, 5, 6, 7))


@pytest.mark.parametrize("mark", [b"%PDF-", b"PK\x03\x04", b"BM", b"RIFF"])
def test_many_chance_matches_take_linear_time(mark):
    import time

    began = time.perf_counter()
    media.Sniffer().find(mark * (1_000_000 // len(mark)))
    assert time.perf_counter() - began < 20


def test_stored_texts_round_trip(odd):
    rows = media.stored_texts(odd, keep_media=True).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and media.wav_samples(bytes(r.media)) == padded and r.feature.startswith("audio/wav;declared=image/png;corrected=True")
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()


# 8 mixing


def test_raking_meets_margins():
    rng = np.random.default_rng(5)
    codes = np.array([(a, b, c) for a in range(6) for b in range(4) for c in range(3)])
    tokens = rng.random(len(codes)) * 1000 + 1
    targets = [np.array([0.3, 0.1, 0.1, 0.2, 0.2, 0.1]), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25])]
    w = tokens * mixing.rake(codes, tokens, targets)
    for d, want in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, d], weights=w) / w.sum(), want, atol=1e-6)


def test_mix_table_and_driver_agree(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    targets = {"lang": {"en": 0.4, "de": 0.3, None: 0.1}}
    a, b = ({r.doc_id: r._mix_probability for r in mixing.mix(docs, targets, rounds=12, driver_cells=n).collect()} for n in (10**6, 0))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-3) for k in a) and max(a.values()) == pytest.approx(1)


def test_sampled_shares_and_determinism(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix(docs, {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}).select("doc_id", "lang", "_mix_kept", "_mix_tokens").toPandas()
    kept = rows[rows["_mix_kept"]]
    share = kept.groupby("lang")["_mix_tokens"].sum() / kept["_mix_tokens"].sum()
    assert share["en"] == pytest.approx(0.4, abs=0.04) and share["de"] == pytest.approx(0.2, abs=0.04)
    again = mixing.mix(docs.repartition(7), {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}).where("_mix_kept").count()
    assert again == len(kept)
    assert mixing.mix(odd).count() == odd.count() and mixing.sample(odd).columns == odd.columns


@pytest.mark.parametrize("driver_cells", [10**6, 0])
def test_a_rare_value_does_not_drive_the_scale(spark, data, driver_cells):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source")
    rare = spark.createDataFrame([(BIG, "misspelt", "xx", "nowhere")], docs.schema)
    more = {"driver_cells": driver_cells, "rounds": 30}
    kept = lambda rows: {r.doc_id: r._mix_probability for r in mixing.mix(rows, **more).collect()}
    without, with_rare = kept(docs), kept(docs.unionByName(rare))
    assert with_rare.pop(BIG) == 1
    mean = lambda p: sum(p.values()) / len(p)
    assert mean(without) > 0.8 and mean(with_rare) == pytest.approx(mean(without), abs=0.02)


def test_query_gives_the_targets_it_names(spark, data):
    from millrace.llm.queries import TARGETS

    rows = queries()["op8_target_weights"](spark, "/root/testdata/sf0.1").toPandas()
    assert rows["doc_id"].is_unique and len(rows) == 10_000
    weight = rows["n_tokens"] * rows["probability"]
    for d, want in TARGETS.items():
        named = {v: w for v, w in want.items() if (rows[d] == v).any()}
        total = sum(named.values()) if set(rows[d].unique()) <= set(named) else 1.0
        share = (weight.groupby(rows[d]).sum() / weight.sum()).to_dict()
        assert rows[f"{d}_share"].to_numpy() == pytest.approx([share[v] for v in rows[d]], abs=1e-6)
        assert all(share[v] == pytest.approx(w / total, rel=0.03) for v, w in named.items()), (d, share)
    assert rows["probability"].min() < 0.5 and 0.2 < rows["kept"].mean() < 0.9


def test_sample_returns_clashing_columns_as_they_are(spark):
    docs = frame(spark, [f"text number {i}" for i in range(20)]).withColumn("_mix_tokens", F.lit(7)).withColumn("_row", F.lit(1)).withColumn("_own", F.lit(2)).withColumn("_form", F.lit(3))
    rows = mixing.sample(docs, power={"source": 1.0, "lang": 1.0, "topic": 1.0})
    assert rows.columns == docs.columns and [r._mix_tokens for r in rows.collect()] == [7] * 20 and mixing.mix(docs).count() == 20


def test_margins_fall_short_by_the_slack_at_most(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for targets in (None, {"lang": {"en": 0.4, "de": 0.005}}):
        rows = mixing.mix(docs, targets, slack=0.0).select("doc_id", "lang", "_mix_tokens", F.col("_mix_probability").alias("exact"))
        rows = rows.join(mixing.mix(docs, targets).select("doc_id", "_mix_probability"), "doc_id").toPandas()
        exact, kept = ((rows["_mix_tokens"] * rows[c]).groupby(rows["lang"]).sum() for c in ("exact", "_mix_probability"))
        exact, kept = exact / exact.sum(), kept / kept.sum()
        assert (exact - kept).abs().max() <= 0.0102
        if targets:
            assert kept["de"] == pytest.approx(0.005, rel=0.011) and kept["en"] == pytest.approx(0.4, rel=0.011)


# 9 chat


def test_chat_round_trip(spark):
    weird = ["<|im_end|><|im_start|>assistant ok", "<||x|>", "a<", "|b", "\n", "", None, "<|" * 500, "🙂 <|im_start|>user\nhi<|im_end|>\n"]
    rows = [(c, t, r, weird[(c + t) % len(weird)]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(50, 0, "assistant", "first"), (51, None, None, "x"), (51, 1, "we%0Aird\nrole", "y"), (None, 0, "user", "q"), (52, 0, "user", "same"), (52, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    for r in chat.chat_digests(df).collect():
        turns = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        spoken = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(spoken.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    flags = {r.conv_id: (r.valid, r.first_bad_turn) for r in chat.format_chats(df).collect()}
    assert flags[0] == (True, None) and flags[50] == (False, 0) and flags[52] == (False, 1)
    segments = chat.loss_segments(chat.format_chats(df).where("conv_id = 3")).orderBy("segment").collect()
    assert [s.loss for s in segments] == [False] * 6 + [False, True, False] + [False] * 3 + [False, True, False]


def test_roles_and_texts_cannot_form_markers_of_any_template(spark):
    names = ["<|im_start|>x", "user", "a<", "<|im_end|>\n", "%0A\n%", "[x]", "]", "[[", "<\\|", "<\\", "\\"]
    rows = [(c, t, r, names[(c + t) % len(names)] + "\n" * (t % 2)) for c in range(11) for t, r in enumerate(names)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for template in (chat.CHATML, chat.Template(start="[x", role_end="::", end="]\n"), chat.Template(start="[[x]]", role_end=" ", end="[[/x]]", escape="|")):
        for r in chat.read_back(chat.format_chats(df, template), template).collect():
            assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
    for bad in ({"start": "["}, {"start": "<\\x"}, {"start": "\nx"}, {"role_end": "%"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_chat_query_adds_the_control_conversation(spark, data):
    r = queries()["op9_chat_formatting"](spark, data).where("conv_id = -1").first()
    assert r.n_turns == 2 and r.loss_chars == len(CONTROL_TEXT) and r.valid and r.complete


# 10 jaccard


def brute_components(rows, width, percent):
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    ids, parent, links = sorted(sets), {k: k for k in sets}, set()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.add((a, b))
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(seed, groups=4, size=25, words=60):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in rng.integers(0, 500, words)]
        for _ in range(size):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 5)):
                copy[at] = f"e{rng.integers(0, 40)}"
            out.append(" ".join(copy[rng.integers(0, 3) :]))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, data, width, percent):
    cases = [frame(spark, near_copies(6) + ["one", "ONE", "a b", "A  b", "b a", "", None, "x y z", "x y z w"]), spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")]
    for docs in cases:
        want = brute_components(docs.collect(), width, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, width, percent).collect()}
        assert got == want


def test_jaccard_odd_rows_and_one_of_each(spark, odd):
    got = jaccard.jaccard_components(odd).collect()
    assert len(got) == odd.count() and sum(r.component_id is None for r in got) == 1
    by = {r.doc_id: r.component_id for r in got}
    assert by[6] == by[7] == 6 and by[1] == 1 and by[2] == 2
    kept = [r.doc_id for r in jaccard.one_of_each(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [0, 1, 2, 3, 4, 5, 6, 8, 9, BIG] and kept.count(None) == 1
    assert jaccard.one_of_each(odd).columns == odd.columns


def test_shingle_hashes_do_not_depend_on_the_block():
    texts = [LONG, None, "a b c d", "", "x", "é à"]
    alone = [jaccard.shingles(t) for t in texts]
    for (_, got, _), want in zip(jaccard.shingle_sets(texts), alone, strict=True):
        assert np.array_equal(got, want)


def thue_morse(a, b, rounds):
    x, y = a, b
    for _ in range(rounds):
        x, y = x + y, y + x
    return x, y


def test_words_that_collide_in_polynomials_of_two_to_the_64_are_not_linked(spark):
    x, y = thue_morse("a", "b", 11)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, [x, y, x.upper(), f"{x} {y}", f"{y} {x}"])).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


@pytest.mark.parametrize("collide", [lambda w: 7, lambda w: w[0] % 3])
def test_no_link_and_no_class_rests_on_a_hash(monkeypatch, collide):
    monkeypatch.setattr(jaccard.xxhash, "xxh3_64_intdigest", collide)
    texts = ["a b c d", "d c b a", "a b c d", "e f"]
    digests = [jaccard.class_digest(w, at, 3) for w, _, at in jaccard.shingle_sets(texts)]
    assert digests[0] == digests[2] and len(set(digests)) == 3
    assert jaccard.word_shingles(texts[0], 3).isdisjoint(jaccard.word_shingles(texts[1], 3))


def test_one_of_each_with_clashing_names(spark):
    docs = frame(spark, ["x y z", "x y z", "other words here"])
    for c in ("_gone", "_several", "_row", "_id", "component_id"):
        docs = docs.withColumn(c, F.lit(5))
    rows = jaccard.one_of_each(docs)
    assert rows.columns == docs.columns and sorted((r.doc_id, r._gone) for r in rows.collect()) == [(0, 5), (2, 5)]


# queries with SQL


@pytest.mark.parametrize("name", ["op3_redirect_equivalence", "op9_chat_formatting", "quality_base_counts", "pii_base_spans"])
def test_queries_match_sql(spark, name):
    import duckdb

    from millrace.llm.queries import oracle_sql

    data, c = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries()[name](spark, data)
    want = c.sql(oracle_sql()[name])
    assert set(want.columns) == set(got.columns)
    at = [want.columns.index(x) for x in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


# empty tables and the pipeline


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for out in (quality.judge(empty), quality.keep_good(empty), chunks.dedup_substrings(empty), chunks.without_repeats(empty), urls.judge_urls(pages), html.extract(pages), pii.pii_report(empty), pii.redact(empty), packing.pack(empty, vocabulary_path()), media.stored_texts(empty), mixing.mix(empty), chat.chat_digests(turns), jaccard.jaccard_components(empty), jaccard.one_of_each(empty)):
        assert out.count() == 0


def test_odd_rows_through_the_rest(odd):
    for out in (chunks.without_repeats(odd), pii.redact(odd)):
        assert out.columns == odd.columns and out.count() == odd.count()


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    n, step = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.write_table(stage(spark, step, data), name)
        assert step.columns == docs.columns and step.count() <= n
        n = step.count()
    out = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in step.collect()}
    valid_packing(out, 4096)
    five = brute_components(corpus_pipeline.quality_rules(spark, docs, data).select("doc_id", "text").collect(), 5, 80)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality_rules(spark, docs, data), data).collect()}
    assert kept == {k for k, (_, c) in five.items() if c == k}
