"""Personal data by fixed shapes, and bootstrapped contextual extraction on top. DataFrame functions only.

The fixed shapes (email, ip, card, phone) give seed entities; long tokens of mixed letters and digits are
seeds of a fifth kind, secret, which is reported only where patterns confirm it. Each mention has lexical
patterns: the one to three words and marks before it, the word or mark after it, both together, and its own
form (digits and letters made alike; whether a long number passes its check digit). Forms say nothing about
secrets and are left out there. Patterns and instances form a bipartite graph that is scored in rounds: a
pattern's confidence is the score-weighted share of its mentions, an instance's score the noisy-or of its
patterns' confidences. Patterns that are confident and supported by several different seeds then mark the
identifier-like tokens and digit groups that the fixed shapes missed: those run together with a neighbour,
those without a valid check digit in a telling context, secrets, national layouts.

Texts are scanned once and never shuffled: what moves are spans, mentions and patterns. Sums are combined
before each shuffle. The mentions are joined to accepted patterns only.

Defined cases: a null or empty text has no spans. A row is known by its id and its text, so repeated rows
each get the same result and rows that share an id don't mix. Positions count code points. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import write_table

KINDS = ["email", "ip", "card", "phone"]
SECRET = len(KINDS)  # the kind that has no fixed shape
NAMES = [*KINDS, "secret"]
#: The contract's shapes, with possessive quantifiers and a look-behind (or \\G, the last match's end) so that long runs take linear time.
SHAPES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BEFORE = r"(?<![A-Za-z0-9@._%+\ue000-])"
#: Long tokens with four letters and four digits or more: seeds of secrets.
LONG = r"(?<![A-Za-z0-9@._%+/=\ue000-])(?=(?:[A-Za-z_/+-]*+[0-9]){4})(?=(?:[0-9_/+-]*+[A-Za-z]){4})[A-Za-z0-9_/+-]{24,}+={0,2}+(?![@.A-Za-z0-9\ue000])"
#: Tokens that look like identifiers: at least six characters of these, one of them a digit or an at sign.
TOKEN = _BEFORE + r"(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]{6,}+(?!\ue000)"
_GROUP = r"[0-9]++(?:-[0-9]++)*+(?![._%+-]*+[A-Za-z0-9@\ue000])"
#: Digit groups joined by single spaces, brackets or slashes; a plus sign or an opening bracket in front belongs to it, a bracket where it is closed after the group.
SPACED = _BEFORE + r"\+?+(?:\((?=[0-9-]++\)))?+" + _GROUP + r"(?:(?:\)[\x20/-]?|[\x20/]?\(|[\x20/])" + _GROUP + ")++"
MENTION = f"{LONG}|{SPACED}|{TOKEN}"
#: Stands for the characters of a base span where a mention is split.
MASK = "\ue000"
CONTEXT_CHARS = 80
BLOCK = 256
_SPAN = "array<struct<kind:int,start:int,end:int,item:string,left:string,right:string>>"
_FIELDS = ["kind", "start", "end", "item", "left", "right"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; nines are cast out."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _located(text: Column, shape: str, kind: int, valid) -> Column:
    """Valid matches with their places: the lengths of matches and of what lies between them, added up."""
    hits = F.regexp_extract_all(text, F.lit(shape), F.lit(0))
    between = F.split(text, shape, -1)
    sides = F.zip_with(F.slice(between, 1, F.size(hits)), F.slice(between, 2, F.size(hits)), lambda p, q: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT_CHARS)).alias("left"), F.left(q, F.lit(CONTEXT_CHARS)).alias("right")))
    steps = F.zip_with(hits, sides, lambda h, p: F.struct(h.alias("hit"), p["gap"].alias("gap"), p["left"].alias("left"), p["right"].alias("right")))
    none = F.array().cast(_SPAN)

    def step(a: Column, s: Column) -> Column:
        at = a["at"] + s["gap"]
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(s["hit"])).alias("end"), s["hit"].alias("item"), s["left"].alias("left"), s["right"].alias("right"))
        return F.struct((at + F.length(s["hit"])).alias("at"), F.when(valid(s["hit"]), F.concat(a["out"], F.array(span).cast(_SPAN))).otherwise(a["out"]).alias("out"))

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(*[(x[f] + by if f in ("start", "end") else x[f]).alias(f) for f in _FIELDS]))

    # appending copies, so matches are added up in blocks and blocks then placed; the one-element array binds the steps, which lambdas would else evaluate anew
    last = lambda s: F.floor(F.greatest(F.size(s) - 1, F.lit(0)) / BLOCK).cast("int")
    blocks = F.transform(F.array(steps), lambda s: F.transform(F.sequence(F.lit(0), last(s)), lambda k: F.aggregate(F.slice(s, k * BLOCK + 1, BLOCK), F.struct(F.lit(0).alias("at"), none.alias("out")), step)))[0]
    lists = F.array().cast(f"array<{_SPAN}>")
    placed = lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(shifted(x["out"], a["at"])).cast(f"array<{_SPAN}>")).alias("out"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), lists.alias("out")), placed, lambda a: F.flatten(a["out"]))


def _mentioned(m: Column) -> Column:
    """Spaced digit groups are a mention from seven digits on, as a phone is; unbroken tokens always."""
    return ~m.rlike(r"[\x20()/]") | (F.length(_digits(m)) >= 7)


def _split_off(m: Column, spans: Column) -> Column:
    """The mentions left of ``m`` where ``spans`` overlap it; an unbroken token leaves none."""
    low, high = lambda b: F.greatest(b["start"], m["start"]), lambda b: F.least(b["end"], m["end"])
    masked = F.aggregate(spans, m["item"], lambda t, b: F.overlay(t, F.repeat(F.lit(MASK), high(b) - low(b)), low(b) - m["start"] + 1, high(b) - low(b)))
    left = lambda x: F.when(F.substring(masked, 1, x["start"]).contains(MASK), F.substring_index(x["left"], MASK, -1)).otherwise(F.concat(m["left"], x["left"]))
    right = lambda x: F.when(F.substring(masked, x["end"] + 1, F.length(masked)).contains(MASK), F.substring_index(x["right"], MASK, 1)).otherwise(F.concat(x["right"], m["right"]))
    pieces = _located(masked, MENTION, -1, _mentioned)
    return F.transform(pieces, lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + m["start"]).alias("start"), (x["end"] + m["start"]).alias("end"), x["item"].alias("item"), left(x).alias("left"), right(x).alias("right")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base: spans of the fixed shapes by start and kind, mentions: identifier-like tokens and spaced digit groups outside of them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none, text = F.array().cast(_SPAN), F.col("text")
    wants = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    rows = rows.withColumns({f"_{k}": F.when(wants[k], _located(text, SHAPES[k], i, lambda m, k=k: _valid(k, m))).otherwise(none) for i, k in enumerate(KINDS)})
    found = F.array_sort(F.concat(*[f"_{k}" for k in KINDS]), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    rows = rows.withColumn("base", found)
    mentions = F.when(text.rlike("[0-9@]"), _located(text, MENTION, -1, _mentioned)).otherwise(none)
    over = lambda m: lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])
    free = F.flatten(F.transform(mentions, lambda m: F.when(F.exists("base", over(m)), _split_off(m, F.filter("base", over(m)))).otherwise(F.array(m).cast(_SPAN))))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "base", free.alias("mentions"))


def _form(item: Column) -> Column:
    """What the item looks like: letters as one, digits as one in addresses and each in numbers, with whether the check digit of a long number fits."""
    letters = F.regexp_replace(item, "[A-Za-z]+", "a")
    digits = _digits(item)
    checked = F.when(F.length(digits) >= 12, F.when(_luhn(digits), "/c").otherwise("/n")).otherwise(F.lit(""))
    address = item.contains("@") | item.rlike(r"^[0-9]+(\.[0-9]+)+$")
    return F.when(address, F.regexp_replace(letters, "[0-9]+", "0")).otherwise(F.concat(F.regexp_replace(letters, "[0-9]", "0"), checked))


def _patterns(m: Column) -> Column:
    """Lexical patterns of a mention. Words and marks count, in lower case, numbers made alike."""
    plain = lambda t: F.regexp_replace(F.lower(t), "[0-9]+", "0")
    before = F.regexp_extract_all(plain(m["left"]), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))
    # of what follows, a word that touches the mention is not one of its own
    after = F.regexp_extract(plain(m["right"]), r"^\s*([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])", 1)
    n = F.size(before)
    last = lambda k: F.when(n >= k, F.concat(F.lit(f"{k}:"), F.array_join(F.slice(before, F.greatest(n - k + 1, F.lit(1)), k), " ")))
    follows = F.when(after != "", after)
    around = F.when(n >= 1, F.concat(F.lit("lr:"), F.element_at(before, -1), F.lit(" _ "), follows))
    return F.array_compact(F.array(last(1), last(2), last(3), F.concat(F.lit("r:"), follows), around, F.concat(F.lit("f:"), _form(m["item"]))))


def _fits(kind: Column, item: Column) -> Column:
    """Whether an unseen identifier can be of a kind: 0 email, 1 ip, 2 card, 3 phone, 4 secret. Items are without blanks and brackets."""
    n = F.length(_digits(item))
    ip = item.rlike(r"^[0-9]+(\.[0-9]+){2,}$")
    secret = (F.length(item) >= 8) & item.rlike("[0-9]") & item.rlike("[a-z]") & ~item.contains("@")
    return F.when(kind == 0, item.contains("@")).when(kind == 1, ip).when(kind == 2, n.between(12, 19) & ~item.rlike("[a-z@]")).when(kind == 3, n.between(7, 15) & ~item.rlike("[a-z@]") & ~ip).otherwise(secret)


def mention_edges(scanned: DataFrame, hidden: Column | None = None) -> DataFrame:
    """One row per mention and pattern: doc_id, text_key, kind (-1: not a seed), was (its kind if it weren't hidden), start, end, item, pattern.

    ``hidden``: a condition on ``item``; seeds that meet it are taken for unknown mentions, to measure what the patterns find again.
    """
    each = scanned.where("size(base) + size(mentions) > 0").select("doc_id", "text_key", F.explode(F.concat("base", "mentions")).alias("m"))
    item = F.lower(F.regexp_replace(F.col("m.item"), r"[\x20()/]", ""))
    was = F.when((F.col("m.kind") < 0) & F.col("m.item").rlike(f"^(?:{LONG})$"), SECRET).otherwise(F.col("m.kind"))
    rows = each.select("doc_id", "text_key", was.alias("was"), "m.start", "m.end", item.alias("item"), F.explode(_patterns(F.col("m"))).alias("pattern"))
    kind = F.col("was") if hidden is None else F.when(hidden, -1).otherwise(F.col("was"))
    return rows.withColumn("kind", kind)


def score_patterns(edges: DataFrame, rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """Accepted patterns: pattern, kind, confidence, seeds (different seed instances)."""
    counted = write_table(edges.groupBy("pattern", "kind", "item").agg(F.count("*").alias("n")), "mentions")
    telling = (F.col("kind") != SECRET) | ~F.col("pattern").startswith("f:")
    seeded = counted.where(F.col("kind") >= 0).where(telling).groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds)
    totals = counted.join(seeded.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(F.sum("n").alias("total"))
    patterns = write_table(seeded.join(totals, "pattern"), "patterns")
    graph = counted.withColumnRenamed("kind", "_kind").join(patterns.select("pattern", "kind", "total"), "pattern")
    graph = graph.withColumn("seed", F.col("_kind") == F.col("kind")).where(F.col("seed") | ((F.col("_kind") < 0) & _fits(F.col("kind"), F.col("item"))))
    graph = write_table(graph.select("pattern", "kind", "item", "n", "seed", "total"), "graph")
    score = graph.where("seed").select("kind", "item", F.lit(1.0).alias("score")).distinct()
    confidence = None
    for _ in range(rounds):
        weighed = graph.join(score, ["kind", "item"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        confidence = write_table(weighed.groupBy("pattern", "kind").agg((F.sum(F.col("n") * F.col("score")) / (F.first("total") + 1)).alias("confidence")), "confidence")
        known = graph.join(confidence, ["pattern", "kind"]).groupBy("kind", "item")
        score = known.agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))))).alias("score"))
    return confidence.where(F.col("confidence") >= min_confidence).join(patterns.select("pattern", "kind", "seeds"), ["pattern", "kind"])


def discovered(edges: DataFrame, accepted: DataFrame) -> DataFrame:
    """Mentions outside the fixed shapes that an accepted pattern marks: doc_id, text_key, was, start, end, kind (of the most confident pattern)."""
    new = edges.where((F.col("kind") < 0) | (F.col("kind") == SECRET)).withColumnRenamed("kind", "_kind").join(accepted, "pattern")
    new = new.where(_fits(F.col("kind"), F.col("item")) & ((F.col("_kind") < 0) | (F.col("kind") == SECRET)))
    return new.groupBy("doc_id", "text_key", "was", "start", "end").agg(F.min_by("kind", F.struct(-F.col("confidence"), F.col("kind"))).alias("kind"))


def held_out_recall(docs: DataFrame, parts: int = 10, rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kind, hidden, found: of every ``parts``-th different seed, hidden from the patterns wherever it occurs, how many mentions they find again."""
    scanned = write_table(scan(docs, id_col, text_col), "scanned")
    edges = mention_edges(scanned, (F.col("was") >= 0) & (F.pmod(F.xxhash64("item"), F.lit(parts)) == 0))
    found = discovered(edges, write_table(score_patterns(edges, rounds, min_seeds, min_confidence), "accepted"))
    own = [F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text_key", "was", "start", "end"]
    hidden = edges.where("kind < 0 and was >= 0").select(*own).distinct()
    again = hidden.join(found.where("was = kind").select(*own), ["doc_id", "text_key", "was", "start", "end"], "left_semi")
    both = hidden.groupBy("was").agg(F.count("*").alias("hidden")).join(again.groupBy("was").agg(F.count("*").alias("found")), "was", "left")
    return both.select(F.get(F.array(*[F.lit(k) for k in NAMES]), F.col("was")).alias("kind"), "hidden", F.coalesce("found", F.lit(0)).alias("found"))


def find_pii(docs: DataFrame, rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base and added: arrays of (kind, start, end); kinds index ``NAMES``."""
    scanned = write_table(scan(docs, id_col, text_col), "scanned")
    edges = mention_edges(scanned)
    accepted = write_table(score_patterns(edges, rounds, min_seeds, min_confidence), "accepted")
    new = discovered(edges, accepted).groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("added"))
    slim = "array<struct<kind:int,start:int,end:int>>"
    out = scanned.join(new, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    added = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("doc_id", "text_key", base.alias("base"), F.coalesce(added, F.array().cast(slim)).alias("added"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _in_order(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(a["end"] - b["end"]))


def _base_columns() -> list[Column]:
    of = lambda i: lambda s: s["kind"] == i  # noqa: E731  (a second parameter would be the place in the array)
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return [*counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256")]


def base_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts, base_sha256 and base_spans of the fixed shapes alone."""
    return scan(docs, id_col, text_col).select("doc_id", *_base_columns(), _listed(F.col("base")).alias("base_spans"))


def pii_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, whose counts are of the fixed shapes; n_added: spans of the method; n_found: all spans."""
    found = find_pii(docs)
    every = F.concat("base", "added")
    return found.select("doc_id", *_base_columns(), _listed(_in_order(every)).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(every).cast("long").alias("n_found"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by its kind in angle brackets; same columns. Texts without spans stay as they are."""
    found = find_pii(docs, id_col=id_col, text_col=text_col).where("size(base) + size(added) > 0")
    found = found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), _in_order(F.concat("base", "added")).alias("_spans")).dropDuplicates(["_doc", "_key"])
    # the row is one column, so that no name of the input can clash
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce("_text", F.lit(""))) == F.col("_key")), "left")
    names, text = F.array(*[F.lit(f"<{k}>") for k in NAMES]), F.col("_text")

    def cut(a: Column, s: Column) -> Column:
        over = s["start"] < a["at"]
        piece = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(over, a["out"]).otherwise(F.concat(a["out"], piece)).alias("out"))

    clean = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.col("_spans").isNotNull(), clean).otherwise(text)
    return joined.select(*[(clean if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
