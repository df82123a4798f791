"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Texts with equal shingle sets, by a digest of their words, form a class; its smallest id stands for it. One pass also counts every
   shingle into a table of fixed size, whose merged counts order shingles rare-first. An order only has to
   be the same everywhere, so shared counters cost speed, never a link.
2. Each representative gives its prefix n-grams. Two sets that reach the threshold share one, at positions
   and with sizes that leave room for the needed overlap (length and positional filters). Those filters see
   only size and position, so rows are first counted per (n-gram, size, position) cell and cells are
   compared instead of rows.
3. First, every row is compared with one member of its cell, and with its n-gram's hub: the text in which
   the n-gram comes earliest, which has the least of its own. What these links tie together needs no further
   comparison: a group of near copies costs its size, not its square.
4. Then every pair of rows in compatible cells that is not tied yet is compared. Pairs are reduced to one
   each, pass the suffix filter on counts over parts of the hash space, and are verified once on the words
   of both whole texts, not on hashes.

Only components are claimed of the result: links inside what step 3 tied are not listed.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing; fewer words than
the width are one shingle. Repeated rows are members of one class. A row without id comes back with a null
component and ties nothing. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.scratch import drop_since, release_memory, tables_made, write_table

COUNTERS, BLOCK = 1 << 21, 1 << 15
PARTS = 64
_K = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]  # fixed odd multipliers


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _K[0]
    x = x ^ (x >> np.uint64(29))
    x = x * _K[1]
    return x ^ (x >> np.uint64(32))


_BLOCK_BYTES = 1 << 19


def words_of(text: str | None) -> list[bytes]:
    """The words, A-Z in lower case; ``bytes`` knows just these letters and the six ASCII white spaces."""
    return (text or "").encode("utf-8").lower().split()


def shingle_sets(texts: Iterable[str | None], width: int = 3) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Each text's words, the sorted distinct 64-bit hashes of its word n-grams, and the first place of each. Texts are hashed in blocks of about half a megabyte."""
    block, size = [], 0
    for text in texts:
        block.append(words_of(text))
        size += len(text or "")
        if size >= _BLOCK_BYTES:
            yield from _block_sets(block, width)
            block, size = [], 0
    yield from _block_sets(block, width)


def _block_sets(block: list[list[bytes]], width: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    words = list(chain.from_iterable(block))
    table = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    hashed = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    grams = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for k in range(width):
        grams = _mix(grams * _K[2] + hashed[k : k + len(grams)])
    at = 0
    for own in block:
        n = len(own)
        if n >= width:
            yield own, *np.unique(grams[at : at + n - width + 1], return_index=True)
        else:
            h = np.full(min(1, n), n, np.uint64)
            for k in range(n):
                h = _mix(h * _K[2] + hashed[at + k : at + k + 1])
            yield own, h, np.zeros(len(h), np.int64)
        at += n


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    return next(shingle_sets([text], width))[1]


def class_digest(words: list[bytes], first: np.ndarray, width: int) -> bytes:
    """Digest of a set by the words of its shingles, in the order of their hashes: equal hashes of different words make no class."""
    h, places = hashlib.blake2b(digest_size=16), first.tolist()
    for k in range(min(width, len(words))):
        h.update(b" ".join([words[i + k] for i in places]) + b"\n")
    return h.digest()


def word_shingles(text: str | None, width: int) -> frozenset[tuple[bytes, ...]]:
    """The set itself, of words."""
    words = words_of(text)
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[k:] for k in range(width)), strict=False))


def prefix_size(n: int, percent: int) -> int:
    """A set of n that reaches the threshold with another shares at least ceil(percent / 100 * n) members with it."""
    return n - -(-percent * n // 100) + 1


def needed(n: Column, m: Column, percent: int) -> Column:
    """Least common members of sets of n and m: 100 c >= percent (n + m - c)."""
    return F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)


def compatible(a: str, b: str, percent: int) -> Column:
    """Length and positional filter on (n, pos) of two sides that share an n-gram."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (1 + F.least(n - i, m - j) - 1 >= needed(n, m, percent))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, digest, n, hash-space counts; and after each task's rows, its counters by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        counts = np.zeros(COUNTERS, np.int32)
        task = TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc, (words, s, first) in zip(b["doc_id"].array, shingle_sets(b["text"].array, width), strict=True):
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), np.int32(1))
                parts = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS)
                rows.append((doc, class_digest(words, first, width), len(s), parts.tolist(), None, task, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "digest", "n", "parts", "block", "task", "places", "counts"])
            yield out.astype({"block": "Int32"})
        held = counts.reshape(-1, BLOCK)
        for k in range(len(held)):
            at = np.flatnonzero(held[k])
            if len(at):  # the counters that are not zero, so that what a task sends is bounded by its shingles
                yield pd.DataFrame({"doc_id": [None], "digest": [None], "n": [0], "parts": [None], "block": [k], "task": [task], "places": [at.astype("<u2").tobytes()], "counts": [held[k][at].astype("<i4").tobytes()]})
        release_memory()

    # ids go as text: pandas would turn longs with nulls into doubles
    out = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, digest binary, n long, parts array<int>, block int, task int, places binary, counts binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _merged_counts(sets: DataFrame) -> np.ndarray:
    """The counters summed over all tasks in two levels; the driver gets the fixed number of blocks."""

    def add(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for at, c in zip(b["places"], b["counts"], strict=True):
            total[np.frombuffer(at, "<u2")] += np.frombuffer(c, "<i4")
        at = np.flatnonzero(total)
        return pd.DataFrame({"block": [key[0]], "places": [at.astype("<u2").tobytes()], "counts": [np.minimum(total[at], 2**31 - 1).astype("<i4").tobytes()]})

    held, schema = sets.where("block is not null"), "block int, places binary, counts binary"
    fan = max(1, int(held.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0] ** 0.5))
    once = held.select("block", F.pmod("task", F.lit(fan)).alias("salt"), "places", "counts").groupBy("block", "salt").applyInPandas(add, schema)
    out = np.zeros((COUNTERS // BLOCK, BLOCK), np.int32)
    for r in once.groupBy("block").applyInPandas(add, schema).toLocalIterator():
        out[r["block"], np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["counts"], "<i4")
    return out.reshape(-1)


def _prefixes(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers, whatever the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = held.value
        for b in batches:
            rows = []
            for doc, (_, s, _) in zip(b["doc_id"].array, shingle_sets(b["text"].array, width), strict=True):
                if len(s):
                    rare = np.argsort(order[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                    rows.append((doc, len(s), s[rare[: prefix_size(len(s), percent)]].view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "prefix"])
        release_memory()

    return docs.mapInPandas(run, "doc_id long, n long, prefix array<long>")


def suffix_filter(p: Column, q: Column, n: Column, m: Column, percent: int) -> Column:
    """Sets cannot have more in common than the sum, over parts of the hash space, of the lesser count. A null bounds nothing."""
    common = F.aggregate(F.zip_with(p, q, lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(common >= needed(n, m, percent), F.lit(True))


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _verified(pairs: DataFrame, parts: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""
    for side in "ab":
        p = parts.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("parts").alias(f"p_{side}"))
        pairs = pairs.join(p, side)
    near = suffix_filter(F.col("p_a"), F.col("p_b"), F.col("n_a"), F.col("n_b"), percent)
    pairs = write_table(pairs.where(near).select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # what the pairs name grows with the corpus, so it is not broadcast
    texts = write_table(docs.join(ids.hint("merge"), "doc_id", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, frozenset[tuple[bytes, ...]]] = {}

        def of(text: str) -> frozenset[tuple[bytes, ...]]:
            if text not in known:
                if len(known) >= 4:
                    known.pop(next(iter(known)))
                known[text] = word_shingles(text, width)
            return known[text]

        for b in batches:
            keep = []
            for x, y in zip(b["text_a"], b["text_b"], strict=True):
                p, q = of(x), of(y)
                c = len(p & q)
                keep.append(100 * c >= percent * (len(p) + len(q) - c) and c > 0)
            yield b.loc[keep, ["a", "b"]]
        release_memory()

    return both.select("a", "b", "text_a", "text_b").mapInPandas(verify, "a long, b long")


def _with_component(rows: DataFrame, comp: DataFrame, on: str, out: str) -> DataFrame:
    c = comp.select(F.col("node").alias(on), F.col("component").alias("_c"))
    return rows.join(c, on, "left").withColumn(out, F.coalesce("_c", on)).drop("_c")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (equal sets), component_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = write_table(_sets(docs, width), "sets")
    rows = sets.where("block is null").select("doc_id", "digest", "n", "parts")
    linked = rows.where("n > 0 and doc_id is not null")
    classes = write_table(linked.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes", rows=rows.count())
    parts = write_table(linked.join(classes, "digest").where(F.col("doc_id") == F.col("class_id")).select("doc_id", "digest", "n", "parts").dropDuplicates(["doc_id", "digest"]), "parts")
    prefixes = _prefixes(docs.where("doc_id is not null"), _merged_counts(sets), width, percent).join(parts.select("doc_id").distinct(), "doc_id", "left_semi")
    prefixes = write_table(prefixes, "prefixes")
    index = prefixes.select(F.col("n").cast("int").alias("n"), "doc_id", F.posexplode("prefix").alias("pos", "gram"))

    # only n-grams of two texts or more can link
    shared = index.groupBy("gram").agg(F.count("*").alias("_n")).where("_n > 1").select("gram")
    index = write_table(index.join(shared.hint("merge"), "gram", "left_semi"), "index")
    cells = write_table(index.groupBy("gram", "n", "pos").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("size")), "cells")
    own = index.alias("a").join(cells.where("size > 1").alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.pos") == F.col("b.pos")))
    own = own.where(compatible("a", "b", percent) & (F.col("doc_id") != F.col("pivot"))).select(*_pairs(F.col("doc_id"), F.col("pivot")))
    hubs = index.groupBy("gram").agg(F.min(F.struct("pos", "doc_id", "n")).alias("h")).select("gram", "h.pos", "h.n", F.col("h.doc_id").alias("hub"))
    spokes = index.alias("a").join(hubs.alias("b"), "gram").where(compatible("a", "b", percent) & (F.col("doc_id") != F.col("hub"))).select(*_pairs(F.col("doc_id"), F.col("hub")))
    first = write_table(_verified(own.unionByName(spokes).distinct(), parts, docs, width, percent), "links")
    comp = write_table(connected_components(first.select(F.col("a").alias("u"), F.col("b").alias("v"))), "tied", rows=2 * first.count())

    # what is not tied yet, within n-grams that still hold more than one component
    tied = _with_component(index, comp, "doc_id", "comp")
    open_grams = tied.groupBy("gram").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x < _y").select("gram")
    tied = write_table(tied.join(open_grams, "gram", "left_semi").select("gram", "n", "pos", "comp", "doc_id"), "open")
    cells = tied.groupBy("gram", "n", "pos", "comp").agg(F.count("*").alias("size"))
    apart = cells.alias("a").join(cells.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.comp") < F.col("b.comp")) & compatible("a", "b", percent))
    apart = apart.select(F.col("a.gram").alias("gram"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("n", "pos", "comp")])
    for side in "ab":
        t = tied.select("gram", F.col("n").alias(f"{side}_n"), F.col("pos").alias(f"{side}_pos"), F.col("comp").alias(f"{side}_comp"), F.col("doc_id").alias(side))
        apart = apart.join(t, ["gram", f"{side}_n", f"{side}_pos", f"{side}_comp"])
    tried = own.unionByName(spokes).distinct()
    rest = apart.select(*_pairs(F.col("a"), F.col("b"))).distinct().join(tried, ["a", "b"], "left_anti")
    more = write_table(_verified(rest, parts, docs, width, percent), "links")

    several = linked.join(classes, "digest").groupBy("doc_id").agg(F.min("class_id").alias("v"), F.max("class_id").alias("_y")).where("v < _y").select("doc_id")
    several = linked.join(classes, "digest").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v"))
    links = first.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(several)
    comp = connected_components(links)
    named = rows.join(classes, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    return _with_component(named, comp, "class_id", "component_id").select("doc_id", "n_shingles", "component_id", "class_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one of the smallest id; same columns.

    Rows without id, and texts without words, stay. Of rows that share an id one stays.
    """
    before = tables_made()
    found = write_table(jaccard_components(docs, width, percent, id_col, text_col).where("doc_id is not null").select("doc_id", "component_id"), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    several = write_table(found.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_several")), "several")
    drop_since(before, found, several)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"))  # one column, so that no name of the input can clash
    out = rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    if not several.isEmpty():
        same = F.col("_id") == F.col("_several")
        out = out.join(several, same, "left_anti").unionByName(out.join(several, same, "left_semi").dropDuplicates(["_id"]))
    return out.select("_row.*")
