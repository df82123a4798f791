"""Substring dedup by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes; a chunk ends where the hash's high bits are zero, within a
least and a largest length. Boundaries depend on the bytes near them only, so an insertion shifts text
without moving the later boundaries. Chunks are keyed by a 128-bit digest and a chunk's first place, by id
and offset, keeps it. Runs of chunks that occur elsewhere are repeats once they span ``min_bytes``; the
later copies are cut out of the text.

What is shuffled is one row a chunk: digest, id, offset and length. Firsts and counts are combined before the shuffle, and
the copies of a hot chunk are joined to one row, never to each other. Texts are not shuffled: cuts return
to them by a join on the row's id and digest.

Defined cases: a null or empty text has no chunks. Equal rows of one id count as one occurrence: they are
treated alike. A null id comes before all others. Texts shorter than the least length are one chunk. Cuts
fall on whole code points. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import write_table

AVERAGE_BITS = 5  # a boundary every 32 bytes beyond the least length
LEAST, LARGEST = 24, 160
MIN_BYTES = 100  # whole chunks of a passage of 50 words cover more


@lru_cache(1)
def gear_table() -> np.ndarray:
    """256 pseudo-random 32-bit numbers from a fixed rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([i]), seed=0x6EA4) for i in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + gear[data[i]] mod 2**32 at every byte: a sum over the last 32 bytes, made by doubling."""
    h = gear_table()[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def boundaries(raw: bytes, bits: int = AVERAGE_BITS, least: int = LEAST, largest: int = LARGEST) -> list[int]:
    """Ends of the chunks of ``raw``."""
    if not raw:
        return []
    data = np.frombuffer(raw, np.uint8)
    # continuation bytes can't start a chunk, so that cuts fall on whole code points
    whole = np.ones(len(data) + 1, bool)
    whole[:-1] = (data & 0xC0) != 0x80
    marks = np.flatnonzero((gear_hashes(data) >> np.uint32(32 - bits)) == 0) + 1
    marks = marks[whole[marks]].tolist()
    ends, at, k = [], 0, 0
    while len(raw) - at > least:
        while k < len(marks) and marks[k] < at + least:
            k += 1
        end = marks[k] if k < len(marks) and marks[k] <= at + largest else min(at + largest, len(raw))
        while not whole[end]:
            end += 1
        ends.append(end)
        at = end
    if at < len(raw):
        ends.append(len(raw))
    return ends


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: doc_id, text_key (of the row's whole text), at (byte offset), size, digest."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, keys, ats, sizes, digests = [], [], [], [], []
            for doc, text in zip(b["doc_id"].array, b["text"].array, strict=True):
                raw = (text or "").encode("utf-8")
                key, at = xxhash.xxh3_64_intdigest(raw) - (1 << 63), 0
                for end in boundaries(raw):
                    ids.append(doc)
                    keys.append(key)
                    ats.append(at)
                    sizes.append(end - at)
                    digests.append(xxhash.xxh3_128_digest(raw[at:end]))
                    at = end
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "text_key": np.array(keys, np.int64), "at": np.array(ats, np.int32), "size": np.array(sizes, np.int32), "digest": pd.Series(digests, dtype=object)})

    # ids go as text: pandas would turn longs with nulls into doubles
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, "doc_id string, text_key long, at int, size int, digest binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", across: bool = True) -> DataFrame:
    """Runs of chunks that also occur elsewhere: doc_id, text_key, start, end (bytes), cut (a first place lies before), first_doc_id, n_places.

    ``across``: only chunks that occur in more than one document (rows of one id are two where their texts differ); without it, repeats inside one document count as well.
    """
    chunks = chunk_rows(docs, id_col, text_col)
    place = F.struct("doc_id", "text_key", "at")
    seen = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    seen = seen.where("not (first.doc_id <=> last.doc_id and first.text_key = last.text_key)" if across else "first < last")
    seen = write_table(seen.select("digest", "first", "n"), "repeated")
    hits = chunks.join(seen, "digest").select("doc_id", "text_key", "at", "size", "first", "n").distinct()
    own = F.struct("doc_id", "text_key", "at") == F.col("first")
    row = Window.partitionBy("doc_id", "text_key").orderBy("at")
    # a run goes on while chunks touch and all of them are first places, or all are copies
    hits = hits.withColumn("copy", ~own)
    starts = F.coalesce((F.lag(F.col("at") + F.col("size")).over(row) != F.col("at")) | (F.lag("copy").over(row) != F.col("copy")), F.lit(True))
    runs = hits.withColumn("run", F.sum(starts.cast("int")).over(row)).groupBy("doc_id", "text_key", "run", "copy")
    runs = runs.agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("end"), F.min("first.doc_id").alias("first_doc_id"), F.max("n").alias("n_places"))
    return runs.where(F.col("end") - F.col("start") >= min_bytes).select("doc_id", "text_key", "start", "end", F.col("copy").alias("cut"), "first_doc_id", "n_places")


def dedup_substrings(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", across: bool = True) -> DataFrame:
    """One row per document with repeats: doc_id, n_repeats, n_cut, cut_bytes, spans (start, end, cut, first_doc_id), first_doc_ids, n_places, text_key."""
    spans = repeated_spans(docs, min_bytes, id_col, text_col, across)
    span = F.struct("start", "end", "cut", "first_doc_id")
    return spans.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_repeats"),
        F.sum(F.col("cut").cast("long")).alias("n_cut"),
        F.sum(F.when(F.col("cut"), F.col("end") - F.col("start")).otherwise(0)).cast("long").alias("cut_bytes"),
        F.sort_array(F.collect_list(span)).alias("spans"),
        F.sort_array(F.collect_set(F.when(F.col("cut"), F.col("first_doc_id")))).alias("first_doc_ids"),
        F.max("n_places").alias("n_places"),
    )


def text_key(text: Column) -> Column:
    @F.pandas_udf("long")
    def key(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield pd.Series([xxhash.xxh3_64_intdigest((x or "").encode("utf-8")) - (1 << 63) for x in v], dtype="int64")

    return key(text)


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", across: bool = True) -> DataFrame:
    """``docs`` with the later copies of repeats cut out of the texts; same columns."""
    found = dedup_substrings(docs, min_bytes, id_col, text_col, across).where("n_cut > 0")
    cuts = write_table(found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.expr("transform(filter(spans, s -> s.cut), s -> array(s.start, s.end))").alias("_cuts")), "cuts")

    @F.pandas_udf("string")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            out = []
            for text, cut in zip(texts, spans, strict=True):
                raw, at, kept = text.encode("utf-8"), 0, []
                for start, end in cut:
                    kept.append(raw[at:start])
                    at = end
                out.append(b"".join([*kept, raw[at:]]).decode("utf-8"))
            yield pd.Series(out, dtype=object)

    # the row is one column, so that no name of the input can clash
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_k", text_key(F.col("_text"))).join(cuts, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key")), "left")
    changed = rows.where("_cuts is not null").withColumn("_row", F.col("_row").withField(text_col, without(F.col("_text"), F.col("_cuts"))))
    return changed.select("_row.*").unionByName(rows.where("_cuts is null").select("_row.*"))
