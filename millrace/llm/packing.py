"""Best-fit packing of tokenised documents with swap-based local search.

Lengths are integers from 1 to the capacity, so a packing depends on nothing but how many pieces have
each length. That histogram has at most ``capacity`` rows however large the corpus is. The driver packs
the histogram: best-fit decreasing over groups of equal bins, then local search over the underfull
groups. The plan says which ranks within each length go to which bins; executors rank the pieces and look
their place up. Only (id, piece, length) rows are shuffled, never texts or tokens.

Defined cases: a null or empty text is one piece of one token (the end id). Equal rows are packed each.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import release_memory, write_table

PIECES = "piece int, start long, length long, ids_crc32 long"
SALTS = 32  # every length is ranked in so many parts
CACHED_WORDS, CACHED_LETTERS, WORDS_A_CALL = 150_000, 48, 2000
#: Letters below U+0250 but for the dotted capital I, whose lower case is two characters; ASCII punctuation.
WORD = r"^(?P<core>[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"

Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def _laid_out(ids: np.ndarray, begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts ``which`` one after the other; part i is ``ids[begins[i]:begins[i + 1]]``. Also where each begins, and the end."""
    lengths = np.diff(begins)[which]
    at = np.concatenate([[0], np.cumsum(lengths)])
    place = np.repeat(begins[which] - at[:-1], lengths)
    place += np.arange(at[-1])
    return ids[place], at


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids as little-endian numbers. White space ends every token of the vocabulary, so the different words of a batch are encoded once each.

    A word of Latin letters, perhaps with punctuation after them, is its lower-case stem and the punctuation. Unknown
    stems are encoded together, past the tokenizer's normalizer and pattern, which leave them as they are, and told
    apart by the tokens that end a word. Other words are encoded one by one. What a batch used is remembered.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.letters = Tokenizer.from_file(vocabulary)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        self.known: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins and the last one ends."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # the six ASCII white spaces
        keyed = split.flatten().dictionary_encode()
        ids, begins = self._encode_words(keyed.dictionary)
        ids, begins = _laid_out(ids, begins, keyed.indices.to_numpy())
        return ids, begins[split.offsets.to_numpy()]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for different words. Parts: all stems, all punctuation, all other words; a word is one or two of them."""
        found = pc.extract_regex(words, WORD)
        plain = pc.is_valid(found)
        found = found.filter(plain)
        stems, tails = (x.dictionary_encode() for x in (pc.utf8_lower(found.field("core")), found.field("tail")))
        others = words.filter(pc.invert(plain))
        parts = [_strings(x) for x in (stems.dictionary, tails.dictionary, others)]
        known = self.known
        strange = dict.fromkeys(w for w in chain(parts[1], parts[2]) if w not in known)
        self._encode_letters([w for w in parts[0] if w not in known], strange)
        for w in strange:
            known[w] = np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
        encoded = [known[w] for w in chain(*parts)]
        if len(known) > CACHED_WORDS:  # rare words go; frequent ones are in this batch, too
            kept = (x for x in zip(chain(*parts), encoded) if len(x[0]) <= CACHED_LETTERS)
            self.known = dict(islice(kept, CACHED_WORDS))
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4)])
        number, n = plain.to_numpy(zero_copy_only=False), len(found)
        which = np.full((len(words), 2), len(encoded))
        which[number, 0], which[number, 1] = stems.indices.to_numpy(), len(parts[0]) + tails.indices.to_numpy()
        which[~number, 0] = len(encoded) - len(words) + n + np.arange(len(words) - n)
        ids, begins = _laid_out(np.frombuffer(b"".join(encoded), "<u4"), np.append(begins, begins[-1]), which.ravel())
        return ids, begins[::2]

    def _encode_letters(self, stems: list[str], strange: dict[str, None]) -> None:
        for k in range(0, len(stems), WORDS_A_CALL):
            part = stems[k : k + WORDS_A_CALL]
            ids = np.asarray(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(part):
                raw = ids.tobytes()
                self.known.update((w, raw[start:stop]) for w, start, stop in zip(part, [0, *stops], stops))
            else:
                strange.update(dict.fromkeys(part))


@lru_cache(2)
def _encoder(vocabulary: str) -> WordEncoder:
    """One per Python worker, so that later tasks of the worker know the words of earlier ones."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the other cores have workers of their own
    return WordEncoder(vocabulary)


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece; ``keep_ids`` adds the ids themselves as an array."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            ids, begins = encoder.encode_all(batch.column("text"))
            rows, parts = [], []
            for doc, (start, stop) in enumerate(pairwise(begins.tolist())):
                raw = ids[start:stop].tobytes() + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if keep_ids:
                        parts.append(np.frombuffer(part, "<u4").astype(np.int64))
            doc, piece, *numbers = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), *map(pa.array, numbers)]
            if keep_ids:
                columns.append(pa.array(parts, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)
        release_memory()

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(cut, f"doc_id long, {PIECES}" + ", ids array<long>" * keep_ids)


class _Groups:
    """Equal bins as (pattern, how many), found by the room they have left."""

    def __init__(self) -> None:
        self.by_room: dict[int, Counter[Pattern]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in self.by_room:
                self.by_room[room] = Counter()
                insort(self.rooms, room)
            self.by_room[room][pattern] += n

    def take(self, room: int, pattern: Pattern, n: int) -> None:
        left = self.by_room[room]
        left[pattern] -= n
        if not left[pattern]:
            del left[pattern]
            if not left:
                del self.by_room[room]
                self.rooms.pop(bisect_left(self.rooms, room))

    def best_fit(self, length: int) -> tuple[int, Pattern, int] | None:
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        pattern, n = next(iter(self.by_room[self.rooms[at]].items()))
        return self.rooms[at], pattern, n

    def bins(self) -> int:
        return sum(sum(c.values()) for c in self.by_room.values())


def _with(pattern: Pattern, add: dict[int, int]) -> Pattern:
    counts = Counter(dict(pattern))
    for length, n in add.items():
        counts[length] += n
    return tuple(sorted(((x, n) for x, n in counts.items() if n), reverse=True))


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> _Groups:
    """Each length, longest first, goes to the bin with the least room that still fits it."""
    groups = _Groups()
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room, pattern, n = groups.best_fit(length) or (capacity, (), left)
            fits = min(room // length, left)
            times = min(n, left // fits)
            if pattern:
                groups.take(room, pattern, times)
            groups.add(room - fits * length, _with(pattern, {length: fits}), times)
            left -= fits * times
    return groups


class _Targets:
    """Open bins by what they can take in exchange: for each piece they may give back (0: none), their room and that piece together."""

    def __init__(self, groups: _Groups) -> None:
        self.groups = groups
        self.entries: list[tuple[int, int, int, Pattern]] = sorted(e for room, held in groups.by_room.items() for p in held for e in self._of(room, p))

    @staticmethod
    def _of(room: int, pattern: Pattern) -> list[tuple[int, int, int, Pattern]]:
        return [(room + back, room, back, pattern) for back in [0, *(x for x, _ in pattern)]] if room else []

    def add(self, room: int, pattern: Pattern, n: int) -> None:
        if pattern not in self.groups.by_room.get(room, ()):
            for e in self._of(room, pattern):
                insort(self.entries, e)
        self.groups.add(room, pattern, n)

    def take(self, room: int, pattern: Pattern, n: int) -> None:
        self.groups.take(room, pattern, n)
        if pattern not in self.groups.by_room.get(room, ()):
            for e in self._of(room, pattern):
                del self.entries[bisect_left(self.entries, e)]

    def best_exchange(self, d_room: int, donor: Pattern) -> tuple[dict[int, int], int, Pattern] | None:
        """The move, one-for-one or two-for-one exchange that leaves a target the least room: (what the target gets, negative for what it gives; its room and pattern)."""
        gives = [((a,), a) for a, _ in donor] + [((a, b), a + b) for i, (a, n) in enumerate(donor) for b in [x for x, _ in donor[i + 1 :]] + [a] * (n > 1)]
        left, best = None, None
        for items, total in gives:
            for k in range(bisect_left(self.entries, (total,)), len(self.entries)):
                value, room, back, pattern = self.entries[k]
                if left is not None and value - total >= left:
                    break
                # two moves do the same as two pieces for none; a target must be as full as the donor, and not the donor itself
                if back >= total or room > d_room or (len(items) == 2 and not back) or ((room, pattern) == (d_room, donor) and self.groups.by_room[room][pattern] < 2):
                    continue
                change: Counter[int] = Counter(items)
                if back:
                    change[back] -= 1
                left, best = value - total, (dict(change), room, pattern)
                break
        return best


def least_bins(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound (Martello and Toth's L2): for every limit, what is larger than half needs a bin each, and what they can't take of the rest needs more."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return 0
    counts = np.array([histogram[x] for x in sizes.tolist()], dtype=np.int64)
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sizes * counts)])
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    best = 0
    for low in [0, *sizes[:half].tolist()]:
        first, top = int(np.searchsorted(sizes, low)), int(np.searchsorted(sizes, capacity - low, side="right"))
        top = max(top, half)
        large, small = int(number[-1] - number[half]), int(total[half] - total[first])
        spare = int((number[top] - number[half]) * capacity - (total[top] - total[half]))
        best = max(best, large + max(0, -(-(small - spare) // capacity)))
    return best


def local_search(groups: _Groups, capacity: int, max_moves: int | None = None) -> _Groups:
    """Exchange pieces between underfull bins so that the squared fill rises, until bins empty or nothing helps.

    Donors are taken from the emptiest on, each for as long as it finds an exchange; sweeps go on until one
    changes nothing. A target is at least as full as its donor, so every exchange raises the sum of squared
    fills and the search ends. It also ends once the bins are as few as the lower bound.
    """
    histogram: Counter[int] = Counter()
    for held in groups.by_room.values():
        for pattern, n in held.items():
            for length, times in pattern:
                histogram[length] += n * times
    least, now, moves, changed = least_bins(histogram, capacity), groups.bins(), 0, True
    targets = _Targets(groups)
    while changed and now > least:
        changed = False
        for d_room, d_pattern in [(room, p) for room in reversed(groups.rooms) if room for p in groups.by_room[room]]:
            while d_pattern and d_pattern in groups.by_room.get(d_room, ()):
                if now <= least or (max_moves is not None and moves >= max_moves):
                    return groups
                found = targets.best_exchange(d_room, d_pattern)
                if found is None:
                    break
                change, room, pattern = found
                n = groups.by_room[room][pattern]
                times = n // 2 if (room, pattern) == (d_room, d_pattern) else min(n, groups.by_room[d_room][d_pattern])
                gain = sum(x * k for x, k in change.items())
                targets.take(d_room, d_pattern, times)
                targets.take(room, pattern, times)
                targets.add(room - gain, _with(pattern, change), times)
                d_room, d_pattern = d_room + gain, _with(d_pattern, {x: -k for x, k in change.items()})
                if d_pattern:
                    targets.add(d_room, d_pattern, times)
                else:
                    now -= times
                moves, changed = moves + 1, True
    return groups


def plan_bins(histogram: dict[int, int], capacity: int, max_moves: int | None = None) -> list[tuple[Pattern, int]]:
    """(pattern, how many bins have it) for a histogram of lengths."""
    groups = local_search(best_fit_decreasing(histogram, capacity), capacity, max_moves)
    return [(p, n) for room in groups.rooms for p, n in groups.by_room[room].items()]


def slots_of(plan: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length in a sequence, offset of the first), by length and rank."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length, times in pattern:
            rows.append((length, used[length], sequence, times, offset))
            used[length] += n * times
            offset += length * times
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def assign(pieces: DataFrame, capacity: int = 4096, max_moves: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32 and perhaps ids).

    The pieces are written once, each with a salt from its place. What the driver gets is one number for each
    length and salt.
    """
    pieces = write_table(pieces.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "pieces")
    counted = pieces.groupBy("length", "_salt").agg(F.count("*").alias("n")).toPandas()  # at most `capacity` times SALTS rows
    table = np.zeros((capacity + 1, SALTS), np.int64)
    table[counted["length"].to_numpy(np.int64), counted["_salt"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    before = np.cumsum(table, axis=1) - table
    slots = slots_of(plan_bins({k: int(n) for k, n in enumerate(table.sum(axis=1)) if n}, capacity, max_moves))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(own).cast("long") - 1)
    keys = slots[:, 0] * (1 << 46) + slots[:, 1]
    with_ids = "ids" in pieces.columns
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b["length"].to_numpy(np.int64)
            rank = b["_rank"].to_numpy(np.int64) + before[length, b["_salt"].to_numpy(np.int64)]
            slot = slots[np.searchsorted(keys, length * (1 << 46) + rank, side="right") - 1]
            nth = rank - slot[:, 1]
            b["sequence_id"] = slot[:, 2] + nth // slot[:, 3]
            b["offset"] = slot[:, 4] + nth % slot[:, 3] * length
            yield b[[*names, "sequence_id", "offset"]]

    out = ranked.select(F.col("doc_id").cast("string").alias("doc_id"), *names[1:], "_rank", "_salt")
    return out.mapInPandas(place, "doc_id string, " + PIECES + ", ids array<long>" * with_ids + ", sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", max_moves: int | None = None) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens; one row per piece."""
    return assign(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), capacity, max_moves)


def packed_sequences(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids. A group is bounded by the capacity. Ids need not be unique, nor known."""
    placed = assign(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, keep_ids=True), capacity)
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    tokens = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return whole.select("sequence_id", F.size(tokens).alias("n_tokens"), tokens.alias("ids"))
