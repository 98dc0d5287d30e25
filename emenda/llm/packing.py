"""Best-fit packing of token pieces into sequences, by exact-complement hashing on the histogram of lengths.

Documents are cut into pieces of at most ``limit`` tokens. Only the number of pieces of each length, a table of at
most ``limit`` rows whatever the input, goes to the driver. There an index (``Sums``) holds how many single lengths, pairs and triples
have each sum under the availability counts; combinations that exactly fill a gap are consumed as long as pieces of those lengths
are there; what is left is placed best-fit, longest first. The plan, as runs of ranks of each length, goes back to the pieces: each
finds its place by its length and its rank among pieces of that length.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emenda.llm.common import materialise, table_batches, to_python, released

LIMIT = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Ranks within a length are counted in so many parts, so that no task gets all pieces of a common length.
PARTS = 256
#: Words kept with their ids by each worker; beyond it the cache starts afresh.
CACHED = 250_000
_LONG = 64
#: Letters (to be confirmed) and ASCII marks; special tokens have a bar, and their case counts.
_MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{}~]+)")


class WordIds:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its parts between spaces and line feeds. Arrow
    numbers a batch's different parts; only those are looked up, and numpy copies ids to their places.
    The tokenizer also parts letters from the marks after them and ignores case, so a part of letters and ASCII marks is a word and its marks, and
    a plain word is looked up in lower case. What the table hasn't yet is encoded: plain words by the model itself, the rest by the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.number = {"": 0}
        self.ids, self.start, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used, self.known = 0, 1

    @classmethod
    def of(cls, path: str) -> WordIds:
        """The one that this process has already, with what it has learnt from earlier tasks."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    @staticmethod
    def _word(part: str) -> tuple[str, str]:
        if part.isalpha():
            return (part.lower() if part.isascii() else part), ""
        found = _MARKED.fullmatch(part)
        if not found:
            return part, ""
        word, marks = found.groups()
        if word.isascii():
            return word.lower(), marks
        # a letter may end in a mark once it is composed and in lower case, which then belongs to the marks after it
        return (word, marks) if word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha() else (part, "")

    def _learn(self, words: list[str]) -> None:
        """Enter words that aren't known."""
        plain = [w for w in words if w.isascii() and w.isalpha()]  # they stand in lower case, and their bytes are letters of the model
        rest = [w for w in words if not (w.isascii() and w.isalpha())]
        model = self.tokenizer.model
        new = [[t.id for t in model.tokenize(w)] for w in plain]
        new += [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        size = np.array([len(x) for x in new], np.int64)
        total = int(size.sum())
        self.ids = _with_room(self.ids, self.used + total)
        self.start, self.size = (_with_room(x, self.known + len(new)) for x in (self.start, self.size))
        self.ids[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(new), "<u4", total)
        self.start[self.known : self.known + len(new)] = self.used + np.cumsum(size) - size
        self.size[self.known : self.known + len(new)] = size
        self.number.update(zip([*plain, *rest], range(self.known, self.known + len(new)), strict=True))
        self.used, self.known = self.used + total, self.known + len(new)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (one entry more than texts). Null counts as empty."""
        if len(self.number) > CACHED or self.used > 16 * CACHED:
            self.clear()
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words = list(itertools.chain.from_iterable(map(self._word, coded.dictionary.to_pylist())))
        new = list({w for w in words if w not in self.number})
        if new:
            self._learn(new)
        both = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)).reshape(-1, 2)
        code = both[coded.indices.to_numpy()].ravel()
        size = self.size[code]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[code] - ends + size, size) + np.arange(total)]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        offsets = np.concatenate([[0], ends])[2 * bounds]
        for w in new:  # long ones hardly come again
            if len(w) > _LONG:
                del self.number[w]
        return ids, offsets

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _with_room(x: np.ndarray, size: int) -> np.ndarray:
    """``x``, copied to twice the room that is needed if it has too little."""
    return x if len(x) >= size else np.concatenate([x, np.zeros(2 * size - len(x), x.dtype)])


_LOADED: dict[str, WordIds] = {}


@contextlib.contextmanager
def word_ids(path: str, forget: bool):
    """This process's ``WordIds``. With ``forget`` they go at the end: a worker that lives on between other stages then holds nothing of them."""
    try:
        yield WordIds.of(path)
    finally:
        if forget:
            _LOADED.pop(path, None)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, path: str | None = None, forget: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece: a document's ids and then id 1, cut only where longer than ``limit``. With ``forget`` each task learns its words anew."""
    path = path or public_tokenizers.path(VOCABULARY)
    last = np.array([END], "<u4").tobytes()

    def cut(batches):
        with word_ids(path, forget) as encode:
            yield from cut_by(encode, batches)

    def cut_by(encode, batches):
        for batch in table_batches(batches, 2 << 20):
            ids, offsets = encode.column(batch.column(1))
            size = np.diff(offsets) + 1
            each = -(-size // limit)
            owner = np.repeat(np.arange(len(size)), each)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            start = nth * limit
            length = np.minimum(limit, size[owner] - start)
            raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), (offsets[owner] + start) * 4
            # a document's last piece ends with the end id
            ends = nth == each[owner] - 1
            till = at + (length - ends) * 4
            crc = [zlib.crc32(last, zlib.crc32(raw[a:b])) if e else zlib.crc32(raw[a:b]) for a, b, e in zip(at.tolist(), till.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(nth, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return to_python(docs).select(key, text).mapInArrow(released(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Sums:
    """Lengths that are left, with an index of every sum of one, two and three of them.

    ``ways[k][s]`` counts the different combinations of k + 1 lengths with the sum s that the availability counts allow: a length is in a
    combination at most as often as there are pieces of it. An entry changes only where the first, second or third piece of a length comes
    or goes, by one vector operation over the lengths, so whether a gap can be filled exactly is one look-up.
    """

    def __init__(self, counts: np.ndarray):
        self.top = len(counts) - 1
        self.left = np.zeros(len(counts), np.int64)
        self.there = np.zeros(len(counts), np.int64)
        self.ways = [self.there, np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)]
        for v in np.flatnonzero(counts):
            self.change(int(v), int(counts[v]))

    def change(self, v: int, by: int) -> None:
        """More (or, negative, fewer) pieces of length ``v``."""
        old, new = min(int(self.left[v]), 3), min(int(self.left[v]) + by, 3)
        self.left[v] += by
        for k in range(old + 1, new + 1):
            self._piece(v, k, 1)
        for k in range(old, new, -1):
            self._piece(v, k, -1)

    def _piece(self, v: int, k: int, sign: int) -> None:
        """The ``k``-th piece of a length comes (1) or goes (-1): combinations in which it stands k times do so too."""
        one, two, three = self.ways
        if k * v > self.top:
            if k == 1:
                one[v] += sign
            return
        if k == 3:
            three[3 * v] += sign
            return
        others = one.copy()
        others[v] = 0
        if k == 2:
            two[2 * v] += sign
            three[2 * v :] += sign * others[: self.top + 1 - 2 * v]
            return
        if sign < 0:
            two[v:] -= others[: self.top + 1 - v]
        three[v:] += sign * two[: self.top + 1 - v]  # pairs without the length
        if sign > 0:
            two[v:] += others[: self.top + 1 - v]
        one[v] += sign

    def pair(self, gap: int) -> tuple[int, int]:
        """The pair with the largest length, where ways[1][gap] > 0."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (self.left[a] > 0) & (self.left[gap - a] > (2 * a == gap))
        first = int(a[ok.argmax()])
        return first, gap - first

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are there and sum to the gap, the fewest and then the largest first."""
        if gap <= 0:
            return None
        if self.ways[0][gap]:
            return (gap,)
        if self.ways[1][gap]:
            return self.pair(gap)
        if not self.ways[2][gap]:
            return None
        for first in np.flatnonzero(self.ways[0][:gap])[::-1].tolist():
            self.change(first, -1)
            rest = self.pair(gap - first) if self.ways[1][gap - first] else None
            self.change(first, 1)
            if rest:
                return (first, *rest)
        raise AssertionError("the index holds a sum that no lengths have")


def plan(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each. counts[n]: pieces of length n."""
    out = []
    index = Sums(counts)
    left = index.left

    def take(lengths: tuple[int, ...]) -> None:
        """As many sequences of this pattern as there are pieces for."""
        times = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        for v in set(lengths):
            index.change(v, -times * lengths.count(v))
        out.append((lengths, times))

    if left[limit]:
        take((limit,))
    for long in range(limit - 1, 0, -1):
        while left[long]:
            index.change(long, -1)  # a piece of its own isn't its complement
            found = index.filling(limit - long)
            index.change(long, 1)
            if not found:
                break
            take((long, *found))
    left = left.copy()
    # best fit, longest first, for whole classes of sequences with the same room
    rooms: dict[int, list[list]] = {}
    free = np.zeros(limit + 1, bool)
    for long in range(limit - 1, 0, -1):
        while left[long]:
            fit = int(free[long:].argmax()) + long if free[long:].any() else 0
            if fit:
                lengths, have = rooms[fit].pop()
                if not rooms[fit]:
                    free[fit] = False
            else:
                each = limit // long
                lengths, have = (), max(1, int(left[long]) // each)
                fit = limit
            each = min(fit // long, int(left[long]))
            have_now = min(have, int(left[long]) // each)
            if have > have_now and lengths:
                rooms.setdefault(fit, []).append([lengths, have - have_now])
                free[fit] = True
            left[long] -= have_now * each
            room = fit - each * long
            rooms.setdefault(room, []).append([lengths + (long,) * each, have_now])
            free[room] = room > 0
    out += [(lengths, n) for same in rooms.values() for lengths, n in same]
    return out


def runs(patterns: list[tuple[tuple[int, ...], int]], limit: int) -> dict[int, np.ndarray]:
    """For each length, runs of ranks: first rank, first sequence, pieces of the length in a sequence, first offset."""
    used, found, sequence = np.zeros(limit + 1, np.int64), {}, 0
    for lengths, times in patterns:
        offset = 0
        for v in sorted(set(lengths), reverse=True):
            each = lengths.count(v)
            found.setdefault(v, []).append((int(used[v]), sequence, each, offset))
            used[v] += each * times
            offset += each * v
        sequence += times
    return {v: np.array(rows, np.int64) for v, rows in found.items()}


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, path: str | None = None, forget: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``forget``: see ``pieces``.

    A null text is empty: one piece with the end id alone. Null and repeated keys are kept; rows with the same key are
    separate documents. Pieces of one length are ranked by key, piece, start and ids, so reruns agree. No rows give no rows.
    """
    cut = materialise(pieces(docs, key, text, limit, path, forget).withColumn("x_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int")), "pieces")
    by_part = materialise(cut.groupBy("length", "x_part").agg(F.count(F.lit(1)).alias("x_n")), "lengths")
    counts = np.zeros(limit + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("x_n").alias("n")).collect():  # at most ``limit`` rows
        counts[row["length"]] = row["n"]
    places = cut.sparkSession.sparkContext.broadcast(runs(plan(counts, limit), limit))
    ahead = by_part.withColumn("x_ahead", F.sum("x_n").over(W.partitionBy("length").orderBy("x_part")) - F.col("x_n")).drop("x_n")
    inner = W.partitionBy("length", "x_part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("x_in", F.row_number().over(inner)).join(ahead, ["length", "x_part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("x_ahead") + F.col("x_in") - 1).alias("x_rank"))

    def place(batches):
        table = places.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                v = int(length[own[0]])
                rows = table[v]
                at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                past = rank[own] - at[:, 0]
                sequence[own], offset[own] = at[:, 1] + past // at[:, 2], at[:, 3] + past % at[:, 2] * v
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return ranked.mapInArrow(released(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_table(report: DataFrame) -> pd.DataFrame:
    """How full the sequences are: one row with sequences, tokens and the share of room used at LIMIT."""
    return report.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count(F.lit(1)) * LIMIT)).alias("fill")).toPandas()
