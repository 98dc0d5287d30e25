"""Suffix-array dedup: bytes covered by a LENGTH-byte string that starts anywhere else are removed.

A string of LENGTH bytes starts at each place of a text that has so many bytes left. Its anchor is its leftmost GRAM bytes with the
smallest hash, so equal strings have equal anchors, and the places of one anchor in one text are a stretch, and their strings a passage.

1. Anchors that come once in the corpus have no repeats; only their hashes are shuffled.
2. Passages that come more than once, by two 64-bit hashes, are repeated throughout.
3. The other passages of an anchor that comes again are sorted together: a suffix array of the places in question by two-stage sorting. Suffixes
   smaller than their successors are sorted directly; the rest are induced by scanning the buckets of first bytes in order. Then the common
   prefix of neighbours tells which strings come again.
4. An anchor with more than HOT different passages is not gathered: the hashes of its strings are counted instead, with partial sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emenda.llm.common import BROADCAST_BYTES, ROW_BYTES, materialise, released, split_join, table_batches, to_python, utf8_parts
from emenda.llm.ngram_join import _changes, _grouped, _parts, mix

LENGTH = 400
GRAM = 128
HOT = 2048
#: Longer texts are looked through in parts of so many bytes that overlap.
PART = 4 << 20
#: A block of passages is sorted once it has so many places.
BLOCK = 1 << 19
_BITS = np.uint64(23)
_SALT = np.frombuffer(b"".join(hashlib.blake2b(bytes([k]), digest_size=8).digest() for k in range(256)), np.uint64)


class Hashes:
    """Polynomial hashes modulo 2^64 of any stretches of a string of bytes."""

    base = 0xD1342543DE82EF95 | 1
    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        with np.errstate(over="ignore"):
            if len(Hashes.powers) < n:
                size = 1 << n.bit_length()
                for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                    own = np.full(size, base, np.uint64)
                    own[0] = 1
                    setattr(Hashes, name, np.multiply.accumulate(own))
            self.run = np.zeros(n, np.uint64)
            np.cumsum(_SALT[raw] * self.powers[: n - 1], out=self.run[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.run[end] - self.run[start]) * self.inverse[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: the end of one block and the beginning of the next."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def passages(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """text, first and last place, anchor hash, passage hash for each stretch of places with one anchor, place by place in the text."""
    out = []
    n = len(raw)
    if n < length:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    h = Hashes(raw)
    at = np.arange(n - gram + 1)
    key = h(at, at + gram)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    value = (key >> _BITS << _BITS) | at.astype(np.uint64)
    value[owner[: n - gram + 1] != owner[gram - 1 :]] = np.iinfo(np.uint64).max
    anchor = (sliding_least(value, length - gram + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
    whole = owner[: n - length + 1] == owner[length - 1 :]
    place = np.flatnonzero(whole)
    if not len(place):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    own = anchor[place]
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (owner[place[1:]] != owner[place[:-1]])))
    first, last = place[new], place[np.append(new[1:], len(place)) - 1]
    own = own[new]
    with np.errstate(over="ignore"):
        passage = mix(h(first, last + length) + (own - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64))
    text = owner[first]
    out = [text, first - offsets[text], last - offsets[text], key[own], passage]
    return out


def _parts_of(raw: np.ndarray, offsets: np.ndarray, length: int):
    """(text numbers, their bytes, their offsets, where in the text each begins): long texts in overlapping parts."""
    size = np.diff(offsets)
    start = 0
    while start < len(size):
        if size[start] > PART:
            for at in range(0, int(size[start]) - length + 1, PART - length + 1):
                own = raw[offsets[start] + at : offsets[start] + min(int(size[start]), at + PART)]
                yield np.array([start]), own, np.array([0, len(own)]), at
            start += 1
            continue
        stop = start
        while stop < len(size) and offsets[stop + 1] - offsets[start] <= PART:
            stop += 1
        yield np.arange(start, stop), raw[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], 0
        start = stop


def digest(text):
    """16 bytes that name a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """x_id, x_first, x_last, x_anchor, x_passage of ``texts`` (x_id, x_text)."""

    def run(batches):
        for batch in table_batches(batches, 2 << 20):
            raw, offsets = utf8_parts(batch.column(1))
            for number, own, at, moved in _parts_of(raw, offsets, length):
                text, first, last, anchor, passage = passages(own, at, length, gram)
                if len(text):
                    ids = batch.column(0).take(pa.array(number[text]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(first + moved), pa.array(last + moved), pa.array(anchor.view(np.int64)), pa.array(passage.view(np.int64))], ["x_id", "x_first", "x_last", "x_anchor", "x_passage"])

    return texts.mapInArrow(released(run), "x_id binary, x_first long, x_last long, x_anchor long, x_passage long")


def suffix_order(raw: np.ndarray, place: np.ndarray, end: np.ndarray, h: Hashes, length: int) -> np.ndarray:
    """``place`` (ascending starts in ``raw``) in the order of the ``length`` bytes from each; bytes from ``end`` (of its passage) on count as zeros.

    Two-stage: a place is direct if its byte string is smaller than that of the next place, and induced if it is larger.
    """
    n = len(raw)
    padded = np.append(raw, np.zeros(8, np.uint8))
    # larger or smaller than the successor: by the first byte that differs from the one after it, within the passage
    edge = np.zeros(n + 1, bool)
    edge[np.unique(end)] = True
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(raw[1:].astype(np.int16) - raw[:-1])
    step[edge[1:]] = -1  # the last byte of a passage is followed by nothing, which is smaller
    known = np.where(step != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    induced_type = step[known] < 0

    # the successors of induced places are needed down to a direct one
    member = np.zeros(n + 1, bool)
    member[place] = True
    after = np.where(~induced_type | edge[1:], np.arange(n), n)
    after = np.minimum.accumulate(after[::-1])[::-1]  # the next direct place, or the passage's last byte
    tails = place[induced_type[place] & ~member[place + 1]]
    count = after[tails] - tails
    member[np.repeat(tails, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1] = True
    every = np.flatnonzero(member[:n])
    edges = every[edge[every + 1]]
    direct = every[~induced_type[every] & ~edge[every + 1]]

    # direct sorting: eight bytes at a time from where a group's common prefix ends
    spread = np.arange(8)
    limit = np.minimum(length, _passage_end(direct, end) - direct)

    def words(at: np.ndarray, most: np.ndarray) -> np.ndarray:
        take = padded[at[:, None] + spread] * (spread < most[:, None])
        return take.astype(np.uint8).view(">u8").ravel().astype(np.uint64)

    order = np.argsort(words(direct, limit), kind="stable")
    rank = words(direct[order], limit[order])
    group = np.cumsum(np.append(True, rank[1:] != rank[:-1])) - 1
    depth = np.full(len(order), 8)
    while True:
        size = np.bincount(group)
        open_ = np.flatnonzero((size[group] > 1))
        if not len(open_):
            break
        own = order[open_]
        g = group[open_]
        head = np.append(True, g[1:] != g[:-1])
        lead = own[np.flatnonzero(head)[np.cumsum(head) - 1]]
        low = _common(h, direct[own], direct[lead], np.minimum(limit[own], limit[lead]), depth[open_])
        starts, member_of = np.flatnonzero(head), np.cumsum(head) - 1
        least = np.maximum(np.minimum.reduceat(low, starts)[member_of], depth[open_])
        key = words(np.minimum(direct[own] + least, n), np.maximum(limit[own] - least, 0))
        # after these eight bytes the group's bytes are at an end, and what is equal stays so
        same = least + 8 >= np.maximum.reduceat(limit[own], starts)[member_of]
        again = np.lexsort((key, g))
        order[open_] = own[again]
        new = np.append(True, (g[1:] != g[:-1]) | (key[again][1:] != key[again][:-1]))
        # groups that are done get numbers of their own for each member
        new |= same[again]
        fresh = np.ones(len(order), bool)
        fresh[open_] = new
        group = np.cumsum(fresh) - 1
        depth[open_] = least[again] + 8
    direct = direct[order]

    # induction: buckets in the order of their byte; what precedes an ordered place, and is larger, goes to its own bucket in that order
    out = []
    first = raw[direct]
    bounds = np.searchsorted(first, np.arange(257))
    at_edge = [edges[raw[edges] == c] for c in range(256)] if len(edges) else [edges] * 256
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    induces = np.zeros(n, bool)
    induces[every] = induced_type[every] & ~edge[every + 1]
    for c in range(256):
        fresh = np.concatenate([at_edge[c], *pending[c]])  # a byte that nothing follows is the least of its bucket
        chunks = [fresh]
        while len(fresh):  # runs of the same byte
            before = fresh - 1
            before = before[(before >= 0)]
            fresh = before[induces[before] & (raw[before] == c)]
            chunks.append(fresh)
        own = direct[bounds[c] : bounds[c + 1]]
        row = np.concatenate([*chunks, own])
        if len(row):
            out.append(row)
            before = row - 1
            before = before[before >= 0]
            before = before[induces[before] & (raw[before] > c)]
            if len(before):
                byte = raw[before]
                by = np.argsort(byte, kind="stable")
                cuts = np.flatnonzero(np.diff(byte[by])) + 1
                for part in np.split(before[by], cuts):
                    pending[raw[part[0]]].append(part)
    result = np.concatenate(out) if out else np.zeros(0, np.int64)
    wanted = np.zeros(n + 1, bool)
    wanted[place] = True
    return result[wanted[result]]


def _passage_end(at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first passage end after each place; ``end`` ascends."""
    return end[np.searchsorted(end, at, "right")]


def _common(h: Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Common prefixes of stretches from ``a`` and ``b``, of ``least`` at least and ``most`` at most, by bisection on hashes."""
    low, high = np.minimum(least, most), most.copy()
    while True:
        going = np.flatnonzero(low < high)
        if not len(going):
            return low
        middle = (low[going] + high[going] + 1) // 2
        same = h(a[going], a[going] + middle) == h(b[going], b[going] + middle)
        low[going[same]] = middle[same]
        high[going[~same]] = middle[~same] - 1


def repeated_places(raw: np.ndarray, offsets: np.ndarray, places: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For passages one after the other (``places`` starts in each, ``length`` - 1 bytes more), whether the string from each start comes again among them."""
    start = np.repeat(offsets[:-1], places) + np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
    h = Hashes(raw)
    order = suffix_order(raw, start, offsets[1:], h, length)
    a, b = order[:-1], order[1:]
    full = np.full(len(a), length)
    prefix = _common(h, a, b, full, np.zeros(len(a), np.int64))
    again = np.zeros(len(raw) + 1, bool)
    hit = prefix >= length
    again[a[hit]] = True
    again[b[hit]] = True
    return again[start]


def repeated_stretches(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """x_id, x_spans: array<struct<a, b>> of bytes to remove (not yet merged) for each text, by digest, that has any.

    Repeated rows and equal texts have the same digest and make each other's strings come again.
    """
    texts = to_python(docs).select(digest(F.col(text)).alias("x_id"), F.coalesce(F.col(text), F.lit("")).alias("x_text"))
    long = texts.where(F.octet_length("x_text") >= length)
    rows = materialise(anchored(long, length, gram), "anchors")
    often = materialise(rows.groupBy("x_anchor").agg(F.count(F.lit(1)).alias("x_n")).where("x_n > 1"), "often")
    met = materialise(split_join(rows, often, ["x_anchor"], "x_n", "left_semi"), "met")
    kinds = met.groupBy("x_anchor", "x_passage").agg(F.count(F.lit(1)).alias("x_n"), F.min(F.struct("x_id", "x_first", "x_last")).alias("x_one"))
    kinds = materialise(kinds, "kinds")
    several = materialise(kinds.groupBy("x_anchor").agg(F.count(F.lit(1)).alias("x_kinds")).where("x_kinds > 1"), "several")
    again = split_join(met, kinds.where("x_n > 1").select("x_anchor", "x_passage", "x_n"), ["x_anchor", "x_passage"], "x_n", "left_semi")
    again = again.select("x_id", F.col("x_first").alias("a"), (F.col("x_last") + length).alias("b")).distinct()

    unlike = split_join(kinds, several, ["x_anchor"], "x_kinds").select("x_anchor", "x_passage", "x_n", "x_kinds", "x_one.*")
    wanted = unlike.groupBy("x_id").agg(F.collect_list(F.struct("x_first", "x_last", "x_anchor", "x_n", "x_kinds")).alias("x_want"))  # as many as a text has stretches at most
    wanted = materialise(wanted, "wanted")
    held = only(long, wanted).join(wanted, "x_id")

    def cut(batches):
        seen = set()
        for batch in table_batches(batches, 4 << 20):
            out = [[], [], [], [], [], [], []]
            for name, body, want in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(name)
                for w in want:
                    row = (w["x_anchor"], w["x_kinds"], w["x_n"], name, w["x_first"], w["x_last"], body[w["x_first"] : w["x_last"] + length])
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            if out[0]:
                kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds_of, strict=True)], ["x_anchor", "x_kinds", "x_n", "x_id", "x_first", "x_last", "x_body"])

    bodies = materialise(held.select("x_id", "x_text", "x_want").mapInArrow(released(cut), "x_anchor long, x_kinds long, x_n long, x_id binary, x_first long, x_last long, x_body binary"), "bodies")
    few = bodies.where(F.col("x_kinds") <= HOT).dropDuplicates(["x_anchor", "x_id", "x_first"])
    sorted_ = sorted_repeats(few, length)
    hot = hashed_repeats(bodies.where(F.col("x_kinds") > HOT).select("x_id", "x_first", "x_n", "x_body"), length)
    spans = again.unionByName(sorted_).unionByName(hot)
    return spans.groupBy("x_id").agg(F.collect_list(F.struct("a", "b")).alias("x_spans"))


def only(rows: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` with (or without) the ids in ``wanted``, so that fewer texts are shuffled; all rows if there are too many ids to broadcast."""
    return rows.join(F.broadcast(wanted.select("x_id")), "x_id", how) if few(wanted) else rows


def few(wanted: DataFrame) -> bool:
    return wanted.count() * ROW_BYTES <= BROADCAST_BYTES


def _stretches(first: int, again: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of repeated places as bytes covered."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
    return [(first + int(a), first + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def sorted_repeats(bodies: DataFrame, length: int) -> DataFrame:
    """x_id, a, b for places of passages (x_anchor, x_id, x_first, x_body) whose strings another passage of the anchor has too."""

    def run(batches):
        for table, bounds in _blocks(_grouped(batches, (0,))):
            raw, offsets = utf8_parts(table.column("x_body").combine_chunks())
            places = np.diff(offsets) - length + 1
            found = repeated_places(raw, offsets, places, length)
            ids, first = table.column("x_id").to_pylist(), np.asarray(table.column("x_first").combine_chunks())
            out = [[], [], []]
            at = np.cumsum(places) - places
            for i in np.flatnonzero(np.add.reduceat(found.astype(np.int64), at)):
                for a, b in _stretches(int(first[i]), found[at[i] : at[i] + places[i]], length):
                    for column, v in zip(out, (ids[i], a, b), strict=True):
                        column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["x_id", "a", "b"])

    return bodies.select("x_anchor", "x_id", "x_first", "x_body").repartition(_parts(bodies), "x_anchor").sortWithinPartitions("x_anchor").mapInArrow(released(run), "x_id binary, a long, b long")


def _blocks(groups):
    """Whole groups until a block has BLOCK places or so."""
    for table, bounds in groups:
        weight = np.asarray(pa.compute.binary_length(table.column("x_body")).combine_chunks()).astype(np.int64) - LENGTH + 1
        total = np.cumsum(np.maximum(weight, 1))
        start = 0
        for end in bounds[1:].tolist():
            if total[end - 1] - (total[start - 1] if start else 0) >= BLOCK or end == len(table):
                yield table.slice(start, end - start), None
                start = end


def hashed_repeats(bodies: DataFrame, length: int) -> DataFrame:
    """The same for passages of anchors with very many: the strings' hashes (two of 64 bits) are counted."""

    def strings(batches):
        for batch in table_batches(batches, 1 << 20):
            raw, offsets = utf8_parts(batch.column(3))
            places = np.diff(offsets) - length + 1
            row = np.repeat(np.arange(batch.num_rows), places)
            nth = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
            start = offsets[row] + nth
            h = Hashes(raw)
            one = h(start, start + length)
            with np.errstate(over="ignore"):
                two = mix(h(start, start + length // 2) * np.uint64(3) + h(start + length // 3, start + length))
            first = np.asarray(batch.column(1))[row] + nth
            many = np.asarray(batch.column(2))[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(first), pa.array(many), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["x_id", "x_place", "x_n", "x_one", "x_two"])

    every = materialise(bodies.distinct().mapInArrow(released(strings), "x_id binary, x_place long, x_n long, x_one long, x_two long"), "strings")
    twice = every.groupBy("x_one", "x_two").agg(F.sum("x_n").alias("x_n")).where("x_n > 1").select("x_one", "x_two")
    return every.join(twice, ["x_one", "x_two"], "left_semi").select("x_id", F.col("x_place").alias("a"), (F.col("x_place") + length).alias("b"))


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``. Null counts as empty; texts under ``length`` bytes keep all.

    Rows with the same text, repeated rows too, make each other's strings come again. Texts of any length are read whole, in parts that
    overlap. Nothing depends on the key. No rows give no rows.
    """
    return _cleaned(docs, key, text, length, gram, False)


def _cleaned(docs: DataFrame, key: str, text: str, length: int, gram: int, whole: bool) -> DataFrame:
    spans = materialise(repeated_stretches(docs, text, length, gram), "spans")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("x_text"), digest(F.col(text)).alias("x_id"))
    if few(spans):  # texts that keep all stay where they are
        cut = only(rows, spans).join(spans, "x_id")
        rows = cut.unionByName(only(rows, spans, "left_anti").withColumn("x_spans", F.lit(None).cast(cut.schema["x_spans"].dataType)))
    else:
        rows = rows.join(spans, "x_id", "left")
    rows = rows.select("doc_id", "x_text", "x_spans")

    def run(batches):
        for batch in table_batches(batches, 4 << 20):
            out = [[], [], [], [], []]
            for body, cuts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body, kept, at, runs = body or b"", [], 0, 0
                stop = -1
                for c in sorted((c["a"], c["b"]) for c in cuts or []):
                    if c[0] > stop:
                        kept.append(body[max(stop, 0) : c[0]])
                        runs += 1
                    stop = max(stop, c[1])
                kept = b"".join([*kept, body[max(stop, 0) :]])
                row = (len(body), len(body) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if whole else None)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            columns = [batch.column(0), *[pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]]
            yield pa.RecordBatch.from_arrays(columns[: 6 if whole else 5], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if whole else 5])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * whole)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The report with the bytes that stay (kept), which may begin or end inside a character."""
    return _cleaned(docs, key, text, length, gram, True)
