"""N-gram Jaccard join: a chosen-path join on word shingles, without pairs of copies.

1. Each text becomes its set of shingles of five words; texts with equal sets are one class from then on. A class carries
   a signature of minhashes: tokens sampled from its set so that two sets share a token with the probability of their similarity.
2. Chosen path: each run sends a class from the root down 1 / threshold of the signature's tokens on average, chosen by a
   hash of the path. Buckets over LIMIT are split again by further tokens; in small ones all signatures are compared by brute
   force, and a spanning tree of what may be alike is kept. Runs repeat until a pair at the threshold is met with the target recall at the
   depth that was needed. Buckets that are still large at the last depth are compared block by block.
3. Trees join into families. In each family the sets themselves are compared by products of incidence matrices: all with all in a small
   one; a large one is cut into bands of set sizes, and those into blocks, and only blocks whose sizes allow a link meet.
   That gives every link's ends their counts, and a spanning tree of true links, from which classes follow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emenda.llm.common import HOT_KEY, keep_rows, materialise, released, row_mark, sized_broadcast, split_join, table_batches, to_python, utf8_parts

THRESHOLD = 0.8
SHINGLE = 5
TOKENS = 48
#: Buckets up to this size are compared by brute force.
LIMIT = 4096
#: Sets, and hashes in them, of a block. Two blocks at most are compared at once by the product of incidence matrices.
BLOCK, BLOCK_HASHES = 1024, 1 << 20
#: Families of more blocks than this are cut into bands first; in smaller ones all blocks meet, which copies fewer sets.
BANDED = 4
#: Sets whose sizes are in bands that aren't neighbours can't reach the threshold. The bands are a little wider than they need be, for rounding.
BAND = 1.0001 / THRESHOLD
DEPTH = 4
RECALL = 0.999
FIRST_RUNS = 4
#: Signatures that agree in fewer tokens than this share aren't of sets at the threshold: four standard deviations below it.
MAYBE = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / TOKENS) ** 0.5
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_WORDS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_TOKEN = np.array([int.from_bytes(hashlib.blake2b(b"token%d" % i, digest_size=8).digest(), "little") | 1 for i in range(TOKENS)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashed shingles of whole texts: words are runs of bytes other than ASCII white space, unchanged; a text of fewer words than a shingle is one."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                    out = np.full(n, base, np.uint64)
                    out[0] = 1
                    setattr(self, name, np.multiply.accumulate(out))

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each text the sorted distinct shingle hashes."""
        n = len(raw)
        if not n:
            return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
        self._grow(n + 1)
        inside = ~SPACES[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < n]
        begins[at] = inside[at]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = offsets[1:] - 1
        last = last[last >= 0]
        ends[last] = inside[last]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        with np.errstate(over="ignore"):
            run = np.zeros(n + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=run[1:])
            words = mix((run[end] - run[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _WORDS[0])
            bounds = np.searchsorted(start, offsets)
            whole = max(0, len(words) - SHINGLE + 1)
            grams = sum((words[k : k + whole] * _WORDS[k] for k in range(SHINGLE)), np.zeros(whole, np.uint64))
            grams = mix(grams)
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= SHINGLE:
                    out.append(np.unique(grams[a : b - SHINGLE + 1]))
                elif b > a:
                    out.append(mix((words[a:b] * _WORDS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
                else:
                    out.append(np.zeros(0, np.uint64))
        return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(n, TOKENS) minhashes of sets that aren't empty."""
    out = np.empty((len(sets), TOKENS), np.uint32)
    if not sets:
        return out
    every = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    with np.errstate(over="ignore"):
        for k in range(TOKENS):
            out[:, k] = np.minimum.reduceat(((every * _TOKEN[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """x_key, x_mark, x_sid (a digest of the set; null if there are no words), x_sig."""

    def run(batches):
        shingles = Shingler()
        for batch in table_batches(batches, 2 << 20):
            sets = shingles(*utf8_parts(batch.column(2)))
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full))
            sid = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sig = [next(sigs).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sid, pa.binary()), pa.array(sig, pa.binary())], ["x_key", "x_mark", "x_sid", "x_sig"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return to_python(docs).select(F.col(key).alias("x_key"), row_mark(docs).alias("x_mark"), F.col(text)).mapInArrow(released(run), f"x_key {kind}, x_mark long, x_sid binary, x_sig binary")


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(utf8_parts(column)[0].tobytes(), np.uint32).reshape(-1, TOKENS)


def _steps(sig: np.ndarray, path: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and their new paths: one token of the signature always, a second one with the probability that makes 1 / threshold on average."""
    n, size = np.arange(len(path)), np.uint64(TOKENS)
    with np.errstate(over="ignore"):
        a = mix(path + np.uint64(0x51))
        first = (a % size).astype(np.int64)
        second = ((first + 1 + (mix(a) % (size - np.uint64(1))).astype(np.int64)) % TOKENS).astype(np.int64)
        more = (a >> np.uint64(40)).astype(np.float64) / 2**24 < 1 / THRESHOLD - 1
        go = lambda token: mix(path * np.uint64(3) + mix((token.astype(np.uint64) << np.uint64(32)) + sig[n, token]))
        return [(n, go(first)), (n[more], go(second)[more])]


def chosen(rows: DataFrame, runs: range | None) -> DataFrame:
    """(x_sid, x_path): from the roots of ``runs``, or a level further down from x_path."""

    def run(batches):
        for batch in table_batches(batches):
            sid, sig = batch.column(0), _sig_matrix(batch.column(1))
            for r in runs if runs is not None else [None]:
                path = mix(np.full(len(sid), r + 1, np.uint64)) if r is not None else np.asarray(batch.column(2)).view(np.uint64)
                for at, new in _steps(sig, path):
                    yield pa.RecordBatch.from_arrays([sid.take(pa.array(at)), pa.array(new.view(np.int64))], ["x_sid", "x_path"])

    return rows.mapInArrow(released(run), "x_sid binary, x_path long")


def components(link: np.ndarray) -> np.ndarray:
    """For each vertex of a symmetric boolean matrix the smallest vertex that it is connected with."""
    label = np.full(len(link), -1)
    for root in range(len(link)):
        if label[root] < 0:
            label[root] = root
            edge = np.array([root])
            while len(edge):
                edge = np.flatnonzero(link[edge].any(0) & (label < 0))
                label[edge] = root
    return label


def _grouped(batches, keys: tuple[int, ...], bound: int = 64 << 20):
    """Runs of equal keys from sorted batches, several whole groups at a time: lists of (start, end) and a table."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])]).combine_chunks()
        change = _changes(table, keys)
        if len(change) > 1:
            cut = int(change[-1])
            yield table.slice(0, cut), change
            kept = table.slice(cut)
        else:
            kept = table
    if kept is not None and len(kept):
        yield kept, np.append(_changes(kept, keys), len(kept))


def _changes(table: pa.Table, keys: tuple[int, ...]) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[0] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        v = np.asarray(column) if not pa.types.is_binary(column.type) else np.frombuffer(utf8_parts(column)[0].tobytes(), "S16")
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def maybe_alike(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A spanning tree (x_a, x_b) of signatures that may be alike, in each bucket of ``rows`` (keys..., x_sid, x_sig)."""
    need = int(np.ceil(MAYBE * TOKENS))
    parts = _parts(rows)

    def run(batches):
        for table, bounds in _grouped(batches, tuple(range(len(keys)))):
            sid = np.array(table.column("x_sid").combine_chunks().to_pylist(), object)
            sig = _sig_matrix(table.column("x_sig").combine_chunks())
            left, right = [], []
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            ok = two[(sig[two] == sig[two + 1]).sum(1) >= need]
            left += [sid[ok]]
            right += [sid[ok + 1]]
            for a, b in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist(), strict=True):
                own = sig[a:b]
                same = np.zeros((b - a, b - a), np.uint8)
                for k in range(TOKENS):
                    same += own[:, k, None] == own[None, :, k]
                label = components(same >= need)
                other = np.flatnonzero(label != np.arange(b - a))
                left.append(sid[a + label[other]])
                right.append(sid[a + other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.binary()) for x in (left, right)], ["x_a", "x_b"])

    return rows.select(*keys, "x_sid", "x_sig").repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(released(run), "x_a binary, x_b binary")


def _parts(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _met(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with a line for each key; vertices with very many neighbours apart from the others."""
    if rows.count() <= HOT_KEY:
        return rows.join(least, key)
    return split_join(rows, materialise(least, "least"), [key], "x_n")


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """x_sid, x_root for each end of ``edges`` (x_a, x_b): alternating large-star and small-star steps until nothing changes.

    Neighbours are never gathered: a vertex's smallest neighbour is a minimum with partial sums, and is joined back.
    """
    edges = materialise(edges.where("x_a <> x_b").select(F.least("x_a", "x_b").alias("x_a"), F.greatest("x_a", "x_b").alias("x_b")).distinct(), "edges")
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("x_b").alias("x_a"), F.col("x_a").alias("x_b")))
        least = both.groupBy("x_a").agg(F.min("x_b").alias("x_m"), F.count(F.lit(1)).alias("x_n")).select("x_a", F.least("x_a", "x_m").alias("x_m"), "x_n")
        large = _met(both, least, "x_a").where("x_b > x_a").select(F.col("x_m").alias("x_a"), "x_b").where("x_a <> x_b").distinct()
        large = materialise(large, "large")
        # small star: each vertex's smaller neighbours and itself go to the smallest of them
        least = large.groupBy("x_b").agg(F.min("x_a").alias("x_m"), F.count(F.lit(1)).alias("x_n"))
        small = _met(large, least, "x_b").select(F.col("x_m").alias("x_l"), F.explode(F.array("x_a", "x_b")).alias("x_r"))
        edges = materialise(small.where("x_l <> x_r").select(F.col("x_l").alias("x_a"), F.col("x_r").alias("x_b")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x_a", "x_b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.groupBy("x_b").agg(F.min("x_a").alias("x_root")).select(F.col("x_b").alias("x_sid"), "x_root")
    return roots.unionByName(roots.select(F.col("x_root").alias("x_sid"), "x_root").distinct())


def families(classes: DataFrame) -> DataFrame:
    """x_sid, x_root: classes (x_sid, x_sig) that the chosen-path runs hold to be perhaps alike."""
    spark = classes.sparkSession
    found, done, runs, pool = [], 0, FIRST_RUNS, classes
    while done < runs:
        rows, depth, deep = materialise(chosen(pool.select("x_sid", "x_sig"), range(done, runs)), "paths"), 1, []
        while True:
            sizes = rows.groupBy("x_path").agg(F.count(F.lit(1)).alias("x_n")).where("x_n > 1")
            met = materialise(rows.join(sizes, "x_path").join(classes.select("x_sid", "x_sig"), "x_sid").select("x_path", "x_sid", "x_sig", "x_n"), "met")
            found.append(materialise(maybe_alike(met.where(F.col("x_n") <= LIMIT), ["x_path"]), "alike"))
            large = met.where(F.col("x_n") > LIMIT)
            if not large.limit(1).count():
                break
            deep.append(large.select("x_sid"))
            if depth == DEPTH:
                blocks = F.ceil(F.col("x_n") * 2 / LIMIT).cast("int")
                own = large.withColumn("x_k", F.pmod(F.xxhash64("x_sid"), blocks).cast("int")).withColumn("x_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
                own = own.select("x_path", F.least("x_k", "x_j").alias("x_i"), F.greatest("x_k", "x_j").alias("x_j"), "x_sid", "x_sig")
                found.append(materialise(maybe_alike(own, ["x_path", "x_i", "x_j"]), "alike"))
                break
            rows, depth = materialise(chosen(large.select("x_sid", "x_sig", "x_path"), None), "paths"), depth + 1
        done = runs
        if deep:  # at that depth a run meets a pair less often: those in large buckets run on until the target
            meets = (THRESHOLD * (2 - 1 / THRESHOLD) + (1 / THRESHOLD - 1) * (1 - (1 - THRESHOLD) ** 2)) ** depth
            runs = max(runs, int(np.ceil(np.log(1 - RECALL) / np.log(1 - meets))))
            ids = deep[0]
            for more in deep[1:]:
                ids = ids.unionByName(more)
            pool = materialise(classes.join(ids.distinct(), "x_sid", "left_semi"), "pool")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return connected(edges)


def exact_links(members: DataFrame) -> DataFrame:
    """Compare the sets of each family with one another, by blocks.

    ``members``: x_root, x_i, x_j (blocks), x_k (the row's own block), x_sid, x_weight, x_set (hashes). Returns x_sid, x_links (weights of other
    classes at the threshold in this pair of blocks) and x_to (the smallest class that it is connected with there).
    """
    parts = _parts(members)
    keys = ["x_root", "x_i", "x_j"]

    def run(batches):
        for table, bounds in _grouped(batches, (0, 1, 2)):
            block_i, block_j, mine = (np.asarray(table.column(c).combine_chunks()) for c in (1, 2, 3))
            sid = np.array(table.column("x_sid").combine_chunks().to_pylist(), object)
            weight = np.asarray(table.column("x_weight").combine_chunks())
            raw, offsets = utf8_parts(table.column("x_set").combine_chunks())
            every = np.frombuffer(raw.tobytes(), np.uint64)
            offsets = offsets // 8
            size = np.diff(offsets)
            links, to = np.zeros(len(sid), np.int64), sid.copy()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                both = _shared(every[offsets[a] : offsets[b]], size[a:b])
                link = both >= THRESHOLD * (size[a:b, None] + size[None, a:b] - both) - 1e-9
                np.fill_diagonal(link, False)
                if block_i[a] != block_j[a]:  # pairs within one block are counted where it meets itself
                    link &= mine[a:b, None] != mine[None, a:b]
                links[a:b] = link @ weight[a:b]
                to[a:b] = sid[a + components(link)]
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(links), pa.array(to, pa.binary())], ["x_sid", "x_links", "x_to"])

    return members.select(*keys, "x_k", "x_sid", "x_weight", "x_set").repartition(parts, *keys).sortWithinPartitions(*keys, "x_sid").mapInArrow(released(run), "x_sid binary, x_links long, x_to binary")


def placed_in_blocks(sized: DataFrame) -> DataFrame:
    """x_root, x_i, x_j, x_k, x_sid, x_weight for each pair of blocks (x_i, x_j) in which a set of block x_k is compared. ``sized``: x_sid, x_root, x_weight, x_hashes."""
    full = lambda: F.ceil(F.greatest(F.col("x_n") / BLOCK, F.col("x_sum") / BLOCK_HASHES)).cast("long")
    tally = (F.count(F.lit(1)).alias("x_n"), F.sum("x_hashes").alias("x_sum"))
    whole = materialise(sized.groupBy("x_root").agg(*tally).withColumn("x_full", full()), "whole")
    rows = materialise(split_join(sized, whole, ["x_root"], "x_n").select("x_sid", "x_root", "x_weight", "x_hashes", "x_full"), "placed")
    # all blocks of a small family meet
    block = F.pmod(F.xxhash64("x_sid"), F.col("x_full"))
    few = rows.where(F.col("x_full") <= BANDED).select("x_root", block.alias("x_k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("x_full") - 1)).alias("x_j"), "x_sid", "x_weight")
    few = few.select("x_root", F.least("x_k", "x_j").alias("x_i"), F.greatest("x_k", "x_j").alias("x_j"), "x_k", "x_sid", "x_weight")
    rows = rows.where(F.col("x_full") > BANDED).withColumn("x_band", F.floor(F.log(F.greatest("x_hashes", F.lit(1)).cast("double")) / float(np.log(BAND))).cast("int"))
    if not rows.limit(1).count():
        return few
    bands = rows.groupBy("x_root", "x_band").agg(*tally).withColumn("x_full", full())
    by = W.partitionBy("x_root").orderBy("x_band")  # a family has as many bands as orders of size at most
    beside = lambda f, step: F.when(f("x_band").over(by) == F.col("x_band") + step, f("x_full").over(by)).otherwise(0)
    bands = materialise(bands.select("x_root", "x_band", "x_n", F.col("x_full").alias("x_own"), beside(F.lag, -1).alias("x_less"), beside(F.lead, 1).alias("x_more")), "bands")
    rows = split_join(rows.drop("x_full"), bands, ["x_root", "x_band"], "x_n")
    number = lambda band, k: band.cast("long") * (1 << 24) + k
    to = lambda size: F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1)).otherwise(F.array().cast("array<bigint>"))
    k, band = F.pmod(F.xxhash64("x_sid"), F.col("x_own")), F.col("x_band")
    pair = lambda a, b: F.struct(a.alias("x_i"), b.alias("x_j"))
    pairs = F.concat(
        F.transform(to(F.col("x_own")), lambda j: pair(number(band, F.least(k, j)), number(band, F.greatest(k, j)))),
        F.transform(to(F.col("x_less")), lambda j: pair(number(band - 1, j), number(band, k))),
        F.transform(to(F.col("x_more")), lambda j: pair(number(band, k), number(band + 1, j))),
    )
    many = rows.select("x_root", number(band, k).alias("x_k"), "x_sid", "x_weight", F.explode(pairs).alias("x")).select("x_root", "x.x_i", "x.x_j", "x_k", "x_sid", "x_weight")
    return few.unionByName(many)


def _shared(every: np.ndarray, size: np.ndarray, wide: int = 1 << 22) -> np.ndarray:
    """How many hashes each two sets share: products of 0/1 matrices over hashes that at least two sets have, some columns at a time."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    v, row = every[order], row[order]
    new = np.append(True, v[1:] != v[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    row, column = row[often], column[often]
    out = np.zeros((n, n), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    step = max(64, wide // n)
    cuts = np.searchsorted(column, np.arange(0, column[-1] + step + 1, step))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if b > a:
            m = np.zeros((n, min(step, int(column[b - 1]) - k * step + 1)), np.float32)
            m[row[a:b], column[a:b] - k * step] = 1
            out += m @ m.T
    return out


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: x_key, x_mark, x_root (its group's name; null if the text has no words), x_links, x_top, x_size.

    x_links counts the other rows whose texts are at the threshold or above, copies included. Groups are connected by links; x_top is the
    group's smallest row (key, null last, then mark) and x_size its rows. A text without words, null or empty too, is a group of its own.
    Repeated keys are separate rows. No rows give no rows.
    """
    rows = materialise(signed(docs, key, text), "signed")
    with_words = rows.where(F.col("x_sid").isNotNull())
    classes = materialise(with_words.groupBy("x_sid").agg(F.max("x_sig").alias("x_sig"), F.count(F.lit(1)).alias("x_weight"), F.min(F.struct(F.col("x_key").isNull().alias("x_null"), "x_key", "x_mark")).alias("x_first")), "classes")
    near = materialise(families(classes), "families")
    found = materialise(near.join(classes.select("x_sid", "x_weight", "x_first"), "x_sid"), "found")

    names = sized_broadcast(materialise(found.select("x_sid", F.col("x_first.x_key").alias("x_key"), F.col("x_first.x_mark").alias("x_mark")), "names"))
    own = docs.select(F.col(key).alias("x_key"), row_mark(docs).alias("x_mark"), F.col(text).alias("x_text")).alias("d")
    texts = own.join(names.alias("n"), F.col("d.x_key").eqNullSafe(F.col("n.x_key")) & (F.col("d.x_mark") == F.col("n.x_mark"))).select("n.x_sid", "d.x_text")

    def shingled(batches):
        shingles = Shingler()
        for batch in table_batches(batches, 2 << 20):
            sets = shingles(*utf8_parts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["x_sid", "x_set", "x_hashes"])

    sets = materialise(texts.mapInArrow(released(shingled), "x_sid binary, x_set binary, x_hashes long"), "sets")
    # rows equal throughout share a mark: one of them is enough here
    sized = materialise(found.select("x_sid", "x_root", "x_weight").join(sets.select("x_sid", "x_hashes").distinct(), "x_sid"), "sized")
    placed = placed_in_blocks(sized).join(sets.select("x_sid", "x_set").dropDuplicates(["x_sid"]), "x_sid")
    linked = materialise(exact_links(placed), "linked")
    counts = linked.groupBy("x_sid").agg(F.sum("x_links").alias("x_links"), F.count(F.lit(1)).alias("x_n"), F.min("x_to").alias("x_to"))
    counts = materialise(counts, "counts")
    # a family in one block has its classes already; trees of several blocks are joined
    several = linked.join(counts.where("x_n > 1").select("x_sid"), "x_sid", "left_semi").select(F.col("x_to").alias("x_a"), F.col("x_sid").alias("x_b"))
    roots = counts.where("x_n = 1").select("x_sid", F.col("x_to").alias("x_root"))
    if counts.where("x_n > 1").limit(1).count():
        roots = roots.unionByName(connected(several))
    counts = counts.select("x_sid", "x_links")

    per = classes.select("x_sid", "x_weight", "x_first").join(counts, "x_sid", "left").join(roots, "x_sid", "left")
    per = per.select("x_sid", "x_weight", "x_first", (F.coalesce("x_links", F.lit(0)) + F.col("x_weight") - 1).alias("x_links"), F.coalesce("x_root", "x_sid").alias("x_root"))
    per = materialise(per, "per")
    groups = per.groupBy("x_root").agg(F.min("x_first").alias("x_top"), F.sum("x_weight").alias("x_size"))
    per = materialise(per.join(groups, "x_root").select("x_sid", "x_root", "x_links", "x_top", "x_size"), "groups")
    wordless = rows.where(F.col("x_sid").isNull()).select("x_key", "x_mark", F.lit(None).cast("binary").alias("x_root"), F.lit(0).cast("long").alias("x_links"), F.struct(F.col("x_key").isNull().alias("x_null"), "x_key", "x_mark").alias("x_top"), F.lit(1).cast("long").alias("x_size"))
    return with_words.select("x_sid", "x_key", "x_mark").join(per, "x_sid").select("x_key", "x_mark", "x_root", "x_links", "x_top", "x_size").unionByName(wordless)


def join_report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group), n_links, class_size for each row of documents."""
    return jaccard_classes(docs).select(F.col("x_key").alias("doc_id"), F.col("x_top.x_key").alias("class_id"), F.col("x_links").alias("n_links"), F.col("x_size").alias("class_size"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that have a near duplicate with a smaller key, all columns as they were."""
    rows = jaccard_classes(docs, key, text)
    stays = F.col("x_root").isNull() | (F.col("x_key").eqNullSafe(F.col("x_top.x_key")) & (F.col("x_mark") == F.col("x_top.x_mark")))
    rows = rows.select("x_key", "x_mark", stays.alias("x_stays"), F.col("x_root").isNotNull().alias("x_worded"))
    rows = rows.groupBy("x_key", "x_mark").agg(F.min("x_stays").alias("x_stays"), F.sum(F.col("x_worded").cast("long")).alias("x_copies"))
    return keep_rows(docs, key, rows)
