"""Exact dedup: static binary-fuse filters per immutable snapshot screen incoming digests.

Documents come in batches. What earlier batches hold is an immutable snapshot: one row for each distinct
text digest, in buckets by digest, and one binary-fuse filter for each bucket. The digests of an incoming batch are first
grouped among themselves, then screened by the snapshot's filters; only positives are joined with the
exact buckets, where the texts themselves are compared. Nothing is sent to the driver but counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emenda.llm.common import materialise

BATCHES = 2
KEYS_PER_BUCKET = 200_000
#: Positives whose rows together stay under this size are broadcast for the byte check; more are shuffled.
BROADCAST_BYTES = 32 << 20
POSITIVE_BYTES = 160


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class FuseFilter:
    """A three-wise binary-fuse filter over 64-bit keys with one-byte fingerprints: no false negatives, about 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        g, mask = _mix(h, 7), np.uint64(segment - 1)
        base = first * np.uint64(segment)
        size = np.uint64(segment)
        slots = np.stack([base + (g & mask), base + size + ((g >> np.uint64(20)) & mask), base + size + size + ((g >> np.uint64(40)) & mask)])
        return slots.astype(np.int64), (h & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
        count = max(1, -(-size // segment) - 2)
        for seed in range(1, 200):
            cells = cls._peel(keys, seed, segment, count)
            if cells is not None:
                return cls(seed, segment, count, cells)
            if seed % 8 == 0:
                count += 1 + count // 8
        raise RuntimeError("no seed gives a filter")

    @classmethod
    def _peel(cls, keys, seed, segment, count):
        slots, marks = cls._slots(keys, seed, segment, count)
        n, cells = len(keys), (count + 2) * segment
        degree = np.bincount(slots.ravel(), minlength=cells)
        names = np.zeros(cells, np.int64)
        for row in slots:
            np.bitwise_xor.at(names, row, np.arange(n))
        rounds, done = [], 0
        ready = np.flatnonzero(degree == 1)
        while len(ready):
            key, at = np.unique(names[ready], return_index=True)
            rounds.append((key, ready[at]))
            done += len(key)
            touched = slots[:, key].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(names, touched, np.tile(key, 3))
            touched = np.unique(touched)
            ready = touched[degree[touched] == 1]
        if done < n:
            return None
        out = np.zeros(cells, np.uint8)
        for key, at in reversed(rounds):
            a, b, c = slots[:, key]
            out[at] = marks[key] ^ out[a] ^ out[b] ^ out[c] ^ out[at]
        return out

    def holds(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), marks = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.count)
        return marks == self.cells[a] ^ self.cells[b] ^ self.cells[c]

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], np.int64).tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> FuseFilter:
        seed, segment, count = np.frombuffer(raw, np.int64, 3).tolist()
        return cls(seed, segment, count, np.frombuffer(raw, np.uint8, offset=24))


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes.fromhex(x[:16]) for x in digests), np.uint64)


def snapshot_filters(groups: DataFrame) -> DataFrame:
    """One filter for each bucket of a snapshot: x_bucket, x_filter."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"x_bucket": part["x_bucket"].iloc[:1], "x_filter": [FuseFilter.build(_keys(part["x_sha"])).to_bytes()]})

    return groups.select("x_bucket", "x_sha").groupBy("x_bucket").applyInPandas(build, "x_bucket long, x_filter binary")


def screen(digests: DataFrame, filters: DataFrame) -> DataFrame:
    """The digests (x_bucket, x_sha) that the filter of their bucket doesn't rule out."""

    def probe(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(own):
            return pd.DataFrame({"x_sha": pd.Series([], dtype=object)})
        found = FuseFilter.from_bytes(own["x_filter"].iloc[0]).holds(_keys(part["x_sha"]))
        return part.loc[found, ["x_sha"]]

    return digests.select("x_bucket", "x_sha").groupBy("x_bucket").cogroup(filters.groupBy("x_bucket")).applyInPandas(probe, "x_sha string")


def _row_mark(docs: DataFrame, text: str, key: str):
    """A hash of a row's other columns, to order rows that share text and key. Maps can't be hashed, so they don't count."""
    plain = [F.col(f"`{n}`") for n, kind in docs.dtypes if n not in (text, key) and "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """Rows with equal texts (null equals empty), by byte.

    Returns (rows, groups). ``rows``: x_sha, x_key, x_mark, x_copies, one for each different row
    (equal rows count in x_copies), with x_top (the key that stays), x_size (rows of that text) and x_stays.
    The row with the largest key stays, null being smaller than any; of rows with the same text and key the one with the larger hash of its other
    columns stays, and one of rows equal throughout. No rows give no rows.
    """
    named = docs.select(F.coalesce(F.col(text), F.lit("")).alias("x_text"), F.col(key).alias("x_key"), _row_mark(docs, text, key).alias("x_mark"))
    hashed = named.withColumn("x_sha", F.sha2(F.col("x_text").cast("binary"), 256))
    batch = F.pmod(F.xxhash64("x_key", "x_mark"), F.lit(batches)).cast("int")
    rows = materialise(hashed.groupBy("x_sha", "x_key", "x_mark").agg(F.count(F.lit(1)).alias("x_copies")).withColumn("x_batch", batch), "rows")
    buckets = max(64, -(-rows.count() // KEYS_PER_BUCKET))
    bucket = F.pmod(F.conv(F.substring("x_sha", 17, 12), 16, 10).cast("long"), F.lit(buckets)).alias("x_bucket")

    def grouped(number: int) -> DataFrame:
        own = rows.where(F.col("x_batch") == number)
        return own.groupBy("x_sha").agg(F.max(F.struct("x_key", "x_mark")).alias("x_best"), F.sum("x_copies").alias("x_size")).select("x_sha", bucket, "x_best", "x_size")

    snapshot = materialise(grouped(0), "snapshot0")
    for number in range(1, batches):
        fresh = materialise(grouped(number), f"batch{number}")
        positive = materialise(screen(fresh, snapshot_filters(snapshot)), f"positive{number}")
        # exact buckets: digest against digest, then byte against byte between one row of each side
        pairs = positive.join(fresh, "x_sha").select("x_sha", F.col("x_best").alias("n_best"), F.col("x_size").alias("n_size"))
        pairs = pairs.join(snapshot, "x_sha").select("x_sha", "n_best", "n_size", "x_best", "x_size")
        pairs = materialise(pairs, f"pairs{number}")
        wanted = pairs.select("x_sha", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x_best").alias("row")), F.struct(F.lit(1).alias("side"), F.col("n_best").alias("row")))).alias("w"))
        wanted = wanted.select("x_sha", "w.side", F.col("w.row.x_key").alias("x_key"), F.col("w.row.x_mark").alias("x_mark"))
        if pairs.count() * 2 * POSITIVE_BYTES <= BROADCAST_BYTES:
            wanted = F.broadcast(wanted)
        texts = hashed.alias("h").join(wanted.alias("w"), (F.col("h.x_sha") == F.col("w.x_sha")) & F.col("h.x_key").eqNullSafe(F.col("w.x_key")) & (F.col("h.x_mark") == F.col("w.x_mark")))
        texts = texts.select("h.x_sha", "w.side", "h.x_text")
        same = texts.groupBy("x_sha").agg((F.min("x_text") == F.max("x_text")).alias("x_same")).where("x_same").select("x_sha")
        same = materialise(pairs.join(same, "x_sha", "left_semi"), f"same{number}")
        add = same.select("x_sha", "n_best", "n_size")
        merged = snapshot.join(add, "x_sha", "left").select("x_sha", "x_bucket", F.greatest("x_best", F.coalesce("n_best", "x_best")).alias("x_best"), (F.col("x_size") + F.coalesce("n_size", F.lit(0))).alias("x_size"))
        new = fresh.join(same.select("x_sha"), "x_sha", "left_anti").select("x_sha", "x_bucket", "x_best", "x_size")
        snapshot = materialise(merged.unionByName(new), f"snapshot{number}")
    groups = snapshot.select("x_sha", F.col("x_best.x_key").alias("x_top"), F.col("x_best.x_mark").alias("x_top_mark"), "x_size")
    joined = rows.join(groups, "x_sha")
    stays = F.col("x_key").eqNullSafe(F.col("x_top")) & (F.col("x_mark") == F.col("x_top_mark"))
    return joined.select("x_sha", "x_key", "x_mark", "x_copies", "x_top", "x_size", stays.alias("x_stays")), groups


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, _ = exact_dedup(docs)
    each = rows.withColumn("x_i", F.explode(F.sequence(F.lit(1), F.col("x_copies").cast("int"))))
    return each.select(
        F.col("x_key").alias("doc_id"),
        F.col("x_top").alias("keep_id"),
        F.col("x_size").alias("group_size"),
        (F.col("x_stays") & (F.col("x_i") == 1)).alias("kept"),
        F.col("x_sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns as they were."""
    rows, _ = exact_dedup(docs, key, text)
    gone = materialise(rows.where(~F.col("x_stays") | (F.col("x_copies") > 1)).select("x_sha", "x_key", "x_mark", "x_copies", "x_stays"), "gone")
    drop = gone.where(~F.col("x_stays")).select("x_key", "x_mark", "x_sha")
    names = docs.columns
    marked = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col(key).alias("x_key"), _row_mark(docs, text, key).alias("x_mark"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("x_sha"))

    def on(a: str, b: str):
        return F.col(f"{a}.x_key").eqNullSafe(F.col(f"{b}.x_key")) & (F.col(f"{a}.x_mark") == F.col(f"{b}.x_mark")) & (F.col(f"{a}.x_sha") == F.col(f"{b}.x_sha"))

    def sized(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if side.count() * POSITIVE_BYTES <= BROADCAST_BYTES else side

    kept = marked.alias("m").join(sized(drop).alias("d"), on("m", "d"), "left_anti")
    repeated = gone.where(F.col("x_stays") & (F.col("x_copies") > 1)).select("x_key", "x_mark", "x_sha")
    if repeated.limit(1).count():  # rows equal throughout: one of them stays
        side = sized(repeated)
        twice = kept.alias("m").join(side.alias("d"), on("m", "d"), "left_semi").dropDuplicates(["x_key", "x_mark", "x_sha"])
        kept = kept.alias("m").join(side.alias("d"), on("m", "d"), "left_anti").unionByName(twice)
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
