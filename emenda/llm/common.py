"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that only Spark's readers need to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset a new one is made, on a local master only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="emenda-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, nothing is computed twice, and a lost executor loses no part of it.

    The tables of an application stand in one folder, which goes when its JVM ends.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/emenda-{spark.sparkContext.applicationId}"
    path = f"{home}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(home)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows on which no model may be fitted; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Arrow batches that go to Python hold so much at most, or a single row: whole texts of any length pass in bounded memory.
BATCH_BYTES = 4 << 20


def to_python(df: DataFrame) -> DataFrame:
    """``df``, with its session set to small Arrow batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    return df


def released(run):
    """``run`` over Arrow batches, after which the worker, which lives on, gives back the memory that it no longer needs."""

    def over(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return over


def utf8_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each starts (one entry more than texts). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def table_batches(batches, max_bytes: int = BATCH_BYTES):
    """Cut Arrow batches so that each holds about ``max_bytes`` of data at most, or a single row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, int(rows * max_bytes / max(1, batch.nbytes))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def row_mark(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A hash of a row's columns, to tell rows with the same key apart. Maps and variants can't be hashed, so they don't count."""
    plain = [F.col(f"`{n}`") for n, kind in docs.dtypes if n not in without and "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


#: Rows to drop (key and mark) under this size together are broadcast; more are shuffled.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64


def sized_broadcast(df: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few enough. ``df`` should be a written table."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: Keys that come more often are joined apart from the others, at least.
HOT_KEY = 10_000


def split_join(rows: DataFrame, side: DataFrame, keys: list[str], number: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_semi) with ``side``, whose column ``number`` says how many of ``rows`` each key has. Both should be written tables.

    Keys that come more than HOT_KEY times, or so often that no more of them than can be broadcast exist, are joined by a broadcast, wherever
    their rows are; so each key that is shuffled has a bounded number of rows, and the broadcast side has a bounded size.
    """
    often = max(HOT_KEY, -(-rows.count() * ROW_BYTES // BROADCAST_BYTES))
    hot = side.where(F.col(number) > often)
    if not hot.limit(1).count():
        return rows.join(side, keys, how)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.where(F.col(number) <= often), keys, how)
    return rest.unionByName(rows.join(F.broadcast(hot), keys, how))


def keep_rows(docs: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    ``rows`` has x_key, x_mark (of row_mark), x_copies (rows equal throughout) and x_stays; of equal rows that stay one is kept.
    """
    names = docs.columns
    notes = materialise(rows.where(~F.col("x_stays") | (F.col("x_copies") > 1)).select("x_key", "x_mark", "x_stays"), "notes")
    marked = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col(f"`{key}`").alias("x_key"), row_mark(docs).alias("x_mark"))
    on = F.col("m.x_key").eqNullSafe(F.col("d.x_key")) & (F.col("m.x_mark") == F.col("d.x_mark"))
    drop = sized_broadcast(notes.where(~F.col("x_stays")))
    kept = marked.alias("m").join(drop.alias("d"), on, "left_anti")
    repeated = notes.where("x_stays")
    if repeated.limit(1).count():
        side = sized_broadcast(repeated)
        once = kept.alias("m").join(side.alias("d"), on, "left_semi").dropDuplicates(["x_key", "x_mark"])
        kept = kept.alias("m").join(side.alias("d"), on, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def sample_bound(most: int, count: int) -> int:
    """Of ``count`` rows with hashes of 31 bits about ``most`` to twice as many are below it: what each task sends on shrinks as tasks grow in number."""
    return int(min(1.0, 2 * most / max(count, 1)) * (1 << 31)) + 1


def hashed_sample(rows: DataFrame, order: str, most: int, count: int) -> DataFrame:
    """About ``most`` to twice as many of ``count`` rows, those with the smallest hashes in column ``order``."""
    return rows.where(F.shiftrightunsigned(F.col(order), 33) < sample_bound(most, count))
