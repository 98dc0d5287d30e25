"""Whole requests: validation, passes to a fixed point, tone by mode."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from emenda.functions import text as T
from emenda.operators import compiled, resolve, tone
from emenda.sources import readers

PASSES = 6
MOST_BYTES = 65_536
MODES = ("fix", "professional", "friendly", "concise", "direct")


def shared_home(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share. It goes when the JVM ends. Only a local master does without the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="emenda-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    home = f"{at}/emenda-core-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(home)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return home


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_home(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def validated(requests: DataFrame, text: str = "text", mode: str = "mode") -> DataFrame:
    """The requests with a column ``error``: null, or why a request can't be served. One bad row doesn't fail the job."""
    problems = F.coalesce(
        F.when(F.col(text).isNull(), F.lit("no text")),
        F.when(F.octet_length(text) > MOST_BYTES, F.lit("more than 64 KB of text")),
        F.when(~F.coalesce(F.col(mode), F.lit("fix")).isin(*MODES), F.lit("unknown mode")),
    )
    return requests.withColumn("error", problems)


def fixed_point(docs: DataFrame, key: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """key, output, passes, edits, settled, one row a document. A text goes through its passes where it is: nothing is shuffled or written between them."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # or one text
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    more = [StructField("output", StringType()), StructField("passes", IntegerType()), StructField("edits", LongType()), StructField("settled", BooleanType())]
    letters = compiled.alphabet(spark)

    def run(batches):
        own = compiled.corrector(letters)
        for batch in batches:
            found = [own.fixed(t.as_py(), passes) for t in batch.column(1)]
            columns = zip(*found, strict=True) if found else [()] * len(more)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names)

    names = [key, *(f.name for f in more)]
    return rows.mapInArrow(run, StructType([rows.schema[key], *more]))


def requested(text: Column, dictionary: Column, names: Column, ranges: Column) -> Column:
    """array of s, e, kind: what a request protects. Its ranges are UTF-16 offsets; dictionary words and names are whole words in any case."""
    spans = "array<struct<s:bigint,e:bigint,kind:int>>"
    own = F.transform(F.array_union(F.coalesce(dictionary, F.array().cast("array<string>")), F.coalesce(names, F.array().cast("array<string>"))), lambda w: F.lower(F.translate(w, *T.SMALL)))

    def words(z):
        hit = F.filter(F.arrays_zip(z["a"]["start"], z["a"]["end"], z["a"]["low"]).cast("array<struct<s:bigint,e:bigint,w:string>>"), lambda t: F.array_contains(z["own"], t["w"]))
        return F.transform(hit, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), F.lit(50).alias("kind")))

    taught = F.when(F.size(own) > 0, T.let(F.struct(T.analysed(text, frozenset(("end",))).alias("a"), own.alias("own")), words)).otherwise(F.array().cast(spans))
    # a UTF-16 offset is a code-point offset but for the characters beyond the basic plane before it, which have two units
    point = lambda u: F.length(F.decode(F.substr(F.encode(text, "UTF-16BE"), F.lit(1), (u * 2).cast("int")), "UTF-16BE")).cast("long")
    given = F.transform(F.coalesce(ranges, F.array().cast("array<struct<start_utf16:int,end_utf16:int>>")), lambda r: F.struct(point(r["start_utf16"]).alias("s"), point(r["end_utf16"]).alias("e"), F.lit(51).alias("kind")))
    return F.array_sort(F.concat(taught.cast(spans), given.cast(spans)))


def rewritten(requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, mode, output, error: corrections, then the mode's wording where the meaning is kept.

    ``dictionary``, ``names`` and ``protected_ranges``, where the requests have them, are left alone by corrections.
    """
    checked = validated(requests)
    good = checked.where("error IS NULL")
    kinds = {"dictionary": "array<string>", "names": "array<string>", "protected_ranges": "array<struct<start_utf16:int,end_utf16:int>>"}
    option = {n: F.col(n) if n in requests.columns else F.lit(None).cast(k) for n, k in kinds.items()}
    rows = good.withColumn("own", requested(F.col("text"), option["dictionary"], option["names"], option["protected_ranges"]))
    fixed = resolve.corrected(rows, key, own="own", keep=("mode",))
    toned = fixed.withColumn("toned", tone.worded(F.col("output"), F.coalesce("mode", F.lit("fix"))))
    kept = F.when(tone.keeps_meaning(F.col("output"), F.col("toned")), F.col("toned")).otherwise(F.col("output"))
    bad = checked.where("error IS NOT NULL").select(key, "mode", F.lit(None).cast("string").alias("output"), "error")
    return toned.select(key, "mode", kept.alias("output"), F.lit(None).cast("string").alias("error")).unionByName(bad)


def process_json(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Requests (``readers.REQUEST``) as JSON in ``value``, results as JSON: {"id", "mode", "output"} or {"id", "mode", "error"}. Lines that aren't JSON have no text. ``lines`` may be a stream."""
    parsed = lines.select(F.from_json("value", readers.REQUEST).alias("r"))
    requests = parsed.select(F.coalesce("r.doc_id", F.lit(-1)).alias("doc_id"), "r.text", F.coalesce("r.mode", F.lit("fix")).alias("mode"), "r.dictionary", "r.names", "r.protected_ranges")
    return rewritten(requests).select(F.to_json(F.struct(F.col("doc_id").alias("id"), "mode", "output", "error")).alias("value"))
