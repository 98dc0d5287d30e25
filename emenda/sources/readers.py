"""Readers and writers of the formats that rules, corpora, evaluations and reports come in. Paths are opened by Spark only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "doc_id bigint, text string, mode string, dictionary array<string>, names array<string>, dialect string, protected_ranges array<struct<start_utf16:int,end_utf16:int>>"
RULE = "id string, pattern string, replacement string, modes array<string>, category string, confidence double, reason string, provenance string, positive array<string>, negative array<string>"


def jsonl(spark: SparkSession, path: str, schema: str = REQUEST) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined lines)."""
    raw = spark.read.text(path).where("trim(value) <> ''").withColumn("r", F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return raw.where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record"), raw.where("r._corrupt_record IS NOT NULL").select("value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text, one passage a line, blank lines and comments left out."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> '' AND NOT startswith(text, '#')")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Two columns split at the first blank: misspelling, correction."""
    parts = F.split("text", r"[\x20\t]+", 2)
    return lines(spark, path).select(F.get(parts, F.lit(0)).alias("misspelling"), F.get(parts, F.lit(1)).alias("correction")).where("correction IS NOT NULL")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Mixed files: JSON lines with ``input`` or ``text`` (and ``clean``), or bare lines, which count as clean."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    parsed = raw.withColumn("r", F.from_json("value", "input string, text string, clean boolean"))
    return parsed.select(F.coalesce("r.input", "r.text", "value").alias("text"), F.coalesce("r.clean", F.lit(True)).alias("clean"))


def markup(rows: DataFrame, text: str = "text") -> DataFrame:
    """[[wrong=>right|other]] as input, reference, alternatives and spans."""
    mark = r"\[\[([^\]=]*)=>([^\]|]*)((?:\|[^\]|]*)*)\]\]"
    body = F.col(text)
    return rows.select(
        "*",
        F.regexp_replace(body, mark, "$1").alias("input"),
        F.regexp_replace(body, mark, "$2").alias("reference"),
        F.transform(F.regexp_extract_all(body, F.lit(mark), F.lit(1)), lambda x: x).alias("originals"),
        F.regexp_extract_all(body, F.lit(mark), F.lit(2)).alias("fixes"),
        F.transform(F.regexp_extract_all(body, F.lit(mark), F.lit(3)), lambda x: F.filter(F.split(x, r"\|"), lambda p: p != "")).alias("alternatives"),
    )


def m2(rows: DataFrame) -> DataFrame:
    """M2 annotations (value, one a line) as start, end, kind, fix."""
    part = F.split(F.substring("value", 3, 1 << 20), r"\|\|\|")
    place = F.split(F.get(part, F.lit(0)), " ")
    return rows.where("startswith(value, 'A ')").select(F.get(place, F.lit(0)).cast("int").alias("start"), F.get(place, F.lit(1)).cast("int").alias("end"), F.get(part, F.lit(1)).alias("kind"), F.get(part, F.lit(2)).alias("fix"))


def table(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """parquet, orc, csv, tsv or (gzipped) json."""
    read = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    return {"parquet": read.parquet, "orc": read.orc, "json": read.json}[kind](path)


def rule_packs(spark: SparkSession, *paths: str) -> DataFrame:
    """All packs as one table; ids that come twice are an error."""
    rules = spark.read.schema(RULE).option("multiLine", True).json(list(paths)).withColumn("confidence", F.coalesce("confidence", F.lit(0.9)))
    twice = rules.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"rule ids come twice: {[r['id'] for r in twice]}")
    return rules


def literals(pattern: str) -> list[str]:
    """Words that any match of a pattern must hold one of, from its plain stretches; none if there is no such word."""
    plain = re.sub(r"\\[a-zA-Z]|\[[^\]]*\][*+?]?|\([^)]*\)[*?]|.[*?]|[^A-Za-z]", " ", re.sub(r"\(\?[a-z]*:?", "(", pattern))
    if "|" in pattern:
        return []
    found = [w.lower() for w in plain.split() if len(w) > 1]
    return [max(found, key=len)] if found else []


def linted(rules: DataFrame) -> DataFrame:
    """id, problem: patterns of the common subset, positive examples that match and negative ones that don't."""
    odd = F.col("pattern").rlike(r"\(\?[=!<]|\\[bBwW1-9]")
    bad_positive = F.exists(F.coalesce("positive", F.array().cast("array<string>")), lambda x: ~F.regexp_like(x, F.col("pattern")))
    bad_negative = F.exists(F.coalesce("negative", F.array().cast("array<string>")), lambda x: F.regexp_like(x, F.col("pattern")))
    problem = F.coalesce(
        F.when(F.col("pattern").isNull() | F.col("replacement").isNull() | F.col("category").isNull(), F.lit("a field is missing")),
        F.when(odd, F.lit("outside the common subset")), F.when(bad_positive, F.lit("a positive example doesn't match")), F.when(bad_negative, F.lit("a negative example matches")),
    )
    return rules.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """A row as a line of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
