"""Collection of reports as a stream: validation, idempotence by key, windows, caps, merges into a table."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEPT = "14 days"
CLIENT_CAP = 200


def report_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of parquet files as a stream; ``ts`` becomes a timestamp with zone, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def json_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of JSON lines as a stream, with rows that don't parse kept apart by a flag."""
    raw = spark.readStream.text(path)
    parsed = raw.withColumn("r", F.from_json("value", schema))
    return parsed.withColumn("corrupt", F.col("r").isNull())


def once(reports: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once within the time that keys are kept."""
    return reports.withWatermark("ts", KEPT).dropDuplicatesWithinWatermark([key])


def weekly(reports: DataFrame) -> DataFrame:
    """Counts by ISO week (from Monday) and rule, complete weeks only."""
    return reports.withWatermark("ts", "1 hour").groupBy(F.window("ts", "7 days", startTime="4 days"), F.col("event_type").alias("rule")).agg(F.count(F.lit(1)).alias("reported"), F.approx_count_distinct("user_id").alias("users"))


#: Clients are dealt over so many groups of state; one group for each client and day would cost more than its rows.
BUCKETS = 1024


def capped_stream(reports: DataFrame, cap: int = CLIENT_CAP) -> DataFrame:
    """user_id, d, event_type, accepted, refused: a client's reports of one type in a micro-batch are taken whole or not at all, up to ``cap`` a day.

    What a client has used of a day is kept as state, so a cap doesn't start anew with each micro-batch; a day's state goes when the
    watermark has passed the day's end. A client has as many groups a day as there are types. State lies in BUCKETS groups of clients.
    """
    groups = reports.withWatermark("ts", "1 hour").withColumn("d", F.date_format("ts", "yyyy-MM-dd")).withColumn("bucket", F.pmod(F.hash("user_id"), F.lit(BUCKETS)))
    shape, keys = "user_id long, d string, event_type string, accepted long, refused long", ["user_id", "d", "event_type"]

    def over(d) -> int:  # a day more, for any zone
        return int(pd.Timestamp(d, tz="UTC").timestamp() * 1000) + 2 * 86_400_000

    def take(key, frames, state):
        used = {(u, d): n for u, d, n in zip(*state.get, strict=True)} if state.exists else {}
        seen = {}
        for frame in frames if not state.hasTimedOut else ():
            frame["user_id"] = frame["user_id"].astype("Int64")
            own = frame.groupby(keys, dropna=False, sort=False)["event_id"].agg(["size", "min"]).reset_index()
            for u, d, kind, n, least in zip(*(own[c].astype(object).where(own[c].notna(), None) for c in keys), own["size"].tolist(), own["min"].tolist(), strict=True):
                k, first = seen.get((u, d, kind), (0, least))
                seen[u, d, kind] = (k + n, min(first, least))
        rows = []
        for (u, d, kind), (n, _) in sorted(seen.items(), key=lambda x: x[1][1]):
            before = used.get((u, d), 0)
            ok = before + n <= cap
            used[u, d] = before + n * ok
            rows.append((u, d, kind, n * ok, n * (not ok)))
        ends = {d: over(d) for _, d in used}
        used = {k: n for k, n in used.items() if ends[k[1]] > state.getCurrentWatermarkMs()}
        if used:
            state.update(([u for u, _ in used], [d for _, d in used], list(used.values())))
            state.setTimeoutTimestamp(min(ends[d] for _, d in used))
        elif state.exists:
            state.remove()
        out = pd.DataFrame(rows, columns=[*keys, "accepted", "refused"])
        yield out.astype({"user_id": "Int64"})

    return groups.select("bucket", *keys, "event_id", "ts").groupBy("bucket").applyInPandasWithState(take, shape, "users array<long>, days array<string>, used array<long>", "update", "EventTimeTimeout")


def minutes(reports: DataFrame, most: int = 4) -> DataFrame:
    """user_id, m, n, refused: requests a client and minute, and how many are beyond the limit."""
    each = reports.groupBy("user_id", F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("n"))
    return each.select("user_id", F.col("window.start").alias("m"), "n", F.greatest(F.col("n") - most, F.lit(0).cast("long")).alias("refused"))


def capped(batch: DataFrame, cap: int = CLIENT_CAP) -> DataFrame:
    """A table's reports within each client's daily cap, by time."""
    by = W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return batch.withColumn("k", F.row_number().over(by)).where(F.col("k") <= cap).drop("k")


def merged(old: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def into(reports: DataFrame, target: str, checkpoint: str, cap: int = CLIENT_CAP):
    """Start a query that appends each micro-batch to a parquet folder, within each client's daily cap over all batches.

    What earlier batches took is counted from the folder itself, without the batch that is written, so a batch that runs again after a failure gives the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        by = W.partitionBy("user_id", "d").orderBy("ts", "event_id")
        rows = batch.withColumn("d", F.to_date("ts")).withColumn("k", F.row_number().over(by))
        try:
            before = batch.sparkSession.read.parquet(target).where(F.col("batch") != number)
        except AnalysisException:  # the first batch finds no folder
            before = None
        if before is not None:
            used = before.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("used"))
            rows = rows.join(used, ["user_id", "d"], "left").withColumn("k", F.col("k") + F.coalesce("used", F.lit(0))).drop("used")
        rows.where(F.col("k") <= cap).select(*batch.columns).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
