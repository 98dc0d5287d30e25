"""Mixing sources to target weights: weighted fair queueing over shuffled documents, by DataFrame operations only.

Each source's documents are put in a shuffled order (by md5 of the key). A document's virtual finish time is its
source's words up to and with it, divided by the source's target; second passes over a source follow its first. All items are
range-sorted by finish time and taken until the total budget is spent, so that at any time every source has got its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emenda.llm.common import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: A source is passed at most so many times.
PASSES = 2
#: Leading hex digits of the shuffle key by which a source's documents are dealt out for running sums: 4096 groups each.
DEAL = 3
#: Sources up to this number (names of a few dozen bytes) are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; null has none."""
    runs = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")).cast("long")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), runs).otherwise(F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """x_source, x_total, x_target for each source of ``sizes`` (x_source, x_size).

    Sources in code-point order, null last, get the weights in turn. The budget, ``share`` of all words, is
    dealt by weight; targets stop at ``passes`` times their source's words and the excess is dealt again, until none is above:
    with sources sorted by cap over weight, the level that is left for those after the first few rises while these are held at
    their caps rightly and falls after that, so the largest is the one.
    """
    per = sizes.groupBy("x_source").agg(F.sum("x_size").alias("x_total"))
    ordered = W.orderBy(F.col("x_source").isNull(), F.col("x_source").cast("binary"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("x_rank", F.row_number().over(ordered)).withColumn("x_weight", turn)
    cap = F.lit(passes) * F.col("x_total")
    every = W.partitionBy()
    by_ratio = W.orderBy(cap.cast("double") / F.col("x_weight"), "x_rank")
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rest = F.sum("x_weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    level = (F.lit(share) * F.sum("x_total").over(every) - before) / rest
    per = per.withColumn("x_level", level).withColumn("x_ratio", cap.cast("double") / F.col("x_weight"))
    per = per.withColumn("x_chosen", F.max("x_level").over(every))
    target = F.when(F.col("x_ratio") <= F.col("x_chosen"), cap.cast("double")).otherwise(F.col("x_chosen") * F.col("x_weight"))
    return per.select("x_source", "x_rank", "x_total", target.alias("x_target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """How often the mix takes each document.

    Returns (rows, sources): x_key, x_source, x_size, x_total, x_target, x_times for each row; and for each source the number of
    full passes and where in the shuffled order the last one ends. Null keys come first in the order of
    ties; rows with the same key, source and size are interchangeable. Empty documents have no words and are taken with their
    neighbours. No rows give no rows.
    """
    sized = docs.select(F.col(key).alias("x_key"), F.col(source).alias("x_source"), words(F.col(text)).alias("x_size"))
    sized = sized.withColumn("x_order", F.md5(F.coalesce(F.col("x_key").cast("string"), F.lit("")).cast("binary")))
    sized = materialise(sized.withColumn("x_deal", F.substring("x_order", 1, DEAL)), "sized")
    sources = materialise(source_targets(sized, share=share, passes=passes), "sources")

    # words before each group of a source, then running sums in the group: no task gets a whole source
    order = ["x_order", F.col("x_key").asc_nulls_first(), "x_size"]
    dealt = sized.groupBy("x_source", "x_deal").agg(F.sum("x_size").alias("x_words"))
    ahead = dealt.withColumn("x_ahead", F.coalesce(F.sum("x_words").over(W.partitionBy("x_source").orderBy("x_deal").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("x_words")
    inner = W.partitionBy("x_source", "x_deal").orderBy(*order)
    ran = sized.withColumn("x_in", F.sum("x_size").over(inner.rowsBetween(W.unboundedPreceding, 0))).withColumn("x_at", F.row_number().over(inner))
    few = sources.count() <= BROADCAST_SOURCES
    side = F.broadcast(sources) if few else sources
    ran = ran.alias("r").join(ahead.alias("a"), F.col("r.x_source").eqNullSafe(F.col("a.x_source")) & (F.col("r.x_deal") == F.col("a.x_deal")))
    ran = ran.select("r.*", (F.col("a.x_ahead") + F.col("r.x_in")).alias("x_sum"))
    ran = ran.alias("r").join(side.alias("s"), F.col("r.x_source").eqNullSafe(F.col("s.x_source"))).select("r.*", "s.x_rank", "s.x_total", "s.x_target")
    ran = materialise(ran, "ran")

    # virtual finish times of every pass, globally range-sorted; the sorted parts' sums give each part its start
    finish = (F.col("x_pass") * F.col("x_total") + F.col("x_sum")).cast("double") / F.col("x_target")
    items = ran.where("x_target > 0").withColumn("x_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("x_finish", finish)
    keys = ["x_finish", "x_rank", "x_pass", "x_order", "x_key", "x_at"]
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    items = items.select(*keys, "x_source", "x_size", "x_deal").repartitionByRange(parts, "x_finish", "x_rank", "x_pass", "x_order")
    line = materialise(items.withColumn("x_part", F.spark_partition_id()), "line")
    starts = line.groupBy("x_part").agg(F.sum("x_size").alias("x_words"))
    starts = starts.withColumn("x_start", F.coalesce(F.sum("x_words").over(W.orderBy("x_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("x_words")
    line = line.join(F.broadcast(starts), "x_part")  # one row for each part
    within = W.partitionBy("x_part").orderBy("x_finish", "x_rank", "x_pass", "x_order", F.col("x_key").asc_nulls_first(), "x_size", "x_at")
    line = line.withColumn("x_run", F.col("x_start") + F.sum("x_size").over(within.rowsBetween(W.unboundedPreceding, 0)))
    budget = sources.agg(F.lit(share) * F.sum("x_total")).first()[0] or 0.0
    taken = line.where(F.col("x_run") <= F.lit(float(budget)))
    # what a source gets is a prefix of its passes: keep where the prefix ends
    ends = taken.groupBy("x_source").agg(F.max(F.struct("x_pass", "x_order", "x_key", "x_size", "x_at")).alias("x_end"))
    ends = sources.alias("s").join(ends.alias("e"), F.col("s.x_source").eqNullSafe(F.col("e.x_source")), "left").select("s.*", "e.x_end")
    ends = materialise(ends, "ends")
    side = F.broadcast(ends) if few else ends
    times = F.when(F.col("e.x_end").isNull(), 0).otherwise(F.col("e.x_end.x_pass") + (F.struct("r.x_order", "r.x_key", "r.x_size", "r.x_at") <= F.struct("e.x_end.x_order", "e.x_end.x_key", "e.x_end.x_size", "e.x_end.x_at")).cast("int"))
    rows = ran.alias("r").join(side.alias("e"), F.col("r.x_source").eqNullSafe(F.col("e.x_source")))
    return rows.select("r.x_key", "r.x_source", "r.x_size", "r.x_total", "r.x_target", times.cast("long").alias("x_times")), ends


def mix_report(docs: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, size, source_size, target, taken."""
    rows, _ = mix(docs)
    return rows.select(F.col("x_key").alias("doc_id"), F.col("x_size").alias("size"), F.col("x_total").alias("source_size"), F.col("x_target").alias("target"), (F.col("x_size") * F.col("x_times")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, all columns as they were, each as often as it is taken; texts are not shuffled.

    Rows that share key, source and size at the very end of a source's last pass are all taken.
    """
    _, ends = mix(docs, key, text, source)
    names = docs.columns
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col(key).alias("x_key"), F.col(source).alias("x_source"), words(F.col(text)).alias("x_size"), order.alias("x_order"))
    side = F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends
    times = F.when(F.col("e.x_end").isNull(), 0).otherwise(F.col("e.x_end.x_pass") + (F.struct("r.x_order", "r.x_key", "r.x_size") <= F.struct("e.x_end.x_order", "e.x_end.x_key", "e.x_end.x_size")).cast("int"))
    rows = rows.alias("r").join(side.alias("e"), F.col("r.x_source").eqNullSafe(F.col("e.x_source"))).withColumn("x_times", times.cast("int"))
    rows = rows.where("x_times > 0").withColumn("x_i", F.explode(F.sequence(F.lit(1), F.col("x_times"))))
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS k FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((k - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, (2 * total)::DOUBLE / weight AS ratio, (1.5::DOUBLE * (sum(total) OVER ())::DOUBLE - coalesce(sum(2 * total) OVER (ORDER BY (2 * total)::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / (sum(weight) OVER (ORDER BY (2 * total)::DOUBLE / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
c AS (SELECT *, max(level) OVER () AS chosen FROM l),
t AS (SELECT source, k, total, CASE WHEN ratio <= chosen THEN (2 * total)::DOUBLE ELSE chosen * weight END AS target FROM c),
r AS (SELECT d.*, t.k, t.total, t.target, (sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS ran FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT r.*, p.pass, (p.pass * total + ran)::DOUBLE / target AS finish FROM r, (VALUES (0), (1)) p(pass) WHERE target > 0),
g AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, k, pass, o, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM i),
b AS (SELECT 1.5::DOUBLE * sum(size)::DOUBLE AS budget FROM d),
n AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM g, b WHERE run <= budget GROUP BY doc_id)
SELECT r.doc_id, r.size, r.total AS source_size, r.target, coalesce(n.taken, 0)::BIGINT AS taken FROM r LEFT JOIN n ON r.doc_id = n.doc_id
"""
