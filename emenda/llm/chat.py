"""Chat formatting with cumulative-snapshot collapse, by DataFrame operations only.

Logs hold a conversation again and again as it grows. A rolling hash of turns names each prefix of each conversation; one whose
whole is a proper prefix of another is dropped by an anti-join, and of equal ones the one with the smallest id stays.
The rest is rendered turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emenda.llm.common import materialise

#: Turns are numbered in groups of so many, so that no task gets the whole of a very long conversation.
SPAN = 256
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
ROLES = ("system", "user", "assistant", "tool")


def _same(a: str, b: str, names: list[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return on


def prefixes(turns: DataFrame) -> DataFrame:
    """x_conv, x_turn, x_role, x_text and x_n (place from 1), x_a, x_b (rolling hash of the turns up to it), x_chars (rendered characters up to it).

    Order: turn (null last), then role, then text; equal rows are separate turns. The hash is a sum over turns of 62 bits each of two hashes of
    (place, role, text), so it can be summed in parts.
    """
    rows = turns.withColumn("x_group", F.floor(F.coalesce(F.col("x_turn"), F.lit(0)) / SPAN)).withColumn("x_late", F.col("x_turn").isNull())
    part = ["x_conv", "x_late", "x_group"]
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("x_c"))
    before = W.partitionBy("x_conv").orderBy("x_late", "x_group").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("x_ahead", F.coalesce(F.sum("x_c").over(before), F.lit(0).cast("long"))).drop("x_c")
    inner = W.partitionBy(*part).orderBy("x_turn", "x_role", "x_text")
    rows = rows.withColumn("x_in", F.row_number().over(inner)).alias("r").join(counts.alias("c"), _same("r", "c", part)).select("r.*", "c.x_ahead")
    rows = rows.withColumn("x_n", F.col("x_ahead") + F.col("x_in"))

    def marks(seed: int) -> list[Column]:
        h = F.xxhash64(F.lit(seed), F.col("x_n"), F.col("x_role").isNull(), "x_role", F.col("x_text").isNull(), "x_text")
        return [F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit((1 << 31) - 1))]

    rows = rows.withColumns(dict(zip(("x_p", "x_q", "x_r", "x_s"), marks(1) + marks(2), strict=True))).withColumn("x_c", F.length(rendered(F.col("x_role"), F.col("x_text"))).cast("long"))
    sums = ("x_p", "x_q", "x_r", "x_s", "x_c")
    totals = rows.groupBy(*part).agg(*[F.sum(n).alias(n) for n in sums])
    totals = totals.select(*part, *[F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")).alias(n + "0") for n in sums])
    running = W.partitionBy(*part).orderBy("x_n").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({n + "1": F.sum(n).over(running) for n in sums}).alias("r").join(totals.alias("t"), _same("r", "t", part))
    full = {n: F.col(f"r.{n}1") + F.col(f"t.{n}0") for n in sums}
    return rows.select("r.x_conv", "r.x_turn", "r.x_role", "r.x_text", "r.x_n", F.struct(full["x_p"].alias("p"), full["x_q"].alias("q")).alias("x_a"), F.struct(full["x_r"].alias("r"), full["x_s"].alias("s")).alias("x_b"), full["x_c"].alias("x_chars"))


def rendered(role: Column, text: Column) -> Column:
    """One turn: role and text between the marks; the marks themselves are broken up where a text has them. Null is empty, an unknown role is user."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_start|>"), F.lit("<| im_start |>")), F.lit("<|im_end|>"), F.lit("<| im_end |>"))
    name = F.when(F.lower(role).isin(*ROLES), F.lower(role)).otherwise(F.lit("user"))
    return F.concat(F.lit(OPEN), name, F.lit(MIDDLE), plain, F.lit(CLOSE))


def collapse(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns of the conversations that stay: conv_id, turn_index (from 0), n_turns, n_snapshots (conversations equal to it), start (its first character in the rendered conversation), rendered.

    A conversation goes if all its turns, in order, begin another with more turns, or equal another's with a smaller id (null is
    the smallest). Roles and texts count as they are, null being different from empty; turn numbers only give the order. A null conv_id names one conversation.
    One row a turn keeps rows bounded for conversations of any length: concatenated by turn_index they are the conversation. No rows give no rows.
    """
    turns = conversations.select(F.col(conv).alias("x_conv"), F.col(turn).alias("x_turn"), F.col(role).alias("x_role"), F.col(text).alias("x_text"))
    rows = materialise(prefixes(turns), "prefixes")
    lengths = rows.groupBy("x_conv").agg(F.max("x_n").alias("x_len"))
    rows = rows.alias("r").join(lengths.alias("l"), _same("r", "l", ["x_conv"])).select("r.*", "l.x_len")
    rows = materialise(rows, "turns")
    hashes = ["x_n", "x_a", "x_b"]
    whole = rows.where("x_n = x_len").groupBy(*hashes).agg(F.min(F.struct(F.col("x_conv").isNotNull().alias("x_some"), "x_conv")).alias("x_first"), F.count(F.lit(1)).alias("x_same"))
    whole = whole.select(*hashes, "x_same", F.col("x_first.x_conv").alias("x_conv"))
    proper = rows.where("x_n < x_len").select(*hashes).distinct()
    stay = materialise(whole.join(proper, hashes, "left_anti").select("x_conv", "x_same"), "stay")
    kept = rows.alias("r").join(stay.alias("s"), _same("r", "s", ["x_conv"])).select("r.*", "s.x_same")
    piece = rendered(F.col("x_role"), F.col("x_text"))
    return kept.select(F.col("x_conv").alias("conv_id"), (F.col("x_n") - 1).alias("turn_index"), F.col("x_len").alias("n_turns"), F.col("x_same").alias("n_snapshots"), (F.col("x_chars") - F.length(piece)).alias("start"), piece.alias("rendered"))


def conversation_texts(report: DataFrame) -> DataFrame:
    """conv_id, text: each conversation in one string, for those whose turns fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn_index", "rendered")))
    return report.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["rendered"]), "").alias("text"))


ORACLE = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS n, count(*) OVER (PARTITION BY conv_id) AS len FROM conversations),
h AS (SELECT *, string_agg(sha256(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-')), '') OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS p FROM t),
w AS (SELECT sha256(p) AS p, n, min(conv_id) AS conv_id, count(*) AS same FROM h WHERE n = len GROUP BY 1, 2),
q AS (SELECT DISTINCT sha256(p) AS p, n FROM h WHERE n < len),
k AS (SELECT w.conv_id, w.same FROM w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.p = w.p AND q.n = w.n)),
r AS (SELECT t.conv_id, t.n, t.len, k.same, '<|im_start|>' || CASE WHEN lower(role) IN ('system', 'user', 'assistant', 'tool') THEN lower(role) ELSE 'user' END || chr(10)
  || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') || '<|im_end|>' || chr(10) AS s FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id)
SELECT conv_id, n - 1 AS turn_index, len AS n_turns, same AS n_snapshots, coalesce(sum(length(s)) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, s AS rendered FROM r
"""
