"""SQL over DataFrames, in a subset that Spark and DuckDB both run.

rx(text, pattern): a pattern is found anywhere; flat(array): one row an element; series(a, b): numbers from a to b; pct(x, p): interpolated
quantile; hex256(x): SHA-256 in hexadecimal; week(d): the Monday of a date's week; nth(array, k): an element, from 1; date_diff_days(a, b):
days from a to b. Names in braces are frames.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from emenda.functions import text as T

SPARK = {"rx(": "regexp_like(", "flat(": "explode(", "series(": "sequence(", "pct(": "percentile(", "COUNT_OF(": "size(", "nth(": "element_at("}
DUCKDB = {"rx(": "regexp_matches(", "flat(": "unnest(", "series(": "generate_series(", "pct(": "quantile_cont(", "COUNT_OF(": "len(", "nth(": "list_extract("}


def for_spark(sql: str) -> str:
    sql = sql.replace("\\", "\\\\").replace(", 'g')", ")")  # every match is replaced anyway
    for a, b in SPARK.items():
        sql = re.sub(rf"\b{re.escape(a)}", b, sql)
    sql = T.call(sql, "hex256", "sha2(CAST({0} AS BINARY), 256)")
    sql = re.sub(r"\bdate_diff_days\((CAST\(ts AS DATE\)), ", r"datediff(DAY, \1, ", sql)
    return T.letter_by_letter(T.call(sql, "week", "CAST(date_trunc('week', {0}) AS DATE)"))


def for_duckdb(sql: str, **frames: str) -> str:
    for a, b in DUCKDB.items():
        sql = re.sub(rf"\b{re.escape(a)}", b, sql)
    sql = re.sub(r"\bhex256\(", "sha256(", sql)
    sql = re.sub(r"\bdate_diff_days\(", "date_diff('day', ", sql)
    sql = T.call(sql, "week", "CAST(date_trunc('week', {0}) AS DATE)")
    return re.sub(r"\{([a-z]\w*)\}", lambda m: frames.get(m[1], m[1]), sql)


def parts(sql: str) -> list[str]:
    """The SQL cut before and after each common table of its WITH, and the rest: no column of a frame is known outside of the part that names the frame."""
    found, at, depth, quoted, begin = [], 0, 0, False, None
    for k, c in enumerate(sql):
        quoted ^= c == "'"
        if quoted or c not in "()":
            continue
        if c == "(" and depth == 0 and re.search(r"(^\s*WITH|,)\s+\w+ AS $", sql[at:k]):
            begin = k
        depth += 1 if c == "(" else -1
        if c == ")" and depth == 0 and begin is not None:
            found += [sql[at:begin], sql[begin : k + 1]]
            at, begin = k + 1, None
    return [*found, sql[at:]]


def by_part(sql: str, frame: str, fields_in) -> tuple[str, dict[str, tuple[str, ...]]]:
    """The SQL with a frame of its own for each part that names ``frame`` (the same for the same fields), and the fields of each."""
    names: dict[tuple[str, ...], str] = {}
    out = []
    for part in parts(sql):
        if f"{{{frame}}}" in part:
            part = part.replace(f"{{{frame}}}", "{" + names.setdefault(fields_in(part), f"{frame}{len(names)}") + "}")
        out.append(part)
    return "".join(out), {name: fields for fields, name in names.items()}


def run(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Each frame is known by a view of its own name, so calls don't disturb one another."""
    names = {}
    for name, df in frames.items():
        names[name] = f"{name}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(names[name])
    return spark.sql(re.sub(r"\{([a-z]\w*)\}", lambda m: names.get(m[1], m[0]), for_spark(sql)))
