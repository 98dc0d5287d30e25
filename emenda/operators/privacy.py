"""Private data in texts: spans by kind, merged by priority, and texts in which they are named instead.

An entry of PRIVATE: what a text must hold (one of these strings, or nothing in particular), and the pattern, in the common subset of Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emenda.operators import resolve as R

_DIGIT = "zero|one|two|three|four|five|six|seven|eight|nine|oh"
PRIVATE = {
    "email": (("@",), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "spelled email": ((" at ", "(at)", "[at]"), r"(?i)[a-z0-9._-]+ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]+ ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{2,}"),
    "key": (("_", "AKIA"), r"(?:sk|pk|rk|ghp|gho|xox[abp])_(?:live_|test_)?[A-Za-z0-9]{8,}|AKIA[A-Z0-9]{12,}"),
    "link": (("://", "www."), r"(?:https?://|www\.)[^\x00-\x20<>\x22]+"),
    "handle": (("@",), r"@[A-Za-z0-9_]{2,}"),
    "hashtag": (("#",), r"#[A-Za-z_][A-Za-z0-9_]*"),
    "domain": ((".",), r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|io|dev|gov|edu|info)"),
    "phone": ((), r"\+?\(?[0-9][0-9 ().-]{7,}[0-9]"),
    "token": ((), r"[A-Za-z]*[0-9][A-Za-z0-9_-]{19,}"),
    "number": ((), r"[0-9]+(?:[.,:/-][0-9]+)*"),
    "spelled number": ((), rf"(?i)(?:(?:{_DIGIT})[ -]){{3,}}(?:{_DIGIT})"),
}


def private(text: Column) -> Column:
    """All private spans, by start; they may overlap."""
    return R.protected(text, PRIVATE)


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, edits, redacted: each merged span replaced by its kind in brackets. ``resolve.source_map`` of text and edits leads back. Null counts as empty."""
    names = F.array(*[F.lit(f"[{k}]") for k in PRIVATE])
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = F.transform(R.merged(private(F.col("text"))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(names, x["kind"] + 1).alias("replacement")))
    return rows.withColumn("edits", spans).withColumn("redacted", R.applied(F.col("text"), F.col("edits")))
