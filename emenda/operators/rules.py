"""Rule packs against documents: sentences meet only the rules one of whose literals they hold, and patterns decide.

A pack is a table (``sources.readers.RULE``) of any size; nothing of it is compiled into the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emenda.functions import text as T
from emenda.sources import readers

_A, _Z = r"(?i)(^|[^\p{L}])", r"([^\p{L}]|$)"


def _words(pattern: str) -> str:
    """A pattern of whole words; what stands before and after them are its first and last groups."""
    return f"{_A}{pattern}{_Z}"


#: The library's own pack: id, pattern (common subset), replacement with $1 for groups, words one of which a match must hold (empty: any).
PACK = (
    ("pack.in_order_to", _words("in order to"), "$1to$2", "order"),
    ("pack.due_to_fact", _words("due to the fact that"), "$1because$2", "fact"),
    ("pack.the_the", _words("(?:the|of|and|de|und) (of the|and the|de la)"), "$1$2$3", "the la"),
    ("pack.of_of", _words("(of|to) (?:of|to)"), "$1$2$3", "of to"),
    ("pack.more_better", _words("more (better|worse|easier)"), "$1$2$3", "more"),
    ("pack.could_of", _words("(could|should|would) of"), "$1$2 have$3", "of"),
    ("pack.and_end", r"(?i),? and\.", ".", "and"),
    ("pack.of_end", r"(?i) of\.", ".", "of"),
    ("pack.very_unique", _words("very unique"), "$1unique$2", "unique"),
    ("pack.und_und", _words("(und|et|y) (?:und|et|y)"), "$1$2$3", "und et y"),
    ("pack.double_comma", r",,+", ",", ""),
    ("pack.license", _words("permission is hereby granted"), "$1permission is granted$2", "permission"),
    ("pack.to_the_be", _words("to the (be|by|in)"), "$1to $2$3", "the"),
    ("pack.a_vowel", _words("a (an|en|in|on)"), "$1an $2$3", "an en in on"),
)


def pack(spark: SparkSession, rows=PACK) -> DataFrame:
    """id, pattern, replacement, literals."""
    return spark.createDataFrame([(i, p, r, w.split()) for i, p, r, w in rows], "id string, pattern string, replacement string, literals array<string>")


def with_literals(rules: DataFrame) -> DataFrame:
    """Rules as a reader gives them, with the literals of their patterns; the patterns alone go to the driver."""
    found = [(r["id"], readers.literals(r["pattern"])) for r in rules.select("id", "pattern").collect()]
    return rules.join(rules.sparkSession.createDataFrame(found, "id string, literals array<string>"), "id")


#: Up to so many literals in a pack, a sentence's literals are found inside its row, and the rules are broadcast.
MOST_LITERALS = 4096


def candidates(docs: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sent, s0, body, id, pattern, replacement for each sentence and rule that may match there.

    A sentence meets each rule once, by the first of the rule's literals that it holds: nothing is shuffled and a body is copied
    for the literals that it holds only. Spark doesn't know the size of a pack made of rows, so the broadcast is asked for. With
    more than MOST_LITERALS literals sentences and rules are shuffled by their words, and what met twice is dropped by another shuffle.
    """
    sentences = T.sentence_rows(docs, key)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.translate("body", *T.SMALL)), F.lit(r"\p{L}+"), F.lit(0)))
    literal = rules.select("id", "pattern", "replacement", "literals", F.posexplode("literals").alias("x_place", "x_word"))
    known = [r[0] for r in literal.where("x_word IS NOT NULL").select("x_word").limit(MOST_LITERALS + 1).collect()]
    wanted = ["id", "pattern", "replacement"]
    if len(known) <= MOST_LITERALS:
        held = F.array_intersect(words, F.array(*map(F.lit, sorted(set(known)))).cast("array<string>"))
        # an outer generator, as before an inner one Spark computes the array again
        met = sentences.select(key, "sent", "s0", "body", held.alias("x_held")).select("*", F.explode_outer("x_held").alias("x_word")).join(F.broadcast(literal), "x_word")
        met = met.where(~F.coalesce(F.arrays_overlap(F.slice("literals", F.lit(1), F.col("x_place")), "x_held"), F.lit(False)))
    else:
        met = sentences.select(key, "sent", "s0", "body", F.explode_outer(words).alias("x_word")).join(literal, "x_word").dropDuplicates([key, "sent", "s0", "id"])
    free = rules.where(F.size("literals") == 0).select(*wanted)
    # rules without a literal look at all sentences; the linter keeps them few
    return met.select(key, "sent", "s0", "body", *wanted).unionByName(sentences.select(key, "sent", "s0", "body").join(F.broadcast(free)))


def matches(docs: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sent, s0, id, body, output: sentences that a rule's pattern matches, and what it makes of them."""
    found = candidates(docs, rules, key).where(F.regexp_like("body", F.col("pattern")))
    return found.select(key, "sent", "s0", "id", "body", F.expr("regexp_replace(body, pattern, replacement)").alias("output"))


def sentences_sql() -> str:
    """CTE sentences (doc_id, sent, body) after those of ``tokens``."""
    return "bounds AS (SELECT doc_id, sent, min(s0) AS a, max(e0) AS b FROM tokens GROUP BY doc_id, sent), sentences AS (SELECT b.doc_id, b.sent, substr(coalesce(d.text, ''), b.a + 1, b.b - b.a) AS body FROM bounds b JOIN documents d ON b.doc_id = d.doc_id)"


def found_sql() -> str:
    """CTE found (doc_id, sent, id, body, output): every pattern on every sentence, with DuckDB's way of naming groups."""
    rows = []
    for name, pattern, replacement, _ in PACK:
        p, r = (T.quoted([x]) for x in (pattern, replacement.replace("$", "\\")))
        rows.append(f"SELECT doc_id, sent, '{name}' AS id, body, regexp_replace(body, {p}, {r}, 'g') AS output FROM sentences WHERE regexp_matches(body, {p})")
    return f"found AS ({' UNION ALL '.join(rows)})"
