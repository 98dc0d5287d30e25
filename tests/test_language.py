"""The operators over tokens, edits and documents: the same rows as DuckDB's, and by example what they are for."""

import decimal
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emenda.functions import text as T
from emenda.operators import language, privacy, relational, resolve, rules
from emenda.plans import sql

SF = "/root/testdata/sf0.001"
OWN = [n for n in relational.SQL if f'add("{n}"' in open(language.__file__).read()]
MORE = ["rule_matches", "rule_prefilter_hits", "private_spans", "redactions", "redaction_maps", "spell_corrected", "stream_corrected", "stream_caps", "stream_rate_limits", "stream_dedupe"]


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(float(r[i]), 6) if isinstance(r[i], (float, decimal.Decimal)) else r[i] for i in at]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in ("nation", "customer", "events", "documents", "embeddings", "benchmark", "labels", "conversations", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", [*OWN, *MORE])
def test_same_rows_as_duckdb(spark, duck, name):
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(found.fetchall(), columns)


def over(spark, name, texts):
    docs = spark.createDataFrame([(k, t, "en", "web") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    return sql.run(spark, relational.SQL[name][1], tokens=T.token_rows(docs, extra=("lang",)), documents=docs).collect()


def test_spelling_in_context(spark):
    texts = ["the green house stands near the river"] * 30 + ["a hosue stands near the river", "the gren house", "the greeen house", "near the rivwr today"]
    got = {r.slip: (r.word, r.sure) for r in over(spark, "spelling_in_context", texts)}
    assert got["hosue"] == ("house", True) and got["greeen"][0] == "green" and got["rivwr"][0] == "river"
    kinds = {r.first_slip: r.kind for r in over(spark, "typo_costs", texts)}
    assert kinds["hosue"] == "swapped" and kinds["greeen"] == "doubled" and kinds["rivwr"] == "beside"


def test_inflections(spark):
    words = {"city": ("cities", "citied", "citying"), "box": ("boxes", "boxed", "boxing"), "plan": ("plans", "planned", "planning"), "bake": ("bakes", "baked", "baking"), "knife": ("knives", "knifed", "knifing"), "play": ("plays", "played", "playing"), "tie": ("ties", "tied", "tying")}
    got = {r.w: r for r in over(spark, "inflections", [" ".join(words)] * 20 + ["cities"] * 20)}
    assert {w: tuple(got[w])[1:4] for w in words} == words and got["cities"].singular == "city" and got["cities"].looks_plural


def test_corruption_can_be_undone(spark):
    text = "Some words stand here in this sentence today. Another sentence has enough words too, really."
    for r in over(spark, "challenge_corruption", [text] * 3):
        start = 0 if r.sent == 0 else text.index("Another")
        assert text[start + r.place :].startswith(r.taken) and r.put != r.taken


def test_private_spans_and_the_way_back(spark):
    text = "Ann: ann@corp.example.com or ann at corp dot com, sk_live_a1b2c3d4e5, call +1 (017) 555-7713, nine one one two, see https://x.org/a."
    row = privacy.redacted(spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].redacted == "Ann: [email] or [spelled email], [key], call [phone], [spelled number], see [link]" and row[1].redacted == "" and row[2].redacted == "nothing"
    maps = spark.createDataFrame([row[0]]).select(F.inline(resolve.source_map(F.col("text"), F.col("edits"))))
    for m in maps.collect():
        assert m.changed or text[m.a : m.b] == row[0].redacted[m.c : m.d]


def test_rules_without_literals_see_all_sentences(spark):
    docs = spark.createDataFrame([(1, "We did it in order to win,, fine."), (2, None), (3, "more better")], "doc_id long, text string")
    got = {(r.doc_id, r.id): r.output for r in rules.matches(docs, rules.pack(spark)).collect()}
    assert got[1, "pack.in_order_to"] == "We did it to win,, fine." and got[1, "pack.double_comma"] == "We did it in order to win, fine." and got[3, "pack.more_better"] == "better"


def test_folds_equal_plain_loops(spark):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        spans = sorted({(a, a + rng.randrange(1, 9), rng.randrange(5)) for a in (rng.randrange(400) for _ in range(rng.choice([0, 1, 63, 64, 65, 150])))})
        edits = [(a, a + rng.randrange(0, 4), "x" * rng.randrange(3), "c", f"r{rng.randrange(3)}", 0.5) for a in (rng.randrange(420) for _ in range(rng.choice([0, 1, 64, 130])))]
        rows.append((k, spans, edits))
    shape = "k int, p array<struct<s:bigint,e:bigint,kind:int>>, e array<struct<s:bigint,e:bigint,replacement:string,category:string,rule_id:string,confidence:double>>"
    df = spark.createDataFrame(rows, shape).select("k", resolve.merged(F.col("p")).alias("m"), "e").select("k", "m", resolve.guarded(F.col("e"), F.col("m")).alias("g"))
    df = df.select("k", "m", "g", resolve.accepted(F.col("g")).alias("a"))
    for r in df.collect():
        _, spans, edits = rows[r.k]
        merged = []
        for s, e, kind in spans:
            if merged and s < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], e), min(merged[-1][2], kind))
            else:
                merged.append((s, e, kind))
        assert [tuple(x) for x in r.m] == merged
        touched = lambda a, b: any((s <= a < e) if a == b else (a < e and b > s) for s, e, _ in merged)
        assert [tuple(x) for x in r.g] == [x for x in edits if not touched(x[0], x[1])]
        last, end, want = -1, 0, []
        for x in sorted((tuple(x) for x in r.g), key=lambda x: (x[0], x[3] == "Capitalization", -x[5], x[1], x[4], x[2])):
            if x[0] != last and x[0] >= end:
                want.append(x)
                last, end = x[0], max(end, x[1])
        assert [tuple(x) for x in r.a] == want
