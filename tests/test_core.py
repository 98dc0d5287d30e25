import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emenda import queries
from emenda.functions import text as T
from emenda.operators import detect, resolve, tone
from emenda.plans import pipeline, sql
from emenda.sources import readers
from emenda.streaming import reports

SF = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tokens_and_offsets(spark):
    texts = ["It's 3.14, a🙂b isn't 'x'.\nNext “line” 1,000!", "", None, "a''b don't-stop", "l’été n’est pas"]
    token = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[0-9]+(?:[.,][0-9]+)*|\S")
    got = T.token_rows(frame(spark, texts)).collect()
    for k, t in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.i)
        assert [(r.tok, r.s0, r.e0) for r in own] == [(m.group(), m.start(), m.end()) for m in token.finditer(t or "")]


def test_sentences(spark):
    got = T.sentence_rows(frame(spark, ["Dr. Lee came. He left at 5 p.m. today! See fig. 2\nnew line", "one"])).collect()
    assert [r.body for r in got if r.doc_id == 0] == ["Dr. Lee came.", "He left at 5 p.m. today!", "See fig. 2", "new line"]
    assert [r.words for r in got if r.doc_id == 1] == [1]


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randrange(9) for _ in range(n)]) for k, n in enumerate((1, 2, 63, 64, 65, 300))]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k int, v array<int>").select("k", T.running(F.col("v")).alias("t")).collect()}
    for k, v in rows:
        total, want = 0, []
        for x in v:
            total += x
            want.append(total)
        assert got[k] == want


GOLDEN = [
    ("i think the the cat sat", "I think the cat sat"),
    ("We met on monday , in paris", "We met on Monday, in Paris"),
    ("She ate a apple and an banana.", "She ate an apple and a banana."),
    ("they is here. we could of won", "They are here. We could have won"),
    ("I dont recieve teh mail", "I don't receive the mail"),
    ("Its been alot of work", "It's been a lot of work"),
    ("However we left", "However, we left"),
    ("He said that that works. No no, it had had enough.", "He said that that works. No no, it had had enough."),
    ("See `i i` and https://example.com/i/i or a_b", "See `i i` and https://example.com/i/i or a_b"),
    ("We saw Bora Bora there", "We saw Bora Bora there"),
]


def test_golden_pairs_and_idempotence(spark):
    got = {r.doc_id: r for r in pipeline.fixed_point(frame(spark, [a for a, _ in GOLDEN] + [None, ""]), passes=3).collect()}
    for k, (source, want) in enumerate(GOLDEN):
        assert got[k].output == want, source
        assert got[k].settled
    assert got[len(GOLDEN)].output == "" and got[len(GOLDEN) + 1].output == ""


def test_edit_plans_are_disjoint_and_maps_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    rows = resolve.corrected(docs).withColumn("map", resolve.source_map(F.col("text"), F.col("edits"))).collect()
    for r in rows:
        at, out = 0, []
        for e in r.edits:
            assert e.s >= at
            out += [r.text[at : e.s], e.replacement]
            at = e.e
        assert "".join(out) + r.text[at:] == r.output
        for m in r.map:
            assert m.changed or r.text[m.a : m.b] == r.output[m.c : m.d]


def test_in_row_and_exploded_detection_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    a = detect.edits(docs).collect()
    b = detect.edit_arrays(docs).select("doc_id", F.inline("edits")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_spans_merge(spark):
    df = frame(spark, ["mail a.b@c.org or see www.c.org/x_y at 10:30", "none"])
    got = {r.doc_id: [(x.s, x.e) for x in r.m] for r in df.select("doc_id", resolve.merged(resolve.protected(F.col("text"))).alias("m")).collect()}
    assert got[1] == [] and got[0][0] == (5, 14)
    assert all(a[1] <= b[0] for a, b in zip(got[0], got[0][1:]))


def test_text_helpers(spark):
    df = spark.createDataFrame([("the", "The"), ("the", "TEH"), ("do I", "I do"), ("abc", "x")], "r string, o string")
    assert [r[0] for r in df.select(T.match_case(F.col("r"), F.col("o"))).collect()] == ["The", "THE", "do I", "abc"]
    one = spark.createDataFrame([("htis", "this", True), ("cat", "cart", True), ("abcd", "badc", False), ("same", "same", True)], "a string, b string, y boolean")
    assert all(r[0] == r[1] for r in one.select(T.osa_one(F.col("a"), F.col("b")), "y").collect())
    row = spark.createDataFrame([("a🙂b\ncd", 5)], "t string, k int").select(T.utf16_length(F.col("t")), T.line_column(F.col("t"), F.col("k")), T.squeeze(F.lit("sooooo"), 2)).first()
    assert row[0] == 7 and tuple(row[1]) == (1, 1) and row[2] == "soo"


def test_tone_keeps_meaning(spark):
    df = spark.createDataFrame([("pay 5 now", "pay 6 now"), ("do not go", "do go"), ("ok?", "ok"), ("fine here", "fine here.")], "a string, b string")
    assert [r[0] for r in df.select(tone.meaning_lost(F.col("a"), F.col("b"))).collect()] == ["facts", "negation", "question", None]
    requests = spark.createDataFrame([(1, "i wanna go asap", "professional"), (2, None, "fix"), (3, "x" * 70_000, "fix"), (4, "hi", "odd")], "doc_id long, text string, mode string")
    got = {r.doc_id: (r.output, r.error) for r in pipeline.rewritten(requests).collect()}
    assert got[1] == ("I want to go as soon as possible.", None)
    assert [got[k][1] for k in (2, 3, 4)] == ["no text", "more than 64 KB of text", "unknown mode"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": 1, "text": "x"}\nbroken\n')
    good, bad = readers.jsonl(spark, str(tmp_path / "a.jsonl"))
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "p.txt").write_text("# note\nteh the\nalone\n\n")
    assert [tuple(r) for r in readers.pairs(spark, str(tmp_path / "p.txt")).collect()] == [("teh", "the")]
    m = readers.markup(spark.createDataFrame([("a [[b=>c|d]] e",)], "text string")).first()
    assert (m.input, m.reference, m.fixes, m.alternatives) == ("a b e", "a c e", ["c"], [["d"]])
    m2 = readers.m2(spark.createDataFrame([("S a b",), ("A 1 2|||R:NOUN|||cats|||REQUIRED|||-NONE-|||0",)], "value string")).first()
    assert (m2.start, m2.end, m2.kind, m2.fix) == (1, 2, "R:NOUN", "cats")
    (tmp_path / "r.json").write_text('[{"id":"x","pattern":"foo+","replacement":"b","category":"c","positive":["foo"],"negative":["foo"]}]')
    rules = readers.rule_packs(spark, str(tmp_path / "r.json"))
    assert readers.linted(rules).first().problem == "a negative example matches"
    with pytest.raises(ValueError):
        readers.rule_packs(spark, str(tmp_path / "r.json"), str(tmp_path / "r.json"))


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.limit(20)).write.parquet(str(tmp_path / "in"))
    stream = reports.report_stream(spark, str(tmp_path / "in"), events.schema)
    reports.into(reports.once(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    new = events.limit(5).withColumn("value", F.lit(0.0))
    assert reports.merged(events, new).count() == events.count()


def test_portable_sql():
    assert sql.for_duckdb("rx(a, 'x{2}') {t}", t="u") == "regexp_matches(a, 'x{2}') u"
    assert sql.for_spark("hex256(concat(a, f(b)))") == "sha2(CAST(concat(a, f(b)) AS BINARY), 256)"


def cells(rows):
    return sorted(str([round(float(v), 6) if isinstance(v, float) else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", ["sentence_ordinals", "corrected_text", "spelling_best", "fix_queue", "verdict_rollup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]}) q").fetchall()
    assert cells(df.select(*names).collect()) == cells(want)


def test_swaps_are_candidates(spark, tmp_path):
    text = "their friend " * 25 + "thier freind frend"
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("spelling_candidates_osa", "spelling_best_osa"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        got = df.collect()
        word = "first_word" if "first_word" in df.columns else "word"
        assert {(r.slip, r[word]) for r in got} == {("thier", "their"), ("freind", "friend"), ("frend", "friend")}
        assert cells(got) == cells(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]}) q").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
