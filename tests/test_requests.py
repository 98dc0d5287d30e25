"""Request options, tone, distances, word pieces and differences."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emenda.functions import distance, register
from emenda.operators import resolve, tone
from emenda.plans import pipeline
from emenda.streaming import reports

SF = "/root/testdata/sf0.001"


def test_requests_leave_alone_what_they_protect(spark):
    lines = [
        {"doc_id": 1, "text": "i recieve teh mail", "mode": "fix"},
        {"doc_id": 2, "text": "i recieve teh mail", "dictionary": ["TEH"]},
        {"doc_id": 3, "text": "😀 i recieve teh mail", "protected_ranges": [{"start_utf16": 5, "end_utf16": 12}]},
        {"doc_id": 4, "text": "we met in london", "names": ["London"]},
        {"doc_id": 5},
    ]
    frame = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("not json",)], "value string")
    got = {r["id"]: r for r in (json.loads(x.value) for x in pipeline.process_json(spark, frame).collect())}
    assert got[1]["output"] == "I receive the mail" and got[2]["output"] == "I receive teh mail"
    assert got[3]["output"] == "😀 I recieve the mail" and got[4]["output"] == "We met in london"
    assert got[5]["error"] == "no text" and got[-1]["error"] == "no text"


def test_process_json_takes_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps({"doc_id": k, "text": "We dont know"}) for k in range(5)))
    out = pipeline.process_json(spark, spark.readStream.text(str(tmp_path / "in")))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(json.loads(r.value)["output"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["We don't know"] * 5


WORDED = [
    ("professional", "i'm gonna send it asap", "I am going to send it as soon as possible."), ("professional", "Thx, lmk", "thank you, let me know."), ("professional", "Dear Ann,\nwe can't come\nBest,\nBo", "Dear Ann,\nwe cannot come.\nBest,\nBo"),
    ("concise", "I hope this finds you well. In order to win, utilize it.", "to win, use it."), ("direct", "Can you please send it?", "Please send it?"), ("friendly", "I am here regarding it", "I'm here about it"),
    ("friendly", "You are an idiot. The stupid plan failed.", "The unhelpful plan failed."), ("fix", "gonna go", "gonna go"), ("concise", "Nothing to change here", "Nothing to change here"),
]


def test_wording(spark):
    df = spark.createDataFrame(WORDED, "mode string, a string, b string").select("b", tone.worded(F.col("a"), F.col("mode")).alias("got"))
    assert [r.got for r in df.collect()] == [b for _, _, b in WORDED]


def test_distances():
    rng = random.Random(4)

    def slow(a, b, again):
        best = {a: 0}
        edge = [a]
        while b not in best:
            new = []
            for w in edge:
                for k in range(len(w) + 1):
                    near = [w[:k] + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :], *(w[:k] + c + w[k:] for c in "ab"), *(w[:k] + c + w[k + 1 :] for c in "ab")]
                    for v in near:
                        if v not in best and len(v) <= max(len(a), len(b)) + 1:
                            best[v] = best[w] + 1
                            new.append(v)
            edge = new
        return best[b]

    for _ in range(150):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(5))) for _ in range(2))
        assert distance.damerau(a, b) == slow(a, b, True), (a, b)
        assert distance.osa(a, b) >= distance.damerau(a, b)
        assert distance.osa(a, b, 1) == min(distance.osa(a, b), 2)
    assert distance.osa("ca", "abc") == 3 and distance.damerau("ca", "abc") == 2 and distance.osa("thier", "their") == 1


def test_pieces_and_differences():
    vocabulary = frozenset(["un", "##able", "##a", "##b", "a", "unit"])
    assert distance.pieces("unable", vocabulary) == ["un", "##able"] and distance.pieces("unit", vocabulary) == ["unit"] and distance.pieces("xu", vocabulary) == ["[UNK]"]
    rng = random.Random(7)
    for _ in range(100):
        words = [rng.choice(["one", "two", " ", ", ", "\n", "it's", "😀"]) for _ in range(rng.randrange(30))]
        other = [rng.choice([w, w, w, "new", ""]) for w in words]
        a, b = "".join(words), "".join(other)
        at, out = 0, []
        for s, e, r in distance.token_edits(a, b):
            out += [a[at:s], r]
            at = e
        assert "".join(out) + a[at:] == b


def test_caps_over_batches(spark, tmp_path):
    """Two micro-batches of one client and day share the cap."""
    rows = spark.createDataFrame([(k, 1, "error", float(k)) for k in range(6)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    for name, part in (("a", rows.where("event_id < 3")), ("b", rows.where("event_id >= 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    reports.into(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 4).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


@pytest.mark.parametrize("name", ["tone_rewrites", "damerau_distances", "token_differences", "sql_functions"])
def test_same_rows_as_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def test_word_pieces_cover_all_words(spark):
    rows = entry.queries()["word_pieces"](spark, SF).collect()
    assert rows and all("".join(p.removeprefix("##") for p in r.pieces.split(" ")) == r.w and r.n >= 1 for r in rows)


def test_functions_can_be_registered_again(spark):
    register.register(spark)
    register.register(spark)
    assert spark.sql("SELECT emenda_plural('city') AS a, emenda_gerund('plan') AS b, emenda_private('call 5') AS c").first() == ("cities", "planning", True)


def test_own_spans(spark):
    df = spark.createDataFrame([(1, "we dont know teh", [(3, 7, 50)])], "doc_id long, text string, own array<struct<s:bigint,e:bigint,kind:int>>")
    assert resolve.corrected(df, own="own").first().output == "We dont know the"
