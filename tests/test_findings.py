"""Cases that reviews found, each held against the query's SQL or against plain Python."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emenda import queries
from emenda.functions import distance, text
from emenda.operators import compiled, detect, relational, resolve, rules
from emenda.plans import pipeline, spelling, sql
from emenda.streaming import reports


def on_both(spark, folder, name, **tables):
    """A query's rows on small tables, by Spark and by its SQL."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    columns = ", ".join(got.columns)
    return order(got.collect()), order(con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall())


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


ODD_CASE = ["ßein ist gut. ßtraße ŉa, ﬁn teh ende. ǰa", "Ok. ﬀ und ΟΔΟΣ ΟΔΟΣ end. İstanbul İstanbul. ƛa. ß", None, "a teh. ßx dont " * 40]


def test_each_letter_has_one_capital(spark, tmp_path):
    spark.createDataFrame([(chr(c),) for c in range(1, 0x11000) if not 0xD800 <= c <= 0xDFFF], "t string").write.parquet(f"{tmp_path}/t")
    capitals, both = sql.run(spark, "SELECT t, upper(t) AS u, upper(concat('x', t, 'ß')) AS v FROM {t}", t=spark.read.parquet(f"{tmp_path}/t")), {}
    for t, u, v in duckdb.sql(f"SELECT t, upper(t), upper(concat('x', t, 'ß')) FROM '{tmp_path}/t/*.parquet'").fetchall():
        both[t] = (u, v)
    assert [r.t for r in capitals.collect() if (r.u, r.v) != both[r.t]] == []
    assert sql.run(spark, "SELECT lower(t) AS l FROM {t}", t=spark.createDataFrame([("ΟΔΟΣ İ",)], "t string")).first().l == "οδοσ i"


@pytest.mark.parametrize("name", ["candidate_edits", "accepted_edits", "corrected_text", "edit_families", "edit_tags", "source_maps", "spell_corrected", "word_frequencies"])
def test_letters_with_several_capitals(spark, tmp_path, name):
    got, want = on_both(spark, tmp_path, name, documents=documents(spark, ODD_CASE))
    assert got == want and got


def test_caps_need_no_group_for_each_client(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS event_id", "nullif(id % 700, 13) AS user_id", "CASE WHEN id % 11 = 3 THEN NULL WHEN id % 3 = 0 THEN 'view' ELSE 'click' END AS event_type", "timestamp'2024-01-05 00:00:00' + make_interval(0, 0, 0, 0, 0, id % 40) AS ts")
    rows.repartition(3).write.parquet(f"{tmp_path}/events")
    shape = reports.capped_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events"), 4)
    assert shape._jdf.queryExecution().analyzed().toString().count("bucket") > 0
    shape.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).foreachBatch(lambda b, k: b.write.parquet(f"{tmp_path}/out/batch={k}")).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").groupBy("user_id", "d").agg(F.sum("accepted").alias("a"), F.sum("refused").alias("r"))
    sent = rows.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("d")).count()
    both = sent.alias("s").join(out.alias("o"), F.expr("s.user_id <=> o.user_id AND s.d = o.d"), "full").collect()
    assert [r for r in both if r["a"] is None or r["a"] + r["r"] != r["count"] or r["a"] > 4] == [] and len(both) == 700


def test_fewest_token_edits_of_long_texts():
    import random
    import time

    rng = random.Random(5)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            corner = 0
            for j, y in enumerate(b):
                corner, row[j + 1] = row[j + 1], corner + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = distance.matched(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and len(pairs) == common(a, b)
    assert distance.matched(list("a" * 4000), list("b" * 4000)) is None
    text = " ".join(rng.choice(("the", "of", "and", "ion")) for _ in range(12_000))
    output, begin = text.replace("the ", "The ", 250), time.process_time()
    assert len(distance.token_edits(text, output)) == 250
    assert time.process_time() - begin < 5  # difflib takes minutes for common words


def test_a_sentence_meets_each_rule_once_without_a_shuffle(spark, monkeypatch):
    pack = [("r1", "the", "x", "of the"), ("r2", "zz", "y", "zz"), ("r3", "of", "z", ""), ("r4", "and", "w", "And the and")]
    docs = documents(spark, ["Of the the of. And zz the and of", None, "the " * 5000])
    wanted = [(0, 0, "r1"), (0, 0, "r3"), (0, 0, "r4"), (0, 1, "r1"), (0, 1, "r2"), (0, 1, "r3"), (0, 1, "r4"), (2, 0, "r1"), (2, 0, "r3"), (2, 0, "r4")]
    for most in (4096, 1):
        monkeypatch.setattr(rules, "MOST_LITERALS", most)
        met = rules.candidates(docs, rules.pack(spark, pack))
        assert sorted((r.doc_id, r.sent, r.id) for r in met.collect()) == wanted
        assert ("hashpartitioning" in met._jdf.queryExecution().executedPlan().toString()) == (most == 1)


def test_each_part_of_the_sql_gets_its_own_fields():
    query = relational.SQL["best_per_sentence"][1]
    own, fields = sql.by_part(query, "tokens", text.fields_in)
    assert ("tok", "norm") in fields.values() and len(fields) == 4 and "{tokens}" not in own
    assert all("".join(sql.parts(q)) == q for _, q in relational.SQL.values())


def odd_texts(seed, count):
    """Words of the detectors and their neighbours, marks, gaps, letters of other scripts and what is protected, in any order."""
    import random

    rng = random.Random(seed)
    words = sorted({w for d in detect.DETECTORS for w in re.findall(r"'((?:[^']|'')*)'", d.when.replace("''", "’")) if re.fullmatch(r"[\w’]+", w)})
    bits = ["a_b", "x.pngy.pdfz", "a.b.com/x", "https://a.b/c", "www.x", "`", "```", "\n>", "\n-- ", "\n$ ", "\r> ", " $ ", "3.14a", "1999", "2024", "5", ":)", "<3", "😀", "x@y.co", "@me", "#a.b", "/a/b", "C:\\x", "aB", "i.e", "U.S.", "Mr", "mR", "ſt", "etc", "K"]
    bits += ["İi", "ΟΔΟΣ", "ßein", "ﬁn", "ŉa", "ǰa", "ƛa", "Ᲊ", "ᲊ", "𐵐", "𐵰", "𝐀b", "é", "É", "ſ", "Ⅷ", "ⓐ", "٣", "Tom's", "Tom'scar", "quickly", "planned", "ok", "OK", "(", ")", "-", "—", "'", "’", "&"]
    marks, gaps = list(".,;:!?.,()-"), [" "] * 14 + ["", "", "\n", "\t", "  ", "\r\n", "\u2028", "\x85", "\x0b", "\u00a0"]

    def one():
        last, out = "the", []
        for _ in range(rng.randrange(1, 160)):
            last = rng.choice([last, rng.choice(words), rng.choice(words).replace("’", "'"), rng.choice(words).capitalize(), rng.choice(bits), rng.choice(marks), rng.choice(marks)])
            out += [last, rng.choice(gaps)]
        return "".join(out)

    return ["", None, "\n", "a", ".", *(one() for _ in range(count))]


def test_passes_are_those_of_the_corrector(spark):
    """fixed_points reads every text once; its passes give the edits and texts that the corrector gives, pass by pass."""
    texts = [*odd_texts(1, 300), "teh " * 1200]
    own = compiled.corrector(compiled.alphabet(spark))
    now = [t or "" for t in texts]
    for _ in range(2):
        rows = {r.doc_id: r for r in resolve.corrected(documents(spark, now)).collect()}
        for k, t in enumerate(now):
            assert own.corrected(t) == ([(e.s, e.e, e.replacement) for e in rows[k].edits], rows[k].output), t
        now = [rows[k].output for k in range(len(now))]
    done = {r.doc_id: r for r in pipeline.fixed_point(documents(spark, texts), passes=2).collect()}
    assert [done[k].output for k in range(len(now))] == now
    assert {(r.passes, r.settled) for r in done.values()} == {(0, True), (1, True), (2, False)} and done[len(now) - 1].edits == 2 * resolve.MOST_EDITS


def test_each_row_reaches_its_fixed_point_alone(spark):
    rows = [(1, "i saw teh cat ."), (1, "they is here"), (None, "i dont know"), (None, None), (2, "It is fine."), (1, "i saw teh cat .")]
    done = pipeline.fixed_point(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, done.select("doc_id", "output", "passes", "settled").collect()), key=repr)
    assert got == sorted([(1, "I saw the cat .", 1, True), (1, "They are here", 1, True), (None, "I don't know", 1, True), (None, "", 0, True), (2, "It is fine.", 0, True), (1, "I saw the cat .", 1, True)], key=repr)


def test_long_runs_of_letters_are_read_once(spark):
    import time

    own, begin = compiled.corrector(compiled.alphabet(spark)), time.process_time()
    assert own.corrected("teh " + "a" * 300_000 + " teh")[1] == "the " + "a" * 300_000 + " the"
    assert len(own.corrected("x,teh" * 100_000)[0]) == resolve.MOST_EDITS
    assert time.process_time() - begin < 20


def test_every_accepted_edit_is_in_the_source_map(spark, tmp_path):
    got, want = on_both(spark, tmp_path, "source_maps", documents=documents(spark, ["teh " * 600, "a teh.", None]))
    assert got == want and sum(r[0] == 0 for r in got) == 600


def test_every_edit_of_detectors_and_spelling_is_accepted(spark, tmp_path):
    texts = ["teh cat " * 600 + "a wondrful sight", "a wonderful sight. " * 30, None]
    got, want = on_both(spark, tmp_path, "spell_corrected_rules", documents=documents(spark, texts))
    assert got == want and {r[1]: r[2] for r in got} == {"spelling.common_misspelling": 600, "spelling.delete_index": 1, "grammar.sentence_capitalization": 30}


@pytest.mark.parametrize("known", [300_000, 40])
def test_spelling_at_size_is_spelling_in_context(spark, tmp_path, monkeypatch, known):
    """Only a slip's places leave their texts and no token becomes a row, whatever a task can hold; the words are those of the relational query."""
    monkeypatch.setattr(spelling, "MOST_KNOWN", known)
    texts = ["We saw a wondrful sight. Wondrful indeed", "a wonderful sight, and the wonderfull sights of great\ncastels", "a wonderful sight, great castles. " * 30, "Castels x castels grat day. É grat", *odd_texts(3, 60), None]
    documents(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = queries.read(spark, str(tmp_path), "documents")
    got = sorted(map(tuple, spelling.sure(docs).collect()))
    rows = entry.queries()["spelling_in_context"](spark, str(tmp_path)).where("sure")
    assert got == sorted(map(tuple, rows.select("doc_id", "s0", "e0", "word").collect())) and len(got) > 2
    plan = entry.queries()["spell_corrected"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
