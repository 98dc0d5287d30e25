import random
import zlib

import numpy as np
import pytest

from emenda.llm import langid, quality


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(3)
    parts = {"aa": ["the", "tion", "ing", "and"], "bb": ["sch", "ein", "lich", "und"], "cc": ["que", "eau", "ment", "les"]}
    rows = []
    for k in range(600):
        lang = rng.choice(list(parts))
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 200))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_accuracy_on_held_out_rows(languages):
    truth = {r.doc_id: r.lang for r in languages.collect()}
    got = langid.identify(languages).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 600 and {r.doc_id for r in out} == {i for i in truth if held(i)}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_never_reads_labels_when_predicting(languages):
    net = langid.train(languages)
    swapped = languages.selectExpr("doc_id + 1 AS doc_id", "text", "'zz' AS lang")
    a = sorted((r.doc_id + 1, r.lang_pred, r.score) for r in langid.predict(languages, net).collect())
    assert a == sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(swapped, net).collect())


def test_language_of_odd_rows(messy, empty):
    got = langid.identify(messy).collect()
    assert len(got) == messy.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for r in messy.collect():
        none = not any(c.isalpha() for c in r.text or "")
        assert any((g.lang_pred == "und") == none for g in by[r.doc_id])
        assert all(g.held_out == held(r.doc_id) for g in by[r.doc_id])
    assert langid.identify(empty).count() == 0
    unlabelled = langid.identify(messy.withColumn("lang", messy.lang.substr(9, 9).cast("string")).where("lang IS NULL")).collect()
    assert {r.lang_pred for r in unlabelled} <= {"und"}


def test_language_stage(messy, empty):
    out = langid.keep_identified(messy)
    assert out.columns == messy.columns and out.schema.simpleString() == messy.schema.simpleString()
    want = [r.text for r in messy.collect() if any(c.isalpha() for c in r.text or "")]
    assert sorted(r.text for r in out.collect()) == sorted(want)
    assert langid.keep_identified(empty).count() == 0


def test_windows_cover_whole_texts():
    raw = np.arange(600, dtype=np.int64).astype(np.uint8)
    x, owner, length = langid.windows(raw, np.array([0, 300, 300, 600]), 256)
    assert length.tolist() == [256, 44, 256, 44] and owner.tolist() == [0, 0, 2, 2]
    assert np.concatenate([row[:n] for row, n in zip(x, length)]).tolist() == raw.tolist() and set(x[1, 44:]) == {32}


def test_trees_fit_and_are_the_same_in_any_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = quality.Boosted.fit(x[:1500], y[:1500])
    assert ((m.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95

    def walk(t, row):
        node = 0
        while node < m.feature.shape[1]:
            node = 2 * node + 1 + (row[m.feature[t, node]] > m.threshold[t, node])
        return m.value[t, node - m.feature.shape[1]]

    one = [1 / (1 + np.exp(-(m.base + sum(walk(t, r) for t in range(len(m.feature)))))) for r in x[:20]]
    assert np.allclose(one, m.probability(x[:20]))
    assert len(m.probability(x[:0])) == 0


def test_quality(spark, messy, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(800):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) + ("" if good else rng.choice(["$$$", "###", "!!"])) for _ in range(rng.randrange(5, 60))]
        rows.append((k, " ".join(words)))
        labels.append((k, int(good), 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = dict((k, q) for k, q, _ in labels)
    got = quality.classify(docs, marks).collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.97
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.7) for r in got)
    model = quality.train(docs, marks)
    odd = quality.score(messy, model).collect()
    assert len(odd) == messy.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(empty, model).count() == 0
    assert {r.score for r in quality.classify(messy, marks.limit(0)).collect()} == {0.5}
