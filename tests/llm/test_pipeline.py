import collections
import re

import corpus_pipeline
from emenda.llm import queries

from test_dedup import jaccard_truth


def test_stages(spark, messy):
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = out.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {"doc_id", "sequence_id", "offset"} <= set(packed.columns) and packed.count() > 0


def test_stages_against_plain_python(spark, messy):
    """Each stage's rows on what its predecessor kept, counted in plain Python."""
    rows = messy.collect()
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, messy, "").cache()
    want = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
    assert collections.Counter((r.doc_id, r.text) for r in known.collect()) == collections.Counter((r.doc_id, r.text) for r in want)
    single = stages["exact_dedup"](spark, known, "").cache()
    assert sorted(r.text for r in single.collect()) == sorted({r.text for r in want})
    apart = stages["ngram_jaccard_join"](spark, single, "").cache()
    texts = [r.text for r in single.collect()]
    _, roots = jaccard_truth(texts)
    kept = [r.text for r in apart.collect()]
    assert sorted(roots[texts.index(t)] for t in kept) == sorted(set(roots))
    mixed = stages["mix_sources"](spark, apart, "").cache()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    times = collections.Counter(r.text for r in mixed.collect())
    assert set(times) <= set(kept) and max(times.values()) <= 2
    taken, budget = sum(size(t) * n for t, n in times.items()), 1.5 * sum(map(size, kept))
    assert budget - max(map(size, kept)) <= taken <= budget + 1
    pieces = stages["best_fit_packing"](spark, mixed, "").collect()
    assert sum(r.piece == 0 for r in pieces) == sum(times.values())


def test_no_documents(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_letters_are_kept_without_labels(spark):
    docs = spark.createDataFrame([(1, "words here", None), (2, "123", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [(r.doc_id, r.lang) for r in corpus_pipeline.STAGES[0][1](spark, docs, "").collect()] == [(1, None)]


def test_every_operator_has_a_query():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(names)


def test_workers_keep_no_words_between_stages(monkeypatch):
    """The pipeline's workers live on: what packing has learnt goes at the end of each task."""
    import corpus_pipeline
    from emenda.llm import packing

    monkeypatch.setattr(packing, "pack", lambda docs, **options: options)
    assert corpus_pipeline.packing_stage(None, None, "") == {"forget": True}
    path = packing.public_tokenizers.path(packing.VOCABULARY)
    with packing.word_ids(path, True) as own:
        assert own(["of the"]) and path in packing._LOADED
    assert path not in packing._LOADED
    with packing.word_ids(path, False) as own:
        assert own is packing.WordIds.of(path)
