import collections
import hashlib
import random
import re

import numpy as np
import pytest

from emenda.llm import common, exact_dedup, ngram_join, queries, suffix_dedup


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 100, 5000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = exact_dedup.FuseFilter.from_bytes(exact_dedup.FuseFilter.build(keys).to_bytes())
        assert f.holds(keys).all()
    assert f.holds(rng.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.01


def test_exact_groups(messy):
    got = exact_dedup.dedup_report(messy).collect()
    rows = messy.collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = collections.Counter()
    for g in got:
        ids = by[g.text_sha256]
        top = max((i for i in ids if i is not None), default=None)
        assert g.group_size == len(ids) and g.keep_id == top
        kept[g.text_sha256] += g.kept
        assert not g.kept or g.doc_id == top
    assert set(kept.values()) == {1} and len(kept) == len(by)


def test_exact_stage(messy, empty):
    out = exact_dedup.keep_one(messy)
    assert out.columns == messy.columns
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in messy.collect()})
    assert exact_dedup.keep_one(empty).count() == 0 and exact_dedup.dedup_report(empty).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_truth(texts):
    sets = [shingles(t) for t in texts]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both >= 0.8 * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return links, [root(i) for i in range(len(sets))]


def test_join_against_brute_force(messy):
    rows = messy.collect()
    links, roots = jaccard_truth([r.text for r in rows])
    size = collections.Counter(roots)
    want = collections.Counter((r.doc_id, links[i], size[roots[i]]) for i, r in enumerate(rows))
    got = collections.Counter((r.doc_id, r.n_links, r.class_size) for r in ngram_join.join_report(messy).collect())
    assert got == want


def test_join_stage_keeps_one_of_each_group(messy, empty):
    rows = messy.collect()
    _, roots = jaccard_truth([r.text for r in rows])
    out = ngram_join.keep_one(messy)
    assert out.columns == messy.columns
    place = {id(r): k for k, r in enumerate(rows)}
    kept = collections.Counter()
    for r in out.collect():
        kept[roots[next(place[id(x)] for x in rows if x == r)]] += 1
    assert set(kept) == set(roots) and out.count() == len(set(roots))
    assert ngram_join.keep_one(empty).count() == 0


def test_join_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIMIT", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "DEPTH", 2)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(60):
        own = list(words)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, _ = jaccard_truth(texts)
    got = {r.doc_id: (r.n_links, r.class_size) for r in ngram_join.join_report(docs).collect()}
    assert got == {k: (n, 60) for k, n in enumerate(links)}


@pytest.mark.parametrize("banded", [0, 4, 1000])
def test_join_of_families_in_bands(spark, monkeypatch, banded):
    """A chain from short to long texts is one family; its bands and blocks lose no link, and hot vertices are joined apart."""
    monkeypatch.setattr(ngram_join, "BANDED", banded)
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "BLOCK_HASHES", 900)
    monkeypatch.setattr(ngram_join, "HOT_KEY", 10)
    monkeypatch.setattr(common, "HOT_KEY", 10)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[: 40 + 5 * k]) for k in range(60)] + [" ".join(words[: 60 + 7 * k]) + " end" for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, roots = jaccard_truth(texts)
    size = collections.Counter(roots)
    got = {r.doc_id: (r.class_id, r.n_links, r.class_size) for r in ngram_join.join_report(docs).collect()}
    assert got == {k: (roots[k], n, size[roots[k]]) for k, n in enumerate(links)}


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEY", 5)
    rows = spark.createDataFrame([(k % 3 if k < 60 else k, k) for k in range(90)], "a int, v int")
    side = rows.groupBy("a").count().where("count > 1 OR a = 70")
    for how in ("inner", "left_semi"):
        want = sorted(map(tuple, rows.join(side, "a", how).collect()))
        assert sorted(map(tuple, common.split_join(rows, side, ["a"], "count", how).collect())) == want


@pytest.mark.parametrize("hot", [2048, 1])
def test_suffixes_against_brute_force(spark, messy, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "LENGTH", 40)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcde ") for _ in range(90))
    more = [(1000 + k, "".join(rng.choice("abc") for _ in range(rng.randrange(60))) + passage[: rng.randrange(30, 90)] + "é" * rng.randrange(30)) for k in range(40)] + [(2000, "x" * 300), (2001, "y" * 39), (2002, "ab" * 60)]
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = docs.collect()
    n = 40
    counts = collections.Counter()
    for r in rows:
        b = (r.text or "").encode()
        counts.update(b[k : k + n] for k in range(len(b) - n + 1))
    want = collections.Counter()
    for r in rows:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if counts[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        left = bytes(x for x, g in zip(b, gone) if not g)
        want[(r.doc_id, len(b), len(b) - len(left), len([p for p in bytes(gone).split(b"\0") if p]), hashlib.sha256(left).hexdigest())] += 1
    got = collections.Counter(tuple(r) for r in suffix_dedup.dedup_report(docs, length=n, gram=12).collect())
    assert got == want


def test_suffix_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(4000))
    docs = spark.createDataFrame([(1, text), (2, "zz" + text[1800:2400] + "qq")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_report(docs).collect()}
    assert got == {1: 600, 2: 600}


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(150):
        n, letters = rng.choice([4, 9, 16]), rng.choice([b"ab", b"abcdefgh", b"a\x00b"])
        base = bytes(rng.choice(letters) for _ in range(200))
        parts = []
        for _ in range(rng.randrange(1, 9)):
            at = rng.randrange(150)
            parts.append(base[at : at + rng.randrange(n, n + 20)] if rng.random() < 0.5 else bytes(rng.choice(letters) for _ in range(rng.randrange(n, n + 20))))
        raw, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        start = np.concatenate([np.arange(a, b - n + 1) for a, b in zip(offsets[:-1], offsets[1:])])
        order = suffix_dedup.suffix_order(raw, start, offsets[1:], suffix_dedup.Hashes(raw), n)
        found = [raw[k : k + n].tobytes() for k in order]
        assert sorted(order.tolist()) == start.tolist() and found == sorted(found)


def test_suffixes_on_all_documents(spark):
    """The whole table at the length of the contract: every 400-byte string of every row, by counting."""
    sf = "/root/testdata/sf0.01"
    rows = common.read_table(spark, sf, "documents").select("doc_id", "text").collect()
    n, seen = 400, {}
    for r in rows:
        b = (r.text or "").encode()
        for k in range(len(b) - n + 1):
            h = hash(b[k : k + n])
            seen[h] = seen.get(h, 0) + 1
    want = {}
    for r in rows:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[hash(b[k : k + n])] > 1:
                gone[k : k + n] = b"\1" * n
        left = bytes(x for x, g in zip(b, gone) if not g)
        want[r.doc_id] = (len(b), len(b) - len(left), len([p for p in bytes(gone).split(b"\0") if p]), hashlib.sha256(left).hexdigest())
    assert sum(v[1] > 0 for v in want.values()) > 100
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_suffix_array_dedup(spark, sf).collect()}
    assert got == want


def test_suffixes_of_nothing(empty):
    assert suffix_dedup.dedup_report(empty).count() == 0
