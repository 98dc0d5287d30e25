import collections
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from emenda.llm import mixing, packing


def table(con, spark, df):
    con.register("documents", df.toPandas())


def test_mix_equals_sql(spark, messy, empty):
    one = messy.select("doc_id", "text", "source").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = sorted(tuple(r) for r in mixing.mix_report(one).collect())
    con = duckdb.connect()
    con.register("documents", one.toPandas())
    assert got == sorted(con.execute(mixing.ORACLE).fetchall())
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mix_bounds(spark, messy):
    got = mixing.mix_report(messy).collect()
    assert len(got) == messy.count()
    total = sum(r["size"] for r in got)
    assert all(0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size + 1e-6 for r in got)
    assert 1.5 * total - max(r["size"] for r in got) <= sum(r.taken for r in got) <= 1.5 * total
    rows = mixing.mixed(messy)
    assert rows.columns == messy.columns
    times = collections.Counter(r.text for r in rows.collect())
    assert max(times.values()) >= 2
    again = sorted(tuple(r) for r in mixing.mix_report(messy.repartition(2)).collect() if r.doc_id is not None)
    assert again == sorted(tuple(r) for r in got if r.doc_id is not None)


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500)], "x_source string, x_size long")
    got = {r.x_source: r.x_target for r in mixing.source_targets(sizes).collect()}
    assert got["c"] == 20 and got["a"] == 200 and abs(sum(got.values()) - 1.5 * 1610) < 1e-6
    assert abs(got[None] / 3 - got["b"]) < 1e-6 or got[None] == 1000


def test_ids_equal_the_tokenizers():
    rng = random.Random(3)
    path = public_tokenizers.path(packing.VOCABULARY)
    tok, own = Tokenizer.from_file(path), packing.WordIds(path)
    letters = [*"abcXYZ012 .,'!?;:\n\t<|>-é Éß😀 \x1c İΣσ", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", " ", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    for t, ids in zip(texts, own(texts)):
        assert ids == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(messy, empty):
    got = packing.pack(messy).collect()
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = collections.Counter()
    for r in messy.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    placed = collections.defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for rows in placed.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(placed) <= -(-total // 4096) + 1
    assert packing.pack(empty).count() == 0


def test_index_of_sums():
    rng = np.random.default_rng(3)
    for _ in range(25):
        top = int(rng.integers(5, 22))
        sums = packing.Sums(np.bincount(rng.integers(1, top + 1, rng.integers(0, 20)), minlength=top + 1))
        for _ in range(4):
            there = np.flatnonzero(sums.left).tolist()
            for k in (1, 2, 3):
                want = np.zeros(top + 1, int)
                for c in itertools.combinations_with_replacement(there, k):
                    if sum(c) <= top and all(c.count(v) <= sums.left[v] for v in c):
                        want[sum(c)] += 1
                assert (sums.ways[k - 1] == want).all()
            for gap in range(1, top + 1):
                found = sums.filling(gap)
                assert (found is not None) == any(w[gap] for w in sums.ways)
                assert not found or (sum(found) == gap and all(found.count(v) <= sums.left[v] for v in found))
            v = int(rng.integers(1, top + 1))
            sums.change(v, int(rng.integers(-sums.left[v], 4)))


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(5)
    for limit, n in ((16, 40), (64, 500), (256, 3000)):
        lengths = rng.integers(1, limit + 1, n)
        counts = np.bincount(lengths, minlength=limit + 1)
        used, sequences = np.zeros(limit + 1, int), 0
        for pattern, times in packing.plan(counts, limit):
            assert sum(pattern) <= limit and times > 0
            for v in pattern:
                used[v] += times
            sequences += times
        assert (used == counts).all() and sequences <= -(-lengths.sum() // limit) * 1.05 + 2
    hot = np.zeros(65, int)
    hot[40], hot[24], hot[3] = 10**9, 10**9 - 5, 7
    assert sum(n for _, n in packing.plan(hot, 64)) == 10**9
