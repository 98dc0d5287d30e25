"""Spelling in context and the corrections with it, for a whole corpus: three maps over the documents in Python, and joins of what is rare.

``language`` has the same as relational algebra over token rows. Here only a slip's own places leave their texts (a slip comes RARE times at most, so
it does within any part of the corpus), and only pairs that a candidate asks for are counted. Both are exact.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from emenda.operators import compiled, language
from emenda.operators import detect as D
from emenda.operators.relational import RARE
from emenda.plans import sql as S
from emenda.plans.pipeline import shared_table

#: Words that are counted by themselves, and those that can be slips; all other words only count in the total.
_COUNTED, _SLIP = re.compile(r"[a-z]{4,14}\Z").match, re.compile(r"[a-z]{5,14}\Z").match
#: A task gives away what it has counted when it knows so many different words or pairs.
MOST_KNOWN = 300_000
#: Bits of the set of pairs that are asked for, by their hash: 16 a pair within these bounds. More pairs only mean that more are counted in vain.
FEWEST_BITS, MOST_BITS, BUCKET = 1 << 16, 1 << 27, 1 << 15
_CATEGORY = {d.rule_id: d.category for d in D.DETECTORS} | {"spelling.delete_index": "Spelling"}


def _batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # or one text
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


class Small(dict):
    """A token's small form."""

    def __init__(self, own: compiled.Corrector):
        super().__init__()
        self.small = own.small

    def __missing__(self, tok: str) -> str:
        low = self[tok] = self.small(tok)
        return low


class Hashes(dict):
    """The hash of a token's small form, as Spark's crc32."""

    def __init__(self, low: Small):
        super().__init__()
        self.low = low

    def __missing__(self, tok: str) -> int:
        h = self[tok] = zlib.crc32(self.low[tok].encode())
        return h


def counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """w, c: words with how often a task saw them (the empty one stands for all that aren't counted alone). Or w, c null, key, s0, e0, prev_n, next_n: where a word
    stands that a task saw RARE times at most."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    letters = compiled.alphabet(docs.sparkSession)
    schema = StructType([StructField("w", StringType()), StructField("c", LongType()), rows.schema[key], StructField("s0", LongType()), StructField("e0", LongType()), StructField("prev_n", StringType()), StructField("next_n", StringType())])
    names = schema.names

    def run(batches):
        own = compiled.corrector(letters)
        low, word = Small(own), re.compile(compiled.ported(r"\p{L}", own.ranges)).match
        known: Counter = Counter()  # of tokens
        places: dict[str, list] = {}

        def given(kind):
            norms: Counter = Counter()
            for tok, n in known.items():
                if word(tok):
                    norms[low[tok] if _COUNTED(low[tok]) else ""] += n
            few = [(w, None, *place) for w, found in places.items() if norms[w] <= RARE for place in found]
            out = [*((w, n, None, None, None, None, None) for w, n in norms.items()), *few]
            known.clear(), places.clear(), low.clear()
            kinds = (pa.string(), pa.int64(), kind, pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            texts = batch.column(1).to_pylist()
            split = [own.tokens(t).findall(t) for t in texts]
            here: Counter = Counter()
            for toks in split:
                here.update(toks)
            known.update(here)
            rare = {w for w, n in here.items() if n <= RARE and known[w] <= RARE and _SLIP(w)}
            for k, toks in enumerate(split if rare else ()):
                hits = list(compress(range(len(toks)), map(rare.__contains__, toks)))
                if hits:
                    gaps = own.tokens(texts[k]).split(texts[k])
                    ends = list(accumulate(map(int.__add__, map(len, gaps), map(len, toks))))
                    at = batch.column(0)[k].as_py()
                    for j in hits:
                        before, after = low[toks[j - 1]] if j else "", low[toks[j + 1]] if j + 1 < len(toks) else ""
                        places.setdefault(toks[j], []).append((at, ends[j] - len(toks[j]), ends[j], before, after))
            if len(known) > MOST_KNOWN:
                yield given(kind)
        if known:
            yield given(kind)

    return rows.mapInArrow(run, schema)


def asked(pairs: DataFrame) -> tuple[int, bytes]:
    """A set of hashes of pairs (a, b), by bits, and how many bits it has."""
    n = pairs.count()
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (16 * n).bit_length()))
    place = F.pmod(F.crc32(F.col("a").cast("binary")) * 1_000_003 + F.crc32(F.col("b").cast("binary")), F.lit(bits))
    rows = pairs.select(place.alias("p")).groupBy(F.floor(F.col("p") / BUCKET).alias("k")).agg(F.expr(f"bitmap_construct_agg(p % {BUCKET})").alias("m"))
    out = bytearray(bits // 8)
    for r in rows.collect():
        out[r["k"] * (BUCKET // 8) : (r["k"] + 1) * (BUCKET // 8)] = r["m"]
    return bits, bytes(out)


def pairs_among(docs: DataFrame, text: str, bits: int, wanted: bytes) -> DataFrame:
    """a, b, c: pairs of words with blanks between whose hash is asked for, with how often a task saw them."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    letters = compiled.alphabet(docs.sparkSession)

    def run(batches):
        own = compiled.corrector(letters)
        low, word, blank = Small(own), re.compile(compiled.ported(r"\p{L}", own.ranges)).match, re.compile(r"[ \t]+\Z").match
        hashes, has, seen = Hashes(low), np.frombuffer(wanted, np.uint8), Counter()

        def given():
            out = list(zip(*((a, b, n) for (a, b), n in seen.items()), strict=True)) or [(), (), ()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)], ["a", "b", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                token = own.tokens(text)
                toks = token.findall(text)
                h = np.fromiter(map(hashes.__getitem__, toks), np.int64, len(toks))
                p = (h[:-1] * 1_000_003 + h[1:]) & (bits - 1)
                hits = np.nonzero(has[p >> 3] >> (p & 7).astype(np.uint8) & 1)[0].tolist()
                if hits:
                    gaps = token.split(text)
                    seen.update((low[toks[j]], low[toks[j + 1]]) for j in hits if blank(gaps[j + 1]) and word(toks[j]) and word(toks[j + 1]))
            if len(seen) > MOST_KNOWN:
                yield given()
            if len(hashes) > MOST_KNOWN:
                hashes.clear(), low.clear()
        yield given()

    return rows.mapInArrow(run, "a string, b string, c long")


def sure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, s0, e0, word: the words that ``spelling_in_context`` is sure of."""
    spark = docs.sparkSession
    _batches(spark)
    found = shared_table(counted(docs, key, text), "counted")
    words = shared_table(found.where("c IS NOT NULL").groupBy("w").agg(F.sum("c").alias("c")), "words")
    tables = {"words": words}
    head = "words AS (SELECT w, c FROM {words}), "
    cost = shared_table(S.run(spark, f"WITH {head}{language.COSTS} SELECT slip, word, c, cost FROM cost", **tables), "cost")
    seen = found.where("c IS NULL").select(F.col(key).alias("doc_id"), "s0", "e0", F.col("w").alias("norm"), "prev_n", "next_n").distinct()
    seen = shared_table(seen.join(cost.select(F.col("slip").alias("norm")).distinct(), "norm", "left_semi"), "seen")
    near = seen.join(cost.select(F.col("slip").alias("norm"), "word"), "norm")
    needed = near.select(F.col("prev_n").alias("a"), F.col("word").alias("b")).union(near.select("word", "next_n")).distinct()
    bits, wanted = asked(shared_table(needed, "needed"))
    pairs = shared_table(pairs_among(docs, text, bits, wanted).groupBy("a", "b").agg(F.sum("c").alias("c")), "pairs")
    own = "cost AS (SELECT slip, word, c, cost FROM {cost}), pairs AS (SELECT a, b, c FROM {pairs}), seen AS (SELECT * FROM {seen})"
    best = S.run(spark, f"WITH {head}{own}, {language.TOTAL},\n{language.BEST} SELECT doc_id, s0, e0, word FROM best WHERE k = 1 AND (second IS NULL OR score - second >= {language.MARGIN})", **tables, cost=cost, pairs=pairs, seen=seen)
    return shared_table(best.withColumnRenamed("doc_id", key), "sure")


def corrected(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, s, e, replacement, category, rule_id, confidence: all accepted edits, where ``words`` (key, s0, e0, word) compete with the detectors' candidates."""
    spark = docs.sparkSession
    _batches(spark)
    more = words.groupBy(key).agg(F.collect_list(F.struct("s0", "e0", "word")).alias("more"))
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(more, key, "left")
    letters = compiled.alphabet(spark)
    schema = StructType([rows.schema[key], *(StructField(n, LongType()) for n in ("s", "e")), *(StructField(n, StringType()) for n in ("replacement", "category", "rule_id")), StructField("confidence", DoubleType())])
    names = schema.names

    def run(batches):
        own = compiled.corrector(letters)
        for batch in batches:
            of, out = [], []
            for k, (t, more) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                edits = own.accepted(t, [(w["s0"], False, -0.8, w["e0"], "spelling.delete_index", w["word"]) for w in more or ()], None)
                of += [k] * len(edits)
                out += [(s, e, replacement, _CATEGORY[rule], rule, -c) for s, _, c, e, rule, replacement in edits]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return rows.mapInArrow(run, schema)
