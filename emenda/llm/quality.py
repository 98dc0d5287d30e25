"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown in numpy from binned statistics of a bounded sample of labelled documents, and flattened into arrays; all documents
go down all trees a level at a time. Statistics are of the whole text, taken from its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emenda.llm.common import hashed_sample, held_out, table_batches, to_python, utf8_parts, released
from emenda.llm.ngram_join import SPACES, Shingler, mix

#: At most so many labelled documents are used to fit.
TRAINING_ROWS = 20_000
BINS = 64
TREES = 120
DEPTH = 4
RATE = 0.1
THRESHOLD = 0.7

_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "space": [9, 11, 12, 13, 32],
    "newline": [10],
    "high": [*range(128, 256)],
    "control": [*range(9), *range(14, 32), 127],
    "stop": [46, 33, 63],
    "comma": [44, 58, 59],
    "bar": [124],
    "mark": [33],
    "symbol": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 96, 126],
    "bracket": [40, 41, 91, 93, 123, 125],
    "quote": [34, 39],
    "dash": [45, 95, 47],
}
NAMES = (*_CLASSES, "log_bytes", "entropy", "used_bytes", "log_words", "word_bytes", "word_spread", "long_words", "one_byte_words", "words_with_symbol", "distinct_words", "top_word", "doubled_words", "log_lines", "line_words", "distinct_lines", "capital_words", "all_capital_words")
_MEMBERS = np.zeros((256, len(_CLASSES)), np.float32)
for _k, _own in enumerate(_CLASSES.values()):
    _MEMBERS[_own, _k] = 1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*_CLASSES["symbol"], *_CLASSES["bar"], *_CLASSES["mark"]]] = True
_UPPER = np.zeros(256, bool)
_UPPER[_CLASSES["upper"]] = True
_LOWER = np.zeros(256, bool)
_LOWER[_CLASSES["lower"]] = True


def _per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds; empty stretches give 0."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def statistics(raw: np.ndarray, offsets: np.ndarray, shingler: Shingler) -> np.ndarray:
    """(texts, NAMES): shares and counts of each whole text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float32)
    some = np.maximum(size, 1)[:, None]
    share = counts / some
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    inside = ~SPACES[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    begins[at] = inside[at]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words = np.searchsorted(start, offsets)
    number = np.diff(words).astype(np.float64)
    many = np.maximum(number, 1)
    length = (end - start).astype(np.float64)
    mean = _per(length, words) / many
    spread = np.sqrt(np.maximum(_per(length**2, words) / many - mean**2, 0))

    def having(table: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        return run[end] - run[start]

    shingler._grow(len(raw) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * shingler.powers[: len(raw)], out=run[1:])
        hashed = mix((run[end] - run[start]) * shingler.inverse[start])
        cut = np.flatnonzero(raw == 10)
        line_start = np.unique(np.concatenate([at, cut + 1]))
        line_start = line_start[line_start < len(raw)]
        line_end = np.append(line_start[1:], len(raw))
        lines = mix((run[line_end] - run[line_start]) * shingler.inverse[line_start]) if len(line_start) else np.zeros(0, np.uint64)
    same = np.zeros(len(hashed))
    same[1:] = hashed[1:] == hashed[:-1]
    own_lines = np.searchsorted(line_start, offsets)
    line_count = np.diff(own_lines).astype(np.float64)
    distinct, top, distinct_lines = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        a, b = words[i], words[i + 1]
        if b > a:
            often = np.unique(hashed[a:b], return_counts=True)[1]
            distinct[i], top[i] = len(often), often.max()
            distinct_lines[i] = len(np.unique(lines[own_lines[i] : own_lines[i + 1]]))
    uppers = having(_UPPER)
    out = [
        share @ _MEMBERS,
        np.log1p(size), entropy, (counts > 0).sum(1), np.log1p(number), mean, spread,
        _per(length > 20, words) / many, _per(length == 1, words) / many, _per(having(_SYMBOL) > 0, words) / many,
        distinct / many, top / many, _per(same, words) / many,
        np.log1p(line_count), number / np.maximum(line_count, 1), distinct_lines / np.maximum(line_count, 1),
        _per(_UPPER[raw[start]], words) / many, _per((uppers > 1) & (having(_LOWER) == 0), words) / many,
    ]
    return np.column_stack(out)


class Boosted:
    """Binary classification by boosted trees, flat: node k of a tree has a feature, a threshold and children 2k + 1 and 2k + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0, least: float = 5.0) -> Boosted:
        n, wide = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(wide)]
        binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(wide)])  # bin b: value <= edges[b]
        flat = binned + np.arange(wide) * bins
        p = np.clip(y.mean(), 0.01, 0.99)
        base = float(np.log(p / (1 - p)))
        inner, leaves = 2**depth - 1, 2**depth
        feature, threshold, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        score = np.full(n, base)
        for t in range(trees):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(n, np.int64)
            for k in range(depth):
                width = 2**k
                key = ((node[:, None] * wide * bins) + flat).ravel()
                size = width * wide * bins
                gs = np.bincount(key, np.repeat(g, wide), size).reshape(width, wide, bins).cumsum(2)
                hs = np.bincount(key, np.repeat(h, wide), size).reshape(width, wide, bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least * 0.25) | (ht - hs < least * 0.25)] = 0
                for j in range(wide):
                    gain[:, j, len(edges[j]) :] = 0
                best = gain.reshape(width, -1).argmax(1)
                split_on, split_at = np.divmod(best, bins)
                real = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                for i in np.flatnonzero(real):
                    feature[t, width - 1 + i], threshold[t, width - 1 + i] = split_on[i], edges[split_on[i]][split_at[i]]
                right = real[node] & (binned[np.arange(n), split_on[node]] > split_at[node])
                node = node * 2 + right
            gl, hl = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            value[t] = -rate * gl / (hl + ridge)
            score += value[t][node]
        return cls(base, feature, threshold, value)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner if len(node) else False:  # all rows are on the same level
                node = node * 2 + 1 + (x[rows, self.feature[t][node]] > self.threshold[t][node])
            score += self.value[t][node - inner]
        return 1 / (1 + np.exp(-score))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAINING_ROWS) -> Boosted | None:
    """Trees fitted on at most ``most`` labelled rows that aren't held out, chosen by a hash of the key; None without such rows.

    A key that has several labels counts once, with the largest.
    """
    own = labels.where(~held_out(F.col(key)) & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("x_key")).agg(F.max(label).cast("double").alias("x_y"))
    own = own.withColumn("x_o", F.xxhash64(F.lit(9), "x_key"))
    chosen = hashed_sample(own, "x_o", most, labels.count()).orderBy(F.shiftrightunsigned("x_o", 33), "x_key").limit(most)
    rows = to_python(docs).select(F.col(key).alias("x_key"), F.col(text).alias("x_text")).join(F.broadcast(chosen), "x_key").select("x_y", "x_text")  # ``most`` bounds it

    def run(batches):
        shingler = Shingler()
        for batch in table_batches(batches, 4 << 20):
            x = statistics(*utf8_parts(batch.column(1)), shingler)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    found = rows.mapInArrow(released(run), "y double, x array<double>").toPandas()
    if not len(found):
        return None
    x, y = np.array(found["x"].tolist()), found["y"].to_numpy()
    order = np.lexsort([*x.T, y])  # any order of arrival gives the same trees
    return Boosted.fit(x[order], y[order])


def score(docs: DataFrame, model: Boosted | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row. Null counts as empty; without a model every score is 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trees, shingler = shared.value, Shingler()
        for batch in table_batches(batches, 4 << 20):
            x = statistics(*utf8_parts(batch.column(2)), shingler)
            p = trees.probability(x) if trees else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return to_python(docs).select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text)).mapInArrow(released(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels, score all documents."""
    return score(docs, train(docs, labels))
