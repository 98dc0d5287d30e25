"""Language identification by a byte convolutional network, trained in numpy.

The network reads windows of WINDOW bytes: filters of widths 2, 3 and 4 over one-hot bytes, the maximum of each filter
over the window, a rectifier and a softmax layer. A filter over one-hot bytes is a sum of table look-ups, so whole texts are scored by
adding rows of tables of byte pairs. All windows of a text count; their probabilities are averaged by length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emenda.llm.common import held_out, released, sample_bound, table_batches, to_python, utf8_parts

WINDOW = 256
FILTERS = 8
WIDTHS = (2, 3, 4)
#: The network is fitted on at most so many windows, one from each of so many documents, chosen by a hash of the key,
#: in equal numbers for each label.
TRAINING_WINDOWS = 6_000
#: Labels that are learnt at most.
LABELS = 512
EPOCHS = 8
NONE = "und"
LETTER = regex.compile(r"\p{L}")
ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def windows(raw: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, width) over each text, the last padded with spaces; the text that each belongs to; how many of its bytes are text."""
    sizes = np.diff(offsets)
    each = -(-sizes // width)
    text = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[text] + nth * width
    length = np.minimum(width, sizes[text] - nth * width)
    if not len(raw):
        return np.zeros((0, width), np.uint8), text, length
    at = start[:, None] + np.arange(width)
    out = raw[np.minimum(at, len(raw) - 1)]
    short = np.flatnonzero(length < width)
    if len(short):
        out[short] = np.where(np.arange(width) < length[short, None], out[short], 32)
    return out, text, length


class ByteNet:
    def __init__(self, labels: list[str], seed: int = 17):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.05) -> None:
        """Adagrad on the cross-entropy. x: windows; y: indexes of labels."""
        rng = np.random.default_rng(3)
        parts = [*self.tables, self.bias, self.out, self.out_bias]
        seen = [np.full_like(p, 1e-3) for p in parts]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                xb, n = x[own], len(own)
                peaks, tops = [], []
                for w, table in zip(WIDTHS, self.tables, strict=True):
                    span = x.shape[1] - w + 1
                    act = sum(table[k][xb[:, k : k + span]] for k in range(w))
                    peak = act.argmax(1)
                    peaks.append(peak)
                    tops.append(np.take_along_axis(act, peak[:, None], 1)[:, 0])
                top = np.concatenate(tops, 1) + self.bias
                hidden = np.maximum(top, 0)
                logits = hidden @ self.out + self.out_bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), y[own]] -= 1
                p /= n
                back = (p @ self.out.T) * (top > 0)
                grads = []
                for k, (w, table) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                    g = np.zeros_like(table)
                    own_back = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        bytes_at = np.take_along_axis(xb, peaks[k] + j, 1)
                        np.add.at(g[j], (bytes_at, np.arange(FILTERS)), own_back)
                    grads.append(g)
                grads += [back.sum(0), hidden.T @ p, p.sum(0)]
                for part, g, s in zip(parts, grads, seen, strict=True):
                    s += g * g
                    part -= rate * g / np.sqrt(s)

    def freeze(self) -> None:
        """Tables of byte pairs: one row has all that a pair adds to the filters that start at it."""
        a, b = np.divmod(np.arange(65536), 256)
        t2, t3, t4 = self.tables
        self.first = np.concatenate([t2[0][a] + t2[1][b], t3[0][a] + t3[1][b], t4[0][a] + t4[1][b]], 1)
        self.third, self.fourth = t3[2], t4[2][a] + t4[3][b]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, labels) for windows (n, WINDOW)."""
        if not hasattr(self, "first"):
            self.freeze()
        f, out = FILTERS, np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), 32):
            xb = x[at : at + 32].T  # positions first: the maximum is then over whole rows
            pair = (xb[:-1].astype(np.uint16) << np.uint16(8)) | xb[1:]
            act = self.first.take(pair, 0)
            two = act[:, :, :f].max(0)
            three = (act[:-1, :, f : 2 * f] + self.third.take(xb[2:], 0)).max(0)
            four = (act[:-2, :, 2 * f :] + self.fourth.take(pair[2:], 0)).max(0)
            hidden = np.maximum(np.concatenate([two, three, four], 1) + self.bias, 0)
            logits = hidden @ self.out + self.out_bias
            e = np.exp(logits - logits.max(1, keepdims=True))
            out[at : at + 32] = e / e.sum(1, keepdims=True)
        return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", most: int = TRAINING_WINDOWS) -> ByteNet | None:
    """A network for the labels of rows that aren't held out; None if there are none.

    The sample is bounded for each label, so that a rare language is learnt from as many rows on a large table as on a small one; at most
    LABELS labels, the most frequent ones, are learnt. Each document gives one stretch of text from a place given by a hash, so that
    beginnings don't weigh more.
    """
    usable = docs.where(~held_out(F.col(key)) & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = F.xxhash64(F.lit(5), F.col(key), F.length(text))
    start = F.pmod(F.xxhash64(F.lit(6), F.col(key)), F.greatest(F.length(text) - WINDOW + 1, F.lit(1))) + 1
    counts = docs.where(~held_out(F.col(key)) & F.col(label).isNotNull()).groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.orderBy(F.desc("n"), "y").limit(LABELS).collect()
    if not counts:
        return None
    each = most // len(counts)
    below = F.create_map(*[F.lit(x) for r in counts for x in (r["y"], sample_bound(each, r["n"]))])
    rows = usable.withColumn("x_o", F.shiftrightunsigned(order, 33)).where(F.col("x_o") < F.try_element_at(below, F.col(label)))
    rows = rows.select(F.col("x_o").alias("o"), F.col(label).alias("y"), F.col(text).substr(start.cast("int"), F.lit(WINDOW)).alias("x"))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("y").orderBy("o", "x"))).where(F.col("k") <= each).orderBy("o", "y", "x").collect()
    labels = sorted({r["y"] for r in rows})
    if not labels:
        return None
    net = ByteNet(labels)
    raw = [r["x"].encode()[:WINDOW].ljust(WINDOW) for r in rows]
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WINDOW)
    # the same stretches cut short and padded, as last windows are
    cut = 24 + (np.arange(len(x)) * 37) % (WINDOW - 24)
    short = np.where(np.arange(WINDOW) < cut[:, None], x, 32).astype(np.uint8)
    y = np.array([labels.index(r["y"]) for r in rows])
    net.fit(np.concatenate([x, short]), np.concatenate([y, y]))
    net.freeze()
    return net


def has_letters(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    hits = np.concatenate([[0], np.cumsum(ASCII_LETTERS[raw], dtype=np.int64)])
    letters = hits[offsets[1:]] > hits[offsets[:-1]]
    for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
        letters[i] = bool(LETTER.search(raw[offsets[i] : offsets[i + 1]].tobytes().decode()))
    return letters


def read_texts(model: ByteNet | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The label and its probability for each text of an Arrow column."""
    raw, offsets = utf8_parts(column)
    n = len(column)
    lang, score = np.full(n, NONE, object), np.zeros(n)
    if model is None or not len(raw):
        return lang, score
    letters = has_letters(raw, offsets)
    x, owner, length = windows(raw, offsets)
    p = model.probabilities(x) * length[:, None]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    total = np.zeros((n, len(model.labels)))
    total[owner[first]] = np.add.reduceat(p, first, axis=0) / np.add.reduceat(length, first)[:, None]
    best = total.argmax(1)
    lang[letters] = np.array(model.labels, object)[best[letters]]
    score[letters] = np.minimum(total[np.arange(n), best][letters], 1.0)
    return lang, score


def predict(docs: DataFrame, net: ByteNet | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    Null texts, texts without any letter, and all texts if nothing could be learnt, get ``und`` and score 0. Whole texts are read, in
    windows, whatever their length. Repeated rows and keys get a row each with the same values. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in table_batches(batches, 2 << 20):
            lang, score = read_texts(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return to_python(docs).select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text)).mapInArrow(released(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the table's own labelled rows, predict all of its rows."""
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The documents in which a language was found, all columns as they were; a null ``lang`` is filled with the one found.

    Only documents without any letter are rejected; without labels to learn from, a null ``lang`` stays null. Texts don't leave their rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, key, text, label))
    names = docs.columns
    at, put = names.index(text), names.index(label)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for batch in table_batches(batches, 2 << 20):
            lang, _ = read_texts(shared.value, batch.column(at))
            letters = has_letters(*utf8_parts(batch.column(at)))
            lang[lang == NONE] = None
            given = batch.column(put)
            filled = pc.coalesce(given, pa.array(lang, pa.string()).cast(given.type))
            columns = [filled if i == put else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(letters))

    return to_python(inner).mapInArrow(released(run), inner.schema).toDF(*names)
