"""Distances between words, word pieces and token differences: what needs a table or a search for each pair, in Arrow batches."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[0-9]+(?:[.,][0-9]+)*|[^\s]|\s+")


def osa(a: str, b: str, limit: int | None = None) -> int:
    """Optimal string alignment: insertions, deletions, replacements, and swaps of neighbours that nothing else touches. Beyond ``limit`` it stops with limit + 1."""
    if limit is not None and abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if limit is not None and min(row) > limit:
            return limit + 1
    return row[-1]


def damerau(a: str, b: str) -> int:
    """Damerau's distance: as ``osa``, but what was swapped may be edited again."""
    seen: dict[str, int] = {}
    far = len(a) + len(b)
    table = {(-1, -1): far}
    for i in range(len(a) + 1):
        table[i, -1], table[i, 0] = far, i
    for j in range(len(b) + 1):
        table[-1, j], table[0, j] = far, j
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), last
            if x == y:
                last = j
            table[i, j] = min(table[i - 1, j - 1] + (x != y), table[i, j - 1] + 1, table[i - 1, j] + 1, table[k - 1, m - 1] + i - k - 1 + 1 + j - m - 1)
        seen[x] = i
    return table[len(a), len(b)]


def distance(a: Column, b: Column, kind=damerau) -> Column:
    """A distance of two columns of words; null if one is null."""

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else kind(u, v) for u, v in zip(x, y, strict=True)], dtype="Int64")

    return run(a, b)


def pieces(word: str, vocabulary: frozenset[str]) -> list[str]:
    """The longest piece of the vocabulary from the left, again and again; pieces inside a word begin with ##. A word with a stretch that no piece covers is [UNK]."""
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            return ["[UNK]"]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def word_pieces(words: DataFrame, vocabulary: frozenset[str], column: str = "w") -> DataFrame:
    """``words`` with a column pieces. The vocabulary is a bounded table that every worker gets."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda w: None if w is None else pieces(w, shared.value))

    return words.withColumn("pieces", run(F.col(column)))


#: Beyond so many insertions and deletions the search's table would grow too large, and difflib takes over.
MOST_STEPS = 3000


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]] | None:
    """Places that a longest common subsequence pairs, by Myers' greedy search: cost grows with the differences, not with the square of the length. None beyond MOST_STEPS."""
    n, m = len(a), len(b)
    trace: list[list[int]] = []  # for each number of steps, how far each diagonal reaches
    row: list[int] = []
    for d in range(min(n + m, MOST_STEPS) + 1):
        before, row = row, []
        for k in range(-d, d + 1, 2):
            at = (k + d) // 2  # diagonal k + 1 has this place in the row before, k - 1 the one before it
            x = 0 if d == 0 else before[at] if at == 0 or (at < d and before[at - 1] < before[at]) else before[at - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            row.append(x)
            if k == n - m and x >= n:
                return _path(trace, n, m)
        trace.append(row)
    return None


def _path(trace: list[list[int]], x: int, y: int) -> list[tuple[int, int]]:
    """The pairs on the way to (x, y), which one step more than ``trace`` has reaches."""
    pairs = []
    for d in range(len(trace), 0, -1):
        before, at = trace[d - 1], (x - y + d) // 2
        down = at == 0 or (at < d and before[at - 1] < before[at])
        begin = before[at] if down else before[at - 1] + 1
        while x > begin:
            x, y = x - 1, y - 1
            pairs.append((x, y))
        x, y = (x, y - 1) if down else (x - 1, y)
    while x > 0:
        x, y = x - 1, y - 1
        pairs.append((x, y))
    return pairs[::-1]


def token_edits(source: str, output: str) -> list[tuple[int, int, str]]:
    """The fewest whole-token edits (start, end, replacement), in code points, that make ``output`` of ``source``."""
    a, b = TOKEN.findall(source), TOKEN.findall(output)
    place, places = 0, [0]
    for t in a:
        place += len(t)
        places.append(place)
    pairs = matched(a, b)
    if pairs is None:
        pairs = [(i + x, j + x) for i, j, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for x in range(n)]
    found, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        if x > i or y > j:
            found.append((places[i], places[x], "".join(b[j:y])))
        i, j = x + 1, y + 1
    return found


def differences(rows: DataFrame, key: str = "doc_id", source: str = "text", output: str = "output") -> DataFrame:
    """key, text, edits (array of s, e, replacement) between two columns of texts; null counts as empty."""
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(frames):
        for frame in frames:
            edits = [[{"s": s, "e": e, "replacement": r} for s, e, r in token_edits(a, b)] for a, b in zip(frame["text"], frame["output"], strict=True)]
            yield pd.DataFrame({key: frame[key], "text": frame["text"], "edits": edits})

    plain = rows.select(key, F.coalesce(F.col(source), F.lit("")).alias("text"), F.coalesce(F.col(output), F.lit("")).alias("output"))
    return plain.mapInPandas(run, f"{key} {kind}, text string, edits array<struct<s:bigint,e:bigint,replacement:string>>")
