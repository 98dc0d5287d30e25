"""The corrector of one text in Python, compiled from the detectors' SQL and the patterns of protected spans: what ``resolve.corrected`` gives.

A token only meets the detectors of its own word or shape, as one function, and a text goes through all of its passes at once.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_left
from itertools import accumulate, compress, repeat
from operator import add, contains, eq

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from emenda.functions import text as T
from emenda.operators import detect as D
from emenda.operators import resolve as R

#: Code points as Java's patterns and Spark's lower() know them: ranges of letters by category, and (letter, small letter) where Python's lower() differs.
Alphabet = tuple[tuple[tuple[str, tuple[tuple[int, int], ...]], ...], tuple[tuple[str, str], ...]]


_ALPHABETS: dict[str, Alphabet] = {}


def alphabet(spark: SparkSession) -> Alphabet:
    """The alphabet of the running JVM, which is asked once an application."""
    at = spark.sparkContext.applicationId
    if at not in _ALPHABETS:
        _ALPHABETS[at] = _alphabet(spark)
    return _ALPHABETS[at]


def _alphabet(spark: SparkSession) -> Alphabet:
    # the planes after the third have no letters
    every = "".join(chr(c) for c in range(0x40000) if not 0xD800 <= c <= 0xDFFF)
    java, there = spark._jvm.java.util.regex.Pattern, spark._jvm.java.lang.StringBuilder(every)
    kinds = []
    for kind in ("L", "Lu", "Ll"):
        ranges: list[list[int]] = []
        for c in map(ord, java.compile(rf"\P{{{kind}}}+").matcher(there).replaceAll("")):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        kinds.append((kind, tuple(map(tuple, ranges))))
    # a letter has a small one in Spark only if it has one in Python or Python doesn't know it
    cased = "".join(c for c in every[:0x20000] if c not in T.SMALL[0] and (c.lower() != c or unicodedata.category(c) == "Cn"))
    small = spark.range(1).select(F.lower(F.lit(cased))).first()[0]
    return tuple(kinds), tuple((a, b) for a, b in zip(cased, small, strict=True) if a.lower() != b)


_PATTERN = re.compile(r"\[\^\\P\{(?P<less>\w+)\}(?P<rest>[^\]]*)\]|\\p\{(?P<kind>\w+)\}|\\x\{(?P<point>[0-9A-F]+)\}|(?P<end>\\z)|\\.|(?P<ascii>\(\?i:)|(?P<line>\(\?m\)\^)|(?P<class>[\[\]])|.", re.S)


def ported(pattern: str, ranges: dict[str, tuple], most: int = 0x10FFFF) -> str:
    """A pattern in Java's syntax as Python's; of the letters only those up to ``most``."""
    classes = {k: "".join(rf"\U{a:08x}-\U{min(b, most):08x}" for a, b in r if a <= most) for k, r in ranges.items()}
    out, inside = [], False
    for m in _PATTERN.finditer(pattern):
        if m["less"]:  # letters of a kind but for some
            out.append(f"(?:(?![{m['rest']}])[{classes[m['less']]}])")
        elif m["kind"]:
            out.append(classes[m["kind"]] if inside else f"[{classes[m['kind']]}]")
        elif m["point"]:
            out.append(rf"\U{int(m['point'], 16):08x}")
        elif m["end"]:
            out.append(r"\Z")
        elif m["ascii"]:  # Java folds the case of ASCII letters only
            out.append("(?ai:")
        elif m["line"]:  # Java begins a line after each of these
            out.append(r"(?:^|(?<=[\n\r\x85\u2028\u2029]))")
        else:
            inside = (m["class"] == "[") if m["class"] and (m["class"] == "]" or not inside) else inside
            out.append(m[0])
    return "".join(out)


#: Kinds of protected spans that may hold white space. No match of the others does, so theirs are those of each run of visible characters.
WIDE = ("fence", "code", "shell", "quote", "signature")
#: Fields of a token as expressions over a text's arrays and the token's place j; there are three empty tokens before the first and after the last.
_FIELDS = {
    "i": "(j - 3)", "tok": "tok[j]", "norm": "low[j]", "gap": "gap[j]", "gapn": "gap[j + 1]", "s0": "(end[j] - len(tok[j]))", "e0": "end[j]", "sent": "sent(j)", "psent": "0", "para": "para(j)", "ppara": "0",
    "prev": "tok[j - 1]", "prev_n": "low[j - 1]", "prev2_n": "low[j - 2]", "prev3_n": "low[j - 3]", "next": "tok[j + 1]", "next_n": "low[j + 1]", "next2_n": "low[j + 2]",
}
_LEXEME = re.compile(r"\s*('(?:[^']|'')*'|<>|>=|<=|[=<>+\-(),]|\d+|\w+)")


class Sql:
    """One SQL expression of a detector as Python source; patterns become calls of functions that are put into ``scope``."""

    def __init__(self, sql: str, pattern):
        self.left = _LEXEME.findall(sql)[::-1]
        assert re.sub(r"\s", "", "".join(self.left[::-1])) == re.sub(r"\s", "", sql), sql
        self.pattern = pattern
        self.source = self.either()
        assert not self.left, sql

    def took(self, *words: str) -> bool:
        if self.left[-len(words) :][::-1] == list(words):
            del self.left[-len(words) :]
            return True
        return False

    def need(self, word: str) -> None:
        assert self.took(word), (word, self.left[::-1])

    def either(self) -> str:
        parts = [self.both()]
        while self.took("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else "(" + " or ".join(parts) + ")"

    def both(self) -> str:
        parts = [self.negated()]
        while self.took("AND"):
            parts.append(self.negated())
        # nothing here can fail, so the cheap ones come first
        parts.sort(key=lambda p: 2 if "sent(" in p or "para(" in p else "rx" in p)
        return parts[0] if len(parts) == 1 else "(" + " and ".join(parts) + ")"

    def negated(self) -> str:
        return f"(not {self.negated()})" if self.took("NOT") else self.compared()

    def compared(self) -> str:
        a = self.sum()
        for word, python in (("=", "=="), ("<>", "!="), (">=", ">="), ("<=", "<="), (">", ">"), ("<", "<")):
            if self.took(word):
                return f"({a} {python} {self.sum()})"
        for words, python in ((("IN",), "in"), (("NOT", "IN"), "not in")):
            if self.took(*words, "("):
                return f"({a} {python} {{{', '.join(self.arguments())}}})"
        return a

    def sum(self) -> str:
        out = self.value()
        while self.left and self.left[-1] in "+-":
            out = f"({out} {self.left.pop()} {self.value()})"
        return out

    def arguments(self) -> list[str]:
        out = [self.either()]
        while self.took(","):
            out.append(self.either())
        self.need(")")
        return out

    def value(self) -> str:
        word = self.left.pop()
        if word == "(":
            return self.arguments()[0]
        if word.startswith("'"):
            return repr(word[1:-1].replace("''", "'"))
        if word.isdigit():
            return word
        if word == "CASE":
            return self.case()
        if word == "isw":
            return self.pattern(r"^\p{L}") + "(tok[j])"
        if not self.took("("):
            return _FIELDS[word]
        if word == "rx":
            of = self.either()
            self.need(",")
            pattern = self.left.pop()[1:-1].replace("''", "'")
            self.need(")")
            return f"{self.pattern(pattern)}({of})"
        a = self.arguments()
        if word == "concat":
            return "(" + " + ".join(a) + ")"
        if word == "substr":
            return f"{a[0]}[{a[1]} - 1:" + (f"{a[1]} - 1 + {a[2]}]" if len(a) > 2 else "]")
        if word == "instr":
            return f"({a[0]}.find({a[1]}) + 1)"
        return {"length": "len", "upper": "upper", "lower": "lower"}[word] + f"({a[0]})"

    def case(self) -> str:
        of = None if self.left[-1] == "WHEN" else self.either()
        out = []
        while self.took("WHEN"):
            when = self.either()
            self.need("THEN")
            out.append(f"{self.either()} if {when if of is None else f'{of} == {when}'} else ")
        out.append(self.either() if self.took("ELSE") else "None")
        self.need("END")
        return "(" + "".join(out) + ")"


class Words(dict):
    """A token's small form; ``hot`` has, by token, its detectors and those of the token after it, where there are any."""

    MOST = 200_000

    def __init__(self, corrector: Corrector):
        super().__init__()
        self.of, self.hot, self.words = corrector, {}, frozenset(D.WORDS)

    def __missing__(self, tok: str) -> str:
        low = self[tok] = self.of.small(tok)
        if tok in _MARKS or low in self.words or "'s" in low or low.endswith("ly") or (len(tok) == 4 and tok[0] in "12"):
            shapes = {"mark": tok in {",", ";", ":", "!", "?"}, "colon": tok == ":", "bracket": tok in {"(", ")"}, "possessive": "'s" in low, "adverb": low.endswith("ly"), "year": len(tok) == 4 and tok[0] in "12"}
            own = self.of.on(lambda d: shapes.get(d.on) if isinstance(d.on, str) else low in d.on)
            after = {"after_mark": tok in {",", ";", ":", ".", "!", "?"}, "starts": tok in {".", "!", "?"}, "bracket": tok == "("}
            then = self.of.on(lambda d: isinstance(d.on, str) and after.get(d.on))
            if own or then:
                self.hot[tok] = own, then
        return low

    def bounded(self) -> None:
        if len(self) > self.MOST:
            self.clear()
            self.hot.clear()


class Protected:
    """The protected spans of a text, looked for only where they are asked for."""

    def __init__(self, text: str, wide: list, compact: list):
        self.text, self.compact = text, compact
        self.all, self.here, self.a, self.b = merged(found(text, wide)), ([], []), 0, 0

    def touches(self, s: int, e: int) -> bool:
        """Whether an edit touches a span; an insertion is touched if it stands inside."""
        a, b, text = s, max(e, s + 1), self.text
        if not (self.a <= a and b <= self.b):
            while a and text[a - 1] > " ":
                a -= 1
            b = _VISIBLE.match(text, b).end()
            self.a, self.b, self.here = a, b, merged(found(text[a:b], self.compact), a)
        return any(near(spans, s, e) for spans in (self.all, self.here))


_MARKS = frozenset(",;:.!?()")
_VISIBLE = re.compile(r"[^\x00-\x20]*")


def found(text: str, kinds: list) -> list[tuple[int, int]]:
    spans = []
    for needs, whole, guarded in kinds:
        if needs and not any(x in text for x in needs):
            continue
        if guarded is None:
            spans += [m.span() for m in whole.finditer(text)]
            continue
        # a leftmost match of a run and more begins with the run, or where the match before ended
        at = 0
        while m := whole.match(text, at) or guarded.search(text, at):
            spans.append(m.span())
            at = m.end()
    return spans


def merged(spans: list[tuple[int, int]], by: int = 0) -> tuple[list[int], list[int]]:
    """Starts and ends of overlapping spans as one."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s + by < ends[-1]:
            ends[-1] = max(ends[-1], e + by)
        else:
            starts.append(s + by)
            ends.append(e + by)
    return starts, ends


def near(spans: tuple[list[int], list[int]], s: int, e: int) -> bool:
    k = bisect_left(spans[0], max(e, s + 1)) - 1  # the span that begins last before the edit's end
    return k >= 0 and s < spans[1][k] and (s == e or e > spans[0][k])


class Corrector:
    def __init__(self, of: Alphabet):
        kinds, odd = of
        self.ranges, self.odd = dict(kinds), str.maketrans(dict(odd))
        self.bare = str.maketrans(*T.SMALL)
        self.scope: dict = {"upper": self.upper, "lower": self.lower}
        self.names: dict[str, str] = {}
        self.made: dict[tuple, object] = {}
        self.source = [tuple(Sql(x, self.pattern).source for x in (d.when, d.start, d.end, d.replacement)) for d in D.DETECTORS]
        # most texts are ASCII or have no letter beyond the basic plane: shorter classes are faster
        self.token = {most: re.compile(ported(T.TOKEN_SQL, self.ranges, most)) for most in (0x7F, 0xFFFF, 0x10FFFF)}
        self.far = re.compile("[\U00010000-\U0010ffff]")
        self.open, self.tail = (re.compile(ported(p, self.ranges)).search for p in (T.OPEN, r"\p{L}+\z"))
        self.wide, self.compact = [], []
        for kind, (needs, pattern) in R.KINDS.items():
            whole = ported(pattern, self.ranges)
            run = re.match(r"(\[[^\]]+\])\+", whole)
            (self.wide if kind in WIDE else self.compact).append((needs, re.compile(whole), re.compile(f"(?<!{run[1]}){whole}") if run else None))
        self.first, self.twice, self.lines = (self.on(lambda d, s=s: d.on == s) for s in ("starts", "double", "line_end"))
        self.words = Words(self)

    # the parts of detectors ---------------------------------------------------------------------------------------------------
    def pattern(self, pattern: str) -> str:
        """The name of a function that finds a pattern anywhere."""
        if pattern not in self.names:
            self.names[pattern] = f"rx{len(self.names)}"
            self.scope[self.names[pattern]] = re.compile(ported(pattern, self.ranges)).search
        return self.names[pattern]

    def on(self, wanted):
        """A function for the detectors that are wanted, or None; it adds edits as (start, is a capitalization, -confidence, end, rule, replacement), which sort as ``resolve.in_order``."""
        which = tuple(k for k, d in enumerate(D.DETECTORS) if wanted(d))
        if which and which not in self.made:
            lines = ["def found(tok, low, gap, end, sent, para, j, out):"]
            for k in which:
                d, (when, start, stop, replacement) = D.DETECTORS[k], self.source[k]
                lines.append(f" if {when}: out.append(({start}, {d.category == 'Capitalization'}, {-d.confidence}, {stop}, {d.rule_id!r}, {replacement}))")
            exec("\n".join(lines), self.scope)  # noqa: S102
            self.made[which] = self.scope["found"]
        return self.made.get(which)

    def lower(self, word: str) -> str:
        return word.translate(self.bare).translate(self.odd).lower()

    def upper(self, word: str) -> str:
        return "".join(T.CAPITALS.get(c) or c.upper() for c in word)

    def small(self, tok: str) -> str:
        return (tok.lower() if tok.isascii() else self.lower(tok)).replace("’", "'")

    # a text -------------------------------------------------------------------------------------------------------------------
    def tokens(self, text: str) -> re.Pattern:
        """The pattern of the text's tokens."""
        return self.token[0x7F if text.isascii() else 0x10FFFF if self.far.search(text) else 0xFFFF]

    def candidates(self, text: str) -> list[tuple]:
        token = self.tokens(text)
        toks, gaps = token.findall(text), token.split(text)
        if not toks:
            return []
        self.words.bounded()
        pad, n, hot = ["", "", ""], len(toks), self.words.hot
        tok, low, gap = [*pad, *toks, *pad], [*pad, *map(self.words.__getitem__, toks), *pad], [*pad, *gaps, *pad]
        end = [0, 0, 0, *accumulate(map(add, map(len, gaps), map(len, toks))), *[len(text)] * 3]

        def sent(j: int) -> int:
            """Whether a sentence begins at a token: detectors only compare ordinals with those of the token before."""
            before = tok[j - 1]
            if j == 3 or before == "!" or before == "?" or "\n" in gap[j]:
                return 1
            return 1 if before == "." and self.closes(tok, gap, j - 1) else 0

        def para(j: int) -> int:
            return max(gap[j].count("\n"), j == 3)

        out: list[tuple] = []
        for j in compress(range(3, n + 3), map(hot.get, toks)):
            own, then = hot[tok[j]]
            if own:
                own(tok, low, gap, end, sent, para, j, out)
            if then and j < n + 2:
                then(tok, low, gap, end, sent, para, j + 1, out)
        for j in compress(range(4, n + 3), map(eq, low[4 : n + 3], low[3:])):
            self.twice(tok, low, gap, end, sent, para, j, out)
        self.first(tok, low, gap, end, sent, para, 3, out)
        for j in compress(range(len(gap)), map(contains, gap, repeat("\n"))):
            if j > 3:
                self.lines(tok, low, gap, end, sent, para, j - 1, out)
            if 3 < j < n + 3:
                self.first(tok, low, gap, end, sent, para, j, out)
        return sorted(set(out))

    def closes(self, tok: list[str], gap: list[str], j: int) -> bool:
        """Whether a full stop ends its sentence, as ``text.ends_sentence``."""
        word = self.tail(tok[j - 1]) if gap[j] == "" else None
        word = word[0] if word else ""
        dotted = "&" if len(word) == 1 and gap[j - 1] == "" and tok[j - 2] == "." else ""
        return self.open(f"{dotted}{word}.{gap[j + 1]}{tok[j + 1]}") is None

    def accepted(self, text: str, more: list[tuple] = [], most: int | None = R.MOST_EDITS) -> list[tuple]:  # noqa: B006
        """Accepted edits as ``on`` has them, ``most`` at most or all; ``more`` are candidates from elsewhere."""
        found = self.candidates(text)
        if more:
            found = sorted({*found, *more})
        if not found:
            return []
        protected = Protected(text, self.wide, self.compact)
        made, last, end = [], -1, 0
        for edit in found:
            s, e = edit[0], edit[3]
            if s == last or s < end or protected.touches(s, e):
                continue
            made.append(edit)
            last, end = s, max(end, e)
            if len(made) == most:
                break
        return made

    def corrected(self, text: str) -> tuple[list[tuple[int, int, str]], str]:
        """Accepted edits (start, end, replacement), and the text with them."""
        made = [(s, e, replacement) for s, _, _, e, _, replacement in self.accepted(text)]
        pieces, at = [], 0
        for s, e, replacement in made:
            pieces += [text[at:s], replacement]
            at = e
        return made, "".join([*pieces, text[at:]])

    def fixed(self, text: str, passes: int) -> tuple[str, int, int, bool]:
        """The text after so many passes at most, those that changed it, the edits of all, and whether nothing more changes."""
        edits = 0
        for k in range(passes):
            made, out = self.corrected(text)
            edits += len(made)
            if out == text:
                return out, k, edits, True
            text = out
        return text, passes, edits, False


corrector = functools.lru_cache(2)(Corrector)
