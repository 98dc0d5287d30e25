"""Wording by tone mode, and checks that a rewording keeps the meaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _Z = r"(^|[^\p{L}’'])", r"([^\p{L}’']|$)"
_ANY, _SHORT, _KIND = ("professional", "friendly", "concise", "direct"), ("concise", "direct"), ("professional", "friendly")


def _said(modes, words: str, put: str) -> tuple:
    """Whole words, in any case, said otherwise."""
    return modes, f"{_A}(?i:{words}){_Z}", f"$1{put}$2"


def _opened(modes, words: str, put: str) -> tuple:
    """An opener of a message or sentence."""
    return modes, rf"(^|[.!?][\x20\n]+)(?i:{words}) ", f"$1{put}"


_FORMAL = ("professional",)
#: Wording rules, applied in turn: modes, pattern (of the common subset), replacement. Written for this library.
WORDING = (
    # a sentence that only insults goes where another one follows
    (_KIND, r"(^|[.!?][\x20\n]+)(?i:you (?:are|'re|’re) (?:an? )?(?:idiot|moron|fool|loser))[.!]+\x20+", "$1"),
    *(_said(_FORMAL, a, b) for a, b in (
        ("gonna", "going to"), ("wanna", "want to"), ("gotta", "have to"), ("asap", "as soon as possible"), ("thx|thanks a lot|tysm", "thank you"), ("lmk", "let me know"), ("fyi", "for your information"),
        ("btw", "by the way"), ("idk", "I do not know"), ("tbh", "to be honest"), ("pls|plz", "please"), ("u", "you"), ("ur", "your"), ("yeah|yep", "yes"), ("nope", "no"), ("kids", "children"), ("a bunch of", "several"),
        ("can['’]t", "cannot"), ("won['’]t", "will not"), ("don['’]t", "do not"), ("doesn['’]t", "does not"), ("isn['’]t", "is not"), ("aren['’]t", "are not"), ("we['’]ve", "we have"), ("we['’]ll", "we will"),
        ("they['’]re", "they are"), ("you['’]re", "you are"), ("it['’]s", "it is"), ("i['’]m", "I am"), ("i['’]ve", "I have"), ("i['’]ll", "I will"),
    )),
    _said(("professional", "direct"), "kinda|sort of|kind of", "somewhat"),
    *(_said(_SHORT, a, b) for a, b in (
        ("in order to", "to"), ("due to the fact that|owing to the fact that", "because"), ("in spite of the fact that", "although"), ("in the event that", "if"), ("for the purpose of", "for"), ("prior to", "before"),
        ("subsequent to", "after"), ("with regard to|with respect to", "about"), ("a large number of", "many"), ("on a daily basis", "daily"), ("has the ability to", "can"), ("at a later date", "later"),
        ("at this point in time|at the present time|at this time", "now"), ("utilize", "use"), ("utilized", "used"), ("each and every", "every"), ("whether or not", "whether"),
    )),
    # padded openers and hedges
    *(_opened(_SHORT, a, "") for a in ("i hope this finds you well[.,]", "i hope you are (?:doing )?well[.,]", "just a quick note to say that", "please note that", "needless to say,", "as you (?:may )?know,")),
    *(_opened(("direct",), a, "Please ") for a in ("i just wanted to ask (?:if|whether) you could", "i was wondering (?:if|whether) you could", "would you mind if you could", "if you get a chance, could you", "can you please")),
    _said(("direct",), "i think that maybe|i feel like maybe|perhaps maybe", "perhaps"),
    *(_said(("friendly",), a, b) for a, b in (("regarding", "about"), ("require", "need"), ("purchase", "buy"), ("commence", "start"), ("i am", "I'm"), ("you are", "you're"), ("thank you very much", "thanks so much"))),
    # insults: said without the insult, or the word alone replaced
    *(_said(_KIND, a, b) for a, b in (("idiotic|stupid|moronic", "unhelpful"), ("garbage|crap", "poor work"), ("shut up", "please stop"), ("what is wrong with you", "what happened"))),
    # formatting: a final mark, and a capital after one
    (_FORMAL, r"([\p{L}\p{N}])\s*\z", "$1."),
)
NEGATION = r"(?i)(?:^|[^\p{L}])(?:not|no|never|none|nobody|nothing|cannot|\p{L}+n['’]t)(?:[^\p{L}]|$)"
FACTS = (r"[0-9]+(?:[.,:/-][0-9]+)*", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"(?:https?://|www\.)[^\x09-\x0D\x20<>]+", r"[@#][A-Za-z0-9_]+")
WORDS = {"fix": 1.25, "professional": 1.6, "friendly": 1.6, "concise": 1.1, "direct": 1.2}
#: A greeting's first line and a sign-off's last ones frame a letter and stay as they are.
FRAME = r"^((?:Dear|Hi|Hello|Hey)[\x20,][^\n]*\n+)?((?s:.*?))((?:\n+(?:Best|Regards|Kind regards|Best regards|Sincerely|Thanks|Cheers),?(?:\n[^\n]*)?\s*)?)\z"


def worded(text: Column, mode: Column) -> Column:
    """The text in the words of its mode; a letter's greeting and sign-off stay."""
    head, body, tail = (F.regexp_extract(text, FRAME, k) for k in (1, 2, 3))
    for modes, pattern, replacement in WORDING:
        # the text must stand once in each step: else the expression doubles with every rule
        body = F.regexp_replace(body, F.when(mode.isin(*modes), F.lit(pattern)).otherwise(F.lit("(?!)")), F.lit(replacement))
    return F.concat(head, body, tail)


def worded_sql(source: str, text: str = "text", mode: str = "mode") -> str:
    """The same in DuckDB: ``source`` (a table) with a column worded."""
    part = lambda k: f"regexp_extract({text}, '{FRAME}', {k})"
    step = f"(SELECT *, {part(2)} AS worded FROM {source})"
    for k, (modes, pattern, replacement) in enumerate(WORDING):
        quoted = [x.replace("'", "''") for x in (pattern, re.sub(r"\$(\d)", r"\\\1", replacement))]
        step = f"(SELECT * REPLACE (CASE WHEN {mode} IN ({', '.join(repr(m) for m in modes)}) THEN regexp_replace(worded, '{quoted[0]}', '{quoted[1]}', 'g') ELSE worded END AS worded) FROM {step} w{k})"
    return f"(SELECT * REPLACE ({part(1)} || worded || {part(3)} AS worded) FROM {step} f)"


def lost_sql(a: str = "text", b: str = "worded", mode: str = "mode") -> str:
    """meaning_lost in DuckDB."""
    found = lambda x, p: f"regexp_extract_all({x}, '{p.replace(chr(39), chr(39) * 2)}')"
    every = lambda x: "list_sort(flatten([" + ", ".join(found(x, p) for p in FACTS) + "]))"
    words = lambda x: f"len(regexp_extract_all({x}, '\\p{{L}}+'))"
    budget = "CASE " + mode + " " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in WORDS.items()) + " ELSE 1.25 END"
    return (
        f"CASE WHEN {every(a)} <> {every(b)} THEN 'facts' WHEN len({found(a, NEGATION)}) <> len({found(b, NEGATION)}) THEN 'negation' WHEN contains({a}, '?') AND NOT contains({b}, '?') THEN 'question'"
        f" WHEN {words(b)} > ({budget}) * {words(a)} + 3 THEN 'length' WHEN {words(a)} > 0 AND {words(b)} = 0 THEN 'empty' END"
    )


def facts(text: Column) -> Column:
    """Numbers, addresses, links and handles, sorted."""
    return F.array_sort(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in FACTS]))


def meaning_lost(source: Column, output: Column, mode: Column | None = None) -> Column:
    """Null, or the first reason why a rewording may have changed the meaning."""
    mode = mode if mode is not None else F.lit("professional")
    words = lambda t: F.size(F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0)))
    budget = F.element_at(F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv]), mode)
    count = lambda t, p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    return F.coalesce(
        F.when(facts(source) != facts(output), F.lit("facts")),
        F.when(count(source, NEGATION) != count(output, NEGATION), F.lit("negation")),
        F.when(source.contains("?") & ~output.contains("?"), F.lit("question")),
        F.when(words(output) > F.coalesce(budget, F.lit(1.25)) * words(source) + 3, F.lit("length")),
        F.when((words(source) > 0) & (words(output) == 0), F.lit("empty")),
    )


def keeps_meaning(source: Column, output: Column, mode: Column | None = None) -> Column:
    return meaning_lost(source, output, mode).isNull()
