"""Detectors of candidate edits. Each is a condition and three expressions over a token and its neighbours, in SQL that both engines read.

A corpus job evaluates all detectors in one pass inside each row (``edit_arrays``), so no token ever leaves its document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emenda.functions import text as T
from emenda.operators.grammar import BLANK, BLANK_AFTER, GRAMMAR, INSIDE, STARTS, mapped, same_case

#: Word lists of the rules.
CALENDAR = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "april", "june", "july", "september", "october", "november", "december")
MEANT_TWICE = (
    "had", "do", "very", "so", "really", "no", "yes", "yeah", "ha", "haha", "bye", "well", "blah", "bla", "knock", "night", "hush", "chop", "tsk", "ok", "okay", "oh", "ah", "uh", "um", "la",
    "there", "now", "go", "more", "many", "far", "again", "too", "much", "ho", "hey", "hi", "wow", "boo", "tick", "tock", "choo", "yum", "mm", "hmm", "pretty",
    "sure", "thanks", "thank", "please", "cool", "nice", "wait", "come", "stop", "fine",
)
AFTER_THAT = ("i", "you", "he", "she", "we", "they", "there", "the", "a", "an", "my", "your", "his", "our", "their", "its", "some", "many", "most", "these", "those", "if", "when", "once")
FUNCTION_WORDS = ("the", "a", "an", "and", "of", "in", "on", "to", "for", "with", "at", "by", "from")
CHAT = ("lol", "fyi", "lmk", "btw", "idk", "omg", "brb", "tbh", "imo", "asap")
CONTRACTIONS = {
    "dont": "don't", "cant": "can't", "wont": "won't", "isnt": "isn't", "didnt": "didn't", "doesnt": "doesn't", "wasnt": "wasn't", "arent": "aren't", "werent": "weren't", "couldnt": "couldn't",
    "shouldnt": "shouldn't", "wouldnt": "wouldn't", "hasnt": "hasn't", "havent": "haven't", "hadnt": "hadn't", "youre": "you're", "theyre": "they're", "ive": "I've", "im": "I'm", "thats": "that's", "whats": "what's",
}
PROPER = {"english": "English", "french": "French", "german": "German", "spanish": "Spanish", "london": "London", "paris": "Paris", "europe": "Europe", "africa": "Africa", "asia": "Asia", "america": "America", "india": "India", "christmas": "Christmas"}
MISSPELLINGS = {
    "teh": "the", "adn": "and", "recieve": "receive", "seperate": "separate", "definately": "definitely", "occured": "occurred", "untill": "until", "wich": "which", "thier": "their", "becuase": "because",
    "tommorow": "tomorrow", "accomodate": "accommodate", "acheive": "achieve", "beleive": "believe", "goverment": "government", "enviroment": "environment", "neccessary": "necessary", "publically": "publicly", "succesful": "successful", "suprise": "surprise",
}
SEASONS = ("Summer", "Winter", "Autumn", "Spring")


@dataclass(frozen=True)
class Detector:
    rule_id: str
    category: str
    confidence: float
    explanation: str
    #: What the token must be at least: one of these words, or a shape. The condition implies it.
    on: tuple[str, ...] | str
    when: str
    start: str
    end: str
    replacement: str


def _beside(z, i, by: int, name: str = "tok") -> Column:
    return F.coalesce(F.get(z[name], i + by), F.lit(""))


#: Cheap tests on a text's arrays (tok, low, gap) and a place in them.
SHAPES = {
    "starts": lambda z, i: (i == 0) | _beside(z, i, 0, "gap").contains("\n") | _beside(z, i, -1).isin(".", "!", "?"),
    "double": lambda z, i: F.get(z["low"], i) == _beside(z, i, -1, "low"),
    "mark": lambda z, i: F.get(z["tok"], i).isin(",", ";", ":", "!", "?"),
    "colon": lambda z, i: F.get(z["tok"], i) == ":",
    "after_mark": lambda z, i: _beside(z, i, -1).isin(",", ";", ":", ".", "!", "?"),
    "bracket": lambda z, i: F.get(z["tok"], i).isin("(", ")") | (_beside(z, i, -1) == "("),
    "possessive": lambda z, i: F.get(z["low"], i).contains("'s"),
    "adverb": lambda z, i: (_beside(z, i, 1) == "-") & F.get(z["low"], i).endswith("ly"),
    "year": lambda z, i: (F.length(F.get(z["tok"], i)) == 4) & (F.get(z["tok"], i).startswith("1") | F.get(z["tok"], i).startswith("2")),
    "line_end": lambda z, i: _beside(z, i, 1, "gap").startswith("\n"),
}

ENUMERATOR = r"(gapn = '' AND next = ')' AND (length(tok) = 1 OR rx(tok, '^[ivxlc]{1,4}\z')))"
PROPER_CASE = mapped(PROPER)
#: A word twice in one line of a sentence is a slip, unless the writer can have meant both.
_DOUBLE = f"norm = prev_n AND isw AND {INSIDE} AND para = ppara AND {BLANK}"
MEANT = {
    "emphasis": f"norm IN ({T.quoted(MEANT_TWICE)})",
    # "what it is is", "all that is is"
    "cleft": rf"norm = 'is' AND rx(concat(prev3_n, ' ', prev2_n), '^(what|all|way|how|who|where|whatever) (it|that|this)\z')",
    # "that that word": the second one points, unless a clause or nothing follows
    "pointing": rf"norm = 'that' AND NOT rx(next_n, '^([.!?]?|{'|'.join(AFTER_THAT)})\z')",
    "name": r"i >= 2 AND rx(prev, '^\p{Lu}') AND rx(tok, '^\p{Lu}')",
    "initials": "length(tok) = 1 AND (tok <> prev OR (gapn = '' AND next = '-'))",
    "figure": r"gapn = '' AND rx(next, '^[0-9$€£¥#/_]')",
}
_SLIP = f"{_DOUBLE} AND NOT (" + " OR ".join(f"({m})" for m in MEANT.values()) + ")"
_RAISED = r"(rx(tok, '^\p{Lu}') AND NOT rx(prev, '^\p{Lu}'))"
_ACRONYM = r"rx(tok, '^\p{Lu}{2,}\z')"

DETECTORS = (
    Detector("grammar.personal_pronoun", "Capitalization", 0.99, "Capitalize the first-person pronoun.", ("i", "i'm", "i've", "i'll", "i'd"), rf"(tok = 'i' OR (norm IN ('i''m', 'i''ve', 'i''ll', 'i''d') AND rx(tok, '^i[^\p{{Lu}}]+\z'))) AND NOT (gapn = '' AND next = '.' AND rx(next2_n, '^\p{{L}}')) AND NOT {ENUMERATOR}", "s0", "s0 + 1", "'I'"),
    Detector("grammar.sentence_capitalization", "Capitalization", 0.97, "Start the sentence with a capital letter.", "starts", rf"{STARTS} AND rx(tok, '^\p{{Ll}}') AND (length(tok) > 1 OR norm = 'a') AND norm NOT IN ({T.quoted(CHAT)}) AND NOT {ENUMERATOR} AND NOT (norm IN ('i''m', 'i''ve', 'i''ll', 'i''d')) AND NOT (gapn = '' AND rx(next, '^[(_=/]'))", "s0", "CASE WHEN tok = 'ok' THEN e0 ELSE s0 + 1 END", "CASE WHEN tok = 'ok' THEN 'OK' ELSE upper(substr(tok, 1, 1)) END"),
    Detector("grammar.calendar_capitalization", "Capitalization", 0.95, "Days and months take a capital letter.", CALENDAR, f"tok IN ({T.quoted(CALENDAR)}) AND {INSIDE}", "s0", "e0", "concat(upper(substr(tok, 1, 1)), substr(tok, 2))"),
    Detector("grammar.proper_noun_capitalization", "Capitalization", 0.94, "Names of places and languages take a capital letter.", tuple(PROPER), f"tok IN ({T.quoted(PROPER)}) AND {INSIDE}", "s0", "e0", PROPER_CASE),
    Detector("grammar.season_lowercase", "Capitalization", 0.9, "Seasons are written in lower case.", tuple(x.lower() for x in SEASONS), f"tok IN ({T.quoted(SEASONS)}) AND {INSIDE} AND prev_n IN ('in', 'this', 'last', 'next', 'the', 'every') AND NOT rx(next, '^\\p{{Lu}}')", "s0", "e0", "lower(tok)"),
    Detector("grammar.repeated_word", "Repetition", 0.99, "Remove an accidental repeated word.", "double", f"{_SLIP} AND NOT {_RAISED}", "s0 - length(gap)", "e0", "''"),
    Detector("grammar.repeated_word", "Repetition", 0.99, "Remove an accidental repeated word.", "double", f"{_SLIP} AND {_RAISED} AND norm IN ({T.quoted(FUNCTION_WORDS)}) AND NOT {_ACRONYM}", "s0 - length(gap) - length(prev)", "s0", "''"),
    Detector("punctuation.before_mark", "Punctuation", 0.98, "Remove whitespace before punctuation.", "mark", rf"tok IN (',', ';', ':', '!', '?') AND {BLANK} AND rx(prev, '[A-Za-z]\z')", "s0 - length(gap)", "s0", "''"),
    Detector("punctuation.after_mark", "Punctuation", 0.98, "Separate words with a space after punctuation.", "after_mark", r"gap = '' AND prev IN (',', ';', ':') AND rx(tok, '^[A-Za-z]') AND rx(prev2_n, '[a-z]{2,}\z')", "s0", "s0", "' '"),
    Detector("punctuation.doubled_mark", "Punctuation", 0.97, "Remove the doubled mark.", "mark", "tok IN (',', ';', ':') AND prev = tok AND gap = ''", "s0", "e0", "''"),
    Detector("punctuation.glued_sentence", "Punctuation", 0.95, "Separate sentences with a space.", "after_mark", r"gap = '' AND prev IN ('.', '!', '?') AND rx(tok, '^\p{Lu}\p{Ll}') AND rx(prev2_n, '^\p{L}{2,}\z') AND sent <> psent", "s0", "s0", "' '"),
    Detector("punctuation.introductory_comma", "Punctuation", 0.9, "Set off an introductory adverb with a comma.", ("however", "therefore", "moreover", "meanwhile", "furthermore", "consequently"), rf"{STARTS} AND norm IN ('however', 'therefore', 'moreover', 'meanwhile', 'furthermore', 'consequently') AND {BLANK_AFTER} AND rx(next, '^\p{{L}}')", "e0", "e0", "','"),
    Detector("grammar.article_sound", "Grammar", 0.96, "The article follows the sound of the next word.", ("a", "an"), rf"norm = 'a' AND {BLANK_AFTER} AND rx(next_n, '^[aeio]\p{{L}}+\z') AND NOT rx(next_n, '^(one|once|eu|ewe)') AND NOT ({ENUMERATOR})", "s0", "e0", same_case("'an'")),
    Detector("grammar.article_sound", "Grammar", 0.96, "The article follows the sound of the next word.", ("a", "an"), rf"norm = 'an' AND {BLANK_AFTER} AND rx(next_n, '^[bcdfgjklmnpqrstvwyz]\p{{L}}+\z')", "s0", "e0", same_case("'a'")),
    Detector("grammar.subject_agreement", "Grammar", 0.9, "The verb agrees with its subject.", ("is", "was", "are", "were"), f"norm IN ('is', 'was') AND prev_n IN ('they', 'we', 'you', 'these', 'those') AND {INSIDE} AND {BLANK} AND prev2_n NOT IN ('of', 'with', 'to', 'for', 'from', 'between', 'what', 'who')", "s0", "e0", "CASE norm WHEN 'is' THEN 'are' ELSE 'were' END"),
    Detector("grammar.subject_agreement", "Grammar", 0.9, "The verb agrees with its subject.", ("is", "was", "are", "were"), f"norm IN ('are', 'were') AND prev_n IN ('he', 'she', 'it') AND {INSIDE} AND {BLANK} AND prev2_n NOT IN ('and', 'or', 'if', 'wish', 'as', 'though', 'of', 'like')", "s0", "e0", "CASE norm WHEN 'are' THEN 'is' ELSE 'was' END"),
    Detector("grammar.subject_do_agreement", "Grammar", 0.92, "The verb agrees with its subject.", ("do",), f"norm = 'do' AND prev_n IN ('he', 'she', 'it') AND next_n = 'not' AND {INSIDE}", "s0", "e0", "'does'"),
    Detector("grammar.modal_have", "Grammar", 0.97, "A modal verb is followed by have.", ("of",), f"norm = 'of' AND prev_n IN ('could', 'should', 'would', 'must', 'might') AND {INSIDE} AND {BLANK} AND next_n <> 'course'", "s0", "e0", "'have'"),
    Detector("grammar.its_contraction", "Grammar", 0.93, "Write the contraction of it is.", ("its",), rf"norm = 'its' AND next_n IN ('been', 'a', 'an', 'the', 'not', 'going', 'very', 'too') AND {BLANK_AFTER}", "s0", "e0", same_case("'it''s'")),
    Detector("grammar.demonstrative_number", "Grammar", 0.9, "The demonstrative agrees with the noun.", ("this", "that"), f"norm IN ('this', 'that') AND next_n IN ('people', 'things', 'days', 'children', 'words', 'reasons') AND {INSIDE}", "s0", "e0", "CASE norm WHEN 'this' THEN 'these' ELSE 'those' END"),
    Detector("grammar.quantifier_number", "Grammar", 0.9, "Countable nouns take fewer or many.", ("less", "much"), f"norm IN ('less', 'much') AND next_n IN ('people', 'items', 'errors', 'words', 'days', 'things') AND {INSIDE}", "s0", "e0", "CASE norm WHEN 'less' THEN 'fewer' ELSE 'many' END"),
    Detector("grammar.there_agreement", "Grammar", 0.9, "There is agrees with what follows.", ("is",), f"norm = 'is' AND prev_n = 'there' AND next_n IN ('many', 'several', 'few', 'two', 'three', 'some') AND {INSIDE}", "s0", "e0", "'are'"),
    Detector("spelling.contraction", "Spelling", 0.95, "Write the contraction with an apostrophe.", tuple(CONTRACTIONS), f"norm IN ({T.quoted(CONTRACTIONS)})", "s0", "e0", same_case(f"({mapped(CONTRACTIONS)})")),
    Detector("spelling.common_misspelling", "Spelling", 0.97, "Correct a common misspelling.", tuple(MISSPELLINGS), f"norm IN ({T.quoted(MISSPELLINGS)})", "s0", "e0", same_case(f"({mapped(MISSPELLINGS)})")),
    Detector("spelling.split_compound", "Spelling", 0.96, "Write as two words.", ("alot", "aswell", "infact", "incase", "eachother"), "norm IN ('alot', 'aswell', 'infact', 'incase', 'eachother')", "s0", "e0", same_case("(CASE norm WHEN 'alot' THEN 'a lot' WHEN 'aswell' THEN 'as well' WHEN 'infact' THEN 'in fact' WHEN 'incase' THEN 'in case' ELSE 'each other' END)")),
    Detector("spelling.join_compound", "Spelling", 0.94, "Write as one word.", ("self", "selves"), f"norm IN ('self', 'selves') AND prev_n IN ('my', 'your', 'him', 'her', 'it', 'our', 'them') AND {INSIDE} AND gap = ' '", "s0 - length(gap)", "s0", "''"),
    Detector("spelling.possessive_boundary", "Spelling", 0.96, "Separate the possessive name from its following noun.", "possessive", r"instr(norm, '''s') > 0 AND rx(norm, '^\p{L}{2,}''s\p{L}{3,}\z')", "s0 + instr(norm, '''s') + 1", "s0 + instr(norm, '''s') + 1", "' '"),
) + tuple(Detector(*row) for row in GRAMMAR)
EXPLANATIONS = {d.rule_id: d.explanation for d in DETECTORS}
EDIT = "struct<s:bigint,e:bigint,original:string,replacement:string,category:string,rule_id:string,confidence:double>"


def _candidates(d: Detector) -> str:
    return f"CASE WHEN {d.when} THEN named_struct('s', CAST({d.start} AS BIGINT), 'e', CAST({d.end} AS BIGINT), 'replacement', {d.replacement}, 'category', '{d.category}', 'rule_id', '{d.rule_id}', 'confidence', CAST({d.confidence} AS DOUBLE)) END"


def detect(tokens: DataFrame, text: Column | None = None) -> DataFrame:
    """Edits from token rows (which may carry other columns): all columns of ``tokens`` and edit.*; one pass for all detectors."""
    every = F.expr(T.portable("array(" + ", ".join(map(_candidates, DETECTORS)) + ")", "spark"))
    found = tokens.withColumn("edit", F.explode(F.filter(every, lambda e: e.isNotNull())))
    return found


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, s, e, replacement, category, rule_id, confidence, one row a candidate edit."""
    return T.rows_of(edit_arrays(docs, key, text), [key], F.col("edits"), "s")


#: Words on which a detector may fire, and the shapes.
WORDS = tuple(sorted({w for d in DETECTORS if not isinstance(d.on, str) for w in d.on}))
_SHAPES = tuple(sorted({d.on for d in DETECTORS if isinstance(d.on, str)}))


def suspects(text: Column) -> Column:
    """The token structs at which a detector may fire: few of all, so most tokens cost one look-up and no struct."""

    def here(z, i):
        may = F.get(z["low"], i).isin(*WORDS)
        for name in _SHAPES:
            may = may | SHAPES[name](z, i)
        return may

    def one(z, i):
        # detectors only compare ordinals with those of the token before
        first = (i == 0).cast("long")
        places = {"i": i, "tok": F.get(z["tok"], i), "norm": F.get(z["low"], i), "s0": F.get(z["end"], i) - F.length(F.get(z["tok"], i)), "e0": F.get(z["end"], i), "psent": F.lit(0).cast("long"), "ppara": F.lit(0).cast("long")}
        places |= {"sent": F.greatest(first, T.rises(z, i)), "para": F.greatest(first, T.feeds(z, i))}
        places |= {n: _beside(z, i, by, array) for n, (array, by) in T.SHIFTED.items()}
        return F.struct(*[places[n].alias(n) for n in T.FIELDS])

    def found(z):
        few = F.filter(z["i"], lambda i: here(z, i))
        return F.transform(few, lambda i: one(z, i))

    return T.let(T.analysed(text, frozenset(("end",))), found)


def edit_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents (key, text, ``keep``) with a column ``edits``: the same candidates, computed without leaving the row."""
    parts = T.portable(", ".join(_inside(_candidates(d)) for d in DETECTORS), "spark")
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), *keep).withColumn("tokens", suspects(F.col("text")))
    return rows.select(key, "text", *keep, F.expr(f"flatten(transform(tokens, x -> filter(array({parts}), e -> e IS NOT NULL)))").alias("edits"))


def _inside(expression: str) -> str:
    """Column names outside of quotes become fields of the lambda's token."""
    out = []
    for k, part in enumerate(expression.split("'")):
        out.append(part if k % 2 else _NAME.sub(lambda m: "x.isw_" if m[0] == "isw" else f"x.{m[0]}", part))
    return "'".join(out).replace("x.isw_", r"rx(x.tok, '^\p{L}')")


_NAME = re.compile(r"\b(?:" + "|".join(sorted((*T.FIELDS, "isw"), key=len, reverse=True)) + r")\b")


def edits_sql(name: str = "edits") -> str:
    """The candidates in DuckDB, as a CTE after those of ``tokens_sql``."""
    rows = " UNION ALL ".join(f"SELECT doc_id, CAST({d.start} AS BIGINT) AS s, CAST({d.end} AS BIGINT) AS e, {d.replacement} AS replacement, '{d.category}' AS category, '{d.rule_id}' AS rule_id, CAST({d.confidence} AS DOUBLE) AS confidence FROM tokens WHERE {d.when}" for d in DETECTORS)
    return f"{name} AS ({T.portable(rows, 'duckdb')})"
