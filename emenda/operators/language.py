"""More operators that are relational algebra over tokens, edits and documents: phrases, names, sentences, spelling in context, privacy, generators.

Added to the registry of ``relational``; see there and ``plans.sql`` for the dialect.
"""

from __future__ import annotations

from emenda.functions import text as T
from emenda.operators.relational import COMMON, PAIRS, RARE, SQL, add  # noqa: F401


def values(rows, *columns: str) -> str:
    """A constant table."""
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) else T.quoted([v]) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(columns)}))"


BLANK_AFTER = r"rx(gapn, '^[\x20\t]+\z')"
#: Phrases of the library's own list: what is found, what it is replaced by.
PHRASES = (
    ("in order to", "to"), ("could of", "could have"), ("should of", "should have"), ("a lot of", "many"), ("as well as", "and"), ("each and every", "every"), ("of the", "of the"), ("and the", "and the"),
    ("to the", "to the"), ("in the", "in the"), ("de la", "de la"), ("und die", "und die"), ("the and of", "the and of"), ("free gift", "gift"), ("past history", "history"), ("end result", "result"),
)
#: Words that users have taught, some of several words.
DICTIONARY = ("the and", "and of", "tion", "the thing", "ion", "der die", "de", "open source", "to be", "be")
_WORDS = "words AS (SELECT norm AS w, count(*) AS c FROM {tokens} WHERE isw GROUP BY norm)"
_GRAMS = (
    "grams AS (SELECT doc_id, i, 1 AS n, s0, norm AS g FROM {tokens} WHERE isw"
    f" UNION ALL SELECT doc_id, i, 2 AS n, s0, concat(norm, ' ', next_n) AS g FROM {{tokens}} WHERE isw AND {BLANK_AFTER} AND rx(next, '^\\p{{L}}')"
    f" UNION ALL SELECT doc_id, i, 3 AS n, s0, concat(norm, ' ', next_n, ' ', next2_n) AS g FROM {{tokens}} WHERE isw AND {BLANK_AFTER} AND rx(next, '^\\p{{L}}') AND rx(next2_n, '^\\p{{L}}'))"
)
#: Sentences with their places; ``k`` numbers them without gaps.
_SENT = "sent AS (SELECT doc_id, sent, min(s0) AS a, max(e0) AS b, min(i) AS i0, max(i) AS i1, CAST(sum(CASE WHEN isw THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent) AS BIGINT) AS k FROM {tokens} GROUP BY doc_id, sent)"

# phrases, dictionaries, hints ------------------------------------------------------------------------------------------------
add("phrase_hits", "tokens", f"WITH {_GRAMS}, ph AS {values(PHRASES, 'p', 'r')} SELECT p, r, count(*) AS hits, count(DISTINCT doc_id) AS docs, min(s0) AS first_place FROM grams JOIN ph ON g = p GROUP BY p, r")
add("dictionary_spans", "tokens", f"""WITH {_GRAMS}, known AS {values([(w, len(w.split())) for w in DICTIONARY], 'p', 'words')}, hit AS (SELECT doc_id, i AS a, i + n - 1 AS b FROM grams JOIN known ON g = p),
isl AS (SELECT doc_id, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM hit),
num AS (SELECT doc_id, a, b, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM isl) SELECT doc_id, CAST(min(a) AS BIGINT) AS first_token, CAST(max(b) AS BIGINT) AS last_token, count(*) AS hits FROM num GROUP BY doc_id, g""")
add("known_words", "documents tokens customer nation", """WITH own AS (SELECT n_name AS w, 1 AS rank FROM {nation} UNION ALL SELECT DISTINCT c_mktsegment AS w, 2 AS rank FROM {customer} UNION ALL SELECT DISTINCT tok AS w, 3 AS rank FROM {tokens} WHERE rx(tok, '^\\p{Lu}\\p{Ll}{5,}\\z')),
one AS (SELECT w, rank, row_number() OVER (PARTITION BY lower(w) ORDER BY rank, w) AS k FROM own), kept AS (SELECT w, rank, CAST(row_number() OVER (ORDER BY rank, w) AS BIGINT) AS place FROM one WHERE k = 1) SELECT w, rank, place FROM kept WHERE place <= 5000""")
add("hint_join", "tokens", """WITH hints AS (SELECT doc_id, s0 AS a, e0 AS b, CASE WHEN rx(tok, '^\\p{Lu}\\p{Ll}') THEN 'name' ELSE 'other' END AS kind FROM {tokens} WHERE isw AND sent = psent AND rx(tok, '^\\p{Lu}') UNION ALL SELECT doc_id, s0 AS a, e0 - 2 AS b, 'owner' AS kind FROM {tokens} WHERE rx(norm, '^\\p{L}+''s\\z')),
exact AS (SELECT t.doc_id AS doc_id, t.i AS i, max(h.kind) AS kind FROM {tokens} t JOIN hints h ON t.doc_id = h.doc_id AND t.s0 = h.a AND t.e0 = h.b GROUP BY t.doc_id, t.i),
owner AS (SELECT t.doc_id AS doc_id, t.i AS i, max(h.kind) AS kind FROM {tokens} t JOIN hints h ON t.doc_id = h.doc_id AND t.s0 = h.a AND t.e0 - 2 = h.b WHERE rx(t.norm, '''s\\z') GROUP BY t.doc_id, t.i)
SELECT coalesce(e.kind, o.kind) AS kind, count(*) AS n, CAST(sum(CASE WHEN e.kind IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS by_owner FROM exact e FULL JOIN owner o ON e.doc_id = o.doc_id AND e.i = o.i GROUP BY 1""")
# sentences, clauses, windows -------------------------------------------------------------------------------------------------
add("sentence_windows", "tokens", f"WITH {_SENT} SELECT doc_id, k, lag(a, 1, a) OVER (PARTITION BY doc_id ORDER BY k) AS from_place, lead(b, 1, b) OVER (PARTITION BY doc_id ORDER BY k) AS to_place, n + lag(n, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) + lead(n, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS words FROM sent")
add("tone_parts", "tokens", f"WITH {_SENT}, p AS (SELECT doc_id, k, a, b, lead(b) OVER (PARTITION BY doc_id ORDER BY k) AS b2, count(*) OVER (PARTITION BY doc_id) AS m FROM sent) SELECT doc_id, 'whole' AS part, min(a) AS a, max(b) AS b FROM p GROUP BY doc_id UNION ALL SELECT doc_id, 'sentence' AS part, a, b FROM p WHERE m > 1 UNION ALL SELECT doc_id, 'pair' AS part, a, b2 AS b FROM p WHERE b2 IS NOT NULL AND m > 2")
add("clause_slices", "tokens", """WITH c AS (SELECT doc_id, sent, i, s0, e0, isw, CASE WHEN sent = psent AND (prev IN (',', ';', ':') OR (norm IN ('and', 'but', 'because', 'und', 'et') AND prev NOT IN (',', ';', ':'))) THEN 1 ELSE 0 END AS cut FROM {tokens}),
g AS (SELECT doc_id, sent, s0, e0, isw, sum(cut) OVER (PARTITION BY doc_id, sent ORDER BY i ROWS UNBOUNDED PRECEDING) AS clause FROM c) SELECT doc_id, sent, CAST(clause AS BIGINT) AS clause, min(s0) AS a, max(e0) AS b, CAST(sum(CASE WHEN isw THEN 1 ELSE 0 END) AS BIGINT) AS words FROM g GROUP BY doc_id, sent, clause""")
add("look_ahead", "tokens", """WITH s AS (SELECT doc_id, sent, i, norm, min(CASE WHEN NOT isw THEN i END) OVER (PARTITION BY doc_id, sent ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS stop FROM {tokens}) SELECT norm, count(*) AS n, CAST(sum(stop - i - 1) AS BIGINT) AS taken, CAST(sum(CASE WHEN stop IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unstopped FROM s WHERE norm IN ('the', 'a', 'of', 'and', 'de', 'der') GROUP BY norm""")
add("clause_frames", "tokens", """WITH f AS (SELECT doc_id, sent, i, CASE WHEN norm IN ('i', 'we', 'ich', 'wir') THEN 'first' WHEN norm IN ('you', 'du', 'tu') THEN 'second' WHEN norm IN ('he', 'she', 'it', 'they', 'er', 'sie') THEN 'third' END AS subject, CASE WHEN norm IN ('was', 'were', 'had', 'did', 'war') OR rx(norm, '[a-z]{3}ed\\z') THEN 'past' WHEN norm IN ('will', 'shall', 'wird') THEN 'future' WHEN norm IN ('is', 'are', 'has', 'have', 'do', 'does', 'be', 'ist') THEN 'present' END AS tense, CASE WHEN tok = '?' THEN 1 ELSE 0 END AS asks FROM {tokens}),
a AS (SELECT doc_id, sent, min(CASE WHEN subject IS NOT NULL THEN i END) AS si, min(CASE WHEN tense IS NOT NULL THEN i END) AS ti, max(asks) AS asks FROM f GROUP BY doc_id, sent),
j AS (SELECT a.doc_id AS doc_id, a.asks AS asks, s.subject AS subject, t.tense AS tense FROM a LEFT JOIN f s ON a.doc_id = s.doc_id AND a.si = s.i LEFT JOIN f t ON a.doc_id = t.doc_id AND a.ti = t.i)
SELECT coalesce(subject, 'none') AS subject, coalesce(tense, 'none') AS tense, CASE WHEN asks = 1 THEN 'question' ELSE 'statement' END AS mood, count(*) AS n, count(DISTINCT doc_id) AS docs FROM j GROUP BY 1, 2, 3""")
# names -----------------------------------------------------------------------------------------------------------------------
_LEVEL = """lev AS (SELECT doc_id, norm, CASE WHEN sum(CASE WHEN rx(tok, '^\\p{Lu}\\p{Ll}') AND sent = psent THEN 1 ELSE 0 END) >= 2 AND sum(CASE WHEN rx(tok, '^\\p{Ll}') THEN 1 ELSE 0 END) = 0 THEN 3 WHEN sum(CASE WHEN rx(tok, '^\\p{Ll}') THEN 1 ELSE 0 END) = 0 AND sum(CASE WHEN rx(tok, '^\\p{Lu}\\p{Ll}') AND sent = psent THEN 1 ELSE 0 END) >= 1 THEN 2 WHEN sum(CASE WHEN rx(tok, '^\\p{Lu}\\p{Ll}') AND sent = psent THEN 1 ELSE 0 END) >= 1 THEN 1 ELSE 0 END AS level FROM {tokens} WHERE isw GROUP BY doc_id, norm)"""
add("name_spans", "tokens", f"""WITH {_LEVEL}, t AS (SELECT t.doc_id AS doc_id, t.i AS i, t.s0 AS s0, t.e0 AS e0, l.level AS level FROM {{tokens}} t JOIN lev l ON t.doc_id = l.doc_id AND t.norm = l.norm WHERE l.level >= 2 AND t.sent = t.psent AND rx(t.tok, '^\\p{{Lu}}')),
r AS (SELECT doc_id, i, s0, e0, level, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t) SELECT doc_id, min(s0) AS a, max(e0) AS b, count(*) AS words, max(level) AS level FROM r GROUP BY doc_id, run""")
add("lowercase_names", "tokens", f"""WITH {_LEVEL}, strong AS (SELECT norm, count(*) AS docs FROM lev WHERE level >= 2 GROUP BY norm), plain AS (SELECT norm, count(*) AS n FROM {{tokens}} WHERE rx(tok, '^\\p{{Ll}}') GROUP BY norm),
c AS (SELECT t.norm AS norm, CASE WHEN t.prev_n IN ('hi', 'hello', 'dear', 'thanks') THEN 'greeting' WHEN t.prev_n IN ('mr', 'mrs', 'dr', 'von', 'de', 'van') THEN 'title' WHEN t.prev_n IN ('and', 'und', 'et', 'y') THEN 'list' WHEN t.prev_n IN ('to', 'for', 'from', 'with') THEN 'transfer' ELSE 'none' END AS frame FROM {{tokens}} t WHERE rx(t.tok, '^\\p{{Ll}}'))
SELECT c.norm AS name, c.frame AS frame, count(*) AS n FROM c JOIN strong s ON c.norm = s.norm JOIN plain p ON c.norm = p.norm WHERE s.docs > p.n AND c.frame <> 'none' GROUP BY c.norm, c.frame""")
add("names_damaged", "tokens edits documents", f"""WITH {_LEVEL}, nm AS (SELECT t.doc_id AS doc_id, t.s0 AS s0, t.e0 AS e0, t.tok AS tok, l.level AS level FROM {{tokens}} t JOIN lev l ON t.doc_id = l.doc_id AND t.norm = l.norm WHERE l.level >= 1 AND rx(t.tok, '^\\p{{Lu}}')),
hit AS (SELECT n.level AS level, e.category AS category, lower(e.replacement) = lower(n.tok) AS case_only FROM nm n JOIN {{edits}} e ON n.doc_id = e.doc_id AND e.s < n.e0 AND e.e > n.s0)
SELECT level, category, count(*) AS touched, CAST(sum(CASE WHEN case_only THEN 0 ELSE 1 END) AS BIGINT) AS damaged FROM hit GROUP BY GROUPING SETS ((), (level), (category), (level, category))""")
add("name_log_odds", "tokens", "WITH f AS (SELECT norm, CAST(sum(CASE WHEN rx(tok, '^\\p{Lu}\\p{Ll}') AND sent = psent THEN 1 ELSE 0 END) AS DOUBLE) AS high, CAST(sum(CASE WHEN rx(tok, '^\\p{Ll}') THEN 1 ELSE 0 END) AS DOUBLE) AS low FROM {tokens} WHERE isw GROUP BY norm), o AS (SELECT norm, high, low, ln((high + 0.5) / (low + 0.5)) AS odds FROM f WHERE high > 0), r AS (SELECT norm, odds, high, row_number() OVER (PARTITION BY substr(norm, 1, 1) ORDER BY odds DESC, high DESC, norm) AS k FROM o) SELECT norm, round(odds, 9) AS odds, odds >= -0.9 AS name FROM r WHERE k <= 12")
# edits -----------------------------------------------------------------------------------------------------------------------
add("edit_families", "edits documents", """WITH x AS (SELECT e.rule_id AS rule_id, substr(coalesce(d.text, ''), CAST(e.s AS INT) + 1, CAST(e.e - e.s AS INT)) AS o, e.replacement AS r FROM {edits} e JOIN {documents} d ON e.doc_id = d.doc_id),
f AS (SELECT rule_id, CASE WHEN o = '' AND rx(r, '^[\\x20\\t]+\\z') THEN 'space' WHEN o = '' AND rx(r, '^[^\\p{L}0-9]+\\z') THEN 'mark added' WHEN o = '' THEN 'word added' WHEN r = '' AND rx(o, '\\p{L}') THEN 'word removed' WHEN r = '' THEN 'mark or space removed' WHEN lower(o) = lower(r) THEN 'case' WHEN replace(replace(lower(o), '''', ''), '’', '') = replace(lower(r), '''', '') THEN 'apostrophe' WHEN replace(lower(o), ' ', '') = replace(replace(lower(r), ' ', ''), '-', '') THEN 'join or split' WHEN NOT rx(o, '\\p{L}') AND NOT rx(r, '\\p{L}') THEN 'mark' WHEN levenshtein(lower(o), lower(r)) <= 2 THEN 'spelling' ELSE 'words' END AS family FROM x)
SELECT family, rule_id, count(*) AS n FROM f GROUP BY family, rule_id""")
add("edit_tags", "edits tokens", """WITH t AS (SELECT doc_id, i, s0, e0, tok FROM {tokens}), h AS (SELECT t.doc_id AS doc_id, t.i AS i, t.tok AS tok, e.s AS s, e.e AS e, e.replacement AS r, t.s0 AS s0, t.e0 AS e0, row_number() OVER (PARTITION BY t.doc_id, t.i ORDER BY e.s, e.e, e.rule_id, e.replacement) AS k FROM t JOIN {edits} e ON t.doc_id = e.doc_id AND ((e.s < t.e0 AND e.e > t.s0) OR (e.s = e.e AND e.s = t.e0) OR (e.s = e.e AND e.s = t.s0 AND t.i = 0))),
g AS (SELECT CASE WHEN s = e THEN concat('$APPEND_', trim(r)) WHEN trim(r) = '' AND s <= s0 AND e >= e0 THEN '$DELETE' WHEN s = s0 AND lower(r) = lower(substr(tok, 1, CAST(e - s AS INT))) THEN '$TRANSFORM_CASE_CAPITAL' WHEN s <= s0 AND e >= e0 THEN concat('$REPLACE_', trim(r)) WHEN trim(r) = '' THEN '$MERGE_SPACE' ELSE '$TRANSFORM_SPLIT' END AS tag FROM h WHERE k = 1)
SELECT tag, count(*) AS n FROM g GROUP BY tag UNION ALL SELECT '$KEEP' AS tag, (SELECT count(*) FROM t) - (SELECT count(*) FROM h WHERE k = 1) AS n""")
add("evidence_maxima", "edits tokens", f"WITH {_SENT} SELECT s.doc_id AS doc_id, s.k AS k, count(*) AS edits, max(e.confidence) AS worst, max(e.rule_id) AS last_rule FROM sent s JOIN {{edits}} e ON s.doc_id = e.doc_id AND e.s >= s.a AND e.s < s.b GROUP BY s.doc_id, s.k")
add("edit_limits", "edits", "WITH r AS (SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, rule_id, replacement) AS k, row_number() OVER (PARTITION BY doc_id, category ORDER BY s, e, rule_id, replacement) AS m FROM {edits}) SELECT doc_id, count(*) AS candidates, CAST(sum(CASE WHEN k <= 512 THEN 1 ELSE 0 END) AS BIGINT) AS within, CAST(sum(CASE WHEN category = 'Punctuation' AND m > 32 THEN 1 ELSE 0 END) AS BIGINT) AS marks_left FROM r GROUP BY doc_id")
add("linked_pairs", "tokens", """WITH b AS (SELECT doc_id, i, tok, sum(CASE WHEN tok = '(' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM {tokens} WHERE tok IN ('(', ')', ',', '.')),
z AS (SELECT doc_id, g, i, tok, row_number() OVER (PARTITION BY doc_id, g, tok ORDER BY i) AS k FROM b WHERE g > 0), p AS (SELECT doc_id, g, i, tok, count(*) OVER (PARTITION BY doc_id, g) AS members FROM z WHERE k = 1 AND tok IN ('(', ')')) SELECT members, count(*) AS edits, count(DISTINCT doc_id) AS docs FROM p GROUP BY members""")
add("code_mixed_screen", "edits tokens", """WITH f AS (SELECT doc_id, sent, min(s0) AS a, max(e0) AS b, count(*) AS words, sum(CASE WHEN norm IN ('der', 'die', 'das', 'und', 'ist', 'le', 'la', 'les', 'et', 'de', 'el', 'los') THEN 1 ELSE 0 END) AS other FROM {tokens} WHERE isw GROUP BY doc_id, sent), mixed AS (SELECT doc_id, a, b FROM f WHERE other >= 2 OR (other >= 1 AND 3 * other >= words)),
bad AS (SELECT DISTINCT e.doc_id AS doc_id, e.s AS s, e.e AS e, e.rule_id AS rule_id FROM {edits} e JOIN mixed m ON e.doc_id = m.doc_id AND e.s >= m.a AND e.s < m.b WHERE e.category NOT IN ('Spelling', 'Capitalization', 'Punctuation'))
SELECT e.category AS category, count(*) AS candidates, CAST(sum(CASE WHEN b.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS left_over FROM {edits} e LEFT JOIN bad b ON e.doc_id = b.doc_id AND e.s = b.s AND e.e = b.e AND e.rule_id = b.rule_id GROUP BY e.category""")
# spelling --------------------------------------------------------------------------------------------------------------------
_LEX = f"{_WORDS}, lex AS (SELECT w, c FROM words WHERE c >= {COMMON} AND length(w) BETWEEN 4 AND 14 AND rx(w, '^[a-z]+\\z')), slips AS (SELECT w, c FROM words WHERE c <= {RARE} AND length(w) BETWEEN 5 AND 14 AND rx(w, '^[a-z]+\\z'))"


def _cut(table: str, columns: str) -> str:
    return f"SELECT {columns}, concat(substr(d, 1, k - 1), substr(d, k + 1)) AS d FROM (SELECT {columns}, d, flat(series(1, length(d))) AS k FROM {table}) x"


_TWO = f"""{_LEX}, l1 AS ({_cut('(SELECT w, c, w AS d FROM lex) y', 'w, c')}), l2 AS ({_cut('(SELECT DISTINCT w, c, d FROM l1) y', 'w, c')}), ld AS (SELECT w, c, w AS d FROM lex UNION SELECT w, c, d FROM l1 UNION SELECT w, c, d FROM l2),
s1 AS ({_cut('(SELECT w, w AS d FROM slips) y', 'w')}), s2 AS ({_cut('(SELECT DISTINCT w, d FROM s1) y', 'w')}), sd AS (SELECT w, w AS d FROM slips UNION SELECT w, d FROM s1 UNION SELECT w, d FROM s2),
two AS (SELECT DISTINCT sd.w AS slip, ld.w AS word, ld.c AS c FROM sd JOIN ld ON sd.d = ld.d WHERE abs(length(sd.w) - length(ld.w)) <= 2)"""
add("spelling_within_two", "tokens", f"WITH {_TWO}, q AS (SELECT slip, word, c, CAST(levenshtein(slip, word) AS BIGINT) AS edits FROM two) SELECT slip, edits, count(*) AS words, min(word) AS first_word, CAST(sum(c) AS BIGINT) AS uses FROM q WHERE edits <= 2 GROUP BY slip, edits")
#: Every slip's candidates at one edit, with a cost that is least for what typists do most: letters doubled or dropped, neighbours on the keyboard.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEIGHBOURS = tuple(a + b for row in KEYS for a, b in zip(row, row[1:])) + tuple(a + b for up, down in zip(KEYS, KEYS[1:]) for a, b in zip(up, down))
_COST = f"""{_LEX}, l1 AS ({_cut('(SELECT w, c, w AS d FROM lex) y', 'w, c')}), ld AS (SELECT w, c, w AS d FROM lex UNION SELECT w, c, d FROM l1), s1 AS ({_cut('(SELECT w, w AS d FROM slips) y', 'w')}), sd AS (SELECT w, w AS d FROM slips UNION SELECT w, d FROM s1),
met AS (SELECT DISTINCT sd.w AS slip, ld.w AS word, ld.c AS c FROM sd JOIN ld ON sd.d = ld.d), same AS (SELECT slip, word, c, flat(series(1, least(length(slip), length(word)))) AS k FROM met),
spot AS (SELECT slip, word, c, coalesce(min(CASE WHEN substr(slip, k, 1) <> substr(word, k, 1) THEN k END), least(length(slip), length(word)) + 1) AS p FROM same GROUP BY slip, word, c),
kinds AS (SELECT slip, word, c, p, CASE WHEN length(slip) = length(word) + 1 AND substr(slip, p + 1) = substr(word, p) THEN CASE WHEN p > 1 AND substr(slip, p, 1) = substr(slip, greatest(p - 1, 1), 1) THEN 'doubled' ELSE 'added' END WHEN length(word) = length(slip) + 1 AND substr(word, p + 1) = substr(slip, p) THEN CASE WHEN p > 1 AND substr(word, p, 1) = substr(word, greatest(p - 1, 1), 1) THEN 'single' ELSE 'left out' END
 WHEN length(slip) = length(word) AND substr(slip, p, 1) = substr(word, p + 1, 1) AND substr(slip, p + 1, 1) = substr(word, p, 1) AND substr(slip, p + 2) = substr(word, p + 2) THEN 'swapped' WHEN length(slip) = length(word) AND substr(slip, p + 1) = substr(word, p + 1) THEN CASE WHEN concat(substr(slip, p, 1), substr(word, p, 1)) IN ({T.quoted(NEIGHBOURS)}) OR concat(substr(word, p, 1), substr(slip, p, 1)) IN ({T.quoted(NEIGHBOURS)}) THEN 'beside' ELSE 'replaced' END END AS kind FROM spot),
cost AS (SELECT slip, word, c, kind, CAST(CASE kind WHEN 'doubled' THEN 0.3 WHEN 'single' THEN 0.3 WHEN 'swapped' THEN 0.5 WHEN 'beside' THEN 0.8 WHEN 'left out' THEN 1.0 WHEN 'added' THEN 1.2 ELSE 1.8 END + CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS cost FROM kinds WHERE kind IS NOT NULL)"""
add("typo_costs", "tokens", f"WITH {_COST} SELECT kind, round(cost, 6) AS cost, count(*) AS pairs, count(DISTINCT slip) AS slips, min(slip) AS first_slip FROM cost GROUP BY kind, round(cost, 6)")
#: The parts of _FIT, which ``plans.spelling`` runs over tables of its own: costs without the words, the total, the choice.
COSTS = _COST.removeprefix(f"{_WORDS}, ")
TOTAL = "total AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM words)"
_SEEN = "seen AS (SELECT DISTINCT doc_id, s0, e0, tok, norm, prev_n, next_n FROM {tokens} WHERE isw AND rx(tok, '^[a-z]+\\z'))"
BEST = """cand AS (SELECT t.doc_id AS doc_id, t.s0 AS s0, t.e0 AS e0, t.norm AS slip, c.word AS word, 0.45 * (log10(c.c * 1000000000.0 / (SELECT n FROM total)) - c.cost) + 0.83 * (log10(1 + coalesce(l.c, 0)) + log10(1 + coalesce(r.c, 0))) AS score FROM seen t JOIN cost c ON t.norm = c.slip LEFT JOIN pairs l ON l.a = t.prev_n AND l.b = c.word LEFT JOIN pairs r ON r.a = c.word AND r.b = t.next_n),
best AS (SELECT doc_id, s0, e0, slip, word, score, lead(score) OVER (PARTITION BY doc_id, s0 ORDER BY round(score, 9) DESC, word) AS second, row_number() OVER (PARTITION BY doc_id, s0 ORDER BY round(score, 9) DESC, word) AS k FROM cand)"""
_FIT = f"""{_COST}, {PAIRS}, {TOTAL}, {_SEEN},
{BEST}"""
#: The best word must lead the second one by so much.
MARGIN = 1.0
add("spelling_in_context", "tokens", f"WITH {_FIT} SELECT doc_id, s0, e0, slip, word, round(score, 6) AS score, second IS NULL OR score - second >= {MARGIN} AS sure FROM best WHERE k = 1")
add("best_per_sentence", "tokens", f"WITH {_FIT}, {_SENT}, one AS (SELECT s.doc_id AS doc_id, s.k AS sentence, b.slip AS slip, b.word AS word, round(b.score - coalesce(b.second, 0), 6) AS lead_by, row_number() OVER (PARTITION BY s.doc_id, s.k ORDER BY round(b.score - coalesce(b.second, 0), 6) DESC, b.s0) AS place FROM best b JOIN sent s ON b.doc_id = s.doc_id AND b.s0 >= s.a AND b.s0 < s.b WHERE b.k = 1) SELECT doc_id, sentence, slip, word, lead_by FROM one WHERE place = 1")
_FOLD = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '(ph|ff|v)', 'f', 'g'), '(ck|c|q|k)', 'k', 'g'), '(tz|z|ss|s)', 's', 'g'), '(th|tt|d|t)', 't', 'g'), '[aeiouyhw]+', '', 'g')"
add("sounds_like", "tokens", f"WITH {_WORDS}, p AS (SELECT w, c, concat(substr(w, 1, 1), {_FOLD}) AS code FROM words WHERE c >= {COMMON} AND length(w) >= 4 AND rx(w, '^[a-z]+\\z')) SELECT code, count(*) AS words, min(w) AS first_word, max(w) AS last_word, CAST(sum(c) AS BIGINT) AS uses FROM p GROUP BY code HAVING count(*) > 1")
add("variant_spellings", "tokens", f"WITH {_WORDS}, v AS (SELECT w, c, 'our/or' AS kind, replace(w, 'our', 'or') AS other FROM words WHERE instr(w, 'our') > 0 UNION ALL SELECT w, c, 'is/iz' AS kind, replace(w, 'is', 'iz') AS other FROM words WHERE instr(w, 'is') > 1 UNION ALL SELECT w, c, 're/er' AS kind, concat(substr(w, 1, length(w) - 2), 'er') AS other FROM words WHERE rx(w, '[a-z]{{2}}re\\z') UNION ALL SELECT w, c, 'll/l' AS kind, replace(w, 'll', 'l') AS other FROM words WHERE instr(w, 'll') > 0) SELECT v.kind AS kind, v.w AS one, x.w AS other, v.c AS uses, x.c AS other_uses FROM v JOIN words x ON v.other = x.w WHERE v.w <> x.w")
add("stand_in_scores", "tokens", f"WITH {_WORDS}, {PAIRS}, {_SENT}, m AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM words), lp AS (SELECT t.doc_id AS doc_id, t.sent AS sent, log10(0.4 * w.c / (SELECT n FROM m) + 0.6 * coalesce(p.c, 0) / v.c) AS lp FROM {{tokens}} t JOIN words w ON t.norm = w.w JOIN words v ON t.prev_n = v.w LEFT JOIN pairs p ON p.a = t.prev_n AND p.b = t.norm WHERE t.isw AND t.sent = t.psent) SELECT doc_id, sent, count(*) AS pairs_seen, round(avg(lp), 6) AS score FROM lp GROUP BY doc_id, sent")
# forms of words --------------------------------------------------------------------------------------------------------------
_PLURAL = "CASE WHEN rx(w, '(s|x|z|ch|sh)\\z') THEN concat(w, 'es') WHEN rx(w, '[^aeiou]y\\z') THEN concat(substr(w, 1, length(w) - 1), 'ies') WHEN rx(w, '[^f]fe\\z') THEN concat(substr(w, 1, length(w) - 2), 'ves') ELSE concat(w, 's') END"
_SINGULAR = "CASE WHEN rx(w, '[^aeiou]ies\\z') THEN concat(substr(w, 1, length(w) - 3), 'y') WHEN rx(w, '(ss|x|z|ch|sh)es\\z') THEN substr(w, 1, length(w) - 2) WHEN rx(w, '[^s]s\\z') AND NOT rx(w, '(us|is)\\z') THEN substr(w, 1, length(w) - 1) ELSE w END"
_DOUBLES = "rx(w, '^[^aeiou]*[aeiou][bdgklmnprt]\\z')"
_PAST = f"CASE WHEN rx(w, 'e\\z') THEN concat(w, 'd') WHEN rx(w, '[^aeiou]y\\z') THEN concat(substr(w, 1, length(w) - 1), 'ied') WHEN {_DOUBLES} THEN concat(w, substr(w, length(w), 1), 'ed') ELSE concat(w, 'ed') END"
_GERUND = f"CASE WHEN rx(w, 'ie\\z') THEN concat(substr(w, 1, length(w) - 2), 'ying') WHEN rx(w, '[^eo]e\\z') THEN concat(substr(w, 1, length(w) - 1), 'ing') WHEN {_DOUBLES} THEN concat(w, substr(w, length(w), 1), 'ing') ELSE concat(w, 'ing') END"
add("inflections", "tokens", f"WITH {_WORDS}, f AS (SELECT w, c, {_PLURAL} AS plural, {_PAST} AS past, {_GERUND} AS gerund, {_SINGULAR} AS singular FROM words WHERE c >= {COMMON} AND length(w) >= 3 AND rx(w, '^[a-z]+\\z')) SELECT f.w AS w, f.plural AS plural, f.past AS past, f.gerund AS gerund, f.singular AS singular, p.w IS NOT NULL AS plural_seen, s.w IS NOT NULL AND s.w <> f.w AS looks_plural FROM f LEFT JOIN words p ON f.plural = p.w LEFT JOIN words s ON f.singular = s.w")
add("article_sounds", "tokens", "WITH n AS (SELECT norm AS article, CASE WHEN rx(next, '^\\p{Lu}{2,}\\z') THEN CASE WHEN rx(next, '^[AEFHILMNORSX]') THEN 'an' ELSE 'a' END WHEN rx(next_n, '^(hour|honest|heir|honou?r)') THEN 'an' WHEN rx(next_n, '^(uni([^mn]|\\z)|use|usu|eu|one|once|ewe|u[bfkqrst][aeiou])') THEN 'a' WHEN rx(next_n, '^[aeiou]') THEN 'an' ELSE 'a' END AS fits FROM {tokens} WHERE norm IN ('a', 'an') AND rx(next, '^\\p{L}')) SELECT article, fits, count(*) AS n FROM n GROUP BY article, fits")
# generators ------------------------------------------------------------------------------------------------------------------
_PICK = f"{_SENT}, pick AS (SELECT doc_id, sent, a, b, i0, i1, n, CAST(length(substr(hex256(concat(CAST(doc_id AS VARCHAR(20)), ':', CAST(sent AS VARCHAR(20)))), 1, 1)) AS INT) AS one, instr('0123456789abcdef', substr(hex256(concat(CAST(doc_id AS VARCHAR(20)), ':', CAST(sent AS VARCHAR(20)))), 1, 1)) - 1 AS h FROM sent WHERE n >= 5)"
add("challenge_corruption", "tokens documents", f"""WITH {_PICK}, spot AS (SELECT p.doc_id AS doc_id, p.sent AS sent, p.a AS a, p.b AS b, p.h AS h, t.s0 AS s0, t.e0 AS e0, t.tok AS tok, t.gapn AS gapn FROM pick p JOIN {{tokens}} t ON p.doc_id = t.doc_id AND t.i = p.i0 + 1 + p.h % 3 WHERE rx(t.tok, '^[A-Za-z]{{4,}}\\z')),
c AS (SELECT doc_id, sent, a, b, CASE h % 5 WHEN 0 THEN 'double word' WHEN 1 THEN 'drop letter' WHEN 2 THEN 'swap letters' WHEN 3 THEN 'lower or raise' ELSE 'glue words' END AS kind, s0 AS s, CASE WHEN h % 5 = 4 THEN e0 + length(gapn) ELSE e0 END AS e, CASE h % 5 WHEN 0 THEN concat(tok, ' ', tok) WHEN 1 THEN concat(substr(tok, 1, 2), substr(tok, 4)) WHEN 2 THEN concat(substr(tok, 1, 1), substr(tok, 3, 1), substr(tok, 2, 1), substr(tok, 4)) WHEN 3 THEN CASE WHEN rx(tok, '^\\p{{Lu}}') THEN lower(tok) ELSE upper(tok) END ELSE tok END AS put FROM spot)
SELECT c.doc_id AS doc_id, c.sent AS sent, c.kind AS kind, c.s - c.a AS place, substr(d.text, CAST(c.s AS INT) + 1, CAST(c.e - c.s AS INT)) AS taken, c.put AS put, md5(concat(substr(d.text, CAST(c.a AS INT) + 1, CAST(c.s - c.a AS INT)), c.put, substr(d.text, CAST(c.e AS INT) + 1, CAST(greatest(c.b - c.e, 0) AS INT)))) AS corrupted FROM c JOIN {{documents}} d ON c.doc_id = d.doc_id""")
TEMPLATES = (("greeting", "Hi %n%, thanks for the note."), ("list", "We met %n% and two others."), ("transfer", "Please send it to %n% today."), ("sign-off", "Best, %n%"), ("possessive", "I read %n%''s report."), ("title", "Dr. %n% will call."), ("question", "Has %n% answered yet?"), ("middle", "Then %n% left early."))
add("names_corpus", "nation", f"WITH t AS {values([(c, x.replace(chr(39) * 2, chr(39))) for c, x in TEMPLATES], 'context', 'template')}, k AS {values([('lower',), ('title',), ('upper',)], 'letters')}, n AS (SELECT n_regionkey AS culture, replace(n_name, '_', ' ') AS n FROM {{nation}}), w AS (SELECT culture, context, letters, template, CASE letters WHEN 'lower' THEN lower(n) WHEN 'upper' THEN upper(n) ELSE concat(upper(substr(n, 1, 1)), lower(substr(n, 2))) END AS n FROM n CROSS JOIN t CROSS JOIN k) SELECT culture, context, letters, n AS name, replace(template, '%n%', n) AS text, CAST(instr(template, '%n%') - 1 AS BIGINT) AS a, CAST(instr(template, '%n%') - 1 + length(n) AS BIGINT) AS b FROM w")
add("tone_training_set", "conversations benchmark", """WITH raw AS (SELECT lower(regexp_replace(trim(text), '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS t, CASE WHEN rx(text, '[!]|(?i)(lol|hey|yeah)') THEN 'informal' WHEN rx(text, '[?]') THEN 'question' ELSE 'plain' END AS label, conv_id FROM {conversations} WHERE text IS NOT NULL),
one AS (SELECT t, label, min(conv_id) AS conv_id FROM raw GROUP BY t, label), clear AS (SELECT t FROM one GROUP BY t HAVING count(*) = 1), held AS (SELECT DISTINCT lower(regexp_replace(trim(text), '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS t FROM {benchmark}),
kept AS (SELECT o.t AS t, o.label AS label, o.conv_id AS conv_id FROM one o JOIN clear c ON o.t = c.t WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.t = o.t))
SELECT md5(t) AS text_md5, label, conv_id, CASE WHEN substr(hex256(CAST(conv_id AS VARCHAR(20))), 1, 1) < '2' THEN 'test' WHEN substr(hex256(CAST(conv_id AS VARCHAR(20))), 1, 1) < '4' THEN 'dev' ELSE 'train' END AS split FROM kept""")
add("typo_pair_filter", "tokens", f"WITH {_COST}, f AS (SELECT slip, word, kind, c, CASE WHEN lower(slip) = lower(word) THEN 'case only' WHEN levenshtein(slip, word) > 3 THEN 'too far' WHEN replace(word, 'our', 'or') = slip OR replace(word, 'or', 'our') = slip THEN 'dialect' WHEN c < 25 THEN 'little evidence' WHEN count(*) OVER (PARTITION BY slip) > 3 THEN 'ambiguous' ELSE 'kept' END AS fate FROM cost) SELECT fate, kind, count(*) AS pairs, min(slip) AS example FROM f GROUP BY fate, kind")
# models' decisions -----------------------------------------------------------------------------------------------------------
add("tag_decode", "embeddings", "WITH x AS (SELECT vec_id, label, k, exp(10 * CAST(nth(embedding, k) AS DOUBLE)) AS e FROM (SELECT vec_id, label, embedding, flat(series(1, 16)) AS k FROM {embeddings}) y), p AS (SELECT vec_id, label, k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM x), r AS (SELECT vec_id, label, k, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS place, max(CASE WHEN k = 1 THEN p END) OVER (PARTITION BY vec_id) AS keep FROM p) SELECT vec_id, CAST(k AS BIGINT) AS tag, round(p, 6) AS p, round(keep, 6) AS keep_p, CASE WHEN k = 1 THEN 'keep' WHEN p < 0.2 THEN 'unsure' WHEN keep > 0.5 * p THEN 'close' ELSE 'edit' END AS decision FROM r WHERE place = 1")
add("tone_classes", "tokens", """WITH c AS (SELECT doc_id, CAST(sum(CASE WHEN norm IN ('please', 'thanks', 'kindly', 'the') THEN 1 ELSE 0 END) AS DOUBLE) AS formal, CAST(sum(CASE WHEN tok = '!' OR norm IN ('lol', 'hey', 'yeah') THEN 1 ELSE 0 END) AS DOUBLE) AS casual, CAST(sum(CASE WHEN norm IN ('stupid', 'idiot', 'hate') THEN 1 ELSE 0 END) AS DOUBLE) AS rude, CAST(count(*) AS DOUBLE) AS n FROM {tokens} GROUP BY doc_id),
e AS (SELECT doc_id, 1.0 AS z0, exp(least(20 * formal / n, 20)) AS z1, exp(least(40 * casual / n, 20)) AS z2, exp(least(80 * rude / n, 20)) AS z3 FROM c), p AS (SELECT doc_id, z0 / (z0 + z1 + z2 + z3) AS p0, greatest(z0, z1, z2, z3) AS best, z0, z1, z2, z3 FROM e)
SELECT doc_id, round(1 - p0, 6) AS toned, 1 - p0 >= 0.8 AS flagged, CASE WHEN best = z0 THEN 'plain' WHEN best = z1 THEN 'formal' WHEN best = z2 THEN 'casual' ELSE 'rude' END AS label FROM p""")
add("verdict_cache", "tokens documents", f"WITH {_SENT}, body AS (SELECT s.doc_id AS doc_id, s.k AS k, md5(substr(coalesce(d.text, ''), CAST(s.a AS INT) + 1, CAST(s.b - s.a AS INT))) AS h, s.n AS n FROM sent s JOIN {{documents}} d ON s.doc_id = d.doc_id), once AS (SELECT h, max(n) AS n, count(*) AS uses FROM body GROUP BY h), judged AS (SELECT h, uses, n % 7 AS verdict FROM once) SELECT b.doc_id AS doc_id, count(*) AS sentences, CAST(sum(CASE WHEN j.uses > 1 THEN 1 ELSE 0 END) AS BIGINT) AS from_cache, CAST(sum(j.verdict) AS BIGINT) AS verdicts FROM body b JOIN judged j ON b.h = j.h GROUP BY b.doc_id")
# privacy and reports ---------------------------------------------------------------------------------------------------------
add("sensitive_refusal", "documents", "SELECT doc_id, CASE WHEN rx(text, '(?i)(passport|password|diagnos|salary|social security|api[_ -]?key|secret)') THEN 'refused' WHEN text IS NULL OR trim(text) = '' THEN 'empty' ELSE 'taken' END AS verdict FROM {documents}")
add("client_prefixes", "events", "WITH a AS (SELECT user_id, CAST(ts AS DATE) AS d, concat('2001:db8:', substr(hex256(CAST(user_id % 40 AS VARCHAR(20))), 1, 4), ':', substr(hex256(CAST(user_id % 20 AS VARCHAR(20))), 5, 4), ':', substr(hex256(CAST(event_id AS VARCHAR(20))), 1, 4), '::1') AS ip FROM {events}), n AS (SELECT d, regexp_extract(ip, '^([0-9a-f]+:[0-9a-f]+:[0-9a-f]+:[0-9a-f]+):', 1) AS net FROM a) SELECT CAST(d AS VARCHAR(20)) AS d, substr(hex256(concat('salt|', CAST(d AS VARCHAR(20)), '|', net)), 1, 32) AS client, count(*) AS n FROM n GROUP BY 1, 2")
add("minute_limits", "events", "WITH m AS (SELECT user_id, date_trunc('minute', ts) AS m, count(*) AS n FROM {events} GROUP BY 1, 2) SELECT user_id, CAST(sum(least(n, 4)) AS BIGINT) AS served, CAST(sum(greatest(n - 4, 0)) AS BIGINT) AS refused FROM m GROUP BY user_id")
add("retention_bands", "events", "WITH x AS (SELECT event_type, date_diff_days(CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM {events})) AS age FROM {events}) SELECT event_type, CASE WHEN age < 1 THEN 'counters' WHEN age < 14 THEN 'keys' WHEN age < 180 THEN 'reports' ELSE 'pruned' END AS band, count(*) AS n, CAST(min(age) AS BIGINT) AS youngest FROM x GROUP BY 1, 2")
add("learned_names", "tokens documents", "WITH s AS (SELECT t.norm AS norm, d.source AS app, t.doc_id AS doc_id FROM {tokens} t JOIN {documents} d ON t.doc_id = d.doc_id WHERE rx(t.tok, '^\\p{Lu}\\p{Ll}{2,}\\z') AND t.sent = t.psent), low AS (SELECT DISTINCT norm FROM {tokens} WHERE rx(tok, '^\\p{Ll}')) SELECT s.norm AS name, count(*) AS sightings, count(DISTINCT app) AS apps FROM s LEFT JOIN low ON s.norm = low.norm WHERE low.norm IS NULL GROUP BY s.norm HAVING count(*) >= 3 AND count(DISTINCT doc_id) >= 2")
add("best_reference", "labels documents", "WITH p AS (SELECT d.lang AS lang, d.doc_id AS doc_id, l.quality AS y, l.toxic AS x, CASE WHEN rx(d.text, '(!!|\\||[$%&*#]{3})') THEN 0 ELSE 1 END AS guess FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id), refs AS (SELECT lang, doc_id, 'quality' AS ref, guess, y FROM p UNION ALL SELECT lang, doc_id, 'toxic' AS ref, guess, 1 - x AS y FROM p), f AS (SELECT lang, doc_id, ref, CAST(CASE WHEN guess = y THEN 1 ELSE 0 END AS DOUBLE) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN guess = y THEN 1 ELSE 0 END DESC, ref) AS k FROM refs) SELECT lang, ref, count(*) AS chosen, round(avg(score), 9) AS agreement FROM f WHERE k = 1 GROUP BY lang, ref")
add("threshold_at_rate", "labels documents", "WITH p AS (SELECT d.doc_id AS doc_id, l.quality AS y, CAST(length(regexp_replace(d.text, '[^\\p{L}]', '', 'g')) AS DOUBLE) / greatest(length(d.text), 1) AS score FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL), s AS (SELECT DISTINCT round(score, 6) AS t FROM p), g AS (SELECT round(score, 6) AS t, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos FROM p GROUP BY round(score, 6)), c AS (SELECT t, sum(neg) OVER (ORDER BY t DESC) AS fp, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(neg) OVER () AS negs, sum(pos) OVER () AS poss FROM g) SELECT min(t) AS threshold, CAST(max(fp) AS BIGINT) AS fp, CAST(max(tp) AS BIGINT) AS tp, round(CAST(max(tp) AS DOUBLE) / CAST(max(poss) AS DOUBLE), 9) AS recall FROM c WHERE fp <= 0.05 * negs")
# guards, generators of rules, late reports ----------------------------------------------------------------------------------
add("deferred_edits", "edits", "WITH o AS (SELECT doc_id, s, e, rule_id, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e, rule_id, replacement) AS before_e, lag(rule_id) OVER (PARTITION BY doc_id ORDER BY s, e, rule_id, replacement) AS before_rule FROM {edits}) SELECT rule_id, count(*) AS edits, CAST(sum(CASE WHEN before_rule IN ('spelling.contraction', 'spelling.split_compound', 'spelling.split_word', 'spelling.join_compound') AND s - before_e BETWEEN 0 AND 1 THEN 1 ELSE 0 END) AS BIGINT) AS deferred FROM o GROUP BY rule_id")
add("suggestion_guard", "tokens", f"WITH {_FIT}, one AS (SELECT * FROM best WHERE k = 1), lev AS (SELECT doc_id, norm, max(CASE WHEN rx(tok, '^\\p{{Lu}}') THEN 1 ELSE 0 END) AS high FROM {{tokens}} WHERE isw GROUP BY doc_id, norm), r AS (SELECT o.slip AS slip, o.word AS word, CASE WHEN l.high = 1 THEN 'a name here' WHEN o.second IS NOT NULL AND o.score - o.second < {MARGIN} THEN 'close second' WHEN length(o.slip) < 5 THEN 'short' WHEN replace(o.slip, o.word, '') = 's' OR replace(o.word, o.slip, '') = 's' THEN 'only number' WHEN o.word IN ('not', 'never', 'none', 'nicht', 'nothing') THEN 'negation' WHEN o.score < 1.5 THEN 'little evidence' ELSE 'kept' END AS reason FROM one o JOIN lev l ON o.doc_id = l.doc_id AND o.slip = l.norm) SELECT reason, count(*) AS suggestions, count(DISTINCT slip) AS slips, min(slip) AS example FROM r GROUP BY reason")
add("opener_names", "tokens", "SELECT CASE WHEN prev_n IN ('hi', 'hello', 'dear', 'hey') THEN 'greeting' WHEN prev_n IN ('thanks', 'please', 'sorry') THEN 'courtesy' WHEN prev_n IN ('best', 'regards', 'sincerely', 'cheers') THEN 'closing' WHEN sent <> psent THEN 'sentence' ELSE 'inside' END AS frame, count(*) AS names, count(DISTINCT norm) AS forms, CAST(sum(CASE WHEN next = ',' THEN 1 ELSE 0 END) AS BIGINT) AS before_comma FROM {tokens} WHERE rx(tok, '^\\p{Lu}\\p{Ll}{2,}\\z') GROUP BY 1")
add("sentence_polarity", "tokens", "WITH w AS (SELECT doc_id, sent, CASE WHEN norm IN ('good', 'great', 'nice', 'best', 'thanks', 'gut', 'bien', 'he', 'the') THEN 1 WHEN norm IN ('bad', 'worst', 'hate', 'wrong', 'fail', 'of', 'der') THEN -1 ELSE 0 END AS v, CASE WHEN prev_n IN ('not', 'no', 'never', 'nicht', 'pas', 'and') OR prev2_n IN ('not', 'never') THEN -1 ELSE 1 END AS turn, CASE WHEN norm IN ('about', 'around', 'roughly', 'nearly') THEN 1 ELSE 0 END AS rough FROM {tokens} WHERE isw), s AS (SELECT doc_id, sent, sum(v * turn) AS polarity, sum(CASE WHEN v <> 0 AND turn < 0 THEN 1 ELSE 0 END) AS turned, sum(rough) AS rough FROM w GROUP BY doc_id, sent) SELECT doc_id, CAST(sum(CASE WHEN polarity > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN polarity < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, CAST(sum(turned) AS BIGINT) AS turned, CAST(sum(rough) AS BIGINT) AS rough FROM s GROUP BY doc_id")
_FRAMES = (("could", "{w} of", "{w} have", "I {w} of known"), ("say", "i {w}", "I {w}", "what i {w} now"), ("more", "more {w}er", "{w}er", "a more {w}er one"))
add("generated_rules", "part", f"WITH frame AS {values([(n, a.replace('{w}', '%w%'), b.replace('{w}', '%w%'), c.replace('{w}', '%w%')) for n, a, b, c in _FRAMES], 'family', 'wrong', 'put', 'example')}, word AS (SELECT DISTINCT regexp_extract(p_name, '^[a-z]+', 0) AS w FROM {{part}}), r AS (SELECT concat(family, '.', w) AS id, concat('(^|[^a-z])', replace(wrong, '%w%', w), '([^a-z]|$)') AS pattern, replace(put, '%w%', w) AS replacement, replace(example, '%w%', w) AS positive, replace(put, '%w%', w) AS negative FROM frame CROSS JOIN word) SELECT id, pattern, replacement, rx(positive, pattern) AS finds, NOT rx(negative, pattern) AS spares FROM r")
add("late_reports", "events", "WITH a AS (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS clock FROM {events}) SELECT CAST(CAST(clock AS DATE) AS VARCHAR(20)) AS arrival_day, count(*) AS n, CAST(sum(CASE WHEN ts < clock - INTERVAL 1 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS late, CAST(sum(CASE WHEN CAST(ts AS DATE) < CAST(clock AS DATE) THEN 1 ELSE 0 END) AS BIGINT) AS day_before FROM a GROUP BY 1")
