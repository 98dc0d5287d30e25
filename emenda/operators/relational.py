"""Operators that are plain relational algebra over tokens, documents, events and labels, as SQL for both engines.

Each entry maps a name to its frames and its SQL. Lexicon, frequencies and word pairs are counted from the corpus itself.
"""

from __future__ import annotations

#: Lexicon words come at least so often, and are candidates' targets; words that come at most RARE times may be slips.
COMMON, RARE = 20, 2
#: Pair scores are logarithms over this count.
PAIR_FLOOR = 10
PRIVATE = r"(rx(text, '[0-9]') OR rx(text, '(?i)(https?://|www\.|mailto:)') OR rx(text, '@[A-Za-z0-9_]') OR rx(text, '#[A-Za-z_]') OR rx(text, '(sk|pk|rk)_(live|test)_[A-Za-z0-9]{4}') OR rx(text, '[A-Za-z0-9_+/=-]*[0-9_][A-Za-z0-9_+/=-]{20}'))"

_WORDS = "words AS (SELECT norm AS w, count(*) AS c, count(DISTINCT doc_id) AS docs FROM {tokens} WHERE isw GROUP BY norm)"
_LEX = _WORDS + f", lex AS (SELECT w, c FROM words WHERE c >= {COMMON} AND length(w) BETWEEN 4 AND 14 AND rx(w, '^[a-z]+\\z')), slips AS (SELECT w, c FROM words WHERE c <= {RARE} AND length(w) BETWEEN 5 AND 14 AND rx(w, '^[a-z]+\\z'))"
PAIRS = f"pairs AS (SELECT norm AS a, next_n AS b, count(*) AS c FROM {{tokens}} WHERE isw AND rx(next, '^\\p{{L}}') AND rx(gapn, '^[\\x20\\t]+\\z') GROUP BY norm, next_n)"

SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def add(name: str, frames: str, sql: str) -> None:
    SQL[name] = (tuple(frames.split()), sql)


# lexicon, frequencies, pairs -------------------------------------------------------------------------------------------------
add("word_frequencies", "tokens", f"WITH {_WORDS} SELECT w, c, docs, CAST(round(100 * log10(c * 1000000.0 / (SELECT sum(c) FROM words))) AS BIGINT) AS zipf100 FROM words")
add("frequency_buckets", "tokens", f"WITH {_WORDS}, r AS (SELECT w, c, row_number() OVER (PARTITION BY length(w) ORDER BY c DESC, w) AS k FROM words) SELECT length(w) AS letters, CASE WHEN k <= 10 THEN 'head' WHEN k <= 100 THEN 'common' WHEN k <= 1000 THEN 'mid' ELSE 'rare' END AS bucket, count(*) AS n, CAST(sum(c) AS BIGINT) AS uses FROM r GROUP BY 1, 2")
add("word_pairs", "tokens", f"WITH {PAIRS} SELECT a, b, c, CAST(round(30 * log10(greatest(c, {PAIR_FLOOR}) / {PAIR_FLOOR}.0)) AS BIGINT) AS score FROM pairs WHERE c > 1")
add("canonical_case", "tokens", "SELECT norm AS w, bit_or(CASE WHEN rx(tok, '^\\p{Lu}+\\z') THEN 4 WHEN rx(tok, '^\\p{Lu}') THEN 2 ELSE 1 END) AS flags, max(tok) AS high, min(tok) AS low, count(DISTINCT tok) AS forms FROM {tokens} WHERE isw GROUP BY norm HAVING count(DISTINCT tok) > 1")
add("deletion_index", "tokens", f"WITH {_LEX} SELECT concat(substr(w, 1, k - 1), substr(w, k + 1)) AS d, count(*) AS words, min(w) AS first_word FROM (SELECT DISTINCT w, k FROM (SELECT w, flat(series(1, length(w))) AS k FROM lex) y) x GROUP BY 1")
_CAND = f"""WITH {_LEX}, ld AS (SELECT DISTINCT w, c, concat(substr(w, 1, k - 1), substr(w, k + 1)) AS d FROM (SELECT w, c, flat(series(1, length(w))) AS k FROM lex) x UNION SELECT w, c, w AS d FROM lex),
sd AS (SELECT DISTINCT w, concat(substr(w, 1, k - 1), substr(w, k + 1)) AS d FROM (SELECT w, flat(series(1, length(w))) AS k FROM slips) x UNION SELECT w, w AS d FROM slips),
met AS (SELECT DISTINCT sd.w AS slip, ld.w AS word, ld.c AS c FROM sd JOIN ld ON sd.d = ld.d),
cand AS (SELECT slip, word, c, CASE WHEN length(slip) > length(word) THEN 'extra' WHEN length(slip) < length(word) THEN 'missing' ELSE 'other' END AS kind, abs(length(slip) - length(word)) + 0.3 * CASE WHEN substr(slip, 1, 1) = substr(word, 1, 1) THEN 0 ELSE 1 END AS cost FROM met WHERE levenshtein(slip, word) = 1)"""
add("spelling_candidates", "tokens", f"{_CAND} SELECT slip, kind, count(*) AS words, min(word) AS first_word, CAST(sum(c) AS BIGINT) AS uses FROM cand GROUP BY slip, kind")
add("spelling_best", "tokens", f"{_CAND}, r AS (SELECT slip, word, log10(c) - cost AS score, row_number() OVER (PARTITION BY slip ORDER BY log10(c) - cost DESC, word) AS k, lead(log10(c) - cost) OVER (PARTITION BY slip ORDER BY log10(c) - cost DESC, word) AS second FROM cand) SELECT slip, word, round(score, 6) AS score, second IS NULL OR score - second >= 1.0 AS sure FROM r WHERE k = 1")
#: As _CAND, a swap of neighbours counting as one edit too.
_OSA = f"""{_CAND}, swapped AS (SELECT w AS slip, concat(substr(w, 1, k - 1), substr(w, k + 1, 1), substr(w, k, 1), substr(w, k + 2)) AS word FROM (SELECT w, flat(series(1, length(w) - 1)) AS k FROM slips) x),
osa AS (SELECT slip, word, c, kind, cost FROM cand UNION ALL SELECT s.slip AS slip, l.w AS word, l.c AS c, 'swap' AS kind, 0.3 * CASE WHEN substr(s.slip, 1, 1) = substr(l.w, 1, 1) THEN 0 ELSE 1 END AS cost FROM swapped s JOIN lex l ON s.word = l.w)"""
add("spelling_candidates_osa", "tokens", f"{_OSA} SELECT slip, kind, count(*) AS words, min(word) AS first_word, CAST(sum(c) AS BIGINT) AS uses FROM osa GROUP BY slip, kind")
add("spelling_best_osa", "tokens", f"{_OSA}, r AS (SELECT slip, word, log10(c) - cost AS score, row_number() OVER (PARTITION BY slip ORDER BY log10(c) - cost DESC, word) AS k, lead(log10(c) - cost) OVER (PARTITION BY slip ORDER BY log10(c) - cost DESC, word) AS second FROM osa) SELECT slip, word, round(score, 6) AS score, second IS NULL OR score - second >= 1.0 AS sure FROM r WHERE k = 1")
add("word_splits", "tokens", f"WITH {_WORDS}, short AS (SELECT w, c FROM words WHERE c >= {COMMON} AND length(w) >= 2), rare AS (SELECT w FROM words WHERE c <= {RARE} AND length(w) BETWEEN 6 AND 12), cut AS (SELECT w, substr(w, 1, k) AS a, substr(w, k + 1) AS b FROM (SELECT w, flat(series(2, length(w) - 2)) AS k FROM rare) x), r AS (SELECT cut.w AS w, a, b, least(l.c, m.c) AS weak, row_number() OVER (PARTITION BY cut.w ORDER BY least(l.c, m.c) DESC, a) AS k FROM cut JOIN short l ON cut.a = l.w JOIN short m ON cut.b = m.w) SELECT w, a, b, weak FROM r WHERE k = 1")
add("real_word_slips", "tokens", f"WITH {_WORDS}, {PAIRS}, lex AS (SELECT w, c FROM words WHERE c >= {COMMON} AND length(w) BETWEEN 4 AND 10), del AS (SELECT DISTINCT w, concat(substr(w, 1, k - 1), '_', substr(w, k + 1)) AS d FROM (SELECT w, flat(series(1, length(w))) AS k FROM lex) x), alike AS (SELECT DISTINCT x.w AS w, y.w AS v FROM del x JOIN del y ON x.d = y.d WHERE x.w <> y.w), seen AS (SELECT p.a AS a, p.b AS w, p.c AS c, k.v AS v FROM pairs p JOIN alike k ON p.b = k.w WHERE p.c = 1), better AS (SELECT s.a AS a, s.w AS w, s.v AS v, q.c AS c, row_number() OVER (PARTITION BY s.a, s.w ORDER BY q.c DESC, s.v) AS k FROM seen s JOIN pairs q ON q.a = s.a AND q.b = s.v WHERE q.c >= 5) SELECT a, w, v, c FROM better WHERE k = 1")
# names and languages ---------------------------------------------------------------------------------------------------------
add("name_evidence", "tokens", "WITH n AS (SELECT doc_id, norm, CAST(sum(CASE WHEN rx(tok, '^\\p{Lu}\\p{Ll}') AND sent = psent THEN 1 ELSE 0 END) AS BIGINT) AS inside, CAST(sum(CASE WHEN rx(tok, '^\\p{Ll}') THEN 1 ELSE 0 END) AS BIGINT) AS plain FROM {tokens} WHERE isw GROUP BY doc_id, norm) SELECT doc_id, norm, CASE WHEN inside >= 2 AND plain = 0 THEN 3 WHEN plain = 0 THEN 2 ELSE 1 END AS level, inside, plain FROM n WHERE inside > 0")
add("code_mixed", "tokens", "WITH f AS (SELECT doc_id, sent, count(*) AS words, CAST(sum(CASE WHEN norm IN ('the', 'and', 'of', 'to', 'is', 'by', 'with') THEN 1 ELSE 0 END) AS BIGINT) AS en, CAST(sum(CASE WHEN norm IN ('der', 'die', 'das', 'und', 'ist', 'nicht', 'mit') THEN 1 ELSE 0 END) AS BIGINT) AS de, CAST(sum(CASE WHEN norm IN ('le', 'la', 'les', 'et', 'des', 'une', 'du') THEN 1 ELSE 0 END) AS BIGINT) AS fr FROM {tokens} WHERE isw GROUP BY doc_id, sent) SELECT doc_id, count(*) AS sentences, CAST(sum(CASE WHEN (en > 0 AND de + fr > 0) OR (de > 0 AND fr > 0) THEN 1 ELSE 0 END) AS BIGINT) AS mixed, CAST(sum(CASE WHEN de + fr >= 2 OR (de + fr >= 1 AND 3 * (de + fr) >= words) THEN 1 ELSE 0 END) AS BIGINT) AS foreign_sentences FROM f GROUP BY doc_id")
add("stretched_words", "tokens", "SELECT norm, count(*) AS n FROM {tokens} WHERE isw AND rx(norm, '(" + "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyzäöüéèêçñóíáß") + ")') GROUP BY norm")
# data sets -------------------------------------------------------------------------------------------------------------------
add("same_text_other_label", "documents labels", "WITH n AS (SELECT d.doc_id AS doc_id, lower(regexp_replace(trim(d.text), '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS t, l.quality AS y FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id), g AS (SELECT md5(t) AS t, count(*) AS copies, count(DISTINCT y) AS labels, min(doc_id) AS keep_id FROM n GROUP BY md5(t)) SELECT t, copies, labels, keep_id, labels = 1 AS kept FROM g")
add("decontaminated", "tokens bench", "WITH g AS (SELECT DISTINCT concat(prev3_n, ' ', prev2_n, ' ', prev_n, ' ', norm, ' ', next_n, ' ', next2_n) AS g FROM {bench} WHERE i >= 3 AND next2_n <> ''), h AS (SELECT t.doc_id AS doc_id, count(*) AS hits FROM {tokens} t JOIN g ON concat(t.prev3_n, ' ', t.prev2_n, ' ', t.prev_n, ' ', t.norm, ' ', t.next_n, ' ', t.next2_n) = g.g WHERE t.i >= 3 AND t.next2_n <> '' GROUP BY t.doc_id) SELECT doc_id, hits FROM h")
add("hash_split", "documents", "SELECT doc_id, substr(hex256(text), 64, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS odd_half, substr(hex256(text), 1, 2) < '4d' AS sealed FROM {documents}")
# ranks within parts of a language, after the rows of the parts before: no task gets a whole language
add("every_nth", "documents", "WITH d AS (SELECT doc_id, lang, md5(coalesce(text, '')) AS h FROM {documents}), c AS (SELECT lang, substr(h, 1, 2) AS p, count(*) AS n FROM d GROUP BY lang, substr(h, 1, 2)), a AS (SELECT lang, p, sum(n) OVER (PARTITION BY lang ORDER BY p ROWS UNBOUNDED PRECEDING) - n AS ahead FROM c), r AS (SELECT d.doc_id AS doc_id, a.ahead + row_number() OVER (PARTITION BY d.lang, substr(d.h, 1, 2) ORDER BY d.h, d.doc_id) AS k FROM d JOIN a ON coalesce(d.lang, '') = coalesce(a.lang, '') AND substr(d.h, 1, 2) = a.p) SELECT doc_id, CAST(k AS BIGINT) AS k FROM r WHERE k % 10 = 0")
# privacy ---------------------------------------------------------------------------------------------------------------------
add("looks_private", "documents", f"SELECT doc_id, {PRIVATE} AS private FROM {{documents}}")
add("redacted_text", "documents", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[email]', 'g'), '(https?://|www\\.)[^\\x09-\\x0D\\x20<>]+', '[link]', 'g'), '\\+?\\(?[0-9][0-9 ().-]{5,}[0-9]', '[phone]', 'g'), '[0-9]+([.,:/-][0-9]+)*', '[number]', 'g')) AS redacted FROM {documents}")
add("client_keys", "events", "SELECT user_id, CAST(CAST(ts AS DATE) AS STRING) AS d, substr(hex256(concat('salt|', CAST(CAST(ts AS DATE) AS STRING), '|', CAST(user_id AS STRING))), 1, 32) AS client, count(*) AS n FROM {events} GROUP BY 1, 2, 3")
# reports ---------------------------------------------------------------------------------------------------------------------
_REPORT = "reports AS (SELECT event_type AS rule, user_id % 7 AS original, user_id % 3 AS replacement, CAST(floor(value) AS BIGINT) AS sentence, CAST(ts AS DATE) AS d, week(ts) AS wk, user_id AS app FROM {events} WHERE event_type <> 'signup')"
add("fix_queue", "events", f"WITH {_REPORT}, days AS (SELECT wk, rule, original, replacement, d, count(*) AS n, count(DISTINCT sentence) AS s FROM reports GROUP BY wk, rule, original, replacement, d), spread AS (SELECT wk, rule, original, replacement, count(DISTINCT sentence) AS sentences FROM reports GROUP BY wk, rule, original, replacement), q AS (SELECT days.wk AS wk, days.rule AS rule, days.original AS original, days.replacement AS replacement, CAST(sum(n) AS BIGINT) AS reported, count(*) AS days, CAST(sum(least(s, 3)) AS BIGINT) AS score FROM days GROUP BY days.wk, days.rule, days.original, days.replacement), r AS (SELECT q.wk AS wk, q.rule AS rule, q.original AS original, q.replacement AS replacement, reported, days, score, sentences, row_number() OVER (PARTITION BY q.wk ORDER BY score DESC, days DESC, sentences DESC, q.rule, q.original, q.replacement) AS k FROM q JOIN spread p ON q.wk = p.wk AND q.rule = p.rule AND q.original = p.original AND q.replacement = p.replacement) SELECT CAST(wk AS STRING) AS wk, rule, original, replacement, reported, sentences, days, score, concat('W', lpad(CAST(k AS STRING), 3, '0')) AS id FROM r")
add("queue_apps", "events", f"WITH {_REPORT}, a AS (SELECT rule, original, app, count(*) AS n FROM reports GROUP BY rule, original, app), r AS (SELECT rule, original, app, n, row_number() OVER (PARTITION BY rule, original ORDER BY n DESC, app) AS k FROM a) SELECT rule, original, app AS top_app, n FROM r WHERE k = 1")
add("iso_weeks", "events", "SELECT CAST(week(ts) AS STRING) AS monday, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY 1, 2")
add("daily_caps", "events", "WITH b AS (SELECT CAST(ts AS DATE) AS d, user_id, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) AS mine FROM {events}) SELECT CAST(d AS STRING) AS d, user_id, count(*) AS sent, CAST(sum(CASE WHEN mine <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS accepted FROM b GROUP BY d, user_id")
add("rate_limit", "events", "WITH m AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM {events} GROUP BY 1, 2) SELECT user_id, count(*) AS hours, CAST(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS refused FROM m GROUP BY user_id")
add("retention", "events", "WITH x AS (SELECT event_type, CAST(ts AS DATE) AS d, (SELECT max(CAST(ts AS DATE)) FROM {events}) AS last FROM {events}) SELECT event_type, CAST(sum(CASE WHEN d >= last - INTERVAL 14 DAYS THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN d < last - INTERVAL 14 DAYS THEN 1 ELSE 0 END) AS BIGINT) AS pruned, CAST(min(d) AS STRING) AS oldest FROM x GROUP BY event_type")
add("idempotent_batches", "events", "SELECT user_id, event_type, count(*) AS first_seen FROM (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id, event_type, CAST(floor(value) AS BIGINT) ORDER BY ts, event_id) AS k FROM {events}) x WHERE k = 1 GROUP BY user_id, event_type")
add("trailing_week", "events", "WITH d AS (SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM {events} GROUP BY 1, 2) SELECT CAST(d AS STRING) AS d, event_type, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS week_n FROM d")
# evaluation ------------------------------------------------------------------------------------------------------------------
_GUESS = "p AS (SELECT l.doc_id AS doc_id, d.lang AS lang, d.source AS source, l.quality AS y, CASE WHEN rx(d.text, '(!!|\\||[$%&*#]{3})') THEN 0 ELSE 1 END AS guess FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id), v AS (SELECT lang, source, CASE WHEN y = 0 AND guess = 0 THEN 'fixed' WHEN y = 0 THEN 'missed' WHEN guess = 0 THEN 'false_alarm' ELSE 'clean' END AS verdict, y, guess FROM p)"
add("verdict_rollup", "labels documents", f"WITH {_GUESS} SELECT lang, source, count(*) AS n, CAST(sum(CASE WHEN verdict = 'fixed' THEN 1 ELSE 0 END) AS BIGINT) AS fixed, CAST(sum(CASE WHEN verdict = 'missed' THEN 1 ELSE 0 END) AS BIGINT) AS missed, CAST(sum(CASE WHEN verdict = 'false_alarm' THEN 1 ELSE 0 END) AS BIGINT) AS false_alarms FROM v GROUP BY ROLLUP (lang, source)")
add("breakdowns", "labels documents", f"WITH {_GUESS} SELECT lang, source, verdict, count(*) AS n FROM v GROUP BY GROUPING SETS ((), (lang), (source), (verdict), (lang, verdict))")
add("precision_recall", "labels documents", f"WITH {_GUESS}, s AS (SELECT lang, CAST(sum(CASE WHEN verdict = 'fixed' THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN verdict = 'false_alarm' THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN verdict = 'missed' THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM v GROUP BY lang) SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS p, round(tp / nullif(tp + fn, 0), 9) AS r, round(1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0), 9) AS f05 FROM s")
add("macro_f1", "labels documents", f"WITH {_GUESS}, c AS (SELECT 0 AS k, CAST(sum(CASE WHEN y = 0 AND guess = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN y <> guess THEN 1 ELSE 0 END) AS DOUBLE) AS wrong FROM v UNION ALL SELECT 1 AS k, CAST(sum(CASE WHEN y = 1 AND guess = 1 THEN 1 ELSE 0 END) AS DOUBLE), CAST(sum(CASE WHEN y <> guess THEN 1 ELSE 0 END) AS DOUBLE) FROM v) SELECT round(avg(2 * tp / nullif(2 * tp + wrong, 0)), 9) AS macro_f1, count(*) AS classes FROM c")
add("latency_quantiles", "events", "SELECT event_type, pct(value, 0.5) AS p50, pct(value, 0.95) AS p95, max(value) AS most, count(*) AS n FROM {events} GROUP BY event_type")
add("gates", "events", "WITH d AS (SELECT event_type, user_id % 10 AS layer, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-16' THEN 0 ELSE 1 END AS half, pct(value, 0.5) AS p50, count(*) AS n FROM {events} GROUP BY 1, 2, 3), a AS (SELECT event_type, layer, p50, n FROM d WHERE half = 0), b AS (SELECT event_type, layer, p50, n FROM d WHERE half = 1) SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.layer, b.layer) AS layer, round(a.p50, 6) AS was, round(b.p50, 6) AS now, CASE WHEN a.p50 IS NULL THEN 'new' WHEN b.p50 IS NULL THEN 'gone' WHEN b.p50 > 1.5 * a.p50 + 2 THEN 'slower' ELSE 'ok' END AS gate FROM a FULL JOIN b ON a.event_type = b.event_type AND a.layer = b.layer")
add("false_alarm_rates", "tokens edits", "SELECT rule_id, count(*) AS hits, count(DISTINCT doc_id) AS docs, round(1000.0 * count(*) / (SELECT count(*) FROM {tokens} WHERE isw), 9) AS per_thousand FROM {edits} GROUP BY rule_id")
# tone and meaning ------------------------------------------------------------------------------------------------------------
_FACTS = "f AS (SELECT conv_id, turn, role, regexp_extract_all(text, '[0-9]+([.,:/-][0-9]+)*', 0) AS numbers, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', 0) AS mails, regexp_extract_all(text, '(?i)(^|[^a-z])(not|no|never|nicht|pas|ne)[^a-z]', 0) AS negations, regexp_extract_all(text, '[?]', 0) AS questions, length(text) AS chars FROM {conversations})"
add("tone_facts", "conversations", f"WITH {_FACTS} SELECT conv_id, turn, COUNT_OF(numbers) AS numbers, COUNT_OF(mails) AS mails, COUNT_OF(negations) AS negations, COUNT_OF(questions) AS questions FROM f")
add("facts_kept", "conversations", f"WITH {_FACTS}, n AS (SELECT conv_id, turn, chars, COUNT_OF(questions) AS q, lead(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS next_chars, lead(COUNT_OF(questions)) OVER (PARTITION BY conv_id ORDER BY turn) AS next_q FROM f) SELECT conv_id, turn, next_chars BETWEEN 0.5 * chars AND 1.6 * chars AS in_budget, q > 0 AND next_q = 0 AS question_lost FROM n WHERE next_chars IS NOT NULL")
add("tone_markers", "tokens", "SELECT doc_id, CAST(sum(CASE WHEN norm IN ('please', 'thanks', 'thank', 'kindly', 'sorry') THEN 1 ELSE 0 END) AS BIGINT) AS warm, CAST(sum(CASE WHEN norm IN ('lol', 'gonna', 'wanna', 'idiot', 'stupid', 'hey', 'yeah') THEN 1 ELSE 0 END) AS BIGINT) AS informal, CAST(sum(CASE WHEN tok = '!' THEN 1 ELSE 0 END) AS BIGINT) AS shouts FROM {tokens} GROUP BY doc_id")
# generators and mining -------------------------------------------------------------------------------------------------------
_NOISE = f"""WITH {_WORDS}, plain AS (SELECT w, c, length(w) AS n, 2 + (length(w) * 7 + c) % (length(w) - 3) AS k FROM words WHERE c >= {COMMON} AND length(w) >= 5 AND rx(w, '^[a-z]+\\z')),
noised AS (SELECT w, c, 'omit' AS kind, concat(substr(w, 1, k - 1), substr(w, k + 1)) AS t FROM plain UNION ALL SELECT w, c, 'double', concat(substr(w, 1, k), substr(w, k)) FROM plain UNION ALL SELECT w, c, 'swap', concat(substr(w, 1, k - 1), substr(w, k + 1, 1), substr(w, k, 1), substr(w, k + 2)) FROM plain
 UNION ALL SELECT w, c, 'replace', concat(substr(w, 1, k - 1), 'x', substr(w, k + 1)) FROM plain UNION ALL SELECT w, c, 'insert', concat(substr(w, 1, k), 'q', substr(w, k + 1)) FROM plain UNION ALL SELECT w, c, 'case', concat(upper(substr(w, 1, 1)), substr(w, 2)) FROM plain UNION ALL SELECT w, c, 'split', concat(substr(w, 1, k), ' ', substr(w, k + 1)) FROM plain)"""
add("keystroke_noise", "tokens", f"{_NOISE} SELECT n.w AS w, n.kind AS kind, n.t AS t, v.w IS NOT NULL AS real_word FROM noised n LEFT JOIN words v ON n.t = v.w WHERE n.t <> n.w")
add("typo_miner", "tokens", f"{_NOISE}, e AS (SELECT t, w, kind, c FROM noised WHERE t <> w), share AS (SELECT t, w, kind, c, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY t) AS agree FROM e), j AS (SELECT s.t AS t, s.w AS w, s.kind AS kind, CASE WHEN rx(s.t, '[^a-z]') THEN 'shape' WHEN v.c >= {COMMON} THEN 'word' WHEN levenshtein(s.t, s.w) > 2 THEN 'distance' WHEN agree < 0.9 THEN 'agreement' WHEN s.c < 25 THEN 'evidence' ELSE 'kept' END AS fate FROM share s LEFT JOIN words v ON s.t = v.w) SELECT kind, fate, count(*) AS n, min(t) AS example FROM j GROUP BY kind, fate")

