"""Grammar, clause and mark detectors: what words and marks beside one another tell.

A row: rule id, category, confidence, explanation, what the token must be at least (words, or the name of a shape in ``detect.SHAPES``), the
condition, start, end, replacement. All but the last column of words are SQL that both engines read, over a token and its neighbours.
"""

from __future__ import annotations

from emenda.functions import text as T

#: English irregular verbs as base, past, participle, and forms of a few frequent verbs and nouns.
IRREGULAR = (
    ("go", "went", "gone"), ("see", "saw", "seen"), ("do", "did", "done"), ("take", "took", "taken"), ("eat", "ate", "eaten"), ("write", "wrote", "written"), ("break", "broke", "broken"),
    ("choose", "chose", "chosen"), ("speak", "spoke", "spoken"), ("drive", "drove", "driven"), ("give", "gave", "given"), ("know", "knew", "known"), ("begin", "began", "begun"),
    ("fall", "fell", "fallen"), ("forget", "forgot", "forgotten"), ("grow", "grew", "grown"), ("hide", "hid", "hidden"), ("ride", "rode", "ridden"), ("rise", "rose", "risen"),
    ("shake", "shook", "shaken"), ("sing", "sang", "sung"), ("steal", "stole", "stolen"), ("swim", "swam", "swum"), ("throw", "threw", "thrown"), ("wear", "wore", "worn"), ("draw", "drew", "drawn"),
    ("fly", "flew", "flown"), ("drink", "drank", "drunk"), ("blow", "blew", "blown"),
)
REGULARISED = {
    "buyed": "bought", "catched": "caught", "teached": "taught", "bringed": "brought", "goed": "went", "eated": "ate", "thinked": "thought", "fighted": "fought", "runned": "ran", "keeped": "kept",
    "sleeped": "slept", "feeled": "felt", "leaved": "left", "maked": "made", "sayed": "said", "selled": "sold", "telled": "told", "writed": "wrote", "choosed": "chose", "speaked": "spoke",
}
THIRD = {"go": "goes", "want": "wants", "need": "needs", "like": "likes", "know": "knows", "think": "thinks", "make": "makes", "work": "works", "live": "lives", "look": "looks", "have": "has"}
GERUND = {"go": "going", "see": "seeing", "make": "making", "take": "taking", "read": "reading", "write": "writing", "play": "playing", "work": "working", "talk": "talking", "walk": "walking", "eat": "eating"}
PLURAL = {
    "car": "cars", "problem": "problems", "day": "days", "student": "students", "thing": "things", "year": "years", "book": "books", "word": "words", "reason": "reasons", "friend": "friends",
    "person": "people", "child": "children", "week": "weeks", "month": "months", "question": "questions", "idea": "ideas",
}
MODALS = ("can", "could", "should", "would", "must", "might", "may", "will", "can't", "couldn't", "shouldn't", "wouldn't", "won't")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
ONES = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NOT_ADVERBS = ("family", "early", "only", "daily", "likely", "friendly", "weekly", "monthly", "yearly", "lovely", "july", "fly", "supply", "apply", "reply", "silly", "ugly", "holy")

BLANK = r"rx(gap, '^[\x20\t]+\z')"
BLANK_AFTER = r"rx(gapn, '^[\x20\t]+\z')"
INSIDE = "sent = psent"
STARTS = "sent <> psent"
WORD_AFTER = rf"{BLANK_AFTER} AND rx(next, '^\p{{L}}')"
WORD_BEFORE = rf"{BLANK} AND rx(prev, '\p{{L}}\z') AND {INSIDE}"
#: A clause begins before the word before.
OPENS = "prev2_n IN ('', '.', '!', '?', ',', ';', 'and', 'but', 'because', 'when', 'if', 'that', 'so')"


def mapped(words: dict[str, str], of: str = "norm") -> str:
    return f"CASE {of} " + " ".join(f"WHEN {T.quoted([a])} THEN {T.quoted([b])}" for a, b in words.items()) + " END"


def same_case(word: str) -> str:
    """A replacement that keeps the token's first capital."""
    return rf"(CASE WHEN rx(tok, '^\p{{Lu}}') THEN concat(upper(substr({word}, 1, 1)), substr({word}, 2)) ELSE {word} END)"


PAST_BASE = {past: base for base, past, _ in IRREGULAR}
PAST_PARTICIPLE = {past: participle for _, past, participle in IRREGULAR}
PASTS = tuple(PAST_BASE)
BASE_OF_THIRD = {b: a for a, b in THIRD.items()}
SINGULAR = {b: a for a, b in PLURAL.items()}
_HERE, _G = ("s0", "e0"), "Grammar"
_BEFORE = ("s0 - length(gap)", "s0 - length(gap)")
_PAIR = ("s0 - length(gap) - length(prev)", "e0")
_VERBS = "grammar.{}"

GRAMMAR = (
    # forms of verbs
    ("grammar.perfect_participle", _G, 0.94, "A perfect takes the participle.", PASTS, f"norm IN ({T.quoted(PASTS)}) AND prev_n IN ('have', 'has', 'had', 'haven''t', 'hasn''t', 'hadn''t') AND {WORD_BEFORE} AND NOT (norm = 'saw' AND next_n IN ('blade', 'blades'))", *_HERE, mapped(PAST_PARTICIPLE)),
    ("grammar.contracted_perfect", _G, 0.9, "A contracted have takes the participle.", PASTS, f"norm IN ({T.quoted(PASTS)}) AND prev_n IN ('i''ve', 'we''ve', 'you''ve', 'they''ve') AND {WORD_BEFORE}", *_HERE, mapped(PAST_PARTICIPLE)),
    ("grammar.passive_participle", _G, 0.9, "A passive takes the participle.", PASTS, f"norm IN ({T.quoted([p for p in PASTS if p not in ('saw', 'rose', 'fell', 'hid')])}) AND prev_n IN ('was', 'were', 'been', 'being', 'is', 'are') AND {WORD_BEFORE}", *_HERE, mapped(PAST_PARTICIPLE)),
    ("grammar.auxiliary_base", _G, 0.94, "Do takes the bare verb.", PASTS, f"norm IN ({T.quoted(PASTS)}) AND prev_n IN ('did', 'didn''t', 'does', 'doesn''t', 'don''t') AND {WORD_BEFORE}", *_HERE, mapped(PAST_BASE)),
    ("grammar.modal_base", _G, 0.94, "A modal takes the bare verb.", PASTS, f"norm IN ({T.quoted(PASTS)}) AND prev_n IN ({T.quoted(MODALS)}) AND {WORD_BEFORE}", *_HERE, mapped(PAST_BASE)),
    ("grammar.infinitive_base", _G, 0.92, "To takes the bare verb.", PASTS, f"norm IN ({T.quoted(PASTS)}) AND prev_n = 'to' AND prev2_n IN ('want', 'wants', 'wanted', 'need', 'needs', 'needed', 'going', 'able', 'try', 'tried', 'used', 'decided') AND {WORD_BEFORE}", *_HERE, mapped(PAST_BASE)),
    ("grammar.regularized_past", _G, 0.95, "An irregular verb has its own past.", tuple(REGULARISED), f"norm IN ({T.quoted(REGULARISED)})", *_HERE, same_case(f"({mapped(REGULARISED)})")),
    ("grammar.subject_third", _G, 0.9, "The verb agrees with its subject.", tuple(k for k in THIRD if k != "have"), f"norm IN ({T.quoted([k for k in THIRD if k != 'have'])}) AND prev_n IN ('he', 'she', 'it') AND {OPENS} AND {WORD_BEFORE}", *_HERE, mapped(THIRD)),
    ("grammar.subject_have", _G, 0.9, "The verb agrees with its subject.", ("have",), f"norm = 'have' AND prev_n IN ('he', 'she', 'it', 'everyone', 'someone', 'nobody') AND {OPENS} AND {WORD_BEFORE}", *_HERE, "'has'"),
    ("grammar.subject_base", _G, 0.9, "The verb agrees with its subject.", tuple(BASE_OF_THIRD), f"norm IN ({T.quoted(BASE_OF_THIRD)}) AND prev_n IN ('they', 'we', 'you', 'i') AND {OPENS} AND {WORD_BEFORE} AND NOT (norm IN ('works', 'looks', 'likes') AND prev_n = 'you')", *_HERE, mapped(BASE_OF_THIRD)),
    ("grammar.inverted_subject_agreement", _G, 0.9, "The verb agrees with the subject after it.", ("do", "does"), f"{STARTS} AND ((norm = 'does' AND next_n IN ('they', 'we', 'you', 'i')) OR (norm = 'do' AND next_n IN ('he', 'she', 'it'))) AND {WORD_AFTER}", *_HERE, same_case("(CASE norm WHEN 'does' THEN 'do' ELSE 'does' END)")),
    ("grammar.each_of_agreement", _G, 0.88, "Each of them takes a singular verb.", ("are", "were", "have"), f"norm IN ('are', 'were', 'have') AND prev_n IN ('them', 'us', 'you', 'these', 'those') AND prev2_n = 'of' AND prev3_n IN ('each', 'one', 'neither', 'either') AND {WORD_BEFORE}", *_HERE, "CASE norm WHEN 'are' THEN 'is' WHEN 'were' THEN 'was' ELSE 'has' END"),
    ("grammar.relative_plural", _G, 0.9, "The verb agrees with the noun before who.", ("is", "was", "has"), f"norm IN ('is', 'was', 'has') AND prev_n IN ('who', 'that') AND prev2_n IN ('people', 'children', 'students', 'friends') AND {WORD_BEFORE}", *_HERE, "CASE norm WHEN 'is' THEN 'are' WHEN 'was' THEN 'were' ELSE 'have' END"),
    ("grammar.relative_singular", _G, 0.88, "The verb agrees with the noun before who.", ("are", "were", "have"), f"norm IN ('are', 'were', 'have') AND prev_n = 'who' AND prev2_n IN ('person', 'man', 'woman', 'someone', 'anyone', 'everyone') AND {WORD_BEFORE}", *_HERE, "CASE norm WHEN 'are' THEN 'is' WHEN 'were' THEN 'was' ELSE 'has' END"),
    ("grammar.state_progressive", _G, 0.86, "Verbs of state have no progressive.", ("knowing", "believing", "understanding", "wanting", "needing"), f"norm IN ('knowing', 'believing', 'understanding', 'wanting', 'needing') AND prev_n IN ('am', 'are') AND prev2_n IN ('i', 'we', 'they', 'you') AND {WORD_BEFORE}", *_PAIR, "CASE norm WHEN 'knowing' THEN 'know' WHEN 'believing' THEN 'believe' WHEN 'understanding' THEN 'understand' WHEN 'wanting' THEN 'want' ELSE 'need' END"),
    ("grammar.gerund_complement", _G, 0.9, "Enjoy takes the gerund.", tuple(GERUND), f"norm IN ({T.quoted(GERUND)}) AND prev_n IN ('enjoy', 'enjoys', 'enjoyed', 'avoid', 'avoided', 'finished') AND {WORD_BEFORE} AND norm NOT IN ('work', 'play', 'talk', 'walk')", *_HERE, mapped(GERUND)),
    ("grammar.prepositional_gerund", _G, 0.88, "A preposition takes the gerund.", tuple(GERUND), f"norm IN ({T.quoted([g for g in GERUND if g not in ('work', 'play', 'talk', 'walk')])}) AND prev_n IN ('without', 'instead') AND {WORD_BEFORE}", *_HERE, mapped(GERUND)),
    # words too many or missing
    ("grammar.extra_to", _G, 0.92, "A modal takes no to.", ("to",), f"norm = 'to' AND prev_n IN ('can', 'could', 'should', 'must', 'might') AND {WORD_BEFORE} AND {WORD_AFTER}", "s0 - length(gap)", "e0", "''"),
    ("grammar.missing_to", _G, 0.88, "The verb before takes to.", tuple(GERUND), f"norm IN ({T.quoted(['go', 'see', 'make', 'take', 'read', 'write', 'eat'])}) AND prev_n IN ('want', 'wants', 'wanted', 'decided', 'hoped') AND {WORD_BEFORE}", "s0", "s0", "'to '"),
    ("grammar.can_able", _G, 0.9, "Able needs be.", ("able",), f"norm = 'able' AND prev_n IN ('can', 'could', 'will', 'would', 'should') AND next_n = 'to' AND {WORD_BEFORE}", "s0", "s0", "'be '"),
    ("grammar.used_to", _G, 0.86, "A past habit is written used to.", ("use",), f"norm = 'use' AND next_n = 'to' AND next2_n IN ('be', 'have', 'go', 'live', 'work', 'play', 'like') AND prev_n IN ('i', 'we', 'they', 'he', 'she', 'it', 'you') AND {WORD_BEFORE}", *_HERE, "'used'"),
    ("grammar.extra_be", _G, 0.92, "Agree takes no form of be.", ("agree", "disagree"), f"norm IN ('agree', 'disagree') AND prev_n IN ('am', 'are') AND {WORD_BEFORE}", "s0 - length(gap) - length(prev)", "s0", "''"),
    ("grammar.missing_copula", _G, 0.86, "A form of be is missing.", ("the",), f"norm = 'the' AND prev_n IN ('this', 'that') AND prev2_n IN ('', '.', '!', '?') AND next_n IN ('best', 'worst', 'first', 'last', 'only', 'same') AND {WORD_BEFORE}", "s0", "s0", "'is '"),
    ("grammar.missing_auxiliary", _G, 0.86, "A form of be is missing.", tuple(GERUND.values()), f"norm IN ({T.quoted(GERUND.values())}) AND prev_n IN ('he', 'she') AND prev2_n IN ('', '.', '!', '?') AND {WORD_BEFORE}", "s0", "s0", "'is '"),
    ("grammar.double_conjunction", _G, 0.9, "One conjunction is enough.", ("and", "but", "or"), f"norm IN ('and', 'but', 'or') AND prev_n IN ('and', 'but', 'or') AND norm <> prev_n AND {WORD_BEFORE}", "s0 - length(gap)", "e0", "''"),
    ("grammar.another_article", _G, 0.95, "Another holds its article.", ("another",), f"norm = 'another' AND prev_n IN ('a', 'an') AND {WORD_BEFORE}", "s0 - length(gap) - length(prev)", "s0", "''"),
    # nouns, pronouns, articles
    ("grammar.noun_number", _G, 0.92, "The number asks for a plural.", tuple(PLURAL), f"norm IN ({T.quoted(PLURAL)}) AND prev_n IN ('many', 'several', 'two', 'three', 'four', 'five', 'six', 'these', 'those') AND {WORD_BEFORE} AND next <> '-'", *_HERE, mapped(PLURAL)),
    ("grammar.article_number", _G, 0.88, "One article, one noun.", tuple(SINGULAR), f"norm IN ({T.quoted([x for x in SINGULAR if x not in ('people', 'days')])}) AND prev_n IN ('a', 'an', 'each', 'every') AND {WORD_BEFORE} AND next NOT IN ('''', '’')", *_HERE, mapped(SINGULAR)),
    ("grammar.between_you_i", _G, 0.95, "Between takes me.", ("i",), f"norm = 'i' AND prev_n = 'and' AND prev2_n = 'you' AND prev3_n = 'between' AND {WORD_BEFORE}", *_HERE, "'me'"),
    ("grammar.its_possessive", _G, 0.92, "The possessive has no apostrophe.", ("it's",), f"norm = 'it''s' AND next_n IN ('own', 'name', 'place', 'way', 'size', 'colour', 'color') AND {WORD_AFTER} AND next2_n NOT IN ('is', 'to')", *_HERE, same_case("'its'")),
    ("grammar.pronoun_lowercase", "Capitalization", 0.9, "You is written small inside a sentence.", ("you",), rf"tok = 'You' AND {BLANK} AND {INSIDE} AND rx(prev, '^\p{{Ll}}+\z')", *_HERE, "'you'"),
    # words that are taken for others
    ("grammar.known_as", _G, 0.94, "The participle is known.", ("know",), f"norm = 'know' AND prev_n IN ('also', 'best', 'well', 'better') AND next_n IN ('as', 'for') AND {WORD_BEFORE}", *_HERE, "'known'"),
    ("grammar.participle_adjective", _G, 0.92, "People are interested, things interesting.", ("interesting", "boring", "exciting"), f"((norm = 'interesting' AND next_n = 'in') OR (norm = 'boring' AND next_n = 'with') OR (norm = 'exciting' AND next_n = 'about')) AND prev_n IN ('am', 'are', 'i''m', 'we''re', 'very') AND {WORD_BEFORE}", *_HERE, "CASE norm WHEN 'interesting' THEN 'interested' WHEN 'boring' THEN 'bored' ELSE 'excited' END"),
    ("grammar.adverb_form", _G, 0.9, "A verb takes an adverb.", ("easy", "quick", "quiet", "careful", "clear"), f"norm IN ('easy', 'quick', 'quiet', 'careful', 'clear') AND prev_n IN ('can', 'could', 'will') AND {WORD_BEFORE} AND {WORD_AFTER} AND norm <> 'clear'", *_HERE, "CASE norm WHEN 'easy' THEN 'easily' WHEN 'careful' THEN 'carefully' ELSE concat(norm, 'ly') END"),
    ("grammar.word_form", _G, 0.92, "The adjective is dependent.", ("dependant",), f"norm = 'dependant' AND next_n IN ('on', 'upon') AND {WORD_AFTER}", *_HERE, same_case("'dependent'")),
    ("grammar.lend_borrow", _G, 0.9, "Who gives, lends.", ("borrow",), f"norm = 'borrow' AND next_n IN ('me', 'us', 'him', 'her') AND {WORD_AFTER} AND prev_n IN ('you', 'to', 'please', 'can', 'could')", *_HERE, "'lend'"),
    ("grammar.no_know", _G, 0.94, "The verb is know.", ("no",), f"norm = 'no' AND prev_n IN ('don''t', 'didn''t', 'doesn''t') AND {WORD_BEFORE}", *_HERE, "'know'"),
    ("grammar.of_off", _G, 0.88, "The particle is off.", ("of",), f"norm = 'of' AND prev_n IN ('turned', 'switched', 'switch') AND next_n = 'the' AND {WORD_BEFORE}", *_HERE, "'off'"),
    ("grammar.worst_case", _G, 0.9, "The superlative is worst.", ("worse",), f"norm = 'worse' AND next_n IN ('case', 'enemy') AND {WORD_AFTER} AND prev_n IN ('the', 'my', 'your', 'his', 'her', 'our', 'their')", *_HERE, "'worst'"),
    ("spelling.frequent_word", "Spelling", 0.88, "A frequent word fits here.", ("form", "form", "fro"), f"((norm = 'form' AND prev_n IN ('came', 'comes', 'coming', 'away', 'far', 'received') AND next_n IN ('the', 'a', 'my', 'your', 'his', 'her', 'our', 'their')) OR (norm = 'fro' AND next_n IN ('the', 'a', 'my', 'me', 'you') AND prev_n <> 'and')) AND {WORD_BEFORE}", *_HERE, "CASE norm WHEN 'form' THEN 'from' ELSE 'for' END"),
    ("spelling.split_word", "Spelling", 0.9, "Write as one word.", ("thing", "body", "where"), "norm IN ('thing', 'body', 'where') AND prev_n IN ('every', 'any', 'some') AND gap = ' ' AND NOT (prev_n = 'any' AND norm = 'body' AND next_n = 'of') AND sent = psent", "s0 - length(gap)", "s0", "''"),
    # order of words
    ("grammar.question_order", _G, 0.86, "A question turns subject and verb.", ("are", "is", "were"), f"norm IN ('are', 'is', 'were') AND prev_n IN ('you', 'he', 'she', 'it', 'they', 'we') AND prev2_n IN ('where', 'how', 'why') AND prev3_n IN ('', '.', '!', '?') AND next = '?' AND {WORD_BEFORE}", *_PAIR, "concat(tok, ' ', prev)"),
    ("grammar.adverb_position", _G, 0.84, "The adverb comes before the verb.", ("always", "never", "often"), f"norm IN ('always', 'never', 'often') AND prev_n IN ('go', 'eat', 'read', 'write', 'see', 'make') AND prev2_n IN ('i', 'we', 'they') AND next_n IN ('to', 'the', 'a', 'my', 'our', 'their') AND {WORD_BEFORE}", *_PAIR, "concat(tok, ' ', prev)"),
    # commas and sentence boundaries
    ("punctuation.coordinated_clauses", "Punctuation", 0.88, "A comma parts two clauses.", ("but",), f"norm = 'but' AND next_n IN ('i', 'we', 'they', 'he', 'she') AND {WORD_BEFORE} AND {WORD_AFTER} AND prev2_n <> '' AND prev3_n <> ''", *_BEFORE, "','"),
    ("punctuation.comma_splice", "Punctuation", 0.88, "A semicolon parts two sentences.", ("however", "therefore", "moreover"), "norm IN ('however', 'therefore', 'moreover') AND prev = ',' AND next = ',' AND next2_n IN ('i', 'we', 'they', 'he', 'she', 'it', 'the') AND prev2_n <> 'and' AND sent = psent", "s0 - length(gap) - 1", "s0 - length(gap)", "';'"),
    ("punctuation.run_on", "Punctuation", 0.86, "A semicolon parts two sentences.", ("therefore", "nevertheless"), f"norm IN ('therefore', 'nevertheless') AND {WORD_BEFORE} AND next_n IN ('we', 'they', 'he', 'she', 'i') AND prev_n NOT IN ('and', 'but', 'so', 'that', 'is', 'was', 'are')", *_BEFORE, "';'"),
    ("punctuation.fragment", "Punctuation", 0.84, "A clause with because belongs to the sentence before.", ("because",), f"tok = 'Because' AND prev = '.' AND gap = ' ' AND {STARTS} AND next_n IN ('i', 'we', 'they', 'he', 'she', 'it') AND rx(prev2_n, '^\\p{{L}}+\\z')", "s0 - 2", "s0 + 1", "' b'"),
    ("punctuation.introductory_time", "Punctuation", 0.86, "Set off the time at the beginning.", ("yesterday", "today", "tomorrow"), f"{STARTS} AND norm IN ('yesterday', 'today', 'tomorrow') AND next_n IN ('i', 'we', 'they', 'he', 'she') AND {WORD_AFTER}", "e0", "e0", "','"),
    ("punctuation.parenthetical_comma", "Punctuation", 0.88, "A comma stands on either side.", ("however",), f"norm = 'however' AND next = ',' AND gapn = '' AND {WORD_BEFORE}", *_BEFORE, "','"),
    ("punctuation.date_comma", "Punctuation", 0.94, "A comma parts day and year.", "year", rf"rx(tok, '^(1[89]|20)[0-9]{{2}}\z') AND rx(prev, '^[0-9]{{1,2}}\z') AND prev2_n IN ({T.quoted(MONTHS)}) AND {BLANK}", *_BEFORE, "','"),
    ("punctuation.missing_sentence_boundary", "Punctuation", 0.84, "A sentence ends here.", ("we", "they", "he", "she"), rf"tok IN ('We', 'They', 'He', 'She') AND {BLANK} AND {INSIDE} AND rx(prev, '^\p{{Ll}}{{2,}}\z') AND prev_n NOT IN ('and', 'but', 'that', 'because', 'if', 'when', 'as', 'or', 'so', 'then', 'which')", *_BEFORE, "'.'"),
    ("punctuation.greeting_comma", "Punctuation", 0.9, "A comma follows the greeting.", "line_end", r"rx(tok, '^\p{Lu}\p{Ll}+\z') AND prev_n IN ('hi', 'hello', 'dear', 'hey') AND prev2_n = '' AND rx(gapn, '^\n') AND next <> ''", "e0", "e0", "','"),
    # marks
    ("punctuation.bracket_spacing", "Punctuation", 0.96, "No space inside brackets.", "bracket", rf"prev = '(' AND {BLANK} AND rx(tok, '^[\p{{L}}0-9]')", "s0 - length(gap)", "s0", "''"),
    ("punctuation.bracket_spacing", "Punctuation", 0.96, "No space inside brackets.", "bracket", rf"tok = ')' AND {BLANK} AND rx(prev, '[\p{{L}}0-9]\z')", "s0 - length(gap)", "s0", "''"),
    ("punctuation.bracket_spacing", "Punctuation", 0.94, "A space comes before a bracket.", "bracket", r"tok = '(' AND gap = '' AND rx(prev, '^\p{L}{3,}\z') AND rx(next, '^\p{Ll}{3,}') AND gapn = ''", "s0", "s0", "' '"),
    ("punctuation.ly_hyphen", "Punctuation", 0.9, "An adverb in -ly takes no hyphen.", "adverb", rf"rx(norm, '^[a-z]{{3,}}ly\z') AND norm NOT IN ({T.quoted(NOT_ADVERBS)}) AND next = '-' AND gapn = '' AND rx(next2_n, '^[a-z]+ed\z')", "e0", "e0 + 1", "' '"),
    ("punctuation.number_hyphen", "Punctuation", 0.96, "Numbers of two words take a hyphen.", ONES, f"norm IN ({T.quoted(ONES)}) AND prev_n IN ({T.quoted(TENS)}) AND gap = ' ' AND sent = psent", "s0 - 1", "s0", "'-'"),
    ("punctuation.compound_hyphen", "Punctuation", 0.95, "Relatives by marriage take hyphens.", ("in",), "norm = 'in' AND prev_n IN ('mother', 'father', 'brother', 'sister', 'son', 'daughter') AND next_n = 'law' AND gap = ' ' AND gapn = ' '", "s0 - 1", "e0 + 1", "'-in-'"),
    ("punctuation.colon_after_verb", "Punctuation", 0.88, "A list after a verb takes no colon.", "colon", r"tok = ':' AND prev_n IN ('are', 'include', 'includes', 'were') AND gap = '' AND rx(gapn, '^\x20\z') AND rx(next, '^\p{Ll}')", "s0", "e0", "''"),
)
