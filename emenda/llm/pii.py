"""Personal data: patterns, and information-theoretic sanitisation, by DataFrame operations only.

Patterns find protected entities (e-mail and IP addresses, card and phone numbers, and keys or tokens, which the method adds). How strongly a term reveals one is estimated
from the corpus: PMI(entity; term) = ln(N * df(entity, term) / (df(entity) * df(term))), against the entity's information
IC(entity) = -ln(df(entity) / N). df counts whole texts. A term discloses an entity if PMI >= DISCLOSURE * IC and it has SUPPORT: texts
in which the entity has at least so many different sets of contexts, or so many different contexts close to it; all its occurrences in the corpus are then spans of kind ``term``, to be generalised with the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emenda.llm.common import BROADCAST_BYTES, materialise, sized_broadcast

DISCLOSURE = 0.9
SUPPORT = 2
#: Characters on either side of an entity that make a context; words cut by its edges are completed by so many more.
NEAR, WIDE = 64, 256
CHUNK = 64
WORD = r"\p{L}{3,}"
KINDS = ("email", "ip", "card", "phone", "secret", "term")
SECRET_KIND, TERM_KIND = 4, 5
#: The patterns in forms that Java matches without recursion or rescanning. Starts in the middle of a run of the first class can't
#: match where the run's start didn't, unless an earlier match ends there.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++\.{_LABEL}(?:(?!\.(?!{_LABEL}))[A-Za-z0-9.-])*"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Keys and tokens: long runs of letters and three digits or more. No word of a language looks so, so each is an entity of its own.
SECRET = r"(?<![A-Za-z0-9])(?:(?:sk|pk|rk|gh[opsu]|xox[abp])[_-](?:live_|test_)?)?[A-Za-z0-9]{20,}+"
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"


def positions(text: Column, pattern: Column) -> Column:
    """Matches from left to right as array<struct<s, e, v>>, in code points: gaps and matches alternate, so running sums of lengths give the places.

    Sums run within chunks and then over chunks, so that texts with very many matches don't cost the square of their number.
    """
    gaps, found = F.call_function("split", text, pattern, F.lit(-1)), F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("m"), v.alias("v")))
    spot = "array<struct<s:int,e:int,v:string>>"
    none = F.struct(F.lit(0).alias("p"), F.array().cast(spot).alias("out"))

    def step(acc, x):
        s = acc["p"] + x["g"]
        e = s + x["m"]
        return F.struct(e.alias("p"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"))).cast(spot).alias("out"))

    def joined(acc, c):
        moved = F.transform(c["out"], lambda o: F.struct((o["s"] + acc["p"]).alias("s"), (o["e"] + acc["p"]).alias("e"), o["v"].alias("v")))
        return F.struct((acc["p"] + c["p"]).alias("p"), F.concat(acc["out"], moved).cast(spot).alias("out"))

    # a let-binding: an array of one element, transformed, so that the matches are found once
    def scanned(z):
        z = F.filter(z, lambda x: x["v"].isNotNull())
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")))
        chunks = F.transform(starts, lambda k: F.slice(z, k * CHUNK + 1, CHUNK))
        return F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, none, step)), none, joined)["out"]

    return F.element_at(F.transform(F.array(both), scanned), 1)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Of a string of digits."""
    each = F.transform(F.split(F.reverse(v), ""), lambda c, i: F.when(c == "", 0).otherwise(F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, v>> by start, then kind; cheap conditions come before each pattern."""

    def of(kind: int, may: Column, pattern: str, keep=None) -> Column:
        found = positions(text, F.lit(pattern))
        found = F.filter(found, keep) if keep else found
        shape = "array<struct<s:int,k:int,e:int,v:string>>"
        return F.when(may, F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["v"].alias("v"))).cast(shape)).otherwise(F.array().cast(shape))

    email = of(0, text.contains("@"), EMAIL)
    ip = of(1, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP, lambda x: F.forall(F.split(x["v"], r"\."), lambda p: p.rlike(BYTE)))
    card = of(2, text.rlike(r"[0-9][0-9\x20-]{10,}+(?<=[0-9])|[0-9][0-9\x20-]{10,}[0-9]"), CARD, lambda x: F.when(F.length(_digits(x["v"])).between(12, 19), _luhn(_digits(x["v"]))).otherwise(F.lit(False)))
    phone = of(3, text.contains("+"), PHONE, lambda x: F.length(_digits(x["v"])).between(9, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def entity_spans(text: Column) -> Column:
    """The base spans, and secrets that overlap none of them."""
    shape = "array<struct<s:int,k:int,e:int,v:string>>"
    keyed = lambda x: x["v"].rlike("(?:[0-9][^0-9]*){3}") & x["v"].rlike("[A-Za-z]")
    found = F.transform(F.filter(positions(text, F.lit(SECRET)), keyed), lambda x: F.struct(x["s"].alias("s"), F.lit(SECRET_KIND).alias("k"), x["e"].alias("e"), x["v"].alias("v"))).cast(shape)
    secrets = F.when(text.rlike(r"[A-Za-z0-9]{20}"), found).otherwise(F.array().cast(shape))

    def both(z):
        free = F.filter(z["secrets"], lambda x: ~F.exists(z["base"], lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        return F.array_sort(F.concat(z["base"], free))

    return F.element_at(F.transform(F.array(F.struct(base_spans(text).alias("base"), secrets.alias("secrets"))), both), 1)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _plain(text: Column) -> Column:
    """Words outside e-mail addresses (no other entity has letters) and words of two addresses or more: those that an entity has beside itself."""
    mails = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower))
    parts = F.array_sort(F.flatten(F.transform(mails, _words)))
    shared = F.element_at(F.transform(F.array(parts), lambda z: F.filter(z, lambda w, i: (i > 0) & w.eqNullSafe(F.get(z, i - 1)))), 1)
    return F.when(text.contains("@"), F.array_union(_words(F.regexp_replace(text, EMAIL, " ")), shared)).otherwise(_words(text))


def once(named: DataFrame, seen: DataFrame) -> DataFrame:
    """x_sha, x_text of each different text. Only texts with copies are shuffled, as long as their hashes can be broadcast."""
    copied = materialise(seen.groupBy("x_sha").agg(F.count(F.lit(1)).alias("x_n")).where(F.col("x_n") > 1).select("x_sha"), "copied")
    texts = named.select("x_sha", "x_text")
    if copied.count() * 128 > BROADCAST_BYTES:
        return texts.dropDuplicates(["x_sha"])
    copied = F.broadcast(copied)
    return texts.join(copied, "x_sha", "left_anti").unionByName(texts.join(copied, "x_sha", "left_semi").dropDuplicates(["x_sha"]))


def disclosing_terms(seen: DataFrame, texts: DataFrame) -> DataFrame:
    """x_term for each term that discloses an entity. ``seen``: x_sha, x_spans; ``texts``: x_sha, x_text, each different text once. N and every df count different texts."""
    near = seen.select("x_sha", F.explode("x_spans").alias("x")).select("x_sha", F.concat(F.col("x.k").cast("string"), F.lit(":"), F.lower("x.v")).alias("x_entity"), F.col("x.near").alias("x_near"), F.col("x.context").alias("x_context"))
    entities = near.groupBy("x_entity").agg(F.countDistinct("x_sha").alias("x_de"), F.countDistinct("x_context").alias("x_c")).where(F.col("x_c") >= SUPPORT)
    near = near.join(entities.select("x_entity"), "x_entity", "left_semi")
    close = near.select("x_entity", "x_context", F.explode(_words(F.col("x_near"))).alias("x_term")).groupBy("x_entity", "x_term").agg(F.countDistinct("x_context").alias("x_c"))
    close = close.where(F.col("x_c") >= SUPPORT).select("x_entity", "x_term", F.lit(True).alias("x_close"))
    own = near.select("x_sha", "x_entity", "x_context").distinct().groupBy("x_sha", "x_entity").agg(F.bit_xor("x_context").alias("x_places"))
    own = materialise(own, "own")
    holders = materialise(own.select("x_sha").distinct(), "holders")
    held = texts.join(sized_broadcast(holders, 128), "x_sha", "left_semi").select("x_sha", _words(F.col("x_text")).alias("x_all"), _plain(F.col("x_text")).alias("x_plain"))
    named = F.array_union("x_plain", F.array_except("x_all", _words(F.substring("x_entity", 3, 1 << 30))))
    pairs = held.join(own, "x_sha").select("x_entity", "x_places", F.explode(named).alias("x_term"))
    pairs = pairs.groupBy("x_entity", "x_term").agg(F.count(F.lit(1)).alias("x_both"), F.countDistinct("x_places").alias("x_c"))
    pairs = pairs.join(close, ["x_entity", "x_term"], "left").where((F.col("x_c") >= SUPPORT) | F.col("x_close"))
    pairs = materialise(pairs.join(entities.select("x_entity", "x_de"), "x_entity").select("x_entity", "x_term", "x_both", "x_de"), "pairs")
    wanted = materialise(pairs.select("x_term").distinct(), "wanted")
    words = texts.select(F.explode(_words(F.col("x_text"))).alias("x_term"))
    if wanted.count() * 64 <= BROADCAST_BYTES:
        counts = words.join(F.broadcast(wanted), "x_term", "left_semi").groupBy("x_term").agg(F.count(F.lit(1)).alias("x_dt"))
    else:
        counts = words.groupBy("x_term").agg(F.count(F.lit(1)).alias("x_dt")).join(wanted, "x_term", "left_semi")
    total = seen.select("x_sha").distinct().count()
    gain = F.log(F.lit(float(max(total, 1))) * F.col("x_both") / (F.col("x_de") * F.col("x_dt")))
    worth = F.log(F.lit(float(max(total, 1))) / F.col("x_de"))
    return pairs.join(counts, "x_term").where((worth > 0) & (gain >= DISCLOSURE * worth)).select("x_term").distinct()


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, terms): for each row x_key, x_sha, x_spans (base), x_terms (array<struct<s, e>>); and the disclosing terms.

    Null counts as empty. N, df(term), df(entity) and df(entity, term) all count different texts, so copies neither make a term disclosing nor hide
    one. Nothing depends on the key. No rows give no rows.
    """
    named = docs.select(F.col(key).alias("x_key"), F.coalesce(F.col(text), F.lit("")).alias("x_text")).withColumn("x_sha", F.sha2(F.col("x_text").cast("binary"), 256))
    window = lambda x: F.substring(F.col("x_text"), F.greatest(x["s"] - NEAR, F.lit(0)) + 1, F.least(x["s"], F.lit(NEAR)))
    after = lambda x: F.substring(F.col("x_text"), x["e"] + 1, F.lit(NEAR))
    # the rest of words that the window's edges cut
    head = lambda x: F.when(window(x).rlike(r"^\p{L}"), F.regexp_extract(F.substring(F.col("x_text"), F.greatest(x["s"] - NEAR - WIDE, F.lit(0)) + 1, F.least(F.greatest(x["s"] - NEAR, F.lit(0)), F.lit(WIDE))), r"\p{L}+\z", 0)).otherwise("")
    tail = lambda x: F.when(after(x).rlike(r"\p{L}\z"), F.regexp_extract(F.substring(F.col("x_text"), x["e"] + NEAR + 1, F.lit(WIDE)), r"^\p{L}+", 0)).otherwise("")
    spans = F.transform(
        F.col("x_base"),
        lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v"), F.concat(head(x), window(x), F.lit(" "), after(x), tail(x)).alias("near"), F.xxhash64(F.concat(window(x), F.lit(" "), after(x))).alias("context")),
    )
    seen = named.withColumn("x_base", entity_spans(F.col("x_text"))).select("x_key", "x_sha", spans.alias("x_spans"))
    seen = materialise(seen, "seen")
    terms = materialise(disclosing_terms(seen, once(named, seen)), "terms")
    if not terms.limit(1).count():
        return seen.withColumn("x_terms", F.array().cast("array<struct<s:int,e:int>>")), terms
    hits = named.select("x_sha", F.explode(_words(F.col("x_text"))).alias("x_term")).join(sized_broadcast(terms), "x_term").distinct()
    hits = materialise(hits.groupBy("x_sha").agg(F.collect_set("x_term").alias("x_own")), "hits")  # at most a text's own words
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort("x_own"), "|"), F.lit(r")(?!\p{L})"))
    where = named.join(sized_broadcast(hits, 512), "x_sha").select("x_sha", F.transform(positions(F.col("x_text"), pattern), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("x_terms"))
    where = where.groupBy("x_sha").agg(F.first("x_terms").alias("x_terms"))  # copies have the same
    rows = seen.join(where, "x_sha", "left").withColumn("x_terms", F.coalesce("x_terms", F.array().cast("array<struct<s:int,e:int>>")))
    free = F.filter("x_terms", lambda t: ~F.exists("x_spans", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return rows.withColumn("x_terms", free), terms


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("x_spans", lambda x: x["k"] == kind)).cast("long")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term for each row of documents.

    Null counts as empty. Texts of any length are searched whole. Repeated rows and equal texts get equal values; no rows give no rows.
    """
    rows, _ = find(docs)
    number = [_count(k).alias(f"n_{n}") for k, n in enumerate(KINDS[:4])]
    bare = F.transform("x_spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    base = F.filter(bare, lambda x: x["k"] < SECRET_KIND)
    term = F.transform("x_terms", lambda x: F.struct(x["s"].alias("s"), F.lit(TERM_KIND).alias("k"), x["e"].alias("e")))
    return rows.select(F.col("x_key").alias("doc_id"), *number, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.array_sort(F.concat(bare, term))).alias("spans"), _count(SECRET_KIND).alias("n_secret"), F.size("x_terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns as they were, with each span in ``text`` replaced by its kind in angle brackets; overlapping spans take the first one's kind."""
    rows, _ = find(docs, key, text)
    names = docs.columns
    spans = rows.groupBy("x_sha").agg(F.first("x_spans").alias("x_spans"), F.first("x_terms").alias("x_terms")).where((F.size("x_spans") > 0) | (F.size("x_terms") > 0))
    every = F.array_sort(F.concat(F.transform("x_spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))), F.transform("x_terms", lambda x: F.struct(x["s"].alias("s"), F.lit(TERM_KIND).alias("k"), x["e"].alias("e")))))
    spans = materialise(spans.select("x_sha", every.alias("x_every")), "spans")
    inner = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).withColumn("x_sha", F.sha2(F.coalesce(F.col(f"c{names.index(text)}"), F.lit("")).cast("binary"), 256))
    body = F.col(f"c{names.index(text)}")
    mark = F.array(*[F.lit(f"<{n.upper()}>") for n in KINDS])
    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.concat(F.substring(body, acc["p"] + 1, x["s"] - acc["p"]), F.element_at(mark, x["k"] + 1))
        return F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.when(x["s"] < acc["p"], acc["out"]).otherwise(F.array_append(acc["out"], gap)).alias("out"))

    clean = F.aggregate("x_every", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["p"] + 1, F.length(body))))
    joined = inner.join(sized_broadcast(spans, 256), "x_sha", "left").withColumn("x_clean", F.when(F.col("x_every").isNotNull(), clean).otherwise(body))
    return joined.select(*[(F.col("x_clean") if n == text else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
