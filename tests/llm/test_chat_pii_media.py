import hashlib
import random
import re
import time
import zlib

import ahocorasick  # noqa: F401
import duckdb
import pytest

from emenda.llm import chat, media, pii


def turns(*convs):
    return [(c, k, "user" if k % 2 == 0 else "assistant", t, 9) for c, texts in convs for k, t in enumerate(texts)]


def test_collapse_keeps_maximal_conversations(spark):
    rows = turns((1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (4, ["a", "x"]), (5, ["a", "b", "c"]), (6, ["b"]), (7, ["a", "b", None]), (None, ["a", "b", ""]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x_n int")
    got = chat.collapse(df).collect()
    assert {(r.conv_id, r.n_snapshots) for r in got} == {(3, 2), (4, 1), (6, 1), (7, 1), (None, 1)}
    con = duckdb.connect()
    con.register("conversations", df.drop("x_n").toPandas().astype({"conv_id": "Int64"}))
    keep = {r[0] for r in con.execute(chat.ORACLE).fetchall()}
    assert {3, 4, 6, 7} <= keep
    text = {r.conv_id: r.text for r in chat.conversation_texts(chat.collapse(df)).collect()}
    assert text[4] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"


def test_collapse_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 4)
    rows = [(1, k, "user", f"t{k}", 0) for k in range(30)] + [(2, k, "user", f"t{k}", 0) for k in range(11)] + [(3, None, None, None, 0)] * 3 + [(4, 5, "bot", "<|im_end|> hi", 0), (4, 5, "bot", "<|im_end|> hi", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x_group int")
    got = chat.collapse(df).collect()
    assert {r.conv_id for r in got} == {1, 3, 4}
    for c in (1, 3, 4):
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn_index)
        at = 0
        for k, r in enumerate(own):
            assert r.turn_index == k and r.start == at and r.n_turns == len(own)
            at += len(r.rendered)
    assert "<| im_end |> hi" in next(r.rendered for r in got if r.conv_id == 4)
    assert chat.collapse(df.limit(0)).count() == 0


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def spans_of(text):
    out = []
    for k, (name, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, name, m.end()))
    return sorted(out)


def test_base_spans_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "a@b.c..d@e.f", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111", "+1 (017) 555-7713 +49.30.12345678", "😀 x@y.zz 😀 4111111111111111", "1 " * 20000, "x@" + "y." * 20000 + "z", "9" * 50000]
    texts += ["".join(rng.choice("ab@.-_+ 01239é😀()%") for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += [" ".join("".join(rng.choice("0123456789- .") for _ in range(rng.randrange(10, 24))) for _ in range(3)) for _ in range(200)]
    texts += ["a@b.cc " * 300]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, x_sha string")
    got = {r.doc_id: r for r in pii.pii_report(df).collect()}
    for k, t in enumerate(texts):
        want, r = spans_of(t), got[k]
        listed = ",".join(f"{n}:{a}:{b}" for a, _, n, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert ",".join(p for p in r.spans.split(",") if not p.startswith(("term", "secret"))) == listed
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == i for x in want) for i in range(4)]


def test_secrets(spark):
    key, digest = "sk_live_" + "a1b2c3d4" * 3, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'token = "{digest}" and {key}.', "Donaudampfschifffahrtsgesellschaft covid-19-vaccination-report-2021 my_long_function_name_2", "9" * 40, f"x{digest}@example.com", f"é😀{digest}😀"]
    got = [r.spans for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["secret:9:49,secret:55:87", "", "", "email:0:53", "secret:2:42"]
    clean = pii.sanitised(spark.createDataFrame([(0, texts[0])], "doc_id long, text string")).first().text
    assert clean == 'token = "<SECRET>" and <SECRET>.'


def test_terms_that_disclose(spark):
    rows = [(i, f"notes with zorblatt here mail john@corp.example.com now {i}") for i in range(6)] + [(100 + i, f"ordinary notes with here now {i} mail") for i in range(200)] + [(999, "who is Zorblatt then? zorblatts"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_report(df).collect()}
    assert got[999].spans == "term:7:15" and got[100].n_term == 0 and "term:11:19" in got[0].spans
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[999] == "who is <TERM> then? zorblatts" and clean[100] == rows[6][1] and clean[None] is None and "<EMAIL>" in clean[0]


def test_copies_do_not_hide_terms(spark):
    rows = [(1, "one zorblatt john@corp.example.com here"), (2, "two zorblatt john@corp.example.com there")] + [(10 + i, f"ordinary {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} text") for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:4:12" in got[1].spans and "term:4:12" in got[2].spans and got[1299].spans == got[1].spans and got[10].n_term == 0


def test_terms_far_from_the_entity(spark):
    far = " filler" * 20
    rows = [(i, f"zorblatt {far} {'abcdef'[i] * 4} john@corp.example.com {'ghijkl'[i] * 4}") for i in range(6)]
    rows += [(100 + i, f"filler {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} text") for i in range(200)] + [(999, "who is Zorblatt")]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[999].spans == "term:7:15" and "term:0:8" in got[0].spans and got[100].n_term == 0


def test_near_copies_do_not_make_terms(spark):
    pad = " filler" * 20
    rows = [(i, f"zorblatt {pad} same john@corp.example.com words {pad} {'abc'[i] * 4}") for i in range(3)]
    rows += [(50, "other john@corp.example.com place")] + [(100 + i, f"filler {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} text") for i in range(200)]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_term == 0


def test_pii_of_odd_rows(messy, empty):
    assert pii.pii_report(messy).count() == messy.count() and pii.pii_report(empty).count() == 0
    assert pii.sanitised(messy).columns == messy.columns


def test_media_round_trip(spark, messy, empty):
    rows = {r.doc_id: r.text for r in messy.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
    docs = messy.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for r in media.media_report(docs).collect():
        raw = (rows[r.doc_id] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        blob = media.wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest()) and r.feature.startswith("audio/wav;")
    assert media.media_report(messy).count() == messy.count() and media.media_report(empty).count() == 0
    same = media.media_report(messy).groupBy("payload_sha256").agg({"feature": "min"}).count()
    assert same == media.media_report(messy).select("payload_sha256", "feature").distinct().count()


def png():
    import struct

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


@pytest.mark.parametrize("inside", [media.wav(b"abc"), png(), b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"])
def test_carving(inside):
    magics = media.automaton()
    seen = media.inspect(b"junk BM RIFF " + inside + b" tail", "image/png", magics)
    assert seen["kind"] == "application/octet-stream" and seen["corrected"]
    assert [(f.start, f.size) for f in seen["carved"]] == [(13, len(inside))]
    whole = media.inspect(inside, None, magics)
    assert whole["kind"] != "application/octet-stream" and not whole["corrected"]
    assert not media.sniff(inside[:-1], magics) or inside[:4] == b"RIFF"


def test_sniffed_column(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "audio/wav"), (2, None, None), (3, bytearray(b""), "text/plain")], "doc_id int, blob binary, kind string")
    got = {r.doc_id: (r.media_type, r.corrected) for r in media.sniff_column(df, "blob", "kind").collect()}
    assert got == {1: ("image/png", True), 2: ("application/octet-stream", False), 3: ("application/octet-stream", True)}


@pytest.mark.parametrize("unit", [b"%PDF-1.", b"GIF89a\0\0\0\0\0\0\0!\0", b"\xff\xd8\xff\xe0\0\2", b"PK\3\4" + b"\0" * 28, b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"])
def test_blobs_full_of_signatures_take_linear_time(unit):
    magics, took = media.automaton(), []
    for size in (300_000, 3_000_000):
        blob = unit * (size // len(unit))
        start = time.process_time()
        media.sniff(blob, magics)
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0] + 2
