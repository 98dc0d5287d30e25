"""Media columns: signature sniffing, format validation and carving.

An Aho-Corasick automaton finds magic bytes anywhere in a blob. A format's validator then confirms structure and length, so a
declared type can be corrected and media inside a blob carved out. The formats written here keep bytes
losslessly as 8-bit samples.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emenda.llm.common import table_batches, to_python, released

UNIT = 192
RATE = 8000


@dataclass(frozen=True)
class Found:
    """A valid medium in a blob: format, where it starts, its length, and where its samples are."""

    kind: str
    start: int
    size: int
    body: tuple[int, int]


def wav(payload: bytes) -> bytes:
    """The payload as 8-bit mono PCM in a RIFF file (chunks are padded to even lengths)."""
    n = len(payload)
    pad = n % 2
    head = b"RIFF" + struct.pack("<I", 36 + n + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)
    return head + payload + b"\0" * pad


class Blob:
    """A blob's bytes with what validators share: the places of end marks, found once, and chains of blocks, followed once.

    A blob in which a signature comes very often is so read a few times in all, and not once for each place.
    """

    def __init__(self, data: bytes):
        self.data, self.marks, self.ends = data, {}, {}

    def next(self, mark: bytes, start: int) -> int:
        """The first place of ``mark`` from ``start`` on, or -1."""
        if mark not in self.marks:
            places, at = [], self.data.find(mark)
            while at >= 0:
                places.append(at)
                at = self.data.find(mark, at + 1)
            self.marks[mark] = places
        places = self.marks[mark]
        k = bisect.bisect_left(places, start)
        return places[k] if k < len(places) else -1

    def follow(self, kind: str, p: int, step) -> int:
        """Where a chain of blocks from ``p`` on ends, or -1. ``step(p)``: (next place or -1, whether the chain ends there)."""
        ends, passed = self.ends.setdefault(kind, {}), []
        while p >= 0 and p not in ends:
            passed.append(p)
            p, last = step(p)
            if last:
                break
        else:
            p = ends[p] if p >= 0 else -1
        for q in passed:
            ends[q] = p
        return p


def _wav(blob: Blob, at: int) -> Found | None:
    b = blob.data
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    p, coded = at + 12, False
    while p + 8 <= end:
        name, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return None
        if name == b"fmt ":
            coded = n >= 16 and struct.unpack_from("<H", b, p + 8)[0] in (1, 3, 6, 7, 0xFFFE)
        if name == b"data":
            return Found("audio/wav", at, end - at, (p + 8, p + 8 + n)) if coded else None
        p += 8 + n + n % 2
    return None


def _png(blob: Blob, at: int) -> Found | None:
    b = blob.data
    if b[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return None

    def step(p: int) -> tuple[int, bool]:
        if p + 12 > len(b):
            return -1, True
        n = struct.unpack_from(">I", b, p)[0]
        stop = p + 12 + n
        if stop > len(b) or zlib.crc32(memoryview(b)[p + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return -1, True
        return stop, b[p + 4 : p + 8] == b"IEND"

    end = blob.follow("png", at + 8, step)
    return Found("image/png", at, end - at, (at, end)) if end >= 0 else None


def _gif(blob: Blob, at: int) -> Found | None:
    b = blob.data
    if len(b) - at < 14:
        return None

    def data(p: int) -> tuple[int, bool]:
        if p >= len(b):
            return -1, True
        return p + b[p] + 1, not b[p]

    def step(p: int) -> tuple[int, bool]:
        if p >= len(b):
            return -1, True
        if b[p] == 0x3B:
            return p + 1, True
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 11 <= len(b):
            own = b[p + 9]
            p += 11 + (3 << ((own & 7) + 1) if own & 128 else 0)
        else:
            return -1, True
        p = blob.follow("gif data", p, data)
        return p, p < 0

    flags = b[at + 10]
    end = blob.follow("gif", at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0), step)
    return Found("image/gif", at, end - at, (at, end)) if end >= 0 else None


def _jpeg(blob: Blob, at: int) -> Found | None:
    b = blob.data

    def step(p: int) -> tuple[int, bool]:
        if p + 4 > len(b) or b[p] != 0xFF or b[p + 1] in (0x00, 0xFF):
            return -1, True
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return -1, True
        if b[p + 1] != 0xDA:
            return p + 2 + n, False
        end = blob.next(b"\xff\xd9", p + 2 + n)
        return (end + 2 if end >= 0 else -1), True

    end = blob.follow("jpeg", at + 2, step)
    return Found("image/jpeg", at, end - at, (at, end)) if end >= 0 else None


def _bmp(blob: Blob, at: int) -> Found | None:
    b = blob.data
    if len(b) - at < 54:
        return None
    size, zero, body, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or planes != 1 or head not in (40, 108, 124) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or not 14 + head <= body <= size <= len(b) - at:
        return None
    if body + (width * bits + 31) // 32 * 4 * abs(height) > size:
        return None
    return Found("image/bmp", at, size, (at + body, at + size))


def _pdf(blob: Blob, at: int) -> Found | None:
    b = blob.data
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    end, table = blob.next(b"%%EOF", at), blob.next(b"startxref", at)
    return Found("application/pdf", at, end + 5 - at, (at, end + 5)) if 0 <= table < end else None


def _zip(blob: Blob, at: int) -> Found | None:
    b = blob.data
    if len(b) - at < 30:
        return None
    end = blob.next(b"PK\5\6", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start = struct.unpack_from("<II", b, end + 12)
    stop = end + 22 + struct.unpack_from("<H", b, end + 20)[0]
    if stop > len(b) or at + start + size != end or b[at + start : at + start + 4] != b"PK\1\2":
        return None
    return Found("application/zip", at, stop - at, (at, stop))


def _gzip(blob: Blob, at: int) -> Found | None:
    b = blob.data
    if len(b) - at < 18 or b[at + 3] & 0xE0:
        return None
    unpack = zlib.decompressobj(31)
    try:
        p = at
        while not unpack.eof and p < len(b):
            unpack.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return None
    end = min(p, len(b)) - len(unpack.unused_data)
    return Found("application/gzip", at, end - at, (at, end)) if unpack.eof else None


#: Magic bytes of the formats, and what confirms them.
SIGNATURES = {
    b"RIFF": _wav,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"%PDF-": _pdf,
    b"PK\3\4": _zip,
    b"\x1f\x8b\x08": _gzip,
}


def automaton() -> ahocorasick.Automaton:
    """Over bytes as the characters with their numbers."""
    out = ahocorasick.Automaton()
    for magic in SIGNATURES:
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def sniff(blob: bytes, magics: ahocorasick.Automaton) -> list[Found]:
    """Valid media in a blob, by start; ones inside another follow it, but what stands in gzip's compressed bytes doesn't count."""
    out, shared, packed = [], Blob(blob), 0
    for last, magic in magics.iter(blob.decode("latin-1")):
        start = last - len(magic) + 1
        found = SIGNATURES[magic](shared, start) if start >= packed else None
        if found:
            out.append(found)
            if found.kind == "application/gzip":
                packed = start + found.size
    return sorted(out, key=lambda f: (f.start, -f.size))


def features(samples: bytes, kind: str, carved: list[Found]) -> str:
    """Format, seconds, mean, deviation and zero crossings of the samples, and the media inside, as one string."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    total, values = max(1, len(x)), np.arange(256)
    mean = float((counts * values).sum() / total)
    deviation = float((counts * (values - mean) ** 2).sum() / total) ** 0.5
    crossings = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    inside = "+".join(f"{f.kind}@{f.start}:{f.size}" for f in carved) or "none"
    return f"{kind};samples={len(x)};seconds={len(x) / RATE:.4f};mean={mean:.4f};deviation={deviation:.4f};crossings={crossings};carved={inside}"


def stored(text: bytes) -> bytes:
    """The stored form of a text: bytes 32 up to a positive multiple of UNIT, as 8-bit samples."""
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return wav(text.ljust(size))


def inspect(blob: bytes | None, declared: str | None, magics: ahocorasick.Automaton) -> dict:
    """What a blob really is: the type found at its start (else application/octet-stream), whether the declared one was wrong, its samples' place, and the media inside it."""
    blob = blob or b""
    found = sniff(blob, magics)
    whole = next((f for f in found if f.start == 0), None)
    kind = whole.kind if whole else "application/octet-stream"
    return {"kind": kind, "corrected": kind != (declared or kind), "body": whole.body if whole else (0, len(blob)), "carved": [f for f in found if f is not whole]}


def sniff_column(table: DataFrame, blob: str, declared: str | None = None, key: str = "doc_id") -> DataFrame:
    """For any table with a binary column: key, media_type, corrected, carved (array of type, start, size). Null blobs are empty; nothing is dropped."""
    shape = f"{key} {table.select(key).schema[0].dataType.simpleString()}, media_type string, corrected boolean, carved array<struct<media_type:string,start:long,size:long>>"

    def run(batches):
        magics = automaton()
        for batch in table_batches(batches):
            rows = [inspect(b, d, magics) for b, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            carved = [[{"media_type": f.kind, "start": f.start, "size": f.size} for f in r["carved"]] for r in rows]
            inner = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("size", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r["kind"] for r in rows], pa.string()), pa.array([r["corrected"] for r in rows], pa.bool_()), pa.array(carved, inner)], [key, "media_type", "corrected", "carved"])

    said = F.col(declared) if declared else F.lit(None)
    return to_python(table).select(key, F.col(blob).cast("binary"), said.cast("string").alias("x_declared")).mapInArrow(released(run), shape)


def media_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each whole text as samples, find them again by sniffing the stored bytes, and describe them.

    Null is empty, and an empty text is one unit of spaces. Columns: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32 (of the last 16 bytes read back), media_bytes, media_sha256, feature. All but doc_id depend on the text alone, so repeated rows
    get equal rows. Texts of any length are read whole, one at a time at least. No rows give no rows.
    """

    def run(batches):
        magics = automaton()
        for batch in table_batches(batches):
            out = [[] for _ in range(7)]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                text = text or b""
                blob = stored(text)
                seen = inspect(blob, "application/octet-stream", magics)
                payload = blob[slice(*seen["body"])]
                row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), features(payload, seen["kind"], seen["carved"]))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(out, kinds, strict=True)]], ["doc_id", *names])

    kind = docs.select(key).schema[0].dataType.simpleString()
    shape = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return to_python(docs).select(F.col(key).alias("doc_id"), F.col(text)).mapInArrow(released(run), shape)
