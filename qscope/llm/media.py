"""Media columns by signature sniffing: an Aho-Corasick automaton finds magic bytes, format
validators confirm structure and lengths, declared types are corrected and embedded media
carved."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qscope.llm.common import Scratch

BLOCK = 576
RATE = 8000


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    length: int
    detail: str = ""


def _png(b: memoryview, at: int) -> tuple[int, str] | None:
    pos, detail = at + 8, ""
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + size
        if end > len(b) or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if pos == at + 8:
            if kind != b"IHDR" or size != 13:
                return None
            detail = "%dx%d" % struct.unpack_from(">II", b, pos + 8)
        pos = end
        if kind == b"IEND":
            return pos - at, detail
    return None


def _gif(b: memoryview, at: int) -> tuple[int, str] | None:
    if at + 13 > len(b):
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at, f"{w}x{h}"
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            f = b[pos + 9]
            pos = blocks(pos + 11 + (3 << (f & 7) + 1 if f & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: memoryview, at: int) -> tuple[int, str] | None:
    pos, detail = at + 2, ""
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        kind = b[pos + 1]
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2:
            return None
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and pos + 9 <= len(b):
            h, w = struct.unpack_from(">HH", b, pos + 5)
            detail = f"{w}x{h}"
        pos += 2 + size
        if kind == 0xDA:
            while pos + 1 < len(b):
                if b[pos] == 0xFF and b[pos + 1] == 0xD9:
                    return (pos + 2 - at, detail) if detail else None
                if b[pos] == 0xFF and b[pos + 1] not in (0, 0xFF) and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 1
    return None


def _riff(b: memoryview, at: int) -> tuple[int, str] | None:
    """WAV: fmt before data, chunks that fill the declared size exactly."""
    if at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if bytes(b[at + 8 : at + 12]) != b"WAVE" or end > len(b):
        return None
    pos, fmt, data = at + 12, None, None
    while pos + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + size > end:
            return None
        if kind == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, pos + 8)
        if kind == b"data" and fmt:
            data = size
        pos += 8 + size + (size & 1)
    if fmt is None or data is None or pos not in (end, end + 1) or fmt[4] != fmt[1] * fmt[5] // 8 or not fmt[4] or data % fmt[4]:
        return None
    return end - at, f"{fmt[1]}ch {fmt[2]}Hz {fmt[5]}bit {data // fmt[4]} samples"


def _bmp(b: memoryview, at: int) -> tuple[int, str] | None:
    if at + 54 > len(b):
        return None
    size, _, off, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or head < 40 or not 54 <= off <= size or at + size > len(b) or w <= 0 or not h:
        return None
    return (size, f"{w}x{abs(h)}") if off + (w * bits + 31) // 32 * 4 * abs(h) <= size else None


def _gzip(b: memoryview, at: int) -> tuple[int, str] | None:
    un = zlib.decompressobj(31)
    try:
        n = 0
        pos = at
        while pos < len(b) and not un.eof:
            n += len(un.decompress(bytes(b[pos : pos + 65536])))
            pos += 65536
    except zlib.error:
        return None
    return (min(pos, len(b)) - len(un.unused_data) - at, f"{n} bytes") if un.eof else None


def _zip(b: memoryview, at: int) -> tuple[int, str] | None:
    data = bytes(b[at:])
    pos = data.find(b"PK\x05\x06")
    while pos >= 0:
        if pos + 22 <= len(data):
            count, size, start, note = struct.unpack_from("<HIIH", data, pos + 10)
            if start + size == pos and pos + 22 + note <= len(data) and data[start : start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                return pos + 22 + note, f"{count} entries"
        pos = data.find(b"PK\x05\x06", pos + 1)
    return None


def _pdf(b: memoryview, at: int) -> tuple[int, str] | None:
    data = bytes(b[at:])
    end = data.find(b"%%EOF")
    return (end + 5, data[5:8].decode("latin-1")) if end > 0 and b"startxref" in data[:end] else None


def _flac(b: memoryview, at: int) -> tuple[int, str] | None:
    pos = at + 4
    while pos + 4 <= len(b):
        last, size = b[pos] >> 7, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if pos == at + 4 and (b[pos] & 127 or size != 34):
            return None
        pos += 4 + size
        if last:
            return (len(b) - at, "to the end") if pos + 2 <= len(b) and b[pos] == 0xFF and b[pos + 1] >> 1 == 0x7C else None
    return None


def _ogg(b: memoryview, at: int) -> tuple[int, str] | None:
    pos, pages = at, 0
    while pos + 27 <= len(b) and bytes(b[pos : pos + 5]) == b"OggS\x00":
        n = b[pos + 26]
        size = 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos + size > len(b):
            return None
        pages += 1
        last = b[pos + 5] & 4
        pos += size
        if last:
            return pos - at, f"{pages} pages"
    return None


#: The formats' magic bytes, their media types and validators.
FORMATS: list[tuple[bytes, str, Callable[[memoryview, int], tuple[int, str] | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
]


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind, check in FORMATS:
        a.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    a.make_automaton()
    return a


def scan(data: bytes) -> list[Found]:
    """Validated media in the bytes, by start; what lies inside another is not listed."""
    view, out, end = memoryview(data), [], 0
    for last, (n, kind, check) in automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        if at >= end and (ok := check(view, at)):
            out.append(Found(kind, at, ok[0], ok[1]))
            end = at + ok[0]
    return out


@dataclass(frozen=True)
class Sniffed:
    declared: str | None
    kind: str
    corrected: bool
    detail: str
    carved: tuple[Found, ...]


def sniff(data: bytes | None, declared: str | None = None) -> Sniffed:
    """The type of a value and the media carved from it. A value that is one medium from its
    first byte to its last has that type, whatever was declared; others are text/plain if
    they are UTF-8 without zeros, else application/octet-stream; null and empty: empty."""
    data = data or b""
    found = scan(data)
    if found and found[0].start == 0 and found[0].length == len(data):
        kind, detail, found = found[0].kind, found[0].detail, found[1:]
    else:
        detail = ""
        try:
            kind = "application/x-empty" if not data else "application/octet-stream" if b"\0" in data or data.decode() is None else "text/plain"
        except UnicodeDecodeError:
            kind = "application/octet-stream"
    return Sniffed(declared, kind, declared is not None and declared != kind, detail, tuple(found))


def store(payload: bytes) -> bytes:
    """8-bit mono WAV whose samples are the payload's bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of a stored value, by its own chunk lengths; ValueError if it is none."""
    ok = _riff(memoryview(media), 0) if media[:4] == b"RIFF" else None
    if not ok or ok[0] != len(media):
        raise ValueError("not a stored value")
    pos = 12
    while media[pos : pos + 4] != b"data":
        pos += 8 + struct.unpack_from("<I", media, pos + 4)[0]
    return media[pos + 8 : pos + 8 + struct.unpack_from("<I", media, pos + 4)[0]]


def pad(raw: bytes, block: int = BLOCK) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // block)) * block - len(raw))


SNIFFED = "declared string, kind string, corrected boolean, detail string, carved array<struct<kind: string, start: long, length: long, detail: string, data: binary>>"


def sniff_column(df: DataFrame, column: str, declared: str | None = None, out: str = "sniffed") -> DataFrame:
    """df plus a struct of what each binary or string value is and what is carved from it."""

    @F.udf(SNIFFED)
    def run(value, said):
        raw = value.encode() if isinstance(value, str) else bytes(value or b"")
        s = sniff(raw, said)
        return (s.declared, s.kind, s.corrected, s.detail, [(f.kind, f.start, f.length, f.detail, raw[f.start : f.start + f.length]) for f in s.carved])

    return df.withColumn(out, run(F.col(column), F.col(declared) if declared else F.lit(None).cast("string")))


MEDIA = "doc_id long, n_bytes long, media binary"
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
ROWS = 256


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            rows = []
            part = batch.slice(a, ROWS)
            for doc, n, media in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                media = media.as_py()
                s = sniff(media, "text/plain")
                payload = samples(media)
                inner = scan(payload)
                feature = f"{s.kind}; {s.detail}; declared text/plain {'corrected' if s.corrected else 'kept'}; carved {len(inner)}" + "".join(f" {f.kind}@{f.start}+{f.length}" for f in inner)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in OUT.split(", ")])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            raws = [(t.as_py() or "").encode("utf-8") for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raws), pa.int64()), pa.array([store(pad(r)) for r in raws], pa.binary())], names=["doc_id", "n_bytes", "media"])


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's padded UTF-8 as a stored value."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_write, MEDIA)


def media_digests(docs: DataFrame) -> DataFrame:
    """Each whole text (null: empty) stored as media in a table of the shared folder, read
    back from there, sniffed and digested. Equal texts give equal values; repeated rows and
    null doc_ids pass through; an empty table gives no rows; extra columns are ignored."""
    stored = Scratch(docs.sparkSession).table(write_media(docs))
    return stored.mapInArrow(_read, OUT)
