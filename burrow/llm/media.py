"""Media columns: signature sniffing and carving (operator 8).

One Aho-Corasick pass over the bytes finds the magic bytes of all known formats. At each place, the format's
validator follows the structure from there and gives the length of a whole file, or rejects the match. A valid file
at the start corrects the declared type; valid files further in, also inside others, are carved. Texts can be stored as 8-bit mono
WAVE, which keeps every byte, and are read back through the same sniffing.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

U16, U32 = struct.Struct("<H"), struct.Struct("<I")
U16B, U32B = struct.Struct(">H"), struct.Struct(">I")


def png(data: bytes, at: int) -> int:
    """Chunks with right checksums, from IHDR to IEND."""
    end = at + 8
    while end + 12 <= len(data):
        n, kind = U32B.unpack_from(data, end)[0], data[end + 4 : end + 8]
        if end + 12 + n > len(data) or (end == at + 8) != (kind == b"IHDR"):
            return 0
        if zlib.crc32(data[end + 4 : end + 8 + n]) != U32B.unpack_from(data, end + 8 + n)[0]:
            return 0
        end += 12 + n
        if kind == b"IEND":
            return end - at
    return 0


def gif(data: bytes, at: int) -> int:
    """Screen descriptor, then extension and image blocks up to the trailer."""
    if at + 13 > len(data):
        return 0
    flags, end = data[at + 10], at + 13
    end += 3 << ((flags & 7) + 1) if flags & 128 else 0
    while end < len(data):
        kind = data[end]
        if kind == 0x3B:
            return end + 1 - at
        if kind == 0x21:
            end += 2
        elif kind == 0x2C and end + 11 <= len(data):
            flags = data[end + 9]
            end += 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
        else:
            return 0
        while end < len(data) and data[end]:
            end += data[end] + 1
        end += 1
    return 0


def jpeg(data: bytes, at: int) -> int:
    """Marker segments with a frame header, then entropy-coded data up to the end marker."""
    end, framed = at + 2, False
    while end + 2 <= len(data) and data[end] == 0xFF:
        kind = data[end + 1]
        if kind == 0xD9:
            return end + 2 - at if framed else 0
        if end + 4 > len(data):
            return 0
        n = U16B.unpack_from(data, end + 2)[0]
        if n < 2 or kind < 0xC0:
            return 0
        framed |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        end += 2 + n
        if kind == 0xDA:
            while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            if end < 0:
                return 0
    return 0


def riff(data: bytes, at: int) -> int:
    """Chunks that fill the declared size exactly, among them the ones that the form needs."""
    if at + 12 > len(data):
        return 0
    size, form, found = U32.unpack_from(data, at + 4)[0], data[at + 8 : at + 12], set()
    stop, end = at + 8 + size, at + 12
    if stop > len(data):
        return 0
    while end + 8 <= stop:
        n = U32.unpack_from(data, end + 4)[0]
        found.add(data[end : end + 4])
        end += 8 + n + (n & 1)
    needed = {b"WAVE": {b"fmt ", b"data"}, b"AVI ": {b"LIST"}}.get(form)
    if form == b"WEBP":
        needed = found & {b"VP8 ", b"VP8L", b"VP8X"} or {b""}
    return stop - at if end == stop and needed is not None and needed <= found else 0


def bmp(data: bytes, at: int) -> int:
    """A file header whose size, offset and picture header fit together."""
    if at + 30 > len(data):
        return 0
    size, spare, offset, header = (U32.unpack_from(data, at + i)[0] for i in (2, 6, 10, 14))
    planes, bits = U16.unpack_from(data, at + 26)[0], U16.unpack_from(data, at + 28)[0]
    right = header in (40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and not spare
    return size if right and 14 + header <= offset <= size and at + size <= len(data) else 0


def gzip(data: bytes, at: int) -> int:
    """A deflate stream with a right checksum and length."""
    if at + 18 > len(data) or data[at + 2] != 8 or data[at + 3] & 0xE0:
        return 0
    inflate, end = zlib.decompressobj(31), at
    try:
        while not inflate.eof and end < len(data):
            piece = data[end : end + 65_536]
            while piece and not inflate.eof:
                inflate.decompress(piece, 1 << 20)
                piece = inflate.unconsumed_tail
            end += 65_536
    except zlib.error:
        return 0
    return min(end, len(data)) - len(inflate.unused_data) - at if inflate.eof else 0


@functools.lru_cache(maxsize=1)
def _archives(data: bytes) -> dict[int, int]:
    """Where ZIP archives start and stop, by their end records: each says how far before it the central directory and the
    archive start."""
    found, end = {}, data.find(b"PK\x05\x06")
    while end >= 0 and end + 22 <= len(data):
        size, offset = U32.unpack_from(data, end + 12)[0], U32.unpack_from(data, end + 16)[0]
        stop, start = end + 22 + U16.unpack_from(data, end + 20)[0], end - size - offset
        if start >= 0 and data[end - size : end - size + 4] == b"PK\x01\x02" and stop <= len(data):
            found.setdefault(start, stop)
        end = data.find(b"PK\x05\x06", end + 4)
    return found


def zip_archive(data: bytes, at: int) -> int:
    """A local header, and an end record whose central directory starts where it says."""
    return _archives(data).get(at, at) - at


def pdf(data: bytes, at: int) -> int:
    """A version, a start of the cross-reference inside, and the end mark after it."""
    if data[at + 5 : at + 6] not in (b"1", b"2") or data[at + 6 : at + 7] != b".":
        return 0
    again = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, again if again >= 0 else len(data))
    return end + 5 - at if end >= 0 and data.rfind(b"startxref", at, end) >= 0 else 0


def ogg(data: bytes, at: int) -> int:
    """Pages of one stream, in order, up to the page marked last."""
    end, serial, turn = at, None, 0
    while data[end : end + 4] == b"OggS" and end + 27 <= len(data):
        flags, count = data[end + 5], data[end + 26]
        table = data[end + 27 : end + 27 + count]
        stop = end + 27 + count + sum(table)
        if data[end + 4] or len(table) < count or stop > len(data) or (turn == 0) != bool(flags & 2):
            return 0
        if serial not in (None, data[end + 14 : end + 18]) or U32.unpack_from(data, end + 18)[0] != turn:
            return 0
        serial, turn, end = data[end + 14 : end + 18], turn + 1, stop
        if flags & 4:
            return end - at
    return 0


#: Magic bytes, media type, validator.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"RIFF", "", riff),
    (b"BM", "image/bmp", bmp),
    (b"\x1f\x8b\x08", "application/gzip", gzip),
    (b"PK\x03\x04", "application/zip", zip_archive),
    (b"%PDF-", "application/pdf", pdf),
    (b"OggS", "audio/ogg", ogg),
)
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


@functools.cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind, valid in FORMATS:
        found.add_word(magic.decode("latin-1"), (len(magic), kind, valid))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid files in order of their offsets. Those inside another are listed after it; files that
    only overlap an earlier one are not."""
    out, around = [], []
    for end, (n, kind, valid) in _automaton().iter(data.decode("latin-1")):
        at = end - n + 1
        while around and around[-1] <= at:
            around.pop()
        if (length := valid(data, at)) and (not around or at + length <= around[-1]):
            out.append((at, length, kind or RIFF_TYPES[data[at + 8 : at + 12]]))
            around.append(at + length)
    return out


def wave_of(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as the samples of an 8-bit mono WAVE file."""
    pad = len(payload) & 1
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + U32.pack(len(payload))
    return b"RIFF" + U32.pack(len(head) + len(payload) + pad) + head + payload + b"\0" * pad


def samples_of(data: bytes, at: int = 0) -> bytes:
    """The samples of a WAVE file that starts at `at`."""
    stop, end = at + 8 + U32.unpack_from(data, at + 4)[0], at + 12
    while end + 8 <= stop:
        n = U32.unpack_from(data, end + 4)[0]
        if data[end : end + 4] == b"data":
            return data[end + 8 : end + 8 + n]
        end += 8 + n + (n & 1)
    return b""


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, filled with zero bytes to a positive multiple of `unit`, as WAVE.

    A null text is an empty one. Rows with null or repeated ids are each stored; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                media = [wave_of(x + b"\0" * (-len(x) % unit if x else unit)) for x in raw]
                columns = [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


SNIFFED = "struct<sniffed_type: string, sniffed_length: long, corrected: boolean, embedded: array<struct<offset: long, length: long, type: string>>>"


def sniff_media(media: DataFrame, media_col: str = "media", declared_col: str | None = None) -> DataFrame:
    """media with what its bytes show; columns of the same names are replaced.

    sniffed_type and sniffed_length: of a valid file at the start (else null and 0). corrected: it isn't of the type
    that `declared_col` gives. embedded: offset, length and type of the valid files in and after that, to be cut out with
    carve(). Null and empty media have no type and nothing embedded; all rows and other columns stay.
    """

    @F.pandas_udf(SNIFFED)
    def look(data: pd.Series, declared: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, said in zip(data, declared, strict=True):
            found = sniff(raw) if raw else []
            first = found.pop(0) if found and found[0][0] == 0 else (0, 0, None)
            inside = [{"offset": o, "length": n, "type": t} for o, n, t in found]
            rows.append((first[2], first[1], first[2] is not None and said != first[2], inside))
        return pd.DataFrame(rows, columns=["sniffed_type", "sniffed_length", "corrected", "embedded"])

    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    seen = media.withColumn("__seen", look(F.col(media_col), declared))
    for name in ("sniffed_type", "sniffed_length", "corrected", "embedded"):
        seen = seen.withColumn(name, F.col(f"__seen.{name}"))
    return seen.drop("__seen")


def carve(sniffed: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each embedded file, with its bytes in `carved` and offset, length and type in `file`."""
    rows = sniffed.withColumn("file", F.explode("embedded")).drop("embedded")
    return rows.withColumn("carved", F.expr(f"substring(`{media_col}`, int(file.offset) + 1, int(file.length))"))


def read_back(sniffed: DataFrame, media_col: str = "media") -> DataFrame:
    """The digests of WAVE media after reading their bytes back: doc_id, n_bytes, payload and media figures, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, kind, corrected, embedded in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                payload = samples_of(data) if kind == "audio/wav" else b""
                loud = f"{sum(payload) / max(1, len(payload)):.3f}"
                feature = f"{kind}{'*' * bool(corrected)};mean={loud};max={max(payload, default=0)};embedded={embedded}"
                out.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature)
                )
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (i, s, i, i, s, s), strict=True)] if out else [pa.array([], t) for t in (i, s, i, i, s, s)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], [f.split()[0] for f in READ.split(", ")])

    i, s = pa.int64(), pa.string()
    return sniffed.select("doc_id", "n_bytes", media_col, "sniffed_type", "corrected", F.size("embedded")).mapInArrow(run, READ)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
