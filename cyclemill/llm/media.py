"""Media columns by signature sniffing.

An Aho-Corasick automaton finds all magic bytes of all formats in one scan of a blob. At each find the format's validator
walks the structure (chunks, blocks, segments, sizes) and gives the file's length, or none: then the find was chance.
Valid files that do not lie in one found before are carved; one that fills the blob settles its type.

Null and empty blobs hold nothing: type null, no spans. Blobs of no known format keep their declared type. Repeated rows
give a row each; columns of the names given here are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cyclemill.llm.shared import slices, stored, table, utf8, widened


def png(b: bytes, at: int) -> int | None:
    """Chunks with right checksums, IHDR first, up to IEND."""
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + n
        if end > len(b) or (kind == b"IHDR") != first or first and n != 13 or zlib.crc32(b[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        i, first = end, False
    return None


class Finds:
    """Next places of patterns in a blob. A search that begins between an earlier one's begin and its find is known already, so
    many files' searches together read the blob once."""

    def __init__(self, blob: bytes):
        self.blob = blob
        self.known: dict[object, tuple[int, int]] = {}
        #: Of GIF files: where a chain of sub-blocks ends; where the blocks from a place on end (None: nowhere), and if one is an image.
        self.chains: dict[int, int] = {}
        self.blocks: dict[int, tuple[int | None, bool]] = {}

    def next(self, pattern: bytes | re.Pattern, at: int) -> int:
        """-1 if there is none."""
        begin, found = self.known.get(pattern, (0, -2))
        if not (found == -1 or found >= at) or begin > at or found == -2:
            m = pattern.search(self.blob, at) if isinstance(pattern, re.Pattern) else None
            found = (m.start() if m else -1) if isinstance(pattern, re.Pattern) else self.blob.find(pattern, at)
            self.known[pattern] = (at, found)
        return found


def gif(b: bytes, at: int, finds: Finds | None = None) -> int | None:
    """Screen descriptor, blocks of sub-blocks, trailer. Chains of sub-blocks, and of blocks, that another file's search has followed
    already are known."""
    if at + 13 > len(b):
        return None
    finds = finds or Finds(b)
    flags = b[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def past(i: int) -> int:
        way = []
        while i < len(b) and b[i] and i not in finds.chains:
            way.append(i)
            i += b[i] + 1
        end = finds.chains.get(i, i + 1)
        finds.chains.update(dict.fromkeys(way, end))
        return end

    way: list[int] = []  # where blocks begin, and of each whether it is an image
    images: list[bool] = []
    end, later = None, False
    while i < len(b):
        if i in finds.blocks:
            end, later = finds.blocks[i]
            break
        if b[i] == 0x3B:
            end = i + 1
            break
        way.append(i)
        images.append(b[i] == 0x2C)
        if b[i] == 0x21:
            i = past(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            local = b[i + 9]
            i = past(i + 10 + (3 << ((local & 7) + 1) if local & 128 else 0) + 1)
        else:
            break
    for start, image in zip(reversed(way), reversed(images), strict=True):
        later |= image
        finds.blocks[start] = (end, later)
    return end - at if end is not None and later else None


#: What ends the data of a scan: a marker that is no restart, and no 0xFF of the data.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def jpeg(b: bytes, at: int, finds: Finds | None = None) -> int | None:
    """Segments of given lengths up to the scans, and scan data up to the end marker. 0xFF may be repeated before a marker."""
    finds = finds or Finds(b)
    i, frames = at + 2, 0
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xFF:
            i += 1
            continue
        if kind == 0xD9:
            return i + 2 - at if frames else None
        n = struct.unpack_from(">H", b, i + 2)[0]
        if kind < 0xC0 or kind == 0xD8 or n < 2:
            return None
        frames += 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        i += 2 + n
        if kind == 0xDA:
            i = finds.next(_MARKER, i)
            if i < 0:
                return None
            if b[i + 1] == 0xD9:
                return i + 2 - at if frames else None
    return None


def bmp(b: bytes, at: int) -> int | None:
    """Sizes in the headers that agree: file size, start of pixels, rows of pixels."""
    if at + 54 > len(b):
        return None
    size, zero, start, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if zero or planes != 1 or header < 40 or bits not in (1, 4, 8, 16, 24, 32) or packed not in ((0, 3, 6) if bits in (16, 32) else (0,)) or width <= 0 or not height:
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return size if 14 + header <= start and start + rows == size and at + size <= len(b) else None


def wav(b: bytes, at: int) -> int | None:
    """RIFF with chunks that fill it: fmt before data, whole frames."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    i, frame, data = at + 12, 0, False
    while i + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, i)
        if i + 8 + n > end:
            return None
        if kind == b"fmt ":
            frame = struct.unpack_from("<H", b, i + 20)[0] if n >= 16 else 0
        if kind == b"data":
            if not frame or n % frame:
                return None
            data = True
        i += 8 + n + n % 2
    return end - at if data and i in (end, end + 1) else None


def pdf(b: bytes, at: int, finds: Finds | None = None) -> int | None:
    """A version, and sections that end in a cross-reference offset inside the file and the end mark. The first section of a
    file in order for the web has offset 0; further ones are updates; the last one before another file begins ends it."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    finds, end, i = finds or Finds(b), None, at
    another = finds.next(b"%PDF-", at + 5)
    while (mark := finds.next(b"%%EOF", i)) >= 0 and not 0 <= another < mark:
        ref = b.rfind(b"startxref", max(at, mark - 64), mark)
        place = b[ref + 9 : mark].strip() if ref >= 0 else b""
        if not place.isdigit() or int(place) >= mark - at:
            break
        end = i = mark + 5
    return end - at if end else None


#: Magic bytes as the formats fix them, each with its type and validator.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"BM", "image/bmp", bmp),
    (b"RIFF", "audio/wav", wav),
    (b"%PDF-", "application/pdf", pdf),
]


@functools.cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), i)
    found.make_automaton()
    return found


def carve(blob: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of each valid file in blob that is not inside another, in order."""
    out: list[tuple[int, int, str]] = []
    over, finds = 0, Finds(blob)
    for last, i in _automaton().iter(blob.decode("latin-1")):
        magic, kind, valid = SIGNATURES[i]
        at = last + 1 - len(magic)
        if at >= over and (n := valid(blob, at, finds) if valid in (gif, jpeg, pdf) else valid(blob, at)):
            out.append((at, n, kind))
            over = at + n
    return out


SPANS = "array<struct<start: bigint, length: bigint, type: string>>"


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))


def sniff_batches(batches, content: str, declared: str):
    """The batches, in slices, with media_type, type_changed and media_spans."""
    for batch in batches:
        for a, b in slices(batch.column(content)):
            part = batch.slice(a, b - a)
            kinds, changed, spans = [], [], []
            for blob, said in zip(part.column(content).to_pylist(), part.column(declared).to_pylist(), strict=True):
                found = carve(blob) if blob else []
                whole = [k for s, n, k in found if s == 0 and n == len(blob)]
                kind = (whole[0] if whole else said) if blob else None
                kinds.append(kind)
                changed.append(bool(blob) and kind != said)
                spans.append([{"start": s, "length": n, "type": k} for s, n, k in found])
            columns = [*part.columns, pa.array(kinds, pa.string()), pa.array(changed, pa.bool_()), pa.array(spans, _SPAN)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "media_type", "type_changed", "media_spans"])


def sniffed(df: DataFrame, content: str, declared: str) -> DataFrame:
    """df with media_type (corrected), type_changed, and media_spans of embedded files."""
    df = df.drop("media_type", "type_changed", "media_spans")
    return df.mapInArrow(lambda batches: sniff_batches(batches, content, declared), widened(df, f"media_type string, type_changed boolean, media_spans {SPANS}"))


# ---------------------------------------------------------------- bytes as samples

UNIT = 192
RATE = 8000


def padded(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % UNIT if text else UNIT)


def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def to_bmp(payload: bytes) -> bytes:
    """8-bit grey pixels, UNIT to a row, first row on top."""
    rows = len(payload) // UNIT
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 54 + len(palette)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(payload), 0, start, 40, UNIT, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + palette + payload


def to_png(payload: bytes) -> bytes:
    """8-bit grey pixels, UNIT to a row, unfiltered."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    body = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 1)) + chunk(b"IEND", b"")


def samples(media: bytes, kind: str) -> bytes:
    """The samples of a file that to_wav, to_bmp or to_png made."""
    if kind == "audio/wav":
        return media[44 : 44 + struct.unpack_from("<I", media, 40)[0]]
    if kind == "image/bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    if kind == "image/png":
        body, i = b"", 8
        while i < len(media):
            n, name = struct.unpack_from(">I4s", media, i)
            body += media[i + 8 : i + 8 + n] if name == b"IDAT" else b""
            i += 12 + n
        return np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, UNIT + 1)[:, 1:].tobytes()
    raise ValueError(f"no samples are read from {kind}")


_WRITERS = (to_wav, to_bmp, to_png)


#: Of CASES texts by content, one is declared as another format, one lies between other bytes, one in both ways.
CASES = 6
_BEFORE, _AFTER = b"--part\r\n\r\n", b"\r\n--end--\r\n"


def _store(batches):
    """Each text as a file of one of three formats, which its content picks, as is the declared type, wrong ones too, and whether
    the file lies alone in its blob."""
    kinds = ("audio/wav", "image/bmp", "image/png")
    for batch in batches:
        for a, b in slices(batch.column("text")):
            texts = utf8(batch.column("text").slice(a, b - a))
            declared, media = [], []
            for text in texts:
                crc = zlib.crc32(payload := padded(text))
                file, case = _WRITERS[crc % 3](payload), crc // 3 % CASES
                declared.append(kinds[(crc + 1) % 3] if case in (0, 2) else "application/octet-stream" if case in (1, 3) else kinds[crc % 3])
                media.append(_BEFORE + file + _AFTER if case in (1, 2) else file)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])


def _read(batches):
    """The contract's columns from the carved file of each row."""
    for batch in sniff_batches(batches, "media", "declared"):
        rows = []
        for media, spans in zip(batch.column("media").to_pylist(), batch.column("media_spans").to_pylist(), strict=True):
            own, kind = media[spans[0]["start"] : spans[0]["start"] + spans[0]["length"]], spans[0]["type"]
            payload = samples(own, kind)
            level = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            share = level[level > 0] / len(payload)
            feature = f"{kind};units={len(payload)};mean={np.arange(256) @ level / len(payload):.4f};bits={-(share * np.log2(share)).sum():.4f}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(own), hashlib.sha256(own).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column("media_type"), batch.column("type_changed")], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "type_changed"])


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_bytes and media_sha256 are those of the media file as it was carved from its blob; in two of CASES cases the blob that is
    stored has other bytes before and after it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = stored(docs.mapInArrow(_store, "doc_id long, n_bytes long, declared string, media binary"))
    return files.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, type_changed boolean")
