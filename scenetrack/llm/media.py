"""Media columns: signature sniffing, correction of declared types and carving of embedded media.

An Aho-Corasick automaton finds all magic bytes of a blob in one pass. A validator per format then walks the structure
at each hit (chunk and block lengths, checksums, end marks) and returns where the file ends, or None. The hit at 0 gives
the blob's type; others that hold up are embedded media. A hit inside an accepted file that is not its container's
payload start is skipped.

Defined cases: a null blob has no type and no media; an empty blob likewise; a null text is the empty text; blobs
without valid media keep their declared type, with corrected false; repeated rows are done each; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .textops import map_texts, record_batch

ROW = 64

# Magic bytes of each format.
MAGIC = {
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/gif": b"GIF8",
    "image/jpeg": b"\xff\xd8\xff",
    "image/bmp": b"BM",
    "audio/wav": b"RIFF",
    "application/gzip": b"\x1f\x8b\x08",
    "application/zip": b"PK\x03\x04",
    "application/pdf": b"%PDF-",
}


# -- writers ---------------------------------------------------------------------------------------------------------


def wav(samples: bytes) -> bytes:
    """8-bit mono PCM."""
    pad = len(samples) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def bmp(samples: bytes) -> bytes:
    """8-bit grey, ROW samples a row, top row first."""
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    at = 54 + len(grey)
    head = b"BM" + struct.pack("<IHHI", at + len(samples), 0, 0, at)
    return head + struct.pack("<IiiHHIIiiII", 40, ROW, -(len(samples) // ROW), 1, 8, 0, len(samples), 2835, 2835, 256, 0) + grey + samples


def png(samples: bytes) -> bytes:
    """8-bit grey, ROW samples a row."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))

    rows = np.zeros((len(samples) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return MAGIC["image/png"] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


WRITERS = (("audio/wav", wav), ("image/bmp", bmp), ("image/png", png))


# -- readers of what the writers store -------------------------------------------------------------------------------


def samples_of(kind: str, blob: bytes) -> bytes:
    """The 8-bit samples of a file of one of the WRITERS' formats, from its stored bytes."""
    if kind == "audio/wav":
        at = 12
        while blob[at : at + 4] != b"data":
            n = struct.unpack_from("<I", blob, at + 4)[0]
            at += 8 + n + n % 2
        return blob[at + 8 : at + 8 + struct.unpack_from("<I", blob, at + 4)[0]]
    if kind == "image/bmp":
        at = struct.unpack_from("<I", blob, 10)[0]
        width, height = struct.unpack_from("<ii", blob, 18)
        stride = -(-width // 4) * 4
        rows = np.frombuffer(blob, np.uint8, stride * abs(height), at).reshape(-1, stride)[:, :width]
        return (rows if height < 0 else rows[::-1]).tobytes()
    if kind == "image/png":
        at, body, width = 8, [], 0
        while at < len(blob):
            n, name = struct.unpack_from(">I4s", blob, at)
            if name == b"IHDR":
                width = struct.unpack_from(">I", blob, at + 8)[0]
            elif name == b"IDAT":
                body.append(blob[at + 8 : at + 8 + n])
            at += 12 + n
        rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
        if rows[:, 0].any():
            raise ValueError("only unfiltered rows are written and read here")
        return rows[:, 1:].tobytes()
    raise ValueError(f"no samples in {kind}")


# -- validators: end of the file that begins at a position, or None ---------------------------------------------------


def _u(blob: bytes, at: int, form: str) -> int | None:
    return struct.unpack_from(form, blob, at)[0] if at + struct.calcsize(form) <= len(blob) else None


def end_of_png(blob: bytes, start: int) -> int | None:
    at, first = start + 8, True
    while (n := _u(blob, at, ">I")) is not None and at + 12 + n <= len(blob):
        kind = blob[at + 4 : at + 8]
        if first and (kind != b"IHDR" or n != 13) or zlib.crc32(memoryview(blob)[at + 4 : at + 8 + n]) != _u(blob, at + 8 + n, ">I"):
            return None
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at
    return None


def end_of_wav(blob: bytes, start: int) -> int | None:
    n = _u(blob, start + 4, "<I")
    if n is None or blob[start + 8 : start + 12] != b"WAVE" or start + 8 + n > len(blob):
        return None
    at, end, seen = start + 12, start + 8 + n, set()
    while at + 8 <= end:
        size = _u(blob, at + 4, "<I")
        seen.add(blob[at : at + 4])
        at += 8 + size + size % 2
    return end if at == end and {b"fmt ", b"data"} <= seen else None


def end_of_bmp(blob: bytes, start: int) -> int | None:
    size, pixels, header = _u(blob, start + 2, "<I"), _u(blob, start + 10, "<I"), _u(blob, start + 14, "<I")
    if header is None or header < 40 or header > 124 or start + size > len(blob) or not 14 + header <= pixels <= size:
        return None
    width, height, planes, bits, packed = struct.unpack_from("<iiHHI", blob, start + 18) if start + 34 <= len(blob) else (0,) * 5
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        return None
    return start + size if packed or pixels + (-(-width * bits // 32) * 4) * abs(height) == size else None


def end_of_gif(blob: bytes, start: int) -> int | None:
    if blob[start + 4 : start + 6] not in (b"7a", b"9a") or (flags := _u(blob, start + 10, "B")) is None:
        return None
    at = start + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(at: int) -> int | None:
        while (n := _u(blob, at, "B")) is not None:
            at += 1 + n
            if n == 0:
                return at
        return None

    while at is not None and (kind := _u(blob, at, "B")) is not None:
        if kind == 0x3B:
            return at + 1
        if kind == 0x21:
            at = blocks(at + 2)
        elif kind == 0x2C and (flags := _u(blob, at + 9, "B")) is not None:
            at = blocks(at + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
        else:
            return None
    return None


def end_of_jpeg(blob: bytes, start: int) -> int | None:
    at = start + 2
    while _u(blob, at, "B") == 0xFF and (kind := _u(blob, at + 1, "B")) is not None:
        n = _u(blob, at + 2, ">H")
        if n is None or n < 2 or at + 2 + n > len(blob):
            return None
        at += 2 + n
        if kind == 0xDA:
            while (at := blob.find(b"\xff", at)) >= 0 and (after := _u(blob, at + 1, "B")) is not None:
                if after == 0xD9:
                    return at + 2
                if after not in (0, 0xFF) and not 0xD0 <= after <= 0xD7:
                    break
                at += 1 if after == 0xFF else 2
            if at < 0:
                return None
    return None


def end_of_gzip(blob: bytes, start: int) -> int | None:
    reader = zlib.decompressobj(31)
    piece, at = b"", start
    try:
        while not reader.eof and (piece or at < len(blob)):
            if not piece:
                piece, at = blob[at : at + 65536], at + 65536
            reader.decompress(piece, 1 << 20)
            piece = reader.unconsumed_tail
    except zlib.error:
        return None
    return min(at, len(blob)) - len(reader.unused_data) if reader.eof else None


def zip_ends(blob: bytes) -> dict[int, int]:
    """End of each archive by its start: an end record tells where its archive begins."""
    out: dict = {}
    at = 0
    while (at := blob.find(b"PK\x05\x06", at)) >= 0:
        size, offset, note = _u(blob, at + 12, "<I"), _u(blob, at + 16, "<I"), _u(blob, at + 20, "<H")
        if note is not None and at + 22 + note <= len(blob):
            start = at - offset - size
            if start >= 0 and blob[start + offset : start + offset + 4] == b"PK\x01\x02":
                out.setdefault(start, at + 22 + note)
        at += 4
    return out


def end_of_pdf(blob: bytes, start: int) -> int | None:
    """Up to the end mark of the file, or of the last update appended to it (with objects and a startxref of its own); never
    beyond the next head, so that false heads cost no more than the bytes between them."""
    limit = blob.find(b"%PDF-", start + 5)
    limit = len(blob) if limit < 0 else limit
    end, at = None, start
    while (mark := blob.find(b"%%EOF", at, limit)) >= 0:
        part = blob[at:mark]
        _, found, place = part.rpartition(b"startxref")
        if not found or not place.strip().isdigit() or (end is not None and b" obj" not in part):
            break
        end = at = mark + 5
    return end


VALIDATORS = {
    "image/png": end_of_png,
    "image/gif": end_of_gif,
    "image/jpeg": end_of_jpeg,
    "image/bmp": end_of_bmp,
    "audio/wav": end_of_wav,
    "application/gzip": end_of_gzip,
    "application/pdf": end_of_pdf,
}
_automata: list = []


def automaton() -> ahocorasick.Automaton:
    """Over Latin-1 text, one character per byte; built once in each Python worker."""
    if not _automata:
        built = ahocorasick.Automaton()
        for kind, magic in MAGIC.items():
            built.add_word(magic.decode("latin-1"), (kind, len(magic)))
        built.make_automaton()
        _automata.append(built)
    return _automata[0]


def media_in(blob: bytes | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the valid files in blob, in order, none inside another."""
    out: list = []
    free, zips = 0, None
    for last, (kind, n) in automaton().iter((blob or b"").decode("latin-1")):
        start = last - n + 1
        if start < free:
            continue
        if kind == "application/zip":
            zips = zip_ends(blob) if zips is None else zips
            end = zips.get(start)
        else:
            end = VALIDATORS[kind](blob, start)
        if end is not None:
            out.append((kind, start, end))
            free = end
    return out


def sniff(df: DataFrame, blob: str, declared: str, key: str = "doc_id") -> DataFrame:
    """key, declared, type (corrected where a valid file begins the blob), corrected, media (array of type, start, size, data)."""
    schema = f"{key} {dict(df.dtypes)[key]}, declared string, type string, corrected boolean, media array<struct<type:string,start:long,size:long,data:binary>>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROW):  # a few blobs at a time in memory
                part = batch.slice(at, ROW)
                said = part[declared].to_pylist()
                kinds, media = [], []
                for raw, name in zip(part[blob], said, strict=True):
                    data = raw.as_py()
                    found = media_in(data)
                    kinds.append(found[0][0] if found and found[0][1] == 0 else name)
                    media.append([{"type": k, "start": s, "size": e - s, "data": data[s:e]} for k, s, e in found])
                kind_of = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("data", pa.binary())]))
                yield record_batch({key: part[key], "declared": part[declared], "type": pa.array(kinds, pa.string()), "corrected": pa.array([k != s for k, s in zip(kinds, said, strict=True)], pa.bool_()), "media": pa.array(media, kind_of)})

    return df.select(key, blob, declared).mapInArrow(run, schema)


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % ROW if text else ROW)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, blob (the text's bytes stored as samples in one of three formats), declared (always generic)."""

    def work(rows, texts):
        sizes, blobs = [], []
        for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True):
            payload = payload_of(texts.data[a:b].tobytes())
            sizes.append(int(b - a))
            blobs.append(WRITERS[zlib.crc32(payload) % len(WRITERS)][1](payload))
        return {"doc_id": rows["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "blob": pa.array(blobs, pa.binary()), "declared": pa.array(["application/octet-stream"] * len(sizes))}

    return map_texts(docs.select("doc_id", "text"), "doc_id long, n_bytes long, blob binary, declared string", work)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's payload as read back from the medium that sniffing carves out of its blob."""
    stored = store_texts(table(spark, sf_dir, "documents")).selectExpr("struct(doc_id, n_bytes) as item", "blob", "declared")
    carved = sniff(stored, "blob", "declared", "item")

    def digests(batches):
        for batch in batches:
            out = []
            for item, kind, media in zip(batch["item"], batch["type"], batch["media"], strict=True):
                file = media[0]["data"].as_py()
                samples = samples_of(kind.as_py(), file)
                values = np.frombuffer(samples, np.uint8)
                steps = np.abs(np.diff(values.astype(np.int16)))
                feature = f"{kind}|mean={values.mean():.4f}|std={values.std():.4f}|step={steps.mean():.4f}|levels={np.count_nonzero(np.bincount(values, minlength=256))}"
                out.append((item["doc_id"].as_py(), item["n_bytes"].as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield record_batch({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return carved.mapInArrow(digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
