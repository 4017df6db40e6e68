"""Benchmark decontamination: q-gram lemma filter over diagonal bands, verified by banded alignment.

Items and documents are compared as code points, lower case, runs of white space as one blank. Items are cut into
windows of WINDOW characters, half overlapping. A region of a document that matches a window of m characters with at most
k = m // EDITS_PER edits shares at least m + 1 - q(k + 1) q-grams with it on k + 1 neighbouring diagonals. Shared q-grams
are counted in bands of 2(k + 1) diagonals, each overlapping the next by half; bands that reach the bound are aligned
with free ends in the document. Windows of an item that meet in a document are merged to one leak.

Windows under 2 Q characters take q-grams of SHORT_Q (or of the whole window, if it is shorter), with which the bound is
1 at least, so nothing within the edit budget is missed; under EDITS_PER characters the budget is 0, an exact search.

The benchmark is indexed in blocks of bounded size; each block is compared with all documents.

Defined cases: null and empty texts leak nothing, and null and empty items are in nothing; a null id is an id; repeated
documents or items are reported each, whether their ids differ or not; an empty table gives no rows; extra columns are kept out
of the report.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textops import Texts, map_texts, mix, slices

Q, SHORT_Q, WINDOW, EDITS_PER = 10, 5, 96, 16
BLOCK_CHARS = 2_000_000
BASE = 0x9E3779B97F4A7C15
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(map(chr, range(0x3000)))], np.uint32)
_BLANK = np.zeros(0x3001, bool)
_BLANK[[i for i in range(0x3001) if chr(i).isspace()]] = True


def normalised(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, offsets of each text, and the character of its text that each code point stands at."""
    raw = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    offsets = heads[texts.offsets]
    codes = raw.copy()
    low = codes < len(_LOWER)
    codes[low] = _LOWER[codes[low]]
    blank = np.zeros(len(codes), bool)
    near = raw < len(_BLANK)
    blank[near] = _BLANK[raw[near]]
    codes[blank] = 32
    again = np.zeros(len(codes), bool)
    again[1:] = blank[1:] & blank[:-1]
    again[offsets[:-1][offsets[:-1] < len(codes)]] = False
    kept = np.flatnonzero(~again)
    at = np.searchsorted(kept, offsets)
    return codes[kept], at, kept - np.repeat(offsets[:-1], np.diff(at))


def grams(codes: np.ndarray, size: int = Q) -> np.ndarray:
    """Hash of the size code points from each position; shorter input has none."""
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64)
    out, width = c, 1
    for bit in f"{size:b}"[1:]:  # twice as wide, and one more where the size's binary digit says so
        out = out[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + out[width:]
        width *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(BASE) + c[width:]
            width += 1
    return mix(out)


def gram_size(chars: int) -> int:
    """Q, or less for short windows, so that the lemma's bound is 1 at least at their edit budget."""
    return Q if chars >= 2 * Q else min(chars, SHORT_Q)


class Index:
    """Windows of a block of items (id, code points) that have q-grams of one size, and these q-grams."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], q: int = Q):
        item_no, window_at, patterns = [], [], []
        for n, (_, codes) in enumerate(items):
            starts = list(range(0, max(1, len(codes) - WINDOW + 1), WINDOW // 2))
            if starts[-1] + WINDOW < len(codes):
                starts.append(len(codes) - WINDOW)
            for s in starts:
                item_no.append(n)
                window_at.append(s)
                patterns.append(codes[s : s + WINDOW])
        self.q, self.ids, self.owner, self.window_at = q, [i for i, _ in items], item_no, window_at
        self.length = np.array([len(p) for p in patterns], np.int64)
        self.edits = self.length // EDITS_PER
        self.bound = self.length + 1 - q * (self.edits + 1)
        self.pattern = np.zeros((len(patterns), WINDOW), np.uint32)
        hashes, window, place = [], [], []
        for i, p in enumerate(patterns):
            self.pattern[i, : len(p)] = p
            g = grams(p, q)
            hashes.append(g)
            window.append(np.full(len(g), i, np.int32))
            place.append(np.arange(len(g), dtype=np.int32))
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        self.keys, first = np.unique(hashes[order], return_index=True)
        self.first = np.concatenate([first, [len(order)]])
        self.window, self.place = np.concatenate(window)[order].astype(np.int32), np.concatenate(place)[order].astype(np.int32)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.keys >> np.uint64(42)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, window, place in window) of every q-gram that both sides hold."""
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        same = self.keys[at] == hashes[maybe]
        maybe, at = maybe[same], at[same]
        n = self.first[at + 1] - self.first[at]
        posting = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(maybe, n), self.window[posting].astype(np.int64), self.place[posting].astype(np.int64)


def indexes_of(items: list[tuple[int | None, str | None]]) -> list[Index]:
    """An index for each size of q-grams that the items' lengths ask for; empty items have none."""
    by_size: dict = defaultdict(list)
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        codes, _, _ = normalised(Texts(raw, np.array([0, len(raw)])))
        if len(codes):
            by_size[gram_size(len(codes))].append((item, codes))
    return [Index(some, q) for q, some in sorted(by_size.items())]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def candidates(index: Index, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, first diagonal of the band) of all bands that reach the bound."""
    at, window, place = index.hits(grams(codes, index.q))
    text = np.searchsorted(offsets, at, "right") - 1
    pair = text * len(index.owner) + window
    keys, n = counted(pair)
    enough = keys[n >= index.bound[keys % len(index.owner)]] if len(keys) else keys
    keep = np.isin(pair, enough)
    at, window, place, pair = at[keep], window[keep], place[keep], pair[keep]
    stride = index.edits[window] + 1
    diagonal = at - offsets[pair // len(index.owner)] - place + WINDOW  # none is negative
    bands = len(codes) + 2 * WINDOW + 2
    band = diagonal // stride
    key = np.concatenate([pair * bands + band, pair * bands + np.maximum(band - 1, 0)])
    keys, n = counted(key)
    pair, band = keys // bands, keys % bands
    window = pair % len(index.owner)
    good = n >= index.bound[window]
    pair, band, window = pair[good], band[good], window[good]
    return pair // len(index.owner), window, band * (index.edits[window] + 1) - WINDOW


def align(index: Index, codes: np.ndarray, offsets: np.ndarray, text: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each window within its band, and the start and end of that match in the text.

    Row i of the table stands for the first i characters of the window, column o for the text character at
    diagonal + i + o. Cells carry edits * 1024 + the column where their match began.
    """
    length, most = index.length[window], int(index.edits.max())
    width = 3 * (most + 1) + 1
    column = np.arange(width)
    low, high = offsets[text], offsets[text + 1]
    start = low + diagonal
    cells = np.broadcast_to(column, (len(text), width)).astype(np.int64).copy()
    far = np.int64(1 << 40)
    for i in range(int(length.max()) if len(length) else 0):
        where = start[:, None] + i + column
        inside = (where >= low[:, None]) & (where < high[:, None])
        same = inside & (codes[np.clip(where, 0, len(codes) - 1)] == index.pattern[window, i][:, None])
        step = np.where(inside, cells + np.where(same, 0, 1024), far)
        step[:, :-1] = np.minimum(step[:, :-1], cells[:, 1:] + 1024)  # a character of the window is missing
        step = np.minimum.accumulate(step - 1024 * column, axis=1) + 1024 * column  # one of the text is extra
        cells = np.where((i < length)[:, None], step, cells)
    best = cells.argmin(1) if len(text) else np.zeros(0, np.int64)
    value = cells[np.arange(len(text)), best]
    return value // 1024, diagonal + value % 1024, diagonal + best + length


def leaks_in(indexes: list[Index], codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int | None, int, int, int, int]]:
    """(text, item id, start, end, edits of the worst window, windows), merged by item."""
    out = []
    for index in indexes:
        text, window, diagonal = candidates(index, codes, offsets)
        if not len(text):
            continue
        edits, start, end = align(index, codes, offsets, text, window, diagonal)
        good = (edits <= index.edits[window]) & (end > start)
        found: dict = defaultdict(dict)
        for t, w, e, a, b in zip(text[good].tolist(), window[good].tolist(), edits[good].tolist(), start[good].tolist(), end[good].tolist(), strict=True):
            spans = found[(t, index.owner[w])]
            if (w, a) not in spans or spans[(w, a)][2] > e:
                spans[(w, a)] = (max(a, 0), b, e, w)
        for (t, item), spans in found.items():
            merged: list = []
            for a, b, e, w in sorted(spans.values()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                    merged[-1][2] = max(merged[-1][2], e)
                    merged[-1][3].add(w)
                else:
                    merged.append([a, b, e, {w}])
            out += [(t, index.ids[item], a, b, e, len(ws)) for a, b, e, ws in merged]
    return out


LEAK = "doc_id long, item_id long, start long, end long, edits int, windows int"


def blocks_of(benchmark: DataFrame, block_chars: int):
    """Broadcast index of each block of items, about block_chars at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(indexes_of([(r.item_id, r.text) for r in part]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per leak: doc_id, item_id, start and end character in the text, edits of its worst window, windows."""
    out = None
    for shared in blocks_of(benchmark, block_chars):

        def work(rows, texts, shared=shared):
            codes, offsets, place = normalised(texts)
            found = leaks_in(shared.value, codes, offsets)
            if not found:
                return None
            ids = rows["doc_id"].to_pylist()
            to_text = lambda t, x: int(place[min(offsets[t] + x, offsets[t + 1] - 1)])
            columns = list(zip(*[(ids[t], item, to_text(t, a), to_text(t, b - 1) + 1, e, n) for t, item, a, b, e, n in found], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return {n: pa.array(c, k) for n, c, k in zip(("doc_id", "item_id", "start", "end", "edits", "windows"), columns, kinds, strict=True)}

        one = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), LEAK, work)
        out = one if out is None else out.unionAll(one)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs less those that hold a leak; rows are tested in place, so equal or null ids can't be mixed up."""
    for shared in blocks_of(benchmark, block_chars):

        def keep(batches, shared=shared):
            for batch in batches:
                for rows, texts in slices(batch, "text"):
                    codes, offsets, _ = normalised(texts)
                    clean = np.ones(len(texts), bool)
                    clean[[leak[0] for leak in leaks_in(shared.value, codes, offsets)]] = False
                    yield rows.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
