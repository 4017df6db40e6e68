"""Alignment of two tokenizers' tokens: groups of tokens that cover the same bytes, and how often two ids meet in one.

Both tokenizers cover the same bytes of a text, space and text, so that both lists of token ends (byte offsets) rise to the
same last one. Merging the lists is divided by merge paths: on each diagonal (i ends of A and j of B with i + j = d) a binary
search finds the i that the merge has taken after d steps. The pieces between diagonals are equal work and need nothing
from each other, however the texts of a batch differ in length; each gives its common ends. An end whose two copies lie on
both sides of a diagonal belongs to both pieces and is added when they are put together, and so are groups that reach over
a diagonal: the common ends of all pieces, in order, cut both lists into groups.

Counts over the corpus need each pair of ids in each document once, some hundred rows a document. So documents are taken in
blocks of BLOCK_BYTES of text: a block tells each of its pairs once, with the number of its documents that hold it, and its
documents name pairs by their place in this list. Only the lists are counted, joined with the counts, and returned to their
blocks. What meets in one task is one block, whatever the size of the corpus and however frequent a pair.

A is a byte-level BPE (vocabulary of a tokenizer file in JSON; ids by rank of merging), B a sentencepiece model. Strings of
special tokens in texts are plain text.

Defined cases: null and empty texts have no tokens, nor do texts that a tokenizer doesn't cover byte by byte (B's
normalisation changes them, or they hold U+2581): zeros and no groups; null ids and repeated rows are documents like any others; an
empty table gives no rows; extra columns are ignored. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table
from .textops import BATCH_BYTES, CHUNK_BYTES, WIDE, as_arrow, slices

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
PIECE_STEPS = 1 << 13  # steps of a merge between two diagonals
PAIR_ROWS = 1 << 20  # pairs that are made at once

#: The pattern by which the byte-level vocabulary splits text, and the bytes that it writes as themselves (fixed values).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


BLANKS = 10_000  # in a row: a limit far below what the fast library's splitter can take
LONG_BLANK = re.compile(rf"\s{{{BLANKS}}}")


class Tokens:
    """Token ids with their bytes: encode(texts) gives ids, piece[id] the bytes, width[id] their number."""

    def __init__(self, piece: list[bytes]):
        self.piece = piece
        self.width = np.array([len(p) for p in piece], np.int64)

    def covers(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.piece.__getitem__, ids)) == raw


class ByteLevel(Tokens):
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special = {t["content"] for t in whole["added_tokens"]}
        byte_of = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}
        ids = {bytes(byte_of[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}
        piece = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            piece[i] = token
        super().__init__(piece)
        self.path, self.model = path, tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=ids, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.slowly(" " + t) if len(t) > BLANKS and LONG_BLANK.search(t) else self.model.encode_ordinary(" " + t) for t in texts]

    def slowly(self, text: str) -> list[int]:
        """The same ids by the library of the vocabulary file, which has no limit on the blanks in a row."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = True
        return whole.encode(text, add_special_tokens=False).ids


class Pieces(Tokens):
    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        as_bytes = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace("▁", " ").encode()
        super().__init__([as_bytes(i) for i in range(m.get_piece_size())])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def diagonals(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the merge path of two sorted lists after every so many steps, first and last place included; of equal ends
    the merge takes a's first. All diagonals are searched at once."""
    d = np.unique(np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b)))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        i = (low[open_] + high[open_]) // 2
        taken = a[i] <= b[d[open_] - i - 1]  # the path passes a[i] before it reaches the diagonal
        low[open_] = np.where(taken, i + 1, low[open_])
        high[open_] = np.where(taken, high[open_], i)
    return low, d - low


def common_ends(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values in two lists that rise strictly."""
    i, j = diagonals(a, b, steps)
    found = []
    for k in range(len(i) - 1):
        piece_a, piece_b = a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]
        if k and i[k] and len(piece_b) and a[i[k] - 1] == piece_b[0]:  # this end's first copy is in the piece before
            found.append((i[k : k + 1] - 1, j[k : k + 1]))
        if len(piece_a) and len(piece_b):
            at = np.searchsorted(piece_b, piece_a)
            hit = np.flatnonzero(piece_b[np.minimum(at, len(piece_b) - 1)] == piece_a)
            found.append((hit + i[k], at[hit] + j[k]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Aligned:
    """Groups of some texts: for all texts in a row, ids of both sides and the first token of each group, end included."""

    def __init__(self, texts: list[str], left: Tokens, right: Tokens, steps: int = PIECE_STEPS):
        a, b = left.encode(texts), right.encode(texts)
        for k, text in enumerate(texts):
            if not text or not (left.covers(a[k], raw := b" " + text.encode()) and right.covers(b[k], raw)):
                a[k] = b[k] = []
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = (np.fromiter((i for x in side for i in x), np.int64, int(n.sum())) for side, n in ((a, self.n_a), (b, self.n_b)))
        end_a, end_b = common_ends(np.cumsum(left.width[self.a]), np.cumsum(right.width[self.b]), steps)
        self.from_a, self.from_b = (np.concatenate([[0], end + 1]).astype(np.int64) for end in (end_a, end_b))
        first = np.concatenate([[0], np.cumsum(self.n_a)])
        self.first = np.searchsorted(self.from_a, first)  # group of each text's first token, and the number of groups
        self.n_groups = np.diff(self.first)
        self.size_a, self.size_b = np.diff(self.from_a), np.diff(self.from_b)
        links = np.concatenate([[0], np.cumsum(self.size_a * self.size_b)])
        self.n_links = links[self.first[1:]] - links[self.first[:-1]]

    def texts_of_groups(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text: ids of the groups."""
        a, b = (list(map(str, side.tolist())) for side in (self.a, self.b))
        for side, groups, mark in ((a, self.from_a, "|"), (b, self.from_b, ";")):
            last = np.zeros(len(side), bool)
            last[groups[1:] - 1] = True
            side[:] = [x + (mark if end else ",") for x, end in zip(side, last.tolist(), strict=True)]
        whole = np.empty(len(a) + len(b), object)
        group_a, group_b = (np.repeat(np.arange(len(s)), s) for s in (self.size_a, self.size_b))
        whole[np.arange(len(a)) + self.from_b[group_a]] = a
        whole[np.arange(len(b)) + self.from_a[group_b + 1]] = b
        cuts = self.from_a[self.first] + self.from_b[self.first]
        return ["".join(whole[s:e])[:-1] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def pairs(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, a * width + b) of all links, some PAIR_ROWS at a time or one group's."""
        text = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        links = np.concatenate([[0], np.cumsum(self.size_a * self.size_b)])
        low = 0
        while low < len(text):
            high = max(int(np.searchsorted(links, links[low] + PAIR_ROWS, "right")) - 1, low + 1)
            n = np.diff(links[low : high + 1])
            group = np.repeat(np.arange(low, high), n)
            k = np.arange(len(group)) - np.repeat(links[low:high] - links[low], n)
            a = self.a[self.from_a[group] + k // self.size_b[group]]
            yield text[group], a * width + self.b[self.from_b[group] + k % self.size_b[group]]
            low = high


def counted(parts: Iterator[tuple[np.ndarray, np.ndarray]], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of links, each once, by text and pair; pairs are below span."""
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for text, pair in parts:
        some, n = np.unique(text * span + pair, return_counts=True)
        if len(keys) and keys[-1] >= some[0]:  # a text goes on
            keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
            n = np.bincount(back, np.concatenate([times, n]), len(keys)).astype(np.int64)
            times = n
        else:
            keys, times = np.concatenate([keys, some]), np.concatenate([times, n])
    return keys // span, keys % span, times


class Block:
    """Documents' pairs, until they are told by their places in one list."""

    def __init__(self):
        self.name, self.bytes, self.rows = uuid.uuid4().hex, 0, []

    def add(self, n_bytes: int, rows: dict, pairs: list[np.ndarray], times: list[np.ndarray]) -> None:
        self.bytes += n_bytes
        self.rows.append((rows, pairs, times))

    def out(self) -> Iterator[pa.RecordBatch]:
        each = [p for _, pairs, _ in self.rows for p in pairs]
        listed, place, docs = np.unique(np.concatenate(each) if each else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
        kind, at = pa.list_(pa.int64()), 0
        for rows, pairs, times in self.rows:
            ends = np.cumsum([0, *map(len, pairs)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[at : at + ends[-1]], pa.int64()))
            counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(times) if times else [], pa.int64()))
            at += int(ends[-1])
            yield batch(rows | {"block": [self.name] * len(pairs), "pairs": lists, "times": counts})
        nothing = {"doc_id": [None], **{n: [0] for n in NUMBERS}, "groups": [None]}
        yield batch(nothing | {"block": [self.name], "pairs": pa.array([listed], kind), "times": pa.array([docs], kind)})


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block string, pairs array<long>, times array<long>"
TYPES = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([as_arrow(columns[f.split()[0]]).cast(t) for f, t in zip(SCHEMA.split(", "), TYPES, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def aligned(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), its block, its different pairs as
    places in the block's list, and how often each is linked (times). Per block one row with groups null: the list of its pairs
    (a * number of B's ids + b), with the number of its documents that hold each. Blocks are drawn anew in each run: write the result
    before anything joins on them."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH_BYTES) == WIDE:
        conf.set(BATCH_BYTES, str(CHUNK_BYTES * 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = ByteLevel(a_path), Pieces(b_path)  # once a task
        width = len(right.piece)
        block = Block()
        for whole in batches:
            for rows, texts in slices(whole, "text"):
                column = rows["text"].fill_null("") if rows["text"].null_count else rows["text"]
                groups = Aligned(column.to_pylist(), left, right)
                text, pair, times = counted(groups.pairs(width), len(left.piece) * width)
                ends = np.searchsorted(text, np.arange(1, len(texts)))
                told = {"doc_id": rows["doc_id"], **{n: getattr(groups, n) for n in NUMBERS}, "groups": groups.texts_of_groups()}
                block.add(len(texts.data), told, np.split(pair, ends), np.split(times, ends))
                if block.bytes >= block_bytes:
                    yield from block.out()
                    block = Block()
        if block.rows:
            yield from block.out()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """pair, count (documents that hold it), best (whether no pair of its A id has a higher count) of rows (pairs, times)."""
    rows = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = cut_lineage(rows.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.floor(F.col("pair") / width)))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of A at most
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """docs with n_best (links of the best pairs) and count_sum (counts of all links), block by block."""
    listed = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
    lists = listed.groupBy("of").agg(F.collect_list(F.struct("place", "count", "best")).alias("told"))

    def work(key: tuple, members: pa.Table, told: pa.Table) -> pa.Table:
        count, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if told.num_rows:
            flat = told["told"].combine_chunks().flatten()
            place, many, top = (np.asarray(flat.field(k).cast(pa.int64())) for k in range(3))
            count, best = np.zeros((2, len(place)), np.int64)
            count[place], best[place] = many, top
        pairs, times = members["pairs"].combine_chunks(), np.asarray(members["times"].combine_chunks().flatten())
        places, at = np.asarray(pairs.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pairs.value_lengths()))])
        sums = (np.concatenate([[0], np.cumsum(times * side[places])]) for side in (best, count))
        n_best, count_sum = (pa.array(s[at[1:]] - s[at[:-1]], pa.int64()) for s in sums)
        kept = members.drop_columns(["block", "pairs", "times"])
        return kept.append_column("n_best", n_best).append_column("count_sum", count_sum)

    kept = [f"{n} {t}" for n, t in docs.dtypes if n not in ("block", "pairs", "times")]
    return docs.groupBy("block").cogroup(lists.groupBy("of")).applyInArrow(work, ", ".join([*kept, "n_best long", "count_sum long"]))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    whole = cut_lineage(aligned(docs).withColumn("groups_sha256", digest).drop("groups"))
    members, blocks = whole.where("groups_sha256 is not null"), whole.where("groups_sha256 is null").select("block", "pairs", "times")
    counts = pair_counts(blocks, len(Pieces(PIECE_BPE).piece))
    return link_counts(members, blocks, counts)
