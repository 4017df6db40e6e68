"""Runs of words that repeat with a period, found by catchers over dyadic blocks of words.

A square is a stretch of words that is some stretch twice in a row. The words of a text arrive in order. When 2**k words
that start at a multiple of 2**k are complete, a catcher is set on this block for the periods 2**(k+1) - 1 to
2**(k+2) - 2: the first half of every square of such a period holds such a block, and the block comes again one period later.
Each word that arrives ends a stretch of 2**k words, which is compared with the block of each open catcher of the level
(two at most, so the comparisons of a word are as many as levels). Where they agree, the agreement is extended to the left and
to the right, word by word as far as it goes, here by binary search on prefix hashes; if it covers a period, the square is
caught, and all squares of one period that overlap are the same maximal stretch, one run. Stretches that a run of a
shorter period already explains are not extended again. All words of a batch are appended at once: what the words of a
level compare is one vector operation.

A run's period is its smallest. Words are compared by 64-bit hashes.

Defined cases: null and blank texts have no words and no runs; null ids and repeated rows are rows like any others; an empty
table gives no rows; extra columns are ignored. Work is proportional to n log n words of a text, memory to its words.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textops import Texts, U, map_texts, mix, powers

LEAST, TIMES = 24, 3
ROW_CELLS = 1 << 22  # comparisons that one vector operation makes

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end (exclusive), period


class Line:
    """Words in a row, with hashes of all stretches."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.up, self.down = powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * self.up[:-1], out=self.sums[1:])

    def stretches(self, size: int, upto: int) -> np.ndarray:
        """Hash of the size words from each place on that end before upto."""
        n = max(upto - size + 1, 0)
        return (self.sums[size : size + n] - self.sums[:n]) * self.down[:n]

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from a on equal those from b on; a < b."""
        return (self.sums[a + n] - self.sums[a]) * self.up[b - a] == self.sums[b + n] - self.sums[b]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on."""
        got, room = np.zeros(len(a), np.int64), len(self.words) - b
        for bit in reversed(range(int(len(self.words)).bit_length())):
            more = got + (1 << bit)
            fits = np.flatnonzero(more <= room)
            fits = fits[self.same(a[fits], b[fits], more[fits])]
            got[fits] = more[fits]
        return got

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b."""
        got = np.zeros(len(a), np.int64)
        for bit in reversed(range(int(len(self.words)).bit_length())):
            more = got + (1 << bit)
            fits = np.flatnonzero(more <= a)
            fits = fits[self.same(a[fits] - more[fits], b[fits] - more[fits], more[fits])]
            got[fits] = more[fits]
        return got


def met(line: Line, level: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (first word) of the level and the periods at which they come again, among the words before upto."""
    size, low, high = 1 << level, (2 << level) - 1, (4 << level) - 1
    hashes = line.stretches(size, upto)
    blocks = np.arange(0, max(len(hashes) - low, 0), size)
    if not len(blocks):
        return blocks, blocks
    later = np.concatenate([hashes, np.zeros(high, U)])
    later = np.lib.stride_tricks.sliding_window_view(later, high - low)[low::size]
    step, found = max(ROW_CELLS // (high - low), 1), []
    for at in range(0, len(blocks), step):
        some = blocks[at : at + step]
        row, lag = np.nonzero(later[at : at + len(some)] == hashes[some][:, None])
        found.append((some[row], lag + low))
    block, period = (np.concatenate(x) for x in zip(*found, strict=True))
    inside = block + period + size <= upto
    return block[inside], period[inside]


def runs_of(words: np.ndarray, lengths: np.ndarray, least: int = LEAST, times: int = TIMES) -> Runs:
    """Runs of at least `least` words and `times` periods (two or more) in texts that stand in a row, the longest first.

    Behind each text stands a word that occurs once; words has len(lengths) more entries than the texts have words.
    """
    line, ends = Line(words), np.cumsum(lengths + 1)
    known_end, known_period = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    out: list[Runs] = []
    level = 0
    while (fit := np.searchsorted(-lengths, -(times * ((2 << level) - 1)), "right")) > 0:
        size = 1 << level
        block, period = met(line, level, int(ends[fit - 1]))
        new = (known_end[block] < block + period + size) | (period % known_period[block] != 0)
        block, period = block[new], period[new]
        start = block - line.behind(block, block + period)
        end = block + period + size + line.ahead(block + size, block + period + size)
        long = end - start >= np.maximum(least, times * period)
        found = np.unique(np.stack([start[long], end[long], period[long]]), axis=1)  # by start, end, period
        out.append(tuple(found))
        for s, e, p in found.T.tolist():
            wider = known_end[s:e] < e
            known_period[s:e][wider] = p
            known_end[s:e][wider] = e
        level += 1
    start, end, period = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # of one stretch, the smallest period
    return start[first], end[first], period[first]


def runs_by_text(hashes: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start and period; texts are word hashes."""
    out: list[list] = [[] for _ in hashes]
    order = [i for i in sorted(range(len(hashes)), key=lambda i: -len(hashes[i])) if len(hashes[i]) >= least]
    if not order:
        return out
    lengths = np.array([len(hashes[i]) for i in order])
    marks = mix(np.arange(len(order), dtype=U) + U(0xA0761D6478BD642F))
    start, end, period = runs_of(np.concatenate([x for i, m in zip(order, marks, strict=True) for x in (hashes[i], [m])]), lengths, least, times)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    for k, s, e, p in zip((np.searchsorted(starts, start, "right") - 1).tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        out[order[k]].append((s - int(starts[k]), e - s, p))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if of each run only the first period does."""
    change = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length in periods; of equal ones that of the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
KIND = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (array by start and period), strongest (a run or null), collapsed: the words of the text joined by
    one space, without those that are in some run behind its first period."""

    def work(rows: pa.RecordBatch, texts: Texts) -> dict:
        words = texts.words()
        runs = runs_by_text(np.split(words.hash, words.first[1:-1]) if len(texts) else [], least, times)
        raw, collapsed = texts.data.tobytes(), []
        for i, found in enumerate(runs):
            parts = raw[texts.offsets[i] : texts.offsets[i + 1]].split()
            if found:
                parts = [parts[j] for j in np.flatnonzero(kept_words(len(parts), found)).tolist()]
            collapsed.append(b" ".join(parts))
        name = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
        return {
            "doc_id": rows["doc_id"],
            "runs": pa.array([[name(r) for r in found] for found in runs], pa.list_(RUN)),
            "strongest": pa.array([name(strongest(found)) for found in runs], RUN),
            "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
        }

    return map_texts(docs.select("doc_id", "text"), f"doc_id long, runs array<{KIND}>, strongest {KIND}, collapsed string", work)


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth text, by the crc32 of its id, goes on from some word a with the p words from there over and
    over (a, p and the words by the contract of op11). Null ids have no crc32; their texts stay."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(crc % 10 == 0, F.lit(False))

    def work(rows: pa.RecordBatch, texts: Texts) -> dict:
        raw, out = texts.data.tobytes(), []
        for i, doc_id in enumerate(rows["doc_id"].to_pylist()):
            words = raw[texts.offsets[i] : texts.offsets[i + 1]].split()
            if n := len(words):
                g = zlib.crc32(str(doc_id).encode()) // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                cycle = words[a : a + p]
                words[a:] = (cycle * ((n - a) // len(cycle) + 1))[: n - a]
            out.append(b" ".join(words))
        return {"doc_id": rows["doc_id"], "text": pa.array(out, pa.binary()).cast(pa.string())}

    return docs.where(~chosen).select("doc_id", "text").union(map_texts(docs.where(chosen).select("doc_id", "text"), "doc_id long, text string", work))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_tails(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.floor(F.col("strongest.length") * 1000 / F.col("strongest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
