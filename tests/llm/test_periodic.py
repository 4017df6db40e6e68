"""Periodic runs against plain loops."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from scenetrack.llm import periodic

DIR = "/root/testdata/sf0.001"


def runs_by_loops(words, least=24, times=3):
    """All maximal stretches of each period; of one stretch the smallest period."""
    found = {}
    for p in range(1, len(words) // times + 1):
        i = p
        while i < len(words):
            if words[i] != words[i - p]:
                i += 1
                continue
            j = i
            while j < len(words) and words[j] == words[j - p]:
                j += 1
            start, length = i - p, j - i + p
            if length >= max(least, times * p):
                found.setdefault((start, length), p)
            i = j
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def hashes(words):
    return np.array([hash((w, 7)) & (2**63 - 1) for w in words], np.uint64)


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(25):
        words = [r.randrange(r.choice([1, 2, 3, 40])) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 4)):
            cycle = [r.randrange(5) for _ in range(r.randint(1, 30))]
            words += (cycle * 9)[: r.randint(1, 6 * len(cycle))]
        texts.append(words)
    for least, times in ((24, 3), (2, 2), (6, 2)):
        got = periodic.runs_by_text([hashes(t) for t in texts], least, times)
        assert got == [runs_by_loops(t, least, times) for t in texts]


def test_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for words in (b, [3] * 4000):
        assert periodic.runs_by_text([hashes(words)]) == [runs_by_loops(words)]


def test_strongest_and_kept():
    assert periodic.strongest([]) is None
    assert periodic.strongest([(5, 30, 7), (2, 60, 14), (9, 90, 30)]) == (2, 60, 14)
    assert periodic.kept_words(8, [(1, 6, 2)]).tolist() == [True, True, True, False, False, False, False, True]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_loops(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_loops(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = sorted(expected(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 3000)
    got = {tuple(r) for r in periodic.op11_periodic_runs(spark, DIR).collect()}
    assert len(got) == docs.count() and set(want) <= got and sum(w[1] > 0 for w in want) > 5


def test_defined_cases(spark, tmp_path):
    long = "x y " * 20_000
    rows = [(1, None, 3), (2, " \t\n", 3), (None, "la " * 30, 3), (4, long, 3), (4, long, 3), (5, "é ü " * 40, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert len(got) == 6
    assert {g for g in got if g[0] != 4} == {expected(i, t) for i, t, _ in rows if i != 4}
    assert [g[:5] for g in got if g[0] == 4] == [(4, 1, 0, 40_000, 2)] * 2
    assert periodic.periodic_runs(docs.where("false")).count() == 0
