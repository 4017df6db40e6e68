"""Alignment of tokens against plain loops over token ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scenetrack.llm import alignment

DIR = "/root/testdata/sf0.001"
PLAIN_TEXTS = ["", "a", " ", "  two  spaces", "naïve café — 漢字 \U0001f600", "tab\tline\nend ", "<|endoftext|> <s>x</s> <0x41>", "▁ mark", "a" * 3000, "　wide", "it's 12345 !?!?"]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)


def groups_by_loops(text, encoders):
    """[(A ids, B ids)] of a text; byte offsets of A come from the tokenizer's own decoding table, one token at a time."""
    a, b = encoders
    if not text:
        return []
    raw = (" " + text).encode()
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    code = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(code.ids, code.tokens)]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
        return []
    ends = lambda side: np.cumsum([len(x) for _, x in side]).tolist()
    both, out = set(ends(left)) & set(ends(right)), [([], [])]
    places = sorted([(e, 0, i) for e, (i, _) in zip(ends(left), left)] + [(e, 1, i) for e, (i, _) in zip(ends(right), right)])
    for e, side, i in places:
        out[-1][side].append(i)
        if side == 1 and e in both:
            out.append(([], []))
    return out[:-1]


def as_text(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def random_texts(seed, n=60):
    r = random.Random(seed)
    alphabet = "abcdeéß漢 \U0001f600\n\t.,'!0123456789ABC"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(n)]


def test_vocabulary_gives_the_ids_of_the_tokenizer_file(encoders):
    model = alignment.ByteLevel(alignment.BYTE_BPE)
    texts = PLAIN_TEXTS + random_texts(1, 300)
    assert model.encode(texts) == [encoders[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_long_blanks_go_to_the_library_of_the_file(encoders):
    model = alignment.ByteLevel(alignment.BYTE_BPE)
    texts = ["x" + " " * 30_000 + "y", "\t \n" * 5_000 + "z", "b" * 30_000]
    assert model.encode(texts) == [encoders[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_diagonals_take_equal_work():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.cumsum(r.integers(1, 4, r.integers(0, 80))) for _ in range(2))
        i, j = alignment.diagonals(a, b, 7)
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b)) and (np.diff(i + j)[:-1] == 7).all()
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
        x, y = alignment.common_ends(a, b, 7)
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@pytest.mark.parametrize("steps", [1, 2, 17, alignment.PIECE_STEPS])
def test_groups_of_texts(encoders, steps):
    texts = PLAIN_TEXTS + random_texts(steps)
    want = [groups_by_loops(t, encoders) for t in texts]
    got = alignment.Aligned(texts, alignment.ByteLevel(alignment.BYTE_BPE), alignment.Pieces(alignment.PIECE_BPE), steps)
    assert got.texts_of_groups() == [as_text(g) for g in want]
    assert got.n_groups.tolist() == [len(g) for g in want]
    assert got.n_links.tolist() == [sum(len(a) * len(b) for a, b in g) for g in want]
    assert sum(map(len, want)) > 500


def rows_by_loops(rows, encoders):
    groups = [(i, groups_by_loops(t, encoders)) for i, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for _, g in groups]
    count = Counter(p for x in links for p in x)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    for (i, g), x in zip(groups, links):
        n = [sum(len(s[k]) for s in g) for k in (0, 1)]
        best = sum(k for p, k in x.items() if count[p] == most[p[0]])
        yield i, *n, len(g), sum(x.values()), best, sum(k * count[p] for p, k in x.items()), hashlib.sha256(as_text(g).encode()).hexdigest() if g else ""


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
order = lambda rows: sorted(rows, key=str)


def test_query_against_loops(spark, encoders):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = alignment.op12_alignment(spark, DIR)
    assert order(tuple(r) for r in got.select(COLUMNS).collect()) == order(rows_by_loops(rows, encoders))


def test_many_blocks_and_defined_cases(spark, encoders, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)
    monkeypatch.setattr(alignment.aligned, "__defaults__", (alignment.BYTE_BPE, alignment.PIECE_BPE, 500))
    monkeypatch.setattr(alignment, "PAIR_ROWS", 16)
    texts = [*PLAIN_TEXTS, *random_texts(9), None, "same words", "same words", "word " * 4000]
    rows = [(None if k % 9 == 5 else k % 50, t, "x") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op12_alignment(spark, str(tmp_path))
    assert order(tuple(r) for r in got.select(COLUMNS).collect()) == order(rows_by_loops([r[:2] for r in rows], encoders))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert alignment.op12_alignment(spark, f"{tmp_path}/none").count() == 0
