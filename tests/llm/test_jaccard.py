"""Similar sets of shingles against all pairs."""

import itertools
import random

import pytest

from scenetrack.llm import jaccard, minhash

DIR = "/root/testdata/sf0.001"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def components_by_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(x for x in (d, least.get(top(i))) if x is not None) if d is not None or least.get(top(i)) is not None else None
    return sorted(((d, len(s), d if not s else least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def made_up(seed):
    """Chains of edited texts of all lengths, texts from few shared lines, sets that differ at exactly the threshold."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    lines = [" ".join(r.choices(words, k=r.randint(6, 30))) for _ in range(8)]
    rows = []
    for _ in range(40):
        text = r.choices(words, k=r.choice([1, 3, 5, 6, 8, 9, 10, 13, 14, 18, 19, 22, 30, 60, 150]))
        for _ in range(r.randint(1, 6)):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(text))
                text[at : at + r.randint(0, 1)] = r.choices(words, k=r.randint(0, 2))
                text = text or ["x"]
    rows += ["\n".join(r.sample(lines, r.randint(1, 4)) + r.choices(words, k=r.randint(0, 6))) for _ in range(70)]
    rows += [t.upper() for t in r.sample(rows, 5)] + [None, "", " \n", "É a b c d e", "é a b c d e"]
    return [(None if k % 23 == 7 else 1000 - k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("most", [None, 0, 16])
def test_against_all_pairs(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(jaccard, "chosen_boundary", lambda *_: most)
        monkeypatch.setattr("scenetrack.llm.minhash.PART_MEMBERS", 4)
        monkeypatch.setattr(jaccard, "frequency_levels", lambda slots: jaccard.np.zeros(jaccard.COUNTERS, "uint8"))
    rows = made_up(most or 77)
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, n int, key int")
    got = sorted((tuple(x) for x in jaccard.similar_sets(docs).collect()), key=str)
    want = components_by_pairs(rows)
    assert got == want and len({x[2] for x in want}) < len(want) - 40


def test_given_documents(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    assert sorted((tuple(x) for x in jaccard.op13_jaccard_join(spark, DIR).collect()), key=str) == components_by_pairs(rows)


def test_sizes_and_boundary():
    for s, t in itertools.product(range(1, 40), repeat=2):
        o = jaccard.overlap(s, t)
        assert 100 * o >= 80 * (s + t - o) and 100 * (o - 1) < 80 * (s + t - o + 1)
        if o <= min(s, t):
            assert jaccard.least_partner(s) <= t and o <= t
            if max(s, t) <= 20:
                assert o in jaccard.subset_sizes(s, 20)
    assert jaccard.chosen_boundary({}) == 0 and jaccard.chosen_boundary({3: 10, 500: 9}) >= 3
    assert jaccard.chosen_boundary({20: 5}) < 20


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_sets(docs).count() == 0
    assert jaccard.similar_sets(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).count() == 2


def test_lists_across_components_are_of_rare_runs(spark, monkeypatch):
    """Texts that share a common part but can't link meet in no list, and of those that may each pair is found once."""
    monkeypatch.setattr(minhash, "PART_MEMBERS", 4)
    common = [f"c{i}" for i in range(90)]
    rows = [(i, i // 2, " ".join(common + [f"d{i // 2}x{k}" for k in range(40)] + [f"e{i % 2}"])) for i in range(30)]
    r = random.Random(5)
    near = [f"n{i}" for i in range(200)]
    for i in range(100, 112):
        text = list(near)
        for at in r.sample(range(200), r.randint(1, 4)):
            text[at] = f"v{i % 5}"
        rows.append((i, i // 3, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, component long, text string")
    sizes = {d: len(shingles(t)) for d, _, t in rows}
    ids = spark.createDataFrame([(d, sizes[d], c) for d, c, _ in rows], "doc_id long, runs int, component long")
    texts = docs.select("doc_id", "text")
    lists = minhash.rare_lists(minhash.foreign_runs(texts, ids, jaccard.run_sets), ids, 0.8)
    assert {x.doc_id for x in lists.collect()} <= set(range(100, 112))
    found = sorted(map(tuple, minhash.across(lists, minhash.bitmaps(texts, jaccard.run_sets), 0.8).collect()))
    sets = {d: shingles(t) for d, _, t in rows}
    part = {d: c for d, c, _ in rows}
    similar = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if part[a] != part[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(similar) > 3 and set(similar) <= set(found) and len(found) == len(set(found))
