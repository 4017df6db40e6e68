"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text gives a vector of statistics (shares of byte classes, word lengths, repetition). The class means and
covariances come from sums over all labelled training rows. Each covariance is shrunk towards the pooled one and its
diagonal; their Cholesky factors are computed once and sent to the tasks. A score is the squashed difference of the two
log densities plus the log prior odds.

Defined cases: null is the empty text, which has statistics of its own and so a score; a class without at least
MIN_ROWS training rows makes all scores 0.5; rows without an id are scored; repeated rows are scored each; labels that
repeat an id count each; null labels are left out; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, fold, fold_of, table
from .textops import Texts, as_arrow, map_texts, record_batch

SHRINK, RIDGE, MIN_ROWS = 0.15, 1e-3, 5
FOLDS, HELD_OUT = 3, 1
_BYTES = np.arange(256)
CLASSES = {
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "stop": np.isin(_BYTES, [ord(c) for c in ".,;:?"]),
    "mark": np.isin(_BYTES, [ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~\"'()[]-"]),
    "newline": _BYTES == 10,
    "high": _BYTES >= 128,
}
STATISTICS = [*CLASSES, "log_words", "word_length", "length_spread", "distinct_words", "distinct_runs", "top_word", "line_words", "marked_words"]


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; empty parts give 0."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repetition(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of different hashes of each text, and the count of its most frequent one."""
    n = np.diff(offsets)
    if not len(hashes):
        return np.zeros(len(n)), np.zeros(len(n))
    owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    keys = np.sort((owner << np.uint64(40)) | (hashes >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    of = (keys[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(len(n))
    np.maximum.at(top, of, np.diff(np.concatenate([first, [len(keys)]])))
    return np.bincount(of, minlength=len(n)).astype(float), top


def statistics(texts: Texts) -> np.ndarray:
    """One row of transformed STATISTICS per text."""
    words = texts.words()
    size = np.maximum(np.diff(texts.offsets), 1)
    n = np.maximum(words.count, 1)
    out = [np.arcsinh(30 * per_text(flags[texts.data], texts.offsets) / size) for flags in CLASSES.values()]
    lines = per_text(texts.data == 10, texts.offsets) + 1
    length = (words.end - words.start).astype(float)
    mean = per_text(length, words.first) / n
    spread = np.sqrt(np.maximum(per_text(length * length, words.first) / n - mean * mean, 0))
    distinct, top = repetition(words.hash, words.first)
    runs, offsets = words.shingles(3)
    distinct_runs, _ = repetition(runs, offsets)
    marks = np.concatenate([[0], np.cumsum(CLASSES["mark"][texts.data])])
    marked = (marks[words.end] - marks[words.start]) > 0
    out += [np.log1p(words.count), np.log1p(mean), np.log1p(spread), np.sqrt(distinct / n), distinct_runs / np.maximum(np.diff(offsets), 1), np.sqrt(top / n), np.log1p(words.count / lines), np.arcsinh(10 * per_text(marked, words.first) / n)]
    return np.stack(out, 1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the vector of its whole text."""
    return map_texts(docs.select("doc_id", "text"), "doc_id long, stats array<double>", lambda rows, texts: {"doc_id": rows["doc_id"], "stats": statistics(texts)})


def class_sums(vectors: DataFrame, labels: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of squares of each class, over all rows of vectors that have a label."""
    width = len(STATISTICS)
    known = vectors.join(labels.where("label is not null and doc_id is not null"), "doc_id")

    def partial(batches):
        total: dict = {}
        for batch in batches:
            x = np.array(batch["stats"].values).reshape(-1, width) if batch.num_rows else np.zeros((0, width))
            y = np.array(batch["label"])
            for label in np.unique(y):
                one = np.column_stack([np.ones((y == label).sum()), x[y == label]])
                total[label] = total.get(label, 0) + one.T @ one
        for label, moments in total.items():
            flat = moments.reshape(-1)
            yield record_batch({"label": np.full(len(flat), label, np.int32), "cell": np.arange(len(flat), dtype=np.int32), "value": flat})

    cells = known.select("label", "stats").mapInArrow(partial, "label int, cell int, value double")
    rows = cells.groupBy("label", "cell").agg(F.sum("value").alias("value")).where(F.col("label").isin(0, 1)).collect()  # 2 * (width + 1)**2 rows
    out = {}
    for label in {r.label for r in rows}:
        m = np.zeros((width + 1) ** 2)
        for r in rows:
            if r.label == label:
                m[r.cell] = r.value
        m = m.reshape(width + 1, width + 1)
        out[label] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes."""

    def __init__(self, sums: dict, shrink: float = SHRINK, ridge: float = RIDGE):
        self.ready = all(sums.get(c, (0,))[0] >= MIN_ROWS for c in (0, 1))
        if not self.ready:
            return
        n = {c: sums[c][0] for c in (0, 1)}
        mean = {c: sums[c][1] / n[c] for c in (0, 1)}
        scatter = {c: sums[c][2] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        level = np.diag(np.diag(pooled)) * 0.1 + np.eye(len(pooled)) * ridge
        self.prior = float(np.log(n[1] / n[0]))
        self.mean, self.factor, self.log_det = {}, {}, {}
        for c in (0, 1):
            weight = shrink + (1 - shrink) * min(1.0, 2.0 * len(pooled) / n[c])  # few rows: nearer to the pooled one
            lower = np.linalg.cholesky((1 - weight) * scatter[c] / n[c] + weight * pooled + shrink * level)
            self.mean[c], self.factor[c] = mean[c], np.linalg.inv(lower)
            self.log_det[c] = 2 * np.log(np.diag(lower)).sum()

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with priors."""
        if not self.ready:
            return np.zeros(len(x))
        far = {c: (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) for c in (0, 1)}
        return self.prior + 0.5 * (far[0] + self.log_det[0] - far[1] - self.log_det[1])


def squash(d: np.ndarray) -> np.ndarray:
    """0 to 1, one half at 0, strictly increasing also where a logistic curve would be flat."""
    return 0.5 + 0.5 * d / (1 + np.abs(d))


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) scored by a discriminant that learns from labels (doc_id, label) outside the held-out fold."""
    vectors = cut_lineage(with_statistics(docs))
    model = Discriminant(class_sums(vectors, labels.where(fold("doc_id", FOLDS) != HELD_OUT)))

    def score(batches):
        for batch in batches:
            x = np.array(batch["stats"].values).reshape(-1, len(STATISTICS)) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            s = squash(model.difference(x))
            held = np.array([fold_of(i, FOLDS) == HELD_OUT for i in batch["doc_id"].to_pylist()], bool)
            yield record_batch({"doc_id": batch["doc_id"], "held_out": as_arrow(held), "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return vectors.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return fit_and_score(table(spark, sf_dir, "documents"), labels)
