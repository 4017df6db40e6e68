"""Toxicity: convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of letters, case folded) and their beginnings are hashed to rows of an embedding table; a word is the sum
of its rows, so that inflected forms share what their stem means. Filters of several widths slide over a
text; the maximum of each filter over the whole text feeds one logistic unit. Dimension 0 of the embeddings starts from
the words' smoothed log odds in the training texts. Training uses a bounded sample of the labelled rows (SAMPLE_ROWS
expected, each of SAMPLE_BYTES at most) in one task. A part of them sets the decision threshold of each language; the language is guessed from function words of
the text itself. A score is the logistic of the output less the threshold of the text's language.

Scoring computes filters once per different word of a block of texts and looks them up.

Defined cases: null is the empty text, scored by the filters' biases; without training rows of both classes all scores
are 0.25 (not toxic); null labels and ids are left out of training; repeated rows are scored each; extra columns are
ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, fold_of, table
from .textops import Texts, Words, map_texts, record_batch, slices

SAMPLE_ROWS, SAMPLE_BYTES = 5_000, 16_384  # bound of the training sample: rows, and bytes of each row's text
ROWS_BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
BEGINNINGS = (4, 5, 6, 7)  # bytes; a word has only those shorter than itself
PARTS = 1 + len(BEGINNINGS)
EPOCHS, BATCH, RATE = 8, 32, 0.02
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 1
PAD = 1 << ROWS_BITS
GAP = max(WIDTHS)  # pads after each text, so that an empty one has a place for every filter

# Frequent function words, to tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with was on are be by this at from",
    "fr": "le la les de des du et un une est que qui dans pour par sur au aux elle",
    "de": "der die das und ein eine den von zu mit ist nicht dem auf für im sich auch",
    "es": "el la los las de que y en un una por con para del se es su no",
}
LANGUAGES = sorted(FUNCTION_WORDS)


def folded(texts: Texts) -> Texts:
    """Letters in lower case, all else blank; accented Latin letters are folded in their second byte."""
    data = texts.data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    data[after & (data >= 0x80) & (data <= 0x9E)] += 32
    data[~letter] = 32
    return Texts(data, texts.offsets)


def rows_of(words: Words) -> np.ndarray:
    """Table rows of each word: the word itself and its beginnings, or PAD."""
    out = np.full((len(words.hash), PARTS), PAD, np.int32)
    out[:, 0] = words.hash >> np.uint64(64 - ROWS_BITS)
    size = words.end - words.start
    for k, n in enumerate(BEGINNINGS, 1):
        longer = size > n
        hashed = words.bytes_hash(words.start[longer], words.start[longer] + n) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
        out[longer, k] = hashed >> np.uint64(64 - ROWS_BITS)
    return out


def _marks() -> np.ndarray:
    """Hashes of each language's function words."""
    out = []
    for name in LANGUAGES:
        raw = FUNCTION_WORDS[name].encode()
        out.append(np.sort(Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).words().hash))
    return out


def languages(words: Words) -> np.ndarray:
    """Index into LANGUAGES of the language with most function words in each text."""
    counts = []
    for marks in _marks():
        at = np.minimum(np.searchsorted(marks, words.hash), len(marks) - 1)
        sums = np.concatenate([[0], np.cumsum(marks[at] == words.hash)])
        counts.append(sums[words.first[1:]] - sums[words.first[:-1]])
    return np.argmax(np.stack(counts, 1), 1)


class Filters:
    """Embeddings, filters and output unit; forward over padded word rows."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (PAD + 1, DIM)).astype(np.float32)
        self.embed[PAD] = 0
        self.kernel = {w: rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.05, (len(WIDTHS), FILTERS)).astype(np.float32)
        self.shift = np.float32(0)

    def start_from(self, odds: np.ndarray) -> None:
        self.embed[:PAD, 0] = odds / 2
        self.kernel[WIDTHS[0]][0, :, 0] = 0
        self.kernel[WIDTHS[0]][0, 0, 0] = 1
        self.out[0, 0] = 1
        self.shift = np.float32(-2)

    def logits(self, rows: np.ndarray, which: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """rows: parts of each different word; which: all texts' words as indices of rows, GAP pads (-1) after each
        text; starts: first position of each text."""
        total = np.full(len(starts), self.shift, np.float32)
        x = np.concatenate([self.embed[rows].sum(1), np.zeros((1, DIM), np.float32)])
        ends = np.append(starts[1:], len(which))
        for k, w in enumerate(WIDTHS):
            reach = (x @ self.kernel[w][0])[which]
            for o in range(1, w):
                reach[:-o] += (x @ self.kernel[w][o])[which[o:]]
            reach[(ends[:, None] - 1 - np.arange(w - 1)).reshape(-1)] = -np.inf  # these would look into the next text
            top = np.maximum.reduceat(reach, starts, axis=0) + self.bias[w]
            total += np.maximum(top, 0) @ self.out[k]
        return total


def padded(values: np.ndarray, count: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """values with GAP pads after each text's, and the start of each text."""
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    starts = first + GAP * np.arange(len(count))
    out = np.full((len(values) + GAP * len(count), *values.shape[1:]), pad, values.dtype)
    out[np.arange(len(values)) + np.repeat(starts - first, count)] = values
    return out, starts


def log_odds(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each table row: in texts of class 1 against those of class 0."""
    seen = np.zeros((2, PAD + 1))
    for rows, label in zip(texts, y, strict=True):
        seen[label, np.unique(rows)] += 1
    n = np.bincount(y, minlength=2)
    raw = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    trust = seen.sum(0) / (seen.sum(0) + 4)
    return np.clip(raw * trust, -1, 4).astype(np.float32)[:PAD]


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> Filters:
    """Adagrad on the logistic loss; only the winning positions of the filters get gradients."""
    net = Filters()
    net.start_from(log_odds(texts, y))
    rng = np.random.default_rng(11)
    memory = {"embed": np.full(net.embed.shape, 1e-2, np.float32), "out": np.full(net.out.shape, 1e-2, np.float32), "shift": 1e-2}
    memory |= {("k", w): np.full(net.kernel[w].shape, 1e-2, np.float32) for w in WIDTHS} | {("b", w): np.full(FILTERS, 1e-2, np.float32) for w in WIDTHS}

    def step(name, value, gradient):
        memory[name] += gradient * gradient
        value -= RATE * gradient / np.sqrt(memory[name])

    weight = np.array([1.0, np.sqrt((y == 0).sum() / max(1, (y == 1).sum()))], np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            count = np.array([len(texts[i]) for i in some])
            rows, starts = padded(np.concatenate([texts[i] for i in some]), count, PAD)
            ends = starts + count + GAP
            x = net.embed[rows].sum(1)
            total = np.full(len(some), net.shift, np.float32)
            best, value = {}, {}
            for k, w in enumerate(WIDTHS):
                reach = x @ net.kernel[w][0]
                for o in range(1, w):
                    reach[:-o] += x[o:] @ net.kernel[w][o]
                where = np.stack([s + reach[s : max(e - w + 1, s + 1)].argmax(0) for s, e in zip(starts, ends, strict=True)])
                best[w], value[w] = where, np.take_along_axis(reach, where, 0) + net.bias[w]
                total += np.maximum(value[w], 0) @ net.out[k]
            error = (1 / (1 + np.exp(-total)) - y[some]) * weight[y[some]] / len(some)
            out_gradient = np.zeros_like(net.out)
            embed_gradient: list = []
            for k, w in enumerate(WIDTHS):
                out_gradient[k] = error @ np.maximum(value[w], 0)
                back = error[:, None] * net.out[k] * (value[w] > 0)  # texts x filters
                kernel_gradient = np.zeros_like(net.kernel[w])
                for o in range(w):
                    at_words = np.minimum(best[w] + o, len(rows) - 1)
                    vectors = x[at_words]  # texts x filters x dim
                    kernel_gradient[o] = np.einsum("tf,tfd->df", back, vectors)
                    gradient = (back[:, :, None] * net.kernel[w][o].T[None]).reshape(-1, DIM)
                    embed_gradient.append((rows[at_words].reshape(-1), np.repeat(gradient, PARTS, axis=0)))
                step(("k", w), net.kernel[w], kernel_gradient + 1e-4 * net.kernel[w])
                step(("b", w), net.bias[w], back.sum(0))
            step("out", net.out, out_gradient + 1e-4 * net.out)
            at_rows = np.concatenate([r for r, _ in embed_gradient])
            touched, index = np.unique(at_rows, return_inverse=True)
            gradient = np.zeros((len(touched), DIM), np.float32)
            np.add.at(gradient, index, np.concatenate([g for _, g in embed_gradient]))
            gradient[touched == PAD] = 0
            memory["embed"][touched] += gradient * gradient
            net.embed[touched] -= RATE * gradient / np.sqrt(memory["embed"][touched])
            memory["shift"] += float(error.sum()) ** 2
            net.shift -= np.float32(RATE * error.sum() / np.sqrt(memory["shift"]))
    return net


def best_threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors; among equal ones the middle of the widest gap."""
    order = np.argsort(logit)
    logit, y = logit[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[logit[0] - 1], logit, [logit[-1] + 1]])
    width = np.where(errors == errors.min(), np.diff(edges), -1)
    at = int(width.argmax())
    return float((edges[at] + edges[at + 1]) / 2)


def calibrate(net: Filters, texts: list[np.ndarray], y: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Threshold of each language; languages with few cases of a class share that of all."""
    rows, which = np.unique(np.concatenate(texts), axis=0, return_inverse=True)
    which, starts = padded(which.reshape(-1), np.array([len(t) for t in texts]), -1)
    logit = net.logits(rows, which, starts)
    common = best_threshold(logit, y)
    out = np.full(len(LANGUAGES), common, np.float32)
    for k in range(len(LANGUAGES)):
        mine = language == k
        if min((y[mine] == 0).sum(), (y[mine] == 1).sum()) >= 20:
            out[k] = best_threshold(logit[mine], y[mine])
    return out


def packed(net: Filters, thresholds: np.ndarray) -> bytes:
    """The model's arrays in numpy's own file format."""
    out = io.BytesIO()
    kernels = {f"kernel{w}": net.kernel[w] for w in WIDTHS} | {f"bias{w}": net.bias[w] for w in WIDTHS}
    np.savez(out, embed=net.embed, out=net.out, shift=net.shift, thresholds=thresholds, **kernels)
    return out.getvalue()


def unpacked(raw: bytes) -> tuple[Filters, np.ndarray]:
    got, net = np.load(io.BytesIO(raw)), Filters()
    net.embed, net.out, net.shift = got["embed"], got["out"], np.float32(got["shift"])
    net.kernel, net.bias = {w: got[f"kernel{w}"] for w in WIDTHS}, {w: got[f"bias{w}"] for w in WIDTHS}
    return net, got["thresholds"]


def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the model of all labelled rows (doc_id, label, text) that arrive; none without both classes."""
    rows: list = []
    for batch in batches:
        for some, texts in slices(batch, "text"):
            found = folded(texts).words()
            parts, language = rows_of(found), languages(found)
            order = found.run_hash(found.first[:-1], found.first[1:]).tolist()
            for i, (doc, label) in enumerate(zip(some["doc_id"].to_pylist(), some["label"].to_pylist(), strict=True)):
                rows.append((doc, label, order[i], int(language[i]), parts[found.first[i] : found.first[i + 1]].copy()))
    rows.sort(key=lambda r: r[:3])  # the same model, however the rows arrive
    y = np.array([r[1] for r in rows], np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < 5:
        return
    lists, language = [r[4] for r in rows], np.array([r[3] for r in rows])
    apart = np.array([fold_of(r[0], FOLDS) == CALIBRATE for r in rows])
    if min((y[apart] == 0).sum(), (y[apart] == 1).sum()) < 5:
        apart[:] = False
    net = train([t for t, a in zip(lists, apart, strict=True) if not a], y[~apart])
    on = apart if apart.any() else ~apart
    thresholds = calibrate(net, [t for t, a in zip(lists, on, strict=True) if a], y[on], language[on])
    yield record_batch({"model": pa.array([packed(net, thresholds)], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[Filters, np.ndarray] | None:
    """Train on labelled rows outside the held-out fold, about sample_rows of them at most, of sample_bytes each at most.

    The bounded sample goes to one task, which trains; the driver gets the model only.
    """
    known = labels.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    n = known.count()
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < sample_rows)
    texts = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= sample_bytes).select("doc_id", "text").join(sample, "doc_id")
    got = texts.select("doc_id", "label", "text").repartition(1).mapInArrow(learn, "model binary").collect()
    return unpacked(got[0].model) if got else None


def probabilities(texts: Texts, model: tuple[Filters, np.ndarray]) -> np.ndarray:
    net, thresholds = model
    words = folded(texts).words()
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    which, starts = padded(which, words.count, -1)
    logit = net.logits(rows_of(words.at(first)), which, starts) - thresholds[languages(words)]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -50, 50)))


def score(docs: DataFrame, model: tuple[Filters, np.ndarray] | None) -> DataFrame:
    def run(rows, texts):
        p = np.full(len(texts), 0.25) if model is None else probabilities(texts, model)
        held = np.array([fold_of(i, FOLDS) == HELD_OUT for i in rows["doc_id"].to_pylist()], bool)
        return {"doc_id": rows["doc_id"], "held_out": held, "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return map_texts(docs.select("doc_id", "text"), "doc_id long, held_out boolean, score double, predicted int", run)


def fit_and_score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, sample_rows))


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs less those whose text the classifier rejects; scored in place, so equal ids can't be mixed up."""
    model = fit(docs, labels, sample_rows)
    if model is None:
        return docs

    def keep(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                clean = probabilities(texts, model) < 0.5
                if clean.any():
                    yield rows.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_score(table(spark, sf_dir, "documents"), toxic_labels(spark, sf_dir))
