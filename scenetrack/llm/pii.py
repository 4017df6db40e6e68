"""Personal data: strict patterns, and more spans by weak supervision.

Strict (base) spans follow fixed patterns and checks and are always kept. Loose candidates are spelled-out addresses,
long digit groups and unprefixed phone numbers outside base spans. Labelers (patterns, a gazetteer of issuers, dialling
codes and domains, checksums, context words) vote on every span, or abstain. Expectation-maximisation over the vote
patterns of the whole corpus estimates each labeler's reliability and each pattern's probability. A logistic span
classifier learns these probabilities from features of the span and its surroundings, half of which no labeler reads; loose
candidates that it accepts become weak_* spans. Weak spans meet no base span and no other weak span (of those that meet,
the leftmost stays, of equal starts the longest, of equal spans the first kind).

Only counts of (kind, votes, features) codes reach the driver; their number is bounded by the codes, not the data.

Defined cases: null is the empty text, with zero counts, the digest of the empty string and empty spans; an empty table
gives no rows; repeated rows are done each; extra columns are ignored; very long runs are scanned in linear time.
"""

from __future__ import annotations

import bisect
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table
from .textops import map_texts, record_batch

KINDS = ("email", "ip", "card", "phone")
WEAK = tuple(f"weak_{k}" for k in KINDS)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive forms match what the greedy ones would, in linear time; no match can begin inside a run of digits
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}+)+", re.I)
LOCAL_PHONE = re.compile(r"(?<![0-9.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
SIX = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
DIGITS = re.compile(r"[0-9]++")

# Gazetteer of card issuers' first digits, dialling codes, common domains; context words.
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
DIALLING = ("1", "33", "34", "44", "49")
DOMAINS = ("com", "org", "net", "edu", "de", "fr", "es", "uk")
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobil"),
}
AGAINST = ("token", "sha", "hash", "version", "key", "id=")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an @ that a domain follows."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list] = {"email": emails(text)}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out["card"] = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    out["phone"] = []
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of loose candidates, not yet apart from base spans."""
    out = []
    if "at" in text or "AT" in text:
        low = text.lower()
        if "(at)" in low or "[at]" in low:
            out += [(0, *m.span()) for m in SPELLED.finditer(text)]
    if text.count(":") >= 7:
        out += [(1, *m.span()) for m in SIX.finditer(text)]
    for m in DIGITS.finditer(text):
        if 13 <= m.end() - m.start() <= 19:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in LOCAL_PHONE.finditer(text)]
    return out


def votes(kind: int, strict: bool, text: str, start: int, end: int) -> tuple[int, int]:
    """Code of the labelers' votes (base 3 digits: 0 abstains, 1 no, 2 yes) and code of the span's features."""
    span = text[start:end]
    before = text[max(0, start - 24) : start].lower()
    digits = "".join(c for c in span if c.isascii() and c.isdigit())
    cast = [2 if strict else 0]
    if kind == 0:
        cast.append(2 if re.split(r"[.\x20)\]]", span.lower())[-1] in DOMAINS else 1)
        cast.append(0)
    elif kind == 1:
        cast += [0, 1 if len(set(span)) < 4 else 2]
    elif kind == 2:
        cast.append(2 if digits.startswith(ISSUERS) else 1)
        cast.append(2 if luhn(digits) else 1)
    else:
        cast.append(2 if span.startswith("+") and digits.startswith(DIALLING) else 0)
        cast.append(2 if 8 <= len(digits) <= 15 else 1)
    near = any(w in before for w in CONTEXT[KINDS[kind]])
    against = any(w in before for w in AGAINST)
    cast.append(1 if against else 2 if near else 0)
    edge = (start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "=_\"'")) and (end == len(text) or not (text[end].isalnum() or text[end] in "_\"'"))
    cast.append(2 if edge else 1)
    code = 0
    for c in cast:
        code = code * 3 + c
    features = [cast[1] == 2, cast[2] == 2, near, against, edge, len(digits) >= 16]
    # what no labeler reads: the span's make-up, and what stands around it
    line = before.rpartition("\n")[2]
    features += [len(set(digits)) > 4, any(c in span for c in " -.()"), len(span) > 24, line.rstrip().endswith((":", "=")), any(c.isdigit() for c in line), text[end : end + 1] in ("", ".", ",", ";", "\n")]
    return code, sum(int(f) << i for i, f in enumerate(features))


LABELERS = 5
FEATURES = 12


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of kind, start, end) and spans' codes: every candidate with kind, start, end, strict, votes, features."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())])

    def work(rows, texts):
        out = []
        for raw in rows["text"]:
            text = raw.as_py() or ""
            base = base_spans(text)
            mine = [(k, s, e, True) for k, name in enumerate(KINDS) for s, e in base[name]]
            starts, reach = reaches(sorted((s, e) for _, s, e, _ in mine))
            for k, s, e in loose_spans(text):
                if not overlaps(starts, reach, s, e):
                    mine.append((k, s, e, False))
            out.append([dict(zip(("kind", "start", "end", "strict", "votes", "features"), (*x, *votes(x[0], x[3], text, x[1], x[2])), strict=True)) for x in mine])
        return {"doc_id": rows["doc_id"], "found": pa.array(out, pa.list_(span))}

    return map_texts(docs.select("doc_id", "text"), "doc_id long, found array<struct<kind:int,start:long,end:long,strict:boolean,votes:int,features:int>>", work)


def reaches(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts of sorted spans, and the furthest end of each and all before it."""
    return [s for s, _ in spans], list(itertools.accumulate((e for _, e in spans), max))


def overlaps(starts: list[int], reach: list[int], start: int, end: int) -> bool:
    """Whether a span meets one of those spans."""
    at = bisect.bisect_left(starts, end)  # these begin before the end
    return at > 0 and reach[at - 1] > start


def apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of spans that don't meet: from the left, the longest first; of equal ones the least kind."""
    out: list = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if not out or out[-1][2] <= s:
            out.append((k, s, e))
    return out


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability of each vote pattern under a two-class model with independent labelers, by EM."""
    cast = np.stack([codes // 3**i % 3 for i in range(LABELERS - 1, -1, -1)], 1)
    p = np.clip(0.5 + 0.15 * ((cast == 2).sum(1) - (cast == 1).sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        share = np.clip((p * counts).sum() / counts.sum(), 0.02, 0.98)
        log = np.full(len(codes), np.log(share) - np.log(1 - share))
        for j in range(LABELERS):
            for v in (1, 2):  # abstaining says nothing
                at = cast[:, j] == v
                yes = (((p * counts)[at]).sum() + 1) / ((p * counts)[cast[:, j] > 0].sum() + 2)
                no = ((((1 - p) * counts)[at]).sum() + 1) / (((1 - p) * counts)[cast[:, j] > 0].sum() + 2)
                log[at] += np.log(yes) - np.log(no)
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return p


def span_classifier(features: np.ndarray, p: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression on feature bits (last: intercept), by Newton steps on soft labels."""
    x = np.column_stack([*((features >> i & 1) for i in range(FEATURES)), np.ones(len(features))]).astype(float)
    w = np.zeros(x.shape[1])
    weight = counts / counts.sum() * len(counts)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (q - p)) + 0.01 * w
        curve = (x * (weight * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(curve, gradient)
    return w


def learn(found: DataFrame) -> dict[int, np.ndarray]:
    """Classifier weights of each kind that has candidates, from the codes of all spans of the corpus."""
    codes = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n")).orderBy("kind", "votes", "features").toPandas()
    out = {}
    for kind, rows in codes.groupby("kind"):
        counts = rows.n.to_numpy(float)
        p = reliabilities(rows.votes.to_numpy(), counts)
        out[int(kind)] = span_classifier(rows.features.to_numpy(), p, counts)
    return out


def accepts(weights: np.ndarray, features: int) -> bool:
    return float(sum(weights[i] for i in range(FEATURES) if features >> i & 1) + weights[-1]) > 0


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end), base kinds first, then weak_* ones, each by start."""
    found = cut_lineage(find_spans(docs))
    weights = learn(found)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for spans in batch["found"].to_pylist():
                kept = [(s["kind"], s["start"], s["end"]) for s in spans if s["strict"]]
                weak = [(s["kind"] + len(KINDS), s["start"], s["end"]) for s in spans if not s["strict"] and accepts(weights[s["kind"]], s["features"])]
                out.append([{"kind": (KINDS + WEAK)[k], "start": a, "end": b} for k, a, b in sorted(kept + apart(weak))])
            yield record_batch({"doc_id": batch["doc_id"], "spans": pa.array(out, span)})

    return found.select("doc_id", "found").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
