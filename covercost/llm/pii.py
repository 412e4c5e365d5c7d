"""Operator 4: personal data by candidate generators and gradient-boosted trees.

Fixed patterns with validators give the base spans of four kinds (email, ip,
card, phone).  Beside them, high-recall generators propose overlapping spans
(addresses written with "(at)", digit groups, long mixed strings); boosted
trees score each from its format and context; spans at or above a calibrated
threshold are taken, best first, where they don't overlap a span taken before.

The trees are trained here, on at most TRAIN_SPANS candidates of about
TRAIN_DOCS documents chosen by a hash of the id (a documented bound).  Their
target is weak: does a candidate pass the strict validators (which are not
features)?  A held-out fifth calibrates the threshold: the least score at which
LEAST_PRECISION of the candidates pass.

Defined cases: null text is empty and has no spans; texts are searched whole;
repeated rows give repeated results; with no candidates to learn from nothing
is added; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm.base import few_of, table

#: The kinds in order, and their patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "number", "key")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Generators of further candidates.
NUMBER = re.compile(r"\+?[0-9(][0-9().\x20/-]{5,24}[0-9]")
KEY = re.compile(r"[A-Za-z0-9_/+=-]{12,}")
AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[A-Za-z0-9-]{1,63})+", re.I)
KNOWN_KEY = re.compile(r"AKIA[0-9A-Z]{16}|(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-f]{32,}|[A-Za-z]+=[A-Za-z0-9_/+-]{8,})")

TRAIN_DOCS, TRAIN_SPANS = 20_000, 20_000
LEAST_PRECISION = 0.9
TREES, DEPTH, RATE, BINS = 30, 3, 0.3, 32

Span = tuple[int, int, str]


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping addresses: the longest local part before each @, then the longest domain."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text.split("."))


def valid_card(text: str) -> bool:
    d = only_digits(text) if len(text) <= 40 else ""
    return 14 <= len(d) <= 19 and luhn(d)


def valid_phone(text: str) -> bool:
    return 10 <= sum("0" <= c <= "9" for c in text) <= 15


def base_spans(text: str) -> list[Span]:
    """The base spans, by start and then kind."""
    found = emails(text)
    for kind, pattern, valid in (("ip", IP, valid_ip), ("card", CARD, valid_card), ("phone", PHONE, valid_phone)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(m[0])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[Span]:
    """High-recall, overlapping proposals."""
    out = [(m.start(), m.end(), "number") for m in NUMBER.finditer(text) if sum("0" <= c <= "9" for c in m[0]) >= 6]
    for m in KEY.finditer(text):
        s = m[0]
        if not s.isalpha() and any("0" <= c <= "9" for c in s) and not s.isdigit():
            out.append((m.start(), m.end(), "key"))
    if "at" in text or "AT" in text:
        out += [(m.start(), m.end(), "email") for m in AT.finditer(text)]
    return out


def passes(span: str) -> bool:
    """The weak target: a whole span that a strict validator takes."""
    return bool((IP.fullmatch(span) and valid_ip(span)) or (CARD.fullmatch(span) and valid_card(span)) or (PHONE.fullmatch(span) and valid_phone(span))
                or KNOWN_KEY.fullmatch(span) or AT.fullmatch(span))


FEATURES = 18


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "=:\"'" else 4


def describe(text: str, a: int, b: int) -> list[float]:
    """Format and context of a span; of its characters the first 200 count (a span of a generator may be longer)."""
    s = text[a:b]
    few = s[:200]
    counts: dict[str, int] = {}
    for c in few:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(n / len(few) * math.log2(n / len(few)) for n in counts.values())
    groups = [len(g) for g in re.findall(r"[0-9]+", few)] or [0]
    digits = sum(groups)
    upper, lower = sum(map(str.isupper, few)), sum(map(str.islower, few))
    before, after = text[a - 1:a], text[b:b + 1]
    return [len(s), digits, upper, lower, digits / len(few), upper / len(few), counts.get(" ", 0), counts.get(".", 0), counts.get("-", 0),
            counts.get("(", 0), counts.get("=", 0), s[0] == "+", len(groups), max(groups), min(groups), entropy, _side(before), _side(after)]


def grow(x: np.ndarray, y: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Boosted regression trees of the logistic loss; a tree is (feature, bin, leaf values) of a complete tree."""
    codes = np.stack([np.searchsorted(edges[f], x[:, f], side="right") for f in range(x.shape[1])], axis=1)
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-9
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                cell = (node - first) * (BINS + 1) + codes[:, f]
                gs, hs = (np.bincount(cell, v, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1) for v in (g, h))
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs)**2 / (hs[:, -1:] - hs + 1) - gs[:, -1:]**2 / (hs[:, -1:] + 1)
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[first:first + width][better], cut[first:first + width][better] = f, k[better]
            node = 2 * node + 1 + (codes[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        score += value[leaf]
        trees.append((feature, cut, value))
    return trees


def score_of(x: np.ndarray, edges: np.ndarray, trees: list) -> np.ndarray:
    codes = np.stack([np.searchsorted(edges[f], x[:, f], side="right") for f in range(x.shape[1])], axis=1)
    rows, score = np.arange(len(x)), np.zeros(len(x))
    for feature, cut, value in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
        score += value[node - (2**DEPTH - 1)]
    return 1 / (1 + np.exp(-score))


def train(docs: DataFrame):
    """(bin edges, trees, threshold) from the candidates of a bounded sample of documents; None without any."""

    def propose(batches):
        for batch in batches:
            x, y, keys = [], [], []
            for text in batch.column(0).to_pylist():
                for a, b, _ in candidates(text or ""):
                    x.append(describe(text, a, b))
                    y.append(passes(text[a:b]))
                    keys.append(int.from_bytes(hashlib.blake2b(text[max(0, a - 40):b].encode("utf-8", "replace"), digest_size=7).digest(), "big"))
            if x:
                yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), pa.array(y), pa.array(keys, pa.int64())], names=["x", "y", "key"])

    some = few_of(docs, TRAIN_DOCS, 3).select(F.col("text").cast("string"))
    rows = some.mapInArrow(propose, "x array<double>, y boolean, key long").dropDuplicates(["key"]).orderBy("key").limit(TRAIN_SPANS).toArrow()
    if not len(rows):
        return None
    x = np.array(rows.column("x").to_pylist())
    y = rows.column("y").to_numpy(zero_copy_only=False).astype(float)
    held = rows.column("key").to_numpy() % 5 == 0
    edges = np.stack([np.quantile(x[:, f], np.linspace(0, 1, BINS + 2)[1:-1], method="nearest") for f in range(x.shape[1])])
    if held.all() or not held.any():
        held = np.zeros(len(y), bool)
    trees = grow(x[~held], y[~held], edges)
    check = held if held.any() else ~held
    p, t = score_of(x[check], edges, trees), y[check]
    order = np.argsort(-p, kind="stable")
    precision = np.cumsum(t[order]) / np.arange(1, len(p) + 1)
    fine = np.flatnonzero(precision >= LEAST_PRECISION)
    return edges, trees, max(0.5, float(p[order][fine[-1]])) if len(fine) else math.inf


def find(texts: list[str | None], model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    proposed = [candidates(t) if t else [] for t in texts] if model else [[] for _ in texts]
    x = [describe(t, a, b) for t, c in zip(texts, proposed, strict=True) for a, b, _ in c]
    scores = score_of(np.array(x, float), model[0], model[1]) if x else np.zeros(0)
    out, k = [], 0
    for own, spans in zip(base, proposed, strict=True):
        taken = list(own)
        best = sorted(zip(scores[k:k + len(spans)].tolist(), spans, strict=True), key=lambda c: (-c[0], c[1]))
        k += len(spans)
        for p, (a, b, kind) in best:
            if p >= model[2] and not any(a < e and s < b for s, e, _ in taken):
                taken.append((a, b, kind))
        out.append((own, sorted(taken, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def detect(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans, and all spans of every row."""
    model = spark.sparkContext.broadcast(train(docs))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                found = find(part.column(1).to_pylist(), model.value)
                counts = [pa.array([sum(s[2] == kind for s in own) for own, _ in found], pa.int64()) for kind in BASE_KINDS]
                yield pa.record_batch([part.column(0).cast(pa.int64()), *counts,
                                       pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in found], pa.string()),
                                       pa.array([joined(every) for _, every in found], pa.string())], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with each selected span of ``text`` replaced by its kind in angle brackets; null texts stay null."""
    model = spark.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(at).to_pylist()
                out = []
                for text, (_, spans) in zip(texts, find(texts, model.value), strict=True):
                    pieces, done = [], 0
                    for a, b, kind in spans:
                        if a >= done:
                            pieces += [text[done:a], f"<{kind.upper()}>"]
                        elif pieces and b > done:  # overlaps a span of another kind: hidden with it
                            pass
                        done = max(done, b)
                    out.append("".join([*pieces, text[done:]]) if pieces else text)
                yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark, table(spark, sf_dir, "documents"))
