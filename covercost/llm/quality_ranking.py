"""Operator 6: document quality by Bradley-Terry pairwise ranking.

Features describe a whole text.  From labelled documents, preference pairs (a
good one over a poor one) train a weight per feature by the logistic loss of
the pair's feature difference.  The score is the weighted sum on a logistic
curve placed so that 0.3 falls on a quantile of the training scores: the share
of poor documents among the labelled ones.

Every labelled document outside the held-out bucket is learned from, and every
pair of a good and a poor one: a pass sums both classes' documents by bins of
their present score, and the loss of all pairs follows from the pairs of bins,
each at its documents' mean score.  What is learned is rounded, so the order
of the rows changes nothing.

Defined cases: null text is scored as empty; texts are read whole; repeated
rows give repeated results; without labels of both classes every score is 0;
an empty table gives an empty result; lang, source and further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm.base import counts_per, slices, stage, table, text_bytes, word_hashes
from covercost.llm.labelled import held_out, order_statistics, training_labels

#: Most passes over the training features, and the slope of the loss at which they end.
PASSES, FLAT = 40, 1e-4
#: Bins of the score's unit, the bin beyond which scores share one, and the weight of the ridge.
BINS, LAST_BIN, RIDGE = 16, 1024, 1e-3
THRESHOLD = 0.3
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&|<>@{}[]\\^~=_",
          "bang": b"!?", "stop": b".,;:", "blank": b" ", "line": b"\n", "bar": b"|"}


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    data, offsets = text_bytes(texts)
    out = []
    for lo, hi in slices(offsets):
        raw, own = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        size = np.maximum(1, np.diff(own))
        rates = []
        for chars in _KINDS.values():
            sums = np.concatenate(([0], np.cumsum(np.isin(raw, np.frombuffer(chars, np.uint8)))))
            rates.append((sums[own[1:]] - sums[own[:-1]]) / size)
        sums = np.concatenate(([0], np.cumsum(raw >= 128)))
        rates.append((sums[own[1:]] - sums[own[:-1]]) / size)
        doc, words, starts, ends = word_hashes(raw, own)
        bounds = counts_per(doc, hi - lo)
        n = np.maximum(1, np.diff(bounds))
        order = np.lexsort((words, doc))
        w, d = words[order], doc[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
        kinds = np.bincount(d[new], minlength=hi - lo) / n
        length = np.bincount(doc, ends - starts, hi - lo) / n
        odd = np.bincount(doc, np.isin(raw[ends - 1], np.frombuffer(b"#*$%&|<>!", np.uint8)), hi - lo) / n if len(words) else np.zeros(hi - lo)
        lines, line_hash, line_start, line_end = word_hashes(raw, own, np.arange(256) == 10)
        order = np.lexsort((line_hash, lines))
        same = np.zeros(len(order), bool)
        same[1:] = (line_hash[order][1:] == line_hash[order][:-1]) & (lines[order][1:] == lines[order][:-1])
        n_lines = np.maximum(1, np.bincount(lines, minlength=hi - lo))
        repeated = np.bincount(lines[order][same], minlength=hi - lo) / n_lines
        few = np.minimum(np.log1p(np.diff(bounds)), 5.0)  # beyond some 150 words length says nothing about quality
        out.append(np.stack([*rates, kinds, np.minimum(length, 30) / 10, odd, repeated, few, rates[0] / np.maximum(1e-9, rates[0] + rates[1])], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(_KINDS) + 7))


def rounded(x, digits: int = 9):
    """``x`` without the last digits of its sums, which depend on the order of the rows."""
    return np.round(np.asarray(x, float), digits)


def scored_pass(train: DataFrame, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray):
    """For both classes (poor, good): documents in each bin of their scores, and the sums of their expanded features."""
    names = [f"z{k}" for k in range(len(weights))]

    def binned(batches):
        for batch in batches:
            if not len(batch):
                continue
            z = expand(np.stack(batch.column(0).to_numpy(zero_copy_only=False)), centre, spread)
            at = np.clip(np.floor((z @ weights) * BINS), -LAST_BIN, LAST_BIN).astype(np.int64) * 2 + batch.column(1).to_numpy()
            keys, of = np.unique(at, return_inverse=True)
            sums = [np.bincount(of, z[:, k], len(keys)) for k in range(z.shape[1])]
            yield pa.record_batch([pa.array(keys), pa.array(np.bincount(of, minlength=len(keys))), *(pa.array(x) for x in sums)], names=["key", "n", *names])

    rows = train.select("x", "y").mapInArrow(binned, "key long, n long, " + ", ".join(f"{x} double" for x in names))
    got = rows.groupBy("key").agg(*(F.sum(x).alias(x) for x in ("n", *names))).orderBy("key").toArrow()
    of_class = got.column("key").to_numpy() % 2
    n, z = got.column("n").to_numpy().astype(float), np.stack([got.column(x).to_numpy() for x in names], axis=1)
    return [(n[of_class == c], z[of_class == c]) for c in (0, 1)]


def pair_loss(poor, good, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of all pairs of a good and a poor document, with the ridge, and its gradient."""
    (n0, z0), (n1, z1) = poor, good
    d = (z1 @ weights / n1)[:, None] - (z0 @ weights / n0)[None, :]
    pairs = n1.sum() * n0.sum()
    wrong = 1 / (1 + np.exp(np.clip(d, -500, 500)))
    gradient = ((wrong * n1[:, None]).sum(axis=0) @ z0 - (wrong * n0[None, :]).sum(axis=1) @ z1) / pairs
    loss = (np.logaddexp(0, -d) * n1[:, None] * n0[None, :]).sum() / pairs
    return loss + RIDGE / 2 * weights @ weights, gradient + RIDGE * weights


def fit(train: DataFrame, centre: np.ndarray, spread: np.ndarray, size: int) -> np.ndarray:
    """The weights of least loss, by quasi-Newton (BFGS) steps of at most PASSES passes."""
    at = np.zeros(size)
    loss, slope = pair_loss(*scored_pass(train, centre, spread, at), at)
    inverse, first, length = np.eye(size), True, 1.0
    for _ in range(PASSES):
        if np.abs(slope).max() < FLAT:
            break
        step = -inverse @ slope
        new = at + length * step
        new_loss, new_slope = pair_loss(*scored_pass(train, centre, spread, new), new)
        if not new_loss <= loss + 1e-4 * length * (slope @ step):
            length /= 4
            continue
        s, y = new - at, new_slope - slope
        if s @ y > 1e-12:
            if first:
                inverse, first = np.eye(size) * (s @ y) / (y @ y), False
            side = np.eye(size) - np.outer(s, y) / (s @ y)
            inverse = side @ inverse @ side.T + np.outer(s, s) / (s @ y)
        at, loss, slope, length = new, new_loss, new_slope, 1.0
    return rounded(at, 6)


def rank(train: DataFrame, poor_share: float):
    """(centre, spread, weights, offset, slope) of the ranking learned from written features ``x`` with ``y``; ``poor_share``: of all labelled documents."""
    size = len(_KINDS) + 7
    each = [F.get("x", F.lit(k)) for k in range(size)]
    got = train.agg(*(F.avg(x) for x in each), *(F.stddev_pop(x) for x in each)).first()
    centre, spread = rounded(got[:size]), rounded(got[size:]) + 1e-6
    weights = fit(train, centre, spread, 2 * size)

    def rated(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                yield pa.record_batch([batch.column(1), pa.array(rounded(expand(x, centre, spread) @ weights))], names=["g", "v"])

    scores = stage(train.sparkSession, train.select("x", "y").mapInArrow(rated, "g int, v double"), "quality-ranks")
    n = dict(scores.groupBy("g").agg(F.count("*")).collect())
    # all documents in one order, of which the share of poor ones lies below the threshold
    k = min(max(0, int(np.ceil(poor_share * (n[0] + n[1]) - 1e-9)) - 1), n[0] + n[1] - 1)
    low, high = order_statistics(scores.select(F.lit(0).alias("g"), "v"), [(0, k), (0, min(k + 1, n[0] + n[1] - 1))])
    spread_of = scores.agg(F.stddev_pop("v")).first()[0]
    return centre, spread, weights, (low + high) / 2, float(rounded(4 / max(1e-9, spread_of), 6))


def expand(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / spread, -5, 5)
    return np.concatenate([z, z * z], axis=1)


def score_of(x: np.ndarray, model) -> np.ndarray:
    centre, spread, weights, cut, slope = model
    zero = np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(slope * (expand(x, centre, spread) @ weights - cut) + zero, -500, 500)))


def learn(spark: SparkSession, described: DataFrame, labels: DataFrame):
    """The ranking model from the features ``x`` of all documents, or None without training documents of both classes."""
    own = training_labels(labels, "quality")
    train = stage(spark, described.join(own, F.col("doc_id") == F.col("_id")).select("x", "y"), "quality-training")
    if train.select("y").distinct().count() < 2:
        return None
    sizes = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return rank(train, sizes[0] / (sizes[0] + sizes[1]))


def describe(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and features ``x`` of every row, written: texts are read once, and never moved."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")
    return stage(spark, rows, "quality-features")


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    described = describe(spark, docs)
    shared = spark.sparkContext.broadcast(learn(spark, described, labels))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            p = score_of(x, shared.value) if shared.value else np.zeros(len(batch))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = described.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
