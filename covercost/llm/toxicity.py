"""Operator 1: toxicity by class-conditional Kneser-Ney word models.

Toxic and ordinary documents each get an interpolated Kneser-Ney bigram model.
Pairs are counted in documents, so a repeated line counts once; a word counts by its distinct predecessors in the class.  Absolute
discounts (from counts of counts) and a concentration hand mass down: pairs to
the class's words, and those to one shared distribution, the distinct
predecessors of each word in the whole corpus, unlabelled documents included.
Every seen word and pair is kept.  A document's evidence is its toxic minus its
ordinary log-likelihood per word, less what words after the same contexts have
on average in training (of contexts that are rare there, little), so that the
classes' mix of languages and subjects is no evidence.  A part of the training documents that the
models didn't see chooses the concentrations (most pairs of a toxic and an
ordinary document in order) and fits the logistic curve that gives the score.

Models are learned from at most 2 * PER_CLASS labelled documents outside the
held-out bucket (a documented bound, which bounds what is broadcast); the
shared counts cover all documents.  They are estimated by multiresolution
bitmaps, which merge by bitwise or: no pair of words leaves its task.

Defined cases: null, blank or wordless text scores the calibrated prior of no
evidence; documents of any length are scored whole; repeated rows give repeated
results; without labels of both classes every score is 0; an empty table gives
an empty result; lang, source and further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm.base import NOT_ALNUM, mix, slices, stage, stream, table, text_bytes, word_hashes
from covercost.llm.labelled import held_out, sample

PER_CLASS = 4000
#: Concentrations to choose from, in parts of a class's counts: of its words on the shared distribution, of a word's pairs on the class's words.
WORD_WEIGHTS, PAIR_WEIGHTS = (0.0, 1.0, 10.0, 100.0), (0.0, 1.0, 100.0, 10_000.0)
#: Bitmaps of LEVELS resolutions count a word's distinct predecessors, each those whose hash ends in 4 more zero bits than the one before;
#: the first one with at most FULL of its 64 bits set is read.
LEVELS, FULL = 6, 52
#: A context followed by this many words of the training documents counts half when a text's usual ratio is taken from its contexts.
SURE = 10
#: Of the training documents one in CALIBRATE fits the score curve instead of the models.
CALIBRATE = 4
_LEFT, _RIGHT = stream(121, 2)
START = np.uint64(1)


def tokens(texts: pa.Array):
    """(first row, document of each word, word hashes, hashes of each word with its predecessor), slice by slice."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    for lo, hi in slices(offsets):
        doc, words, _, _ = word_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], NOT_ALNUM)
        before = np.empty_like(words)
        before[:1], before[1:] = START, words[:-1]
        before[np.flatnonzero(doc[1:] != doc[:-1]) + 1] = START
        yield lo, hi, doc, words, before


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _LEFT + words * _RIGHT)


def merged(words: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, and the bitwise or of each one's rows of ``maps``."""
    order = np.argsort(words)
    words = words[order]
    new = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
    return words[new], np.bitwise_or.reduceat(maps[order], new) if len(new) else maps[:0]


def bitmaps(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One bit for each word's predecessor in every level that takes it."""
    own = pair_keys(before, words)
    bit = np.uint64(1) << (own >> np.uint64(58))
    return np.stack([np.where(own & np.uint64((1 << 4 * k) - 1) == 0, bit, np.uint64(0)) for k in range(LEVELS)], axis=1)


def distinct(columns: list[str]):
    """The number of distinct predecessors that bitmaps tell: by linear counting in the first level that isn't full."""
    out = None
    for k in reversed(range(LEVELS)):
        free = 64 - F.bit_count(F.col(columns[k]))
        here = F.lit(64.0 * 16**k) * F.log(F.lit(64.0) / F.greatest(free, F.lit(1)))
        out = here if out is None else F.when(free >= 64 - FULL, here).otherwise(out)
    return out


def corpus_counts(docs: DataFrame) -> DataFrame:
    """word -> number n of distinct words before it (a text's beginning is one) in all documents, estimated."""
    names = [f"b{k}" for k in range(LEVELS)]

    def count(batches):
        for batch in batches:
            for _, _, _, words, before in tokens(batch.column(0)):
                keys, maps = merged(words, bitmaps(before, words))
                yield pa.record_batch([pa.array(keys.view(np.int64)), *(pa.array(maps[:, k].copy().view(np.int64)) for k in range(LEVELS))], names=["word", *names])

    seen = docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, " + ", ".join(f"{x} long" for x in names))
    return seen.groupBy("word").agg(*(F.bit_or(x).alias(x) for x in names)).select("word", distinct(names).alias("n"))


def class_counts(train: DataFrame) -> DataFrame:
    """(before, word) -> number of training documents of either class, n0 and n1."""

    def count(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            for lo, _, doc, words, before in tokens(batch.column(0)):
                order = np.lexsort((words, before, doc))
                doc, before, words = doc[order], before[order], words[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (before[1:] != before[:-1]) | (words[1:] != words[:-1])
                yield pa.record_batch([pa.array(y[lo + doc[new]].astype(np.int32)), pa.array(before[new].view(np.int64)), pa.array(words[new].view(np.int64))], names=["y", "before", "word"])

    seen = train.select("text", "y").mapInArrow(count, "y int, before long, word long")
    return seen.groupBy("before", "word").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))


def discount(n: np.ndarray) -> float:
    """Kneser and Ney's estimate from how many counts are 1 and 2."""
    once, twice = (n == 1).sum(), (n == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.75


class Counts:
    """Pairs, words and contexts in sorted hash arrays, with either class's counts of them."""

    def __init__(self, before: np.ndarray, word: np.ndarray, n: list[np.ndarray]):
        """``n``: for each class, the documents that hold the pair (before, word)."""
        order = np.argsort(pair_keys(before, word))
        before, word = before[order], word[order]
        self.keys, self.n = pair_keys(before, word), [x[order] for x in n]
        self.words, self.word_of = np.unique(word, return_inverse=True)
        self.contexts, self.context_of = np.unique(before, return_inverse=True)
        self.before = [np.bincount(self.word_of, x > 0, len(self.words)) for x in self.n]  # distinct predecessors

    def ratios(self, shared: np.ndarray, word_weight: float, pair_weight: float) -> Model:
        """``shared``: probability of each of ``words`` in the shared distribution."""
        of_word, of_context, of_pair, unseen = 0.0, 0.0, 0.0, 0.0
        for sign, pairs, n in zip((-1, 1), self.n, self.before, strict=True):
            total = max(1.0, n.sum())
            d = discount(n)
            left = (np.minimum(n, d).sum() + word_weight * total) / (total * (1 + word_weight)) or 1.0
            p = np.maximum(n - d, 0) / (total * (1 + word_weight)) + left * shared
            d = discount(pairs)
            size = np.bincount(self.context_of, pairs, len(self.contexts)) + pair_weight * total
            back = np.bincount(self.context_of, np.minimum(pairs, d), len(self.contexts)) + pair_weight * total
            back = np.where(size > 0, back / np.maximum(size, 1e-300), 1.0)
            full = np.maximum(pairs - d, 0) / np.maximum(size, 1e-300)[self.context_of] + back[self.context_of] * p[self.word_of]
            of_word, of_context, of_pair, unseen = of_word + sign * np.log(p), of_context + sign * np.log(back), of_pair + sign * np.log(full), unseen + sign * np.log(left)
        seen = self.n[0] + self.n[1]
        sure = np.bincount(self.context_of, seen, len(self.contexts))
        norm = np.bincount(self.context_of, seen * of_word[self.word_of], len(self.contexts)) / np.maximum(sure, 1)
        sure = sure / (sure + SURE)
        return Model(self.keys, self.words, self.contexts, *(x.astype(np.float32) for x in (of_pair, of_word, of_context, norm, sure)), float(unseen))


@dataclass
class Model:
    """Toxic minus ordinary log-probability of pairs; of words, and of contexts' backoff weights, for pairs that neither class has.

    ``norm`` is the average over the words seen after each context, and ``sure`` its weight.
    """

    keys: np.ndarray
    words: np.ndarray
    contexts: np.ndarray
    of_pair: np.ndarray
    of_word: np.ndarray
    of_context: np.ndarray
    norm: np.ndarray
    sure: np.ndarray
    unseen: float

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Toxic minus ordinary log-likelihood per word of each text; 0 without words."""
        out = np.zeros(len(texts))
        for lo, hi, doc, words, before in tokens(texts):
            k = find(self.keys, pair_keys(before, words))
            each = self.of_pair[k]
            c = find(self.contexts, before)
            rest = np.flatnonzero(k < 0)
            w = find(self.words, words[rest])
            each[rest] = np.where(w >= 0, self.of_word[w], self.unseen) + np.where(c[rest] >= 0, self.of_context[c[rest]], 0)
            sure = np.where(c >= 0, self.sure[c], 0)
            usual = np.bincount(doc, sure * self.norm[c], hi - lo) / np.maximum(np.bincount(doc, sure, hi - lo), 1e-9)
            out[lo:hi] = np.bincount(doc, each, hi - lo) / np.maximum(np.bincount(doc, minlength=hi - lo), 1) - usual
        return out


def in_order(x: np.ndarray, y: np.ndarray) -> float:
    """Share of the pairs of a toxic and an ordinary text of which the toxic one has more evidence (ties: half)."""
    bad, fine = x[y == 1], np.sort(x[y == 0])
    return float((np.searchsorted(fine, bad) + np.searchsorted(fine, bad, side="right")).mean() / 2 / len(fine))


def find(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(of), -1)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, at, -1)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a class-balanced logistic curve: Newton steps of bounded size, with a small ridge on the slope."""
    a, b, ridge = 0.0, 0.0, 1e-3
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    centre, spread = float(np.median(x)), max(1e-9, float(x.std()))
    z = (x - centre) / spread
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (y - p), weight * p * (1 - p)
        grad = np.array([(g * z).sum() - ridge * a, g.sum()])
        hess = np.array([[(h * z * z).sum() + ridge, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a, b = a + step[0], b + step[1]
    return a / spread, b - a * centre / spread


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame):
    """(model, slope, offset), or None without training documents of both classes."""
    train = stage(spark, sample(docs, labels, "toxic", PER_CLASS), "toxic-sample")
    fit = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(CALIBRATE)) == 0
    pairs = class_counts(train.where(~fit)).toArrow()
    held = train.where(fit).select("text", "y").toArrow()
    y = held.column("y").to_numpy()
    if not len(pairs) or len(set(y.tolist())) < 2:
        return None
    before, word = (pairs.column(c).to_numpy().view(np.uint64) for c in ("before", "word"))
    counts = Counts(before, word, [pairs.column(f"n{c}").to_numpy() for c in (0, 1)])
    corpus = stage(spark, corpus_counts(docs), "word-counts")
    total, kinds = corpus.agg(F.sum("n"), F.count("*")).first()
    of_pairs = spark.createDataFrame(pa.table({"_word": counts.words.view(np.int64)}))
    known = corpus.join(F.broadcast(of_pairs), F.col("word") == F.col("_word")).select("word", "n").toArrow()
    n = np.zeros(len(counts.words))
    n[find(counts.words, known.column("word").to_numpy().view(np.uint64))] = known.column("n").to_numpy()
    shared = (n + 1) / (total + kinds + 1)
    best = None
    for word_weight in WORD_WEIGHTS:
        for pair_weight in PAIR_WEIGHTS:
            model = counts.ratios(shared, word_weight, pair_weight)
            x = model.evidence(held.column("text"))
            if best is None or in_order(x, y) > best[0]:
                best = in_order(x, y), model, x
    return (best[1], *logistic(best[2], y))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence per word of every row."""
    shared = spark.sparkContext.broadcast(learn(spark, docs, labels))

    def run(batches):
        for batch in batches:
            if shared.value is None:
                evidence, p = np.zeros(len(batch)), np.zeros(len(batch))
            else:
                model, a, b = shared.value
                evidence = model.evidence(batch.column(1))
                p = 1 / (1 + np.exp(-np.clip(a * evidence + b, -500, 500)))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(evidence)],
                                  names=["doc_id", "score", "predicted", "evidence"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, evidence double")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
