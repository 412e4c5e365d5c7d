"""Operator 10: benchmark passages in training documents, by n-gram seeds and Smith-Waterman alignment.

1. The words of every item at the offsets of each of SHAPES are its seeds.  A
   text's words at any of these offsets are looked up among them, so a seed is
   hit by three words in a row, and across one word that was replaced, put in
   or left out.
2. Each diagonal that seeds hit opens a window that holds every alignment good
   enough to count.  Windows with too few of the item's words to reach
   LEAST_SCORE are left out (an upper bound, so no result is lost); the words
   of the others are aligned with the item's (Smith-Waterman, linear gaps).  A
   pair is contaminated when the best local score is at least LEAST_SCORE of
   the item's score with itself.

All seeds are used, whatever their frequency.  An alignment of m item words
without any seed has no three words in a row, and single edits only between
single words, so each word gains at most 1 net of the edits beside it, and the
two ends 1 more: its score is at most m + 2 of 2 * m.  A copy of a share over
0.5 + 1 / m is therefore always aligned; one between that and LEAST_SCORE is
missed only if its words stand alone or in twos between words put in.

Benchmarks are handled in chunks of items of at most CHUNK_WORDS words; only a
chunk is broadcast, and each chunk takes a pass, so a benchmark of any size
is compared whole.  No document text is shuffled.

Defined cases: null or blank texts and items match nothing; an item of fewer
than SEED words has no seed and matches nothing; items with equal texts all
match; repeated rows give repeated results; empty tables give an empty result;
further columns are ignored, clashing names included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm.base import NOT_ALNUM, counts_per, mix, slices, stream, table, text_bytes, word_hashes

#: Words of an n-gram, and their offsets from its first one.
SEED, SHAPES = 3, ((0, 1, 2), (0, 1, 3), (0, 2, 3))
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: Words of benchmark items that are broadcast at once (8 bytes each, and three n-grams of 16).
CHUNK_WORDS = 1_000_000
#: Cells of the alignment matrices' rows that are held at once.
BATCH_CELLS = 1 << 19
_KEYS = stream(101, SEED)


def ngrams(words: np.ndarray, shape: tuple[int, ...] = SHAPES[0]) -> np.ndarray:
    """Hashes of the words at ``shape`` from each word on that has them all."""
    n = len(words) - shape[-1]
    if n <= 0:
        return words[:0]
    first, second, third = (words[s:s + n] * k for s, k in zip(shape, _KEYS, strict=True))
    first += second
    first += third
    return mix(first)


def tokens(texts: pa.Array):
    """(first row, word hashes, bounds, n-gram hashes, their documents and word positions, the words' first and end code points), slice by slice."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    for lo, hi in slices(offsets):
        doc, words, starts, ends = word_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], NOT_ALNUM)
        bounds = counts_per(doc, hi - lo)
        grams, at = [], []
        for shape in SHAPES:
            g = ngrams(words, shape)
            at.append(np.flatnonzero(doc[:len(g)] == doc[shape[-1]:]) if len(g) else np.zeros(0, np.int64))  # n-grams don't cross documents
            grams.append(g[at[-1]])
        grams, at = np.concatenate(grams), np.concatenate(at)
        # code points before each byte; lower-casing keeps their number
        points = np.concatenate(([0], np.cumsum((data[offsets[lo]:offsets[hi]] & 0xC0) != 0x80)))
        zero = points[(offsets[lo:hi] - offsets[lo])[doc]]
        yield lo, words, bounds, grams, doc[at], at, points[starts] - zero, points[ends] - zero


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in ``sorted_keys``, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def chunks(benchmark: DataFrame):
    """Lists of (item_id, words) with at most CHUNK_WORDS words (an item longer than that comes alone)."""
    held, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").toLocalIterator():
        for _, w, *_ in tokens(pa.array([row[1]])):
            if len(w) >= SEED:
                if held and words + len(w) > CHUNK_WORDS:
                    yield held
                    held, words = [], 0
                held.append((row[0], w))
                words += len(w)
    if held:
        yield held


def sieve(keys: np.ndarray) -> np.ndarray:
    """A table by the lowest bits of a hash: false where no key has them."""
    out = np.zeros(1 << max(16, (16 * len(keys)).bit_length()), bool)
    out[keys & np.uint64(len(out) - 1)] = True
    return out


def seeds(items: list[tuple[int, np.ndarray]]):
    """Sorted seed hashes, and for each the items and word positions where it stands."""
    hashes, places = [], []
    for i, (_, w) in enumerate(items):
        for shape in SHAPES:
            g = ngrams(w, shape)
            hashes.append(g)
            places.append(np.stack([np.full(len(g), i, np.int32), np.arange(len(g), dtype=np.int32)], axis=1))
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], places[order]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Best local alignment of each item with its window: (score, first, end) in words of the window."""
    b, m, n = len(items), max(map(len, items)), max(map(len, windows))
    item, text = np.zeros((b, m), np.uint64), np.ones((b, n), np.uint64)  # the paddings never match
    for k in range(b):
        item[k, :len(items[k])], text[k, :len(windows[k])] = items[k], windows[k]
    one = np.int64(1 << 32)  # scores stand in the upper half, where an alignment began in the lower one
    ramp = np.arange(n + 1, dtype=np.int64) * (-GAP * one)
    fresh = np.arange(n, dtype=np.int64)
    above = np.zeros((b, n + 1), np.int64)
    best, best_end = np.zeros(b, np.int64), np.zeros(b, np.int64)
    for row in range(m):
        hit = text == item[:, row:row + 1]
        diagonal = np.where(above[:, :-1] >= one, above[:, :-1], fresh) + np.where(hit, MATCH, MISMATCH) * one
        here = np.zeros((b, n + 1), np.int64)
        np.maximum(diagonal, above[:, 1:] + GAP * one, out=here[:, 1:])
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp
        here[here < one] = 0
        col = here.argmax(axis=1)
        top = here[np.arange(b), col]
        better = (top >> 32) > (best >> 32)
        best[better], best_end[better] = top[better], col[better]
        above = here
    return [(int(x >> 32), int(x & 0xFFFFFFFF), int(e)) for x, e in zip(best, best_end, strict=True)]


def candidates(doc, at, bounds, item, place, lengths):
    """Windows (document, item, first word, end) around the diagonals that seeds hit; near diagonals share one."""
    start = at - place
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    slack = lengths[item]  # an alignment that counts has no more edits than the item has words
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(doc)) - 1
    d, i = doc[firsts], item[firsts]
    lo = np.maximum(bounds[d], start[firsts] - slack[firsts])
    hi = np.minimum(bounds[d + 1], start[lasts] + lengths[i] + slack[firsts])
    return d, i, lo, hi


def enough(words, lo, hi, item, lengths, own, times) -> np.ndarray:
    """Which windows hold so many of their item's words that LEAST_SCORE can be reached at all; ``own``: sorted keys of the items' words, ``times``: how often each stands in its item."""
    out = np.zeros(len(lo), bool)
    for k, sizes in slices_of(hi - lo):
        at = np.repeat(lo[k] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        of = np.repeat(np.arange(len(k)), sizes)
        found = lookup(own, word_keys(words[at], item[k][of]))
        pairs, n = np.unique((of * len(own) + found)[found >= 0], return_counts=True)
        shared = np.bincount(pairs // len(own), np.minimum(n, times[pairs % len(own)]), len(k))
        out[k] = MATCH * shared >= LEAST_SCORE * MATCH * lengths[item[k]]
    return out


def word_keys(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix(words + mix(item.astype(np.uint64) + np.uint64(1)))


def slices_of(sizes: np.ndarray):
    """(indices, their sizes) of neighbours of at most BATCH_CELLS together; a larger one comes alone."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for a, b in slices(ends, BATCH_CELLS):
        yield np.arange(a, b), sizes[a:b]


FOUND = "doc_id long, item_id long, score double, first_char long, end_char long"


def aligned(texts: pa.Array, model) -> list[tuple[int, int, float, int, int]]:
    """(row, item index, share of the item's own score, first and end code point) of each item in each text, at its best copy."""
    keys, places, _, items = model
    distinct, first = np.unique(keys, return_index=True)
    sift = sieve(distinct)
    each = np.diff(np.append(first, len(keys)))
    lengths = np.array([len(w) for w in items])
    own, times_own = np.unique(word_keys(np.concatenate(items), np.repeat(np.arange(len(items)), lengths)), return_counts=True)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for lo, words, bounds, grams, doc, at, begins, ends in tokens(texts):
        hit = np.flatnonzero(sift[grams & np.uint64(len(sift) - 1)])
        k = lookup(distinct, grams[hit])
        hit, k = hit[k >= 0], k[k >= 0]
        if not len(hit):
            continue
        times = each[k]
        which = np.repeat(first[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        hit = np.repeat(hit, times)
        d, i, a, b = candidates(doc[hit], at[hit], bounds, places[which, 0], places[which, 1], lengths)
        fit = enough(words, a, b, i, lengths, own, times_own)
        d, i, a, b = d[fit], i[fit], a[fit], b[fit]
        order = np.argsort(b - a, kind="stable")
        while len(order):
            take = 1
            while take < len(order) and (take + 1) * (b - a)[order[take]] <= BATCH_CELLS:
                take += 1
            now, order = order[:take], order[take:]
            for c, (score, s, e) in zip(now, align([items[x] for x in i[now]], [words[a[x]:b[x]] for x in now]), strict=True):
                share, pair = score / (MATCH * lengths[i[c]]), (lo + int(d[c]), int(i[c]))
                if share >= LEAST_SCORE and share > best.get(pair, (0.0,))[0]:
                    best[pair] = (share, int(begins[a[c] + s]), int(ends[a[c] + e - 1]))
    return [(*pair, *x) for pair, x in best.items()]


def models(spark: SparkSession, benchmark: DataFrame):
    """A broadcast (seeds, their places, item ids, item words) for each chunk of the benchmark."""
    for items in chunks(benchmark):
        yield spark.sparkContext.broadcast((*seeds(items), [i for i, _ in items], [w for _, w in items]))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that align: doc_id, item_id, score (share of the item's own), and the best copy's code points."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    found = spark.createDataFrame([], FOUND)
    for model in models(spark, benchmark):

        def search(batches, model=model):
            for batch in batches:
                rows = aligned(batch.column(0), model.value)
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch([
                    batch.column(1).take(pa.array(cols[0], pa.int64())), pa.array([model.value[2][i] for i in cols[1]], pa.int64()),
                    pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    names=["doc_id", "item_id", "score", "first_char", "end_char"])

        found = found.union(docs.mapInArrow(search, FOUND))
    return found


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; columns stay as they are."""
    at, kept = docs.columns.index("text"), docs
    for model in models(spark, benchmark):

        def clean(batches, model=model):
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[np.array([row for row, *_ in aligned(batch.column(at), model.value)], np.int64)] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
