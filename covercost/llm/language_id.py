"""Operator 8: language by interpolated Kneser-Ney character models.

Every document with a language outside the held-out bucket is counted: per
language, its code point 4-grams (lower-cased).  Kneser-Ney continuation counts
of the shorter n-grams follow from the 4-gram table.  The models are sorted
hash arrays: for each n-gram that any language has seen, its interpolated
log-probability in every language, and for each context its backoff weight.  A
text is given the language of the lowest cross-entropy per character; the
score is that language's probability on a scale fitted to all training documents,
and ``rejected`` tells that the cross-entropy is higher than nearly all
training texts of the language have.

All n-grams are kept.  A model of more than MODEL_CELLS n-gram and language
pairs is cut into shards by the two middle units of the 4-gram, which its
context, its 3-gram and that one's context share, so a shard has all that its
4-grams back off to.  The documents are read once for each shard and a text's
log-likelihoods in the shards are added up; only one shard is held at a time.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any language to learn from every text is ``und``; texts are read whole;
repeated rows give repeated results; an empty table gives an empty result;
source and further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm.base import bucket_of, mix, slices, stage, table, text_bytes
from covercost.llm.byte_bpe import LETTER, code_point_classes
from covercost.llm.labelled import held_out, order_statistics

BUCKETS, HELD_OUT = 4, 2
ORDER, DISCOUNT = 4, 0.75
#: N-gram and language pairs of a shard (more, if the 4-grams of one pair of middle units have more).
MODEL_CELLS = 4_000_000
#: Scales of the score to choose from, by the mean loss over all training documents.
SCALES = [2.0**k for k in range(-2, 8)]
REJECTED_SHARE = 0.001


def code_units(texts: pa.Array):
    """(first row, end row, code points folded to 16 bits with ORDER - 1 zeros before each text, text bounds, has a letter)."""
    lower = pc.utf8_lower(texts)
    data, offsets = text_bytes(lower)
    for lo, hi in slices(offsets):
        own = offsets[lo:hi + 1] - offsets[lo]
        raw = data[offsets[lo]:offsets[hi]]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), own)
        letters = np.concatenate(([0], np.cumsum(code_point_classes()[points] == LETTER)))
        pad = ORDER - 1
        units = np.zeros(len(points) + pad * (hi - lo), np.uint64)
        place = np.arange(len(points)) + pad * (np.repeat(np.arange(hi - lo), np.diff(bounds)) + 1)
        units[place] = (points ^ (points >> 16)) & 0xFFFF
        yield lo, hi, units, place, bounds, letters[bounds[1:]] > letters[bounds[:-1]]


def grams(units: np.ndarray, place: np.ndarray, n: int = ORDER) -> np.ndarray:
    """The n code units that end at each place, the last one lowest, in one number."""
    key = units[place].copy()
    for k in range(1, n):
        key |= units[place - k] << np.uint64(16 * k)
    return key


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram) -> count over all of ``docs`` (lang, text)."""

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            found: dict[str, list] = {x: [] for x in names}
            for lo, hi, units, place, bounds, _ in code_units(batch.column(1)):
                key = grams(units, place)
                of = np.repeat(code[lo:hi], np.diff(bounds))
                for k in np.unique(of):
                    found[names[k]].append(np.unique(key[of == k], return_counts=True))
            for name, parts in found.items():
                if parts:
                    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                    yield pa.record_batch([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return docs.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def find(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, at, -1)


class Models:
    """All languages' models of the 4-grams whose middle units are in [first, end); ``tables[n]`` has (hashes, log-probabilities) of n-grams, ``backs[n]`` of n-unit contexts."""

    def __init__(self, langs: list[str], seen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: int = 0, end: int = 1 << 32):
        """``seen``: for each order, language, n-gram and count (of distinct left neighbours below ORDER)."""
        self.langs, self.first, self.end = langs, first, end
        of, grams_n, counts_n = ({m: x[k] for m, x in seen.items()} for k in range(3))
        size = len(langs)
        self.tables, self.backs = {}, {}
        below = None
        for m in range(1, ORDER + 1):
            keys, k_at = np.unique(grams_n[m], return_inverse=True)
            contexts, c_at = np.unique(grams_n[m] >> np.uint64(16), return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, (c_at, of[m]), counts_n[m])
            np.add.at(kinds, (c_at, of[m]), 1)
            back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            direct = np.zeros((len(keys), size))
            direct[k_at, of[m]] = (counts_n[m] - DISCOUNT) / total[c_at, of[m]]
            if below is None:
                lower = np.full((len(keys), size), 1 / 65536)
            else:
                lower = below[1][np.searchsorted(below[0], keys & np.uint64((1 << (16 * (m - 1))) - 1))]
            own = np.searchsorted(contexts, keys >> np.uint64(16))
            p = direct + back[own] * lower
            below = (keys, p)
            for store, name, values in ((self.tables, keys, p), (self.backs, contexts, back)):
                hashed = mix(name + np.uint64(m))
                order = np.argsort(hashed)
                store[m] = (hashed[order], np.log(values[order]).astype(np.float32))
        self.unseen = np.float32(np.log(1 / 65536))

    def each(self, keys: np.ndarray, m: int = ORDER) -> np.ndarray:
        """Log-probability of every n-gram (rows) in every language (columns), backing off where no language has it."""
        hashed, values = self.tables[m]
        at = find(hashed, mix(keys + np.uint64(m)))
        out = values[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            low = keys[miss]
            context, back = self.backs[m]
            c = find(context, mix((low >> np.uint64(16)) + np.uint64(m)))
            weight = np.where((c >= 0)[:, None], back[c], np.float32(0))
            rest = self.each(low & np.uint64((1 << (16 * (m - 1))) - 1), m - 1) if m > 1 else self.unseen
            out[miss] = weight + rest
        return out

    def log_likelihoods(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of this shard's part of each text in every language; the code points of the text, and whether it has a letter."""
        out, size, letter = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for lo, hi, units, place, bounds, has in code_units(texts):
            key, doc = grams(units, place), np.repeat(np.arange(hi - lo), np.diff(bounds))
            if self.first > 0 or self.end < 1 << 32:
                middle = middles(key)
                own = (middle >= np.uint64(self.first)) & (middle < np.uint64(self.end))
                key, doc = key[own], doc[own]
            keys, at = np.unique(key, return_inverse=True)
            if len(keys):
                logs = self.each(keys)
                for k in range(len(self.langs)):
                    out[lo:hi, k] = np.bincount(doc, logs[at, k], hi - lo)
            size[lo:hi], letter[lo:hi] = np.diff(bounds), has
        return out, size, letter


def middles(gram: np.ndarray) -> np.ndarray:
    """The 4-gram's third unit, and below it the second one."""
    return (gram >> np.uint64(16) & np.uint64(0xFFFF)) << np.uint64(16) | gram >> np.uint64(32) & np.uint64(0xFFFF)


class Curve:
    """The scale that makes the languages' probabilities likeliest, and each language's rejection limit (see ``fitted``)."""

    def __init__(self, langs: list[str], scale: float = 1.0, limits: np.ndarray | None = None):
        self.langs, self.scale, self.limits = langs, scale, np.full(len(langs), np.inf) if limits is None else limits

    def results(self, logs: np.ndarray, size: np.ndarray, letter: np.ndarray) -> list[pa.Array]:
        """lang_pred, score, cross_entropy and rejected of texts."""
        h = -logs / np.maximum(1, size)[:, None]
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        p = 1 / np.exp(-self.scale * (h - low[:, None])).sum(axis=1)
        names = [self.langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(letter, p, 0.0)), pa.array(np.where(letter, low, np.nan), from_pandas=True), pa.array(letter & (low > self.limits[best]))]


def shards(found: DataFrame, langs: list[str]) -> Iterator[Models]:
    """The models, shard by shard, of the counted 4-grams ``found``."""
    spark = found.sparkSession
    mask = lambda m: F.col("gram").bitwiseAND(F.lit((1 << (16 * m)) - 1)).alias("gram")
    fewer = {ORDER: found}
    for m in range(ORDER - 1, 0, -1):  # distinct left neighbours of each shorter n-gram, over the whole table
        fewer[m] = fewer[m + 1].groupBy("lang", mask(m)).agg(F.count("*").alias("n"))
    third, second = (F.shiftrightunsigned("gram", k).bitwiseAND(F.lit(0xFFFF)) for k in (16, 32))
    middle = F.shiftleft(third, 16).bitwiseOR(second)
    most, starts, rows = max(1, MODEL_CELLS // len(langs)), [0], 0
    for r in found.groupBy(middle.alias("middle")).agg(F.count("*").alias("rows")).orderBy("middle").toLocalIterator():
        if rows and rows + r.rows > most:
            starts.append(r.middle)
            rows = 0
        rows += r.rows
    pairs = stage(spark, fewer[2], "char-pairs") if len(starts) > 1 else fewer[2]

    def fetched(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = df.select("lang", "gram", "n").toArrow()
        return np.searchsorted(np.array(langs), np.array(t.column("lang").to_pylist())), t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy().astype(float)

    one = fetched(fewer[1])
    for first, end in zip(starts, [*starts[1:], 1 << 32], strict=True):
        lang, gram, n = fetched(found.where((middle >= first) & (middle < end)))
        own = np.unique(np.stack([lang.astype(np.uint64), gram & np.uint64((1 << 48) - 1)], axis=1), axis=0, return_counts=True)
        three = own[0][:, 0].astype(np.int64), own[0][:, 1], own[1].astype(float)  # the shard has every left neighbour of its 3-grams
        two = fetched(pairs.where((third >= first >> 16) & (third <= end - 1 >> 16)))
        yield Models(langs, {4: (lang, gram, n), 3: three, 2: two, 1: one}, first, end)


def learn(spark: SparkSession, docs: DataFrame) -> tuple[list[str], list] | None:
    """The languages and the broadcast shards of their models; None without any language."""
    train = docs.where("lang is not null and text is not null").where(bucket_of("doc_id", BUCKETS) != HELD_OUT)
    train = train.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    found = stage(spark, counts(train.select("lang", "text")), "char-grams")
    langs = [r.lang for r in found.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    return langs, [spark.sparkContext.broadcast(models) for models in shards(found, langs)]


def fitted(scored: DataFrame, langs: list[str]) -> Curve:
    """The curve of all training documents of ``scored`` (written rows with ``lang``, null for others, and log-likelihoods)."""
    own = scored.where("lang is not null and letter")

    def losses(batches):
        for batch in batches:
            if not len(batch):
                continue
            h = -likelihoods(batch, langs) / np.maximum(1, batch.column("size").to_numpy())[:, None]
            lang = np.searchsorted(np.array(langs), np.array(batch.column("lang").to_pylist()))
            own = np.arange(len(h)), lang
            low = h.min(axis=1, keepdims=True)
            each = [np.log(np.exp(-s * (h - low)).sum(axis=1)) + s * (h - low)[own] for s in SCALES]
            yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(h[own]), *(pa.array(x) for x in each)], names=["g", "v", *names])

    names = [f"s{k}" for k in range(len(SCALES))]
    h = stage(scored.sparkSession, own.mapInArrow(losses, "g int, v double, " + ", ".join(f"{x} double" for x in names)), "language-fit")
    sums = h.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in names)).collect()
    if not sums:
        return Curve(langs)
    # the last digits of a sum depend on the order of its rows
    scale = SCALES[int(np.argmin([round(sum(r[x] for r in sums) / sum(r.n for r in sums), 9) for x in names]))]
    wanted = {r.g: (1 - REJECTED_SHARE) * (r.n - 1) for r in sums}
    at = [(g, k) for g, x in wanted.items() for k in (int(x), min(int(x) + 1, int(np.ceil(x))))]
    value = dict(zip(at, order_statistics(h.select("g", "v"), at), strict=True))
    limits = np.full(len(langs), np.inf)
    for g, x in wanted.items():
        low, high = value[g, int(x)], value[g, min(int(x) + 1, int(np.ceil(x)))]
        limits[g] = (low + (high - low) * (x - int(x))) * 1.1
    return Curve(langs, scale, limits)


def likelihoods(batch: pa.RecordBatch, langs: list[str]) -> np.ndarray:
    return np.stack([batch.column(f"l{k}").to_numpy() for k in range(len(langs))], axis=1)


RESULT = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def finished(ids: pa.Array, results: list[pa.Array]) -> pa.RecordBatch:
    return pa.record_batch([ids.cast(pa.int64()), *results], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])


def scored_rows(spark: SparkSession, docs: DataFrame, langs: list[str], shared: list) -> DataFrame:
    """doc_id, lang (of training documents, else null), size, letter and log-likelihoods l0.. of every row, written."""
    names = ["row", "doc_id", "lang", "size", "letter", *(f"l{k}" for k in range(len(langs)))]
    if len(shared) > 1:
        docs = stage(spark, docs, "language-texts")  # read once for each shard, with the same row numbers
    every = None
    for model in shared:

        def part(batches, model=model):
            for batch in batches:
                logs, size, letter = model.value.log_likelihoods(batch.column("text"))
                columns = [pa.array(logs[:, k]) for k in range(logs.shape[1])]
                yield pa.record_batch([batch.column("row"), batch.column("doc_id"), batch.column("lang"), pa.array(size), pa.array(letter), *columns], names=names)

        own = docs.mapInArrow(part, f"row long, doc_id long, lang string, size long, letter boolean, {', '.join(f'{x} double' for x in names[5:])}")
        every = own if every is None else every.union(own)
    if len(shared) > 1:
        every = every.groupBy(*names[:5]).agg(*(F.sum(x).alias(x) for x in names[5:]))
    return stage(spark, every, "language-scores")


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of every row."""
    learned = learn(spark, docs)
    if learned is None:
        out = docs.selectExpr("cast(doc_id as long) doc_id", "'und' lang_pred", "0D score", "cast(null as double) cross_entropy", "false rejected")
    else:
        langs = learned[0]
        lang = F.when(F.col("text").isNotNull() & (bucket_of("doc_id", BUCKETS) != HELD_OUT), F.col("lang").cast("string"))
        texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
        scored = scored_rows(spark, texts, *learned)
        curve = fitted(scored, langs)

        def finish(batches):
            for batch in batches:
                yield finished(batch.column("doc_id"), curve.results(likelihoods(batch, langs), batch.column("size").to_numpy(), batch.column("letter").to_numpy(zero_copy_only=False)))

        out = scored.mapInArrow(finish, RESULT)
    return out.select("doc_id", held_out(n=BUCKETS, bucket=HELD_OUT).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"))
