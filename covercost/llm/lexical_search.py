"""Operator 13: ranked lexical search the other way round: documents stream through an index of the items' terms.

The items (few, short) are indexed: each of their terms has a list of the items
that hold it.  The index is broadcast in chunks of a counted number of postings.
Each document's counts of the chunk's terms are written once; document
frequencies come from them, and then they stream through the index, whose
weights are now known.  A task keeps the TOP best documents of each item; the
tasks' lists are merged by a window.  No document text is shuffled, and no score
of a document that isn't among a task's best leaves the task.

Terms are found by hash and compared byte by byte.

Defined cases: null or blank texts have no terms (a document without terms
doesn't count and is never found, an item without any has no rows); rows of one
item_id, null included, are one item with the terms of all of them; repeated
documents are ranked one by one, null ids after others of the same score; long
texts count whole; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covercost.llm.base import LOWER, NOT_ALNUM, counts_per, prefix_hashes, slices, span_hashes, stage, table, text_bytes, word_spans

TOP = 10
#: Postings (item and term) of an index that is broadcast; an item with more comes alone.
CHUNK_POSTINGS = 1_000_000
#: Cells (documents by items) and postings that are scored at once.
CELLS = 1 << 21
COUNTED = "doc_id long, n long, terms array<int>, tf array<long>"
FOUND = "item int, doc_id long, score long"


def terms_of(texts: pa.Array):
    """Slice by slice: first and last row, lower-cased bytes, and document, hash, start and end of each term."""
    data, offsets = text_bytes(texts)
    for lo, hi in slices(offsets):
        part = LOWER[data[offsets[lo]:offsets[hi]]]
        doc, starts, ends = word_spans(part, offsets[lo:hi + 1] - offsets[lo], NOT_ALNUM)
        yield lo, hi, part, doc, span_hashes(prefix_hashes(part), starts, ends), starts, ends


def postings(benchmark: DataFrame) -> DataFrame:
    """(item_id, term), each once."""

    def split(batches):
        for batch in batches:
            for lo, _, part, doc, _, starts, ends in terms_of(batch.column(0)):
                raw = part.tobytes()
                terms = [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)]
                yield pa.record_batch([batch.column(1).take(pa.array(lo + doc)), pa.array(terms, pa.string())], names=["item_id", "term"])

    texts = benchmark.select(F.col("text").cast("string").alias("text"), F.col("item_id").cast("long").alias("item_id"))
    return texts.mapInArrow(split, "item_id long, term string").distinct()


def chunks(posted: DataFrame):
    """Arrow tables (item_id, term) of at most CHUNK_POSTINGS rows, or of a single item."""
    n = -(-posted.count() // CHUNK_POSTINGS)
    while n:
        chunk = F.pmod(F.xxhash64("item_id"), F.lit(n))
        sizes = posted.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), (F.min("item_id").eqNullSafe(F.max("item_id"))).alias("alone"))
        if sizes.where(F.col("n") > CHUNK_POSTINGS).where("not alone").isEmpty():
            break
        n *= 2
    for k in range(n):
        yield posted.where(chunk == k).toArrow()


class Index:
    """Items by term: sorted term hashes, the terms' bytes, and their items' numbers."""

    def __init__(self, posted: pa.Table):
        ids = posted.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        terms = posted.column("term").combine_chunks().dictionary_encode()
        self.items, self.terms = ids.dictionary, terms.dictionary
        self.raw, self.at = text_bytes(self.terms)
        hashes = span_hashes(prefix_hashes(self.raw), self.at[:-1], self.at[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        term, item = terms.indices.to_numpy(), ids.indices.to_numpy()
        by = np.lexsort((item, term))
        self.first, self.item_of = np.searchsorted(term[by], np.arange(len(self.terms) + 1)), item[by]
        self.sift = np.zeros(1 << max(12, (16 * len(hashes)).bit_length()), bool)
        self.sift[hashes & np.uint64(len(self.sift) - 1)] = True

    def find(self, part, hashes, starts, ends):
        """Positions of the words that are index terms, and the terms."""
        hit = np.flatnonzero(self.sift[hashes & np.uint64(len(self.sift) - 1)])
        left, right = (np.searchsorted(self.hashes, hashes[hit], side=s) for s in ("left", "right"))
        at, terms = [], []
        for k in range(int((right - left).max(initial=0))):  # terms of equal hashes: one, as a rule
            some = np.flatnonzero(left + k < right)
            term = self.order[left[some] + k]
            same = self.same(part, starts[hit[some]], ends[hit[some]], term)
            at.append(hit[some][same])
            terms.append(term[same])
        return np.concatenate(at or [hit[:0]]), np.concatenate(terms or [hit[:0]])

    def same(self, part, starts, ends, term) -> np.ndarray:
        """Whether the words' bytes are the terms'."""
        size = ends - starts
        out = size == self.at[term + 1] - self.at[term]
        rest = np.flatnonzero(out)
        for j in range(int(size[rest].max(initial=0))):
            rest = rest[size[rest] > j]
            wrong = part[starts[rest] + j] != self.raw[self.at[term[rest]] + j]
            out[rest[wrong]] = False
            rest = rest[~wrong]
        return out


def term_counts(docs: DataFrame, index) -> DataFrame:
    """Each document's number of terms n, and the numbers and counts of the index terms in it."""

    def count(batches):
        for batch in batches:
            for lo, hi, part, doc, hashes, starts, ends in terms_of(batch.column(0)):
                at, term = index.value.find(part, hashes, starts, ends)
                size = len(index.value.terms)
                key, tf = np.unique(doc[at] * size + term, return_counts=True)
                bounds = pa.array(counts_per(key // size, hi - lo), pa.int32())
                yield pa.record_batch([
                    batch.column(1).slice(lo, hi - lo), pa.array(np.bincount(doc, minlength=hi - lo), pa.int64()),
                    pa.ListArray.from_arrays(bounds, pa.array(key % size, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(tf, pa.int64()))],
                    names=["doc_id", "n", "terms", "tf"])

    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return texts.mapInArrow(count, COUNTED)


class Best:
    """The TOP best documents of each item so far, as parallel arrays ordered by item and rank."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.item, self.score, self.none, self.doc = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.ones(items, np.int64)  # a lower score can't enter

    def add(self, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """``scores``: documents by items; ``none``: 1 where the document has no id."""
        if len(scores) > self.top:
            least = np.maximum(self.least, np.partition(scores, len(scores) - self.top, axis=0)[-self.top])
        else:
            least = self.least
        row, item = np.nonzero(scores >= least)
        if not len(row):
            return
        item, score, none, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, scores[row, item]), (self.none, none[row]), (self.doc, doc[row])))
        order = np.lexsort((doc, none, -score, item))
        begins = np.searchsorted(item[order], np.arange(self.items))
        rank = np.arange(len(order)) - begins[item[order]]
        order = order[rank < self.top]
        self.item, self.score, self.none, self.doc = item[order], score[order], none[order], doc[order]
        full, at = np.unique(self.item, return_index=True)
        ends = np.append(at[1:], len(self.item)) - 1
        done = ends - at + 1 == self.top
        self.least[full[done]] = self.score[ends[done]]


def best_documents(counted: DataFrame, index, weights, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item number, doc_id, score) of the best documents that each task saw."""

    def score(batches):
        x, w = index.value, weights.value
        best = Best(len(x.items), top)
        each = np.diff(x.first)
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy()
            none, doc = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            bounds = batch.column(2).offsets.to_numpy().astype(np.int64)
            term = batch.column(2).values.to_numpy()
            tf = batch.column(3).values.to_numpy()
            m = 100 - 90 + 90 * n * n_docs // max(1, n_terms)
            of = np.repeat(np.arange(len(batch)), np.diff(bounds))
            term, tf = term[bounds[0]:bounds[-1]], tf[bounds[0]:bounds[-1]]
            bounds = bounds - bounds[0]
            part = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of]))
            work = np.concatenate(([0], np.cumsum(each[term])))[bounds] + np.arange(len(batch) + 1) * len(x.items)
            for lo, hi in slices(work, CELLS):
                a, b = bounds[lo], bounds[hi]
                times = each[term[a:b]]
                at = np.repeat(x.first[term[a:b]] - np.cumsum(times) + times, times) + np.arange(times.sum())
                cell = np.repeat((of[a:b] - lo) * len(x.items), times) + x.item_of[at]
                value = np.repeat(part[a:b], times)
                # sums of doubles are exact for halves of this size
                sums = [np.bincount(cell, half, (hi - lo) * len(x.items)).astype(np.int64) for half in (value >> 20, value & 0xFFFFF)]
                best.add(((sums[0] << 20) + sums[1]).reshape(hi - lo, len(x.items)), doc[lo:hi], none[lo:hi])
        yield pa.record_batch([pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.none == 1), pa.array(best.score, pa.int64())], names=["item", "doc_id", "score"])

    return counted.mapInArrow(score, FOUND)


def search(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank, doc_id, score."""
    posted = stage(spark, postings(benchmark), "search-postings")
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for chunk in chunks(posted):
        if not len(chunk):
            continue
        own = Index(chunk)
        index = spark.sparkContext.broadcast(own)
        counted = stage(spark, term_counts(docs, index), "search-counts")
        n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(own.terms), np.int64)
        for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of one chunk
            df[term] = n
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        best = best_documents(counted, index, spark.sparkContext.broadcast(weights), n_docs, n_terms, top)
        names = spark.createDataFrame(pa.table([pa.array(range(len(own.items)), pa.int32()), own.items], names=["item", "item_id"]))
        found = found.unionByName(best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle(top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term"
    return rf"""
    with d as (select row_number() over () rid, doc_id, text from documents),
    t as (select rid, doc_id, {terms} from d),
    i as (select distinct item_id, term from (select item_id, {terms} from benchmark)),
    size as (select rid, any_value(doc_id) doc_id, count(*) n from t group by rid),
    total as (select count(*) nd, sum(n)::bigint nl from size),
    tf as (select rid, term, count(*) tf from t where term in (select term from i) group by rid, term),
    w as (select term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::bigint w from tf, total group by term),
    m as (select rid, doc_id, 100 - 90 + (90 * n * nd) // nl m from size, total),
    s as (select item_id, m.rid, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
          from tf join w using (term) join m using (rid) join i using (term) group by item_id, m.rid, m.doc_id)
    select item_id, rank::int rank, doc_id, score
    from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last, rid) rank from s where score > 0) where rank <= {top}"""
