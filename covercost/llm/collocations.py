"""Operator 12: frequent phrases of two to four words, from a weighted de Bruijn graph of their words.

1. A table of hash slots counts every word, every neighbouring pair and triple (in
   each task, then added up slot by slot).  One whose slot stays under LEAST is
   certainly rarer than LEAST, and no phrase that
   holds it can be a candidate.  Only one bit a slot is broadcast; shared slots
   let rare ones through and never stop a frequent one.
2. Each word opens its longest gram: up to four words, ended by the piece or by
   a rare pair or triple.  Grams of four words are the edges of the graph, from the node
   of their first three words to that of their last three; shorter grams are
   the corrections of flow that ends in a node.
3. A node's count is the flow out of it plus the flow that ends there; counts of
   two words and of one follow from those of three and of two in the same way.
4. Unary paths (edges whose shared node has no other edge, beginning or end, so
   that all have the same count) are compacted into one path by pointer
   doubling.  A path's count stands for all nodes along it, and what longer
   candidates cover is looked up from paths and nodes instead of single edges.

The counts are exact: grams are grouped by language and their words' text, and
scores are computed in decimals.

Defined cases: null text has no words; null lang is ``und``, together with the
value ``und``; repeated rows count as often as they stand; long texts count
whole; equal scores and counts are ranked by the phrase's UTF-8 bytes; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covercost.llm.base import LOWER, mix, prefix_hashes, slices, span_hashes, stage, stream, table, text_bytes, word_spans

#: Words of the longest phrase, least count of a candidate, phrases returned for a language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: Parts of a language's phrases that are ranked by tasks of their own.
PARTS = 64
#: A candidate is dropped when a longer one that holds it has this share of its count, in percent.
COVERED = 80
#: Slots for the counts of words, pairs and triples: one for about BYTES_PER_SLOT bytes of text, within these bounds (a bit of each is broadcast).
LEAST_SLOTS, MOST_SLOTS, BYTES_PER_SLOT = 1 << 16, 1 << 27, 24
#: Slots that are counted and added up together.
BLOCK = 1 << 16
BLANK, CUT = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_FIRST, _SECOND, _LANG, _THIRD = stream(211, 4)


def words_of(texts: pa.Array, langs: pa.Array):
    """Slice by slice: language of each word, the words, their hashes within the language, and whether the next word stands in the same piece."""
    data, offsets = text_bytes(texts)
    langs = langs.fill_null("und").dictionary_encode()
    seeds = np.array([hash_of(x) for x in langs.dictionary.to_pylist()], np.uint64)
    lang_of = langs.indices.to_numpy(zero_copy_only=False)
    for lo, hi in slices(offsets):
        part = LOWER[data[offsets[lo]:offsets[hi]]]
        doc, starts, ends = word_spans(part, offsets[lo:hi + 1] - offsets[lo], BLANK | CUT)
        if not len(doc):
            continue
        lang = lang_of[lo:hi][doc]
        cuts = np.concatenate(([0], np.cumsum(CUT[part])))
        same = np.zeros(len(doc), bool)
        same[:-1] = (doc[1:] == doc[:-1]) & (cuts[starts[1:]] == cuts[ends[:-1]])
        hashes = mix(span_hashes(prefix_hashes(part), starts, ends) + seeds[lang])
        inside = ~(BLANK | CUT)[part]
        ends_at = np.concatenate(([0], np.cumsum(ends - starts)))
        words = pa.LargeStringArray.from_buffers(len(doc), pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(part[inside]))
        yield langs.dictionary.take(pa.array(lang)), words, hashes, same


def hash_of(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int((span_hashes(prefix_hashes(raw), np.array([0]), np.array([len(raw)])) * _LANG)[0])


def later(x: np.ndarray, k: int = 1) -> np.ndarray:
    """At each place what stands ``k`` places on; zero (false) at the end."""
    out = np.zeros_like(x)
    if k < len(x):
        out[:-k] = x[k:]
    return out


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one."""
    return mix(words * _FIRST + later(words) * _SECOND)


def triple_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each word with the next two."""
    return mix(words * _FIRST + later(words) * _SECOND + later(words, 2) * _THIRD)


def frequent(docs: DataFrame, slots: int, least: int = LEAST) -> np.ndarray:
    """One bit a slot: whether its words, pairs and triples together come to ``least`` (or to 255, which is as good a sieve)."""
    mask, most = np.uint64(slots - 1), np.uint8(min(least, 255))

    def count(batches):
        counts = np.zeros(slots, np.uint8)  # counting stops at ``most``
        for batch in batches:
            for _, _, words, same in words_of(batch.column(0), batch.column(1)):
                grams = [words, pair_hashes(words)[same], triple_hashes(words)[same & later(same)]]
                at, n = np.unique(np.concatenate(grams) & mask, return_counts=True)
                counts[at] = np.minimum(counts[at] + n, most)
        for block in range(0, slots, BLOCK):
            at = np.flatnonzero(counts[block:block + BLOCK])
            if len(at):
                packed = at.astype(np.uint16).tobytes() + counts[block + at].tobytes()
                yield pa.record_batch([pa.array([block // BLOCK], pa.int32()), pa.array([packed], pa.binary())], names=["block", "packed"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}  # of the blocks of this partition
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(packed.as_buffer(), np.uint8)
                at, n = raw[:len(raw) // 3 * 2].view(np.uint16), raw[len(raw) // 3 * 2:]
                held = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                held[at] = np.minimum(held[at].astype(np.uint16) + n, most)
        for block, held in sums.items():
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([np.packbits(held >= most).tobytes()], pa.binary())], names=["block", "bits"])

    sums = docs.mapInArrow(count, "block int, packed binary").repartition("block").mapInArrow(add, "block int, bits binary")
    out = np.zeros((max(1, slots // BLOCK), BLOCK // 8), np.uint8)
    for block, bits in sums.collect():  # at most MOST_SLOTS bits
        out[block] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def longest_grams(docs: DataFrame, bits) -> DataFrame:
    """(lang, phrase, n): the longest gram at each frequent word, and a row of the empty phrase with the number of all words."""

    def grams(batches):
        for batch in batches:
            for langs, words, hashes, same in words_of(batch.column(0), batch.column(1)):
                linked = same & has(bits.value, pair_hashes(hashes))
                whole = linked & later(linked) & has(bits.value, triple_hashes(hashes))
                triples = np.zeros(len(hashes), np.int64)  # that follow one another from here on
                for _ in range(LONGEST - 2):
                    triples = np.where(whole, np.minimum(later(triples) + 1, LONGEST - 2), 0)
                size = np.where(linked, 2 + triples, 1)
                keep = has(bits.value, hashes)
                which, phrases = [], []
                for k in range(1, LONGEST + 1):
                    at = np.flatnonzero(keep & (size == k))
                    which.append(at)
                    phrases.append(pc.binary_join_element_wise(*(words.take(pa.array(at + j)) for j in range(k)), pa.scalar(" ", pa.large_string())))
                seen = pa.table([langs.take(pa.array(np.concatenate(which))), pa.chunked_array(phrases)], names=["lang", "phrase"])
                seen = seen.group_by(["lang", "phrase"]).aggregate([([], "count_all")])
                every = pa.table([langs], names=["lang"]).group_by("lang").aggregate([([], "count_all")])
                every = every.append_column("phrase", pa.array([""] * len(every), pa.large_string()))
                for t in (seen, every):
                    yield from t.select(["lang", "phrase", "count_all"]).cast(OUT).to_batches()

    found = docs.mapInArrow(grams, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


OUT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("count_all", pa.int64())])


def first(phrase: str | Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def last(phrase: str | Column, k: int) -> Column:
    return F.substring_index(phrase, " ", -k)


def counts(grams: DataFrame) -> list[DataFrame]:
    """Counts (lang, phrase, n) of phrases of 1 to LONGEST words: flow out of a node, and flow that ends there."""
    own = [grams.where(F.size(F.split("phrase", " ")) == k) for k in range(1, LONGEST + 1)]
    own[0] = own[0].where("phrase != ''")
    levels = [own[-1]]
    for k in range(LONGEST - 1, 0, -1):
        flow = levels[0].withColumn("phrase", first("phrase", k)).unionByName(own[k - 1])
        levels.insert(0, flow.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    return levels


def paths(spark: SparkSession, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Maximal unary paths: lang, words (array), n.  ``edges`` and ``nodes``: lang, phrase, n; every node of an edge is given.

    Edges of one path have the count of the nodes between them, so each edge has
    at most one before it, and a path is no longer than the piece of text it stands in.
    """
    only = nodes.select("lang", F.col("phrase").alias("node"), F.col("n").alias("flow"))
    into = edges.select("lang", F.col("phrase").alias("before"), last("phrase", LONGEST - 1).alias("node"), F.col("n").alias("flow")).join(only, ["lang", "node", "flow"])
    out = edges.select("lang", "phrase", "n", first("phrase", LONGEST - 1).alias("node"))
    linked = out.join(into, (out.lang == into.lang) & (out.node == into.node) & (out.n == into.flow), "left")
    chain = linked.select(out.lang, "phrase", "n", F.coalesce("before", "phrase").alias("head"), F.col("before").isNotNull().cast("long").alias("step"))
    while True:
        chain = stage(spark, chain, "collocation-chain")
        up = chain.where("step > 0")
        if up.join(up.select("lang", F.col("phrase").alias("head")), ["lang", "head"], "left_semi").isEmpty():
            break
        jump = chain.select("lang", F.col("phrase").alias("head"), F.col("head").alias("_head"), F.col("step").alias("_step"))
        chain = chain.join(jump, ["lang", "head"]).select("lang", "phrase", "n", F.col("_head").alias("head"), (F.col("step") + F.col("_step")).alias("step"))
    steps = F.sort_array(F.collect_list(F.struct("step", last("phrase", 1).alias("word"))))
    whole = chain.groupBy("lang", "head").agg(F.max("n").alias("n"), F.transform(steps, lambda s: s["word"]).alias("_ends"))
    return whole.select("lang", F.concat(F.slice(F.split("head", " "), 1, LONGEST - 1), "_ends").alias("words"), "n")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score. """
    docs = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (size // BYTES_PER_SLOT).bit_length()))
    bits = spark.sparkContext.broadcast(frequent(docs, slots, least))
    grams = stage(spark, longest_grams(docs, bits), "collocation-grams")
    levels = [x.where(F.col("n") >= least) for x in counts(grams)]
    levels = [x.withColumn("k", F.lit(k)) for k, x in enumerate(levels, 1)]
    found = levels[0]
    for x in levels[1:]:
        found = found.unionByName(x)
    found = stage(spark, found, "collocation-counts")
    size = lambda k: found.where(F.col("k") == k).select("lang", "phrase", "n")
    nodes = size(LONGEST - 1)
    path = paths(spark, size(LONGEST), nodes)
    # three words are covered along paths, two words by the nodes that hold them (whose counts are no less than any edge's)
    along = path.select("lang", "n", F.explode(F.expr(f"transform(sequence(1, size(words) - {LONGEST - 2}), i -> array_join(slice(words, i, {LONGEST - 1}), ' '))")).alias("phrase"))
    under = along
    for k in range(LONGEST - 1, 2, -1):
        above = size(k)
        for part in (first, last):
            under = under.unionByName(above.select("lang", "n", part("phrase", k - 1).alias("phrase")))
    under = under.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = found.where("k > 1").join(under, ["lang", "phrase"], "left")
    kept = kept.where(F.col("most").isNull() | (100 * F.col("most").cast("decimal(30,0)") < COVERED * F.col("n").cast("decimal(30,0)")))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"_l": F.expr("substring_index(phrase, ' ', cut)"), "_r": F.expr("substring_index(phrase, ' ', cut - k)")})
    part = lambda c, n: found.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    cuts = cuts.join(part("_l", "l"), ["lang", "_l"]).join(part("_r", "r"), ["lang", "_r"])
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the first of each part of a language, then of those parts: no task ranks all phrases of a large language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    best = lowest.select("lang", "phrase", "a", "s.l", "s.r", "s.score").withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    every = grams.where("phrase = ''").select("lang", "n")
    return best.join(every, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, table(spark, sf_dir, "documents"))


def oracle(least: int = LEAST, top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda a, b: f"array_to_string(list_slice(w, {a}, {b}), ' ')"
    grams = " union all ".join(f"select lang, {k} k, array_to_string(list_slice(w, i, i + {k - 1}), ' ') p from (select lang, w, unnest(range(1, len(w) - {k - 2})) i from pieces)" for k in range(1, LONGEST + 1))
    inner = " union all ".join(
        f"select lang, n, {part(i, i + k - 1)} p from (select lang, n, string_split(p, ' ') w from c where k = {long})"
        for long in range(3, LONGEST + 1) for k in range(2, long) for i in range(1, long - k + 2))
    cuts = " union all ".join(f"select lang, k, p, n a, {cut} cut, {part(1, cut)} lp, {part(cut + 1, k)} rp from (select *, string_split(p, ' ') w from kept where k = {k})" for k in range(2, LONGEST + 1) for cut in range(1, k))
    return rf"""
    with pieces as (
      select lang, regexp_extract_all(piece, '[^\x20\x09]+') w
      from (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) piece from documents)),
    c as (select lang, k, p, count(*) n from ({grams}) group by all having count(*) >= {least}),
    total as (select lang, sum(len(w))::bigint n from pieces group by lang),
    covered as (select lang, p, max(n) n from ({inner}) group by all),
    kept as (select c.* from c left join covered on c.lang = covered.lang and c.p = covered.p
             where k > 1 and (covered.n is null or 100 * covered.n < {COVERED} * c.n)),
    cuts as (select x.lang, x.p, a, cut, l.n l, r.n r, (2000000::hugeint * a // (l.n + r.n))::bigint score
             from ({cuts}) x join c l on x.lang = l.lang and x.lp = l.p join c r on x.lang = r.lang and x.rp = r.p),
    low as (select * from (select *, row_number() over (partition by lang, p order by score, cut) o from cuts) where o = 1),
    best as (select *, row_number() over (partition by lang order by score desc, a desc, p) rank from low)
    select best.lang, rank, p phrase, a, l, r, total.n, score from best join total on best.lang = total.lang where rank <= {top}"""
