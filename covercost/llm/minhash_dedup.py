"""Operator 7: near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set holds its distinct 3-word shingles (A-Z lower-cased; a shorter
text's whole word sequence is one shingle).  SuperMinHash ranks each shingle
with a pseudo-random permutation whose steps are correlated over the signature:
step j offers the value j + r to slot p[j], so the slots fill level by level
and a document stops as soon as no later level can lower a slot.

Steps: equal sets become one class (``min(doc_id)`` stands for it).  Signatures
of classes are cut into bands; of bands with the same members one is kept.  The
members of a band are compared by signature, in blocks, and a spanning forest of
likely pairs is merged by union-find into clusters.  Within each cluster, pairs
are confirmed on the full sets, in blocks again, and the spanning forests of
confirmed links are merged into components.

Defined cases: null or blank text has an empty set and is linked with nothing;
a null doc_id is linked with nothing and kept; repeated rows are classes of
equal sets like any copies; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm.base import broadcast_if_small, counts_per, mix, scratch, slices, stage, stream, table, text_bytes, word_hashes

SHINGLE = 3
#: Signature slots, in BANDS bands of ROWS: a pair at similarity 0.85 shares no band with probability 7e-9.
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
_WORD_KEYS = stream(71, SHINGLE)
_SHORT = stream(72, 1)
_STEPS = stream(73, SLOTS)
_BAND_KEYS = stream(74, ROWS) | np.uint64(1)
_BAND_SEEDS = stream(75, BANDS)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for slices of the texts."""
    data, offsets = text_bytes(texts)
    for lo, hi in slices(offsets):
        own = offsets[lo:hi + 1] - offsets[lo]
        doc, words, _, _ = word_hashes(data[offsets[lo]:offsets[hi]], own)
        bounds = counts_per(doc, hi - lo)
        n = len(words) - SHINGLE + 1
        rolled = mix(sum((words[k:k + n] * _WORD_KEYS[k] for k in range(SHINGLE)), np.zeros(max(n, 0), np.uint64))) if n > 0 else words[:0]
        sets = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= SHINGLE:
                sets.append(np.unique(rolled[a:b - SHINGLE + 1]))
            elif b > a:  # too short for a window: the whole sequence
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = mix(whole * _SHORT + words[k:k + 1])
                sets.append(whole)
            else:
                sets.append(words[:0])
        yield lo, sets


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def superminhash(elements: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (one row per set) of sets given as sorted slices of ``elements``; empty sets keep the maximum.

    A slot's value is level * 2**32 + rank.  All sets advance level by level;
    a set whose slots are all filled leaves, because later levels only offer
    larger values.
    """
    n = len(bounds) - 1
    sig = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    perm = None
    for level in range(slots):
        if not len(elements):
            break
        draw = mix(elements + _STEPS[level])
        k = level + ((draw >> np.uint64(40)) % np.uint64(slots - level)).astype(np.int64)
        if level == 0:
            slot = first = k
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
                each = np.arange(len(elements))
                perm[each, first], perm[:, 0] = 0, first
            each = np.arange(len(elements))
            slot = perm[each, k].astype(np.int64)
            perm[each, k] = perm[:, level]
            perm[each, level] = slot
        value = (draw & np.uint64(0xFFFFFFFF)) | np.uint64(level << 32)
        np.minimum.at(sig, owner * slots + slot, value)
        open_ = (sig.reshape(n, slots) == np.iinfo(np.uint64).max).any(axis=1)
        stay = open_[owner]
        if not stay.all():
            elements, owner, first = elements[stay], owner[stay], first[stay]
            perm = perm[stay] if perm is not None else None
    return sig.reshape(n, slots)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key per band, as signed 64-bit values; the band's number is part of the key."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    return mix((parts * _BAND_KEYS).sum(axis=2, dtype=np.uint64) + _BAND_SEEDS).view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set size, a digest of the full set, band keys, and the slots' low bytes for estimates."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def sign(batches):
        for batch in batches:
            for lo, sets in shingle_sets(batch.column(1)):
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                sig = superminhash(np.concatenate(sets), bounds)
                keys, low = band_keys(sig), (sig & np.uint64(255)).astype(np.uint8)
                yield pa.record_batch([
                    batch.column(0).slice(lo, len(sets)).cast(pa.int64()), pa.array(np.diff(bounds)),
                    pa.array([digest(s) for s in sets], pa.binary()),
                    pa.array([k if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if len(s) else None for x, s in zip(low, sets, strict=True)], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIGNED)


#: Rows that a comparison task holds of one side; larger groups are compared block by block.
BLOCK = 2048
#: Pairs whose estimated similarity is lower are not compared on full sets; by a binomial model a pair at 0.85 falls below it far less often than it shares no band.
LEAST_ESTIMATE = 0.60


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first ``keys`` columns, from batches sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        cols = [t.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(len(t), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new), len(t)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def blocked(members: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Deal the members of each key (``n`` of them) so that every two meet in one of its block pairs (_i, _j)."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks)
    m = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    m = m.withColumn("_i", F.least("_own", "_other").cast("int")).withColumn("_j", F.greatest("_own", "_other").cast("int"))
    keep = [c for c in members.columns if c not in (key, "n")]
    return m.select(key, "_i", "_j", *keep).repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j", "rep")


def tree(n: int, close) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which ``close(x, others)`` tells x's neighbours."""
    rest, edges = np.arange(n), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = close(x, rest)
            edges += [(x, y) for y in rest[near]]
            queue += list(rest[near])
            rest = rest[~near]
    return edges


def estimate(sketches: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Estimated similarity from the slots' low bytes, corrected for chance agreement."""
    return ((sketches[others] == sketches[x]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _edge_batch(rep: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    e = rep[np.array(edges, np.int64).reshape(-1, 2)]
    return pa.record_batch([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["u", "v"])


def likely_links(members: DataFrame, key: str) -> DataFrame:
    """A spanning forest, for each key, of the pairs whose estimate is LEAST_ESTIMATE or more."""

    def forest(batches):
        for t in by_key(batches, 3):
            if len(t) > 1:
                rep = t.column("rep").to_numpy()
                sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(t), -1)
                if edges := tree(len(t), lambda x, o, sk=sk: estimate(sk, x, o) >= LEAST_ESTIMATE):
                    yield _edge_batch(rep, edges)

    return blocked(members, key).mapInArrow(forest, "u long, v long").distinct()


def verified_links(members: DataFrame, key: str) -> DataFrame:
    """A spanning forest, for each key, of the pairs confirmed on their full shingle sets (from ``text``)."""

    def forest(batches):
        for t in by_key(batches, 3):
            if len(t) < 2:
                continue
            sets = [s for _, part in shingle_sets(t.column("text")) for s in part]
            # a row that shares the id but isn't of the class has another set
            own = [k for k, (s, key) in enumerate(zip(sets, t.column("set_key").to_pylist(), strict=True)) if digest(s) == key]
            sets, t = [sets[k] for k in own], t.take(own)
            rep = t.column("rep").to_numpy()
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(t), -1)
            sizes = np.array([len(s) for s in sets])

            def close(x, others, sk=sk, sets=sets, sizes=sizes):
                near = estimate(sk, x, others) >= LEAST_ESTIMATE
                for k in np.flatnonzero(near):
                    both = len(np.intersect1d(sets[x], sets[others[k]], assume_unique=True))
                    near[k] = 100 * both >= PERCENT * (sizes[x] + sizes[others[k]] - both)
                return near

            if edges := tree(len(t), close):
                yield _edge_batch(rep, edges)

    return blocked(members, key).mapInArrow(forest, "u long, v long").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Union-find by alternating stars: (node, root) for every node of ``links`` (u, v), root its component's least node."""

    def least(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("_m"))
        return pairs.join(low.select(F.col("u").alias("_u"), F.least("_u", "_m").alias("m")), F.col("u") == F.col("_u")).drop("_u")

    edges = stage(spark, links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(spark, small.select("e.u", "e.v").where("u != v").distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum("v")).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        seen = now


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    signed = stage(spark, signatures(docs), "signatures")
    of_sets = signed.where("set_key is not null and doc_id is not null")
    classes = stage(spark, of_sets.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    band = classes.select("rep", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("_y"))
    # bands of the same members (two hashes of all of them) link the same pairs: one of them is enough
    shared = shared.where("n > 1").groupBy("n", "_x", "_y").agg(F.min("band").alias("band")).select("band", "n")
    shared = broadcast_if_small(stage(spark, shared, "shared-bands"), 24)
    close = stage(spark, band.join(shared, "band"), "close").join(classes.select("rep", "sketch"), "rep").select("band", "rep", "sketch", "n")
    likely = components(spark, likely_links(close, "band")).withColumnsRenamed({"node": "rep", "root": "cluster"})
    sizes = likely.groupBy("cluster").agg(F.count("*").alias("n"))
    chosen = likely.join(sizes, "cluster").join(classes.select("rep", "sketch", "set_key"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    ids = broadcast_if_small(stage(spark, likely.select(F.col("rep").alias("_rep")), "candidates"), 16)
    texts = texts.join(ids, F.col("rep") == F.col("_rep"), "left_semi")  # few texts have a likely copy: only these are moved
    members = texts.join(chosen.select("rep", "cluster", "n", "sketch", "set_key"), "rep")
    linked = components(spark, verified_links(members, "cluster"))
    root = classes.select("rep", "set_key").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    root = root.select(F.col("set_key").alias("_key"), F.coalesce("root", "rep").alias("_root"))
    j = signed.select("doc_id", "n_shingles", "set_key").join(root, F.col("set_key") == F.col("_key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_root", "doc_id"))
    return j.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group; of rows with the same id and text one stays (null ids all stay)."""
    key = "_id"
    while key in docs.columns:
        key += "_"
    with scratch(spark) as keep:
        # an id goes when none of its rows stands for a group; few ids go, and fewer stand more than once
        ids = near_duplicates(spark, docs).where("doc_id is not null").groupBy(F.col("doc_id").alias(key))
        ids = keep(ids.agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "near-duplicates")
    same = F.col("doc_id").cast("long") == F.col(key)
    out = docs.join(broadcast_if_small(ids.where("not kept").select(key), 16), same, "left_anti")
    again = ids.where("kept").select(key)
    if again.isEmpty():
        return out
    again = broadcast_if_small(again, 16)  # only rows of ids that stand more than once are moved
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def oracle() -> str:
    return rf"""
    with recursive w as (
      select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
      from documents),
    s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                         when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
    n as (select doc_id, count(*) n from s group by doc_id),
    common as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
    link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {PERCENT} * (x.n + y.n - c)),
    edge as (select a, b from link union all select b, a from link),
    reach(doc_id, r) as (select a, a from edge union select reach.doc_id, edge.b from reach join edge on reach.r = edge.a),
    low as (select doc_id, min(r) r from reach group by doc_id)
    select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(low.r, d.doc_id) component_id, coalesce(low.r, d.doc_id) = d.doc_id kept
    from documents d left join n on n.doc_id = d.doc_id left join low on low.doc_id = d.doc_id"""
