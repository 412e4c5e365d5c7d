"""Labelled documents, whole or as bounded samples, and exact order statistics, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covercost.llm.base import bucket_of

#: Documents of one in HELD_OUT buckets are never learned from.
HELD_OUT = 5


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """_id and y of the labelled documents outside the held-out bucket; an id with several labels counts as 1 if any of them is."""
    own = labels.where(F.col(label).isin(0, 1) & (bucket_of("doc_id", HELD_OUT) != 0))
    return own.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))


def training(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text and y of every labelled document outside the held-out bucket; null ids and labels are left out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(training_labels(labels, label), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


#: Parts into which one pass of ``order_statistics`` cuts each range of values.
PARTS = 4096


def order_statistics(values: DataFrame, wanted: list[tuple[int, int]]) -> list[float]:
    """The k-th smallest ``v`` (from 0) of group ``g`` for each wanted (g, k), exactly; ``values`` is a written table (g int, v double without NaN).

    Each pass counts the rows in PARTS parts of a target's range and goes on
    with the part that holds it, until all its values are equal.
    """
    ends = {r.g: (r.lo, r.hi) for r in values.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    state = [(*ends[g], k) for g, k in wanted]
    while any(lo < hi for lo, hi, _ in state):
        rows = [(t, g, lo, hi) for t, ((g, _), (lo, hi, _)) in enumerate(zip(wanted, state, strict=True)) if lo < hi]
        targets = values.sparkSession.createDataFrame(rows, "t int, _g int, lo double, hi double")
        part = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS)  # never falls as v rises
        own = values.join(F.broadcast(targets), (F.col("g") == F.col("_g")) & F.col("v").between(F.col("lo"), F.col("hi")))
        found: dict[int, list] = {}
        for r in own.groupBy("t", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            found.setdefault(r.t, []).append(r)
        for t, parts in found.items():
            k = state[t][2]
            for r in sorted(parts, key=lambda r: r.part):
                if k < r.n:
                    state[t] = (r.lo, r.hi, k)
                    break
                k -= r.n
    return [lo for lo, _, _ in state]


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text and y of ``per_class`` documents of either class (all, if fewer): those with the smallest hashes of their ids.

    Only documents outside the held-out bucket are taken; null ids and labels
    are left out.  The chosen ids are few at any size of the tables, so they are
    broadcast and no text of another document moves.
    """
    own = training_labels(labels, label)
    by_hash = (F.xxhash64("_id", F.lit(11)), "_id")
    chosen = own.where("y = 0").orderBy(*by_hash).limit(per_class).unionByName(own.where("y = 1").orderBy(*by_hash).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


def held_out(doc_id: str = "doc_id", n: int = HELD_OUT, bucket: int = 0):
    """Whether the id falls in the held-out bucket; false for a null id."""
    return F.coalesce(bucket_of(doc_id, n) == bucket, F.lit(False))
