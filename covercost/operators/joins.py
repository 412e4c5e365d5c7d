"""Dimension joins with a checked broadcast and row-order helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covercost.constants import FANOUT, MOST_SPLITTERS, SLICE_ROWS
from covercost.session import ensure_checkpoint_dir, max_broadcast_rows, num_partitions, pass_bytes
from covercost.sources.files import remove, versions


class Dim:
    """A dimension table persisted once, with its exact row count.

    ``side()`` returns a broadcast hint only when the counted size is within
    ``covercost.broadcast.maxRows``; a larger dimension is joined by shuffle,
    where adaptive execution still switches to a broadcast if the runtime
    size allows and splits skewed keys.
    """

    # Lets adaptive execution coalesce (and split skew) inside the cached
    # plan; a dimension cache has no partitioning worth preserving.
    _CACHED_PLAN_CONF = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"

    def __init__(self, df: DataFrame, name: str, max_rows: int | None = None):
        self.name = name
        spark = df.sparkSession
        self.max_rows = max_rows if max_rows is not None else max_broadcast_rows(spark)
        previous = spark.conf.get(self._CACHED_PLAN_CONF)
        spark.conf.set(self._CACHED_PLAN_CONF, "true")
        try:
            self.df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.rows = self.df.count()
        finally:
            spark.conf.set(self._CACHED_PLAN_CONF, previous)
        if not self.broadcastable:
            # A dimension deduplicated by key is cached hash-partitioned on it;
            # a join would then shuffle only the fact side, and adaptive
            # execution can split a hot key only between two shuffles.  Cache
            # a copy without key partitioning so both sides are shuffled and a
            # key holding a large share of the facts is split over many tasks.
            spread = self.df.repartition(max(num_partitions(self.df, 1) or 1, 1))
            spread = spread.persist(StorageLevel.MEMORY_AND_DISK)
            spread.count()
            self.df.unpersist()
            self.df = spread

    @property
    def broadcastable(self) -> bool:
        return self.rows <= self.max_rows

    def side(self) -> DataFrame:
        return F.broadcast(self.df) if self.broadcastable else self.df

    def unpersist(self) -> None:
        self.df.unpersist()


def sized_side(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows (checked by a bounded count)."""
    limit = max_rows if max_rows is not None else max_broadcast_rows(df.sparkSession)
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key in ``order`` (dictionary-overwrite semantics).

    ``row_number() = 1`` lets Spark insert a partial group limit before the
    shuffle, so a hot key never brings all its rows to one task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_first() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key in ``order`` (first-match semantics)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


#: Folders written inside each open ``scratch``, the innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``materialize`` and ``new_folder`` make inside goes at the end; only results that are written elsewhere may leave."""
    own: list[str] = []
    _SCRATCH.append(own)
    try:
        yield
    finally:
        k = next((k for k, x in enumerate(_SCRATCH) if x is own), len(_SCRATCH))
        inner = _SCRATCH[k:]  # with those that a failure left open
        del _SCRATCH[k:]
        for path in (p for x in inner for p in x):
            remove(spark, path)


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a new folder under the session's checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/covercost-{label}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def add_rows(df: DataFrame, path: str, *folders: str) -> None:
    """Rows added to a Parquet folder, in one folder for each value of ``folders``."""
    df.write.mode("append").option("compression", "zstd").partitionBy(*folders).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the session's checkpoint folder and read it back.

    This cuts the lineage: later stages read stable files, so a lost executor
    never recomputes position-dependent columns.
    """
    path = new_folder(df.sparkSession, label)
    add_rows(df, path)
    return df.sparkSession.read.parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from; 0 when there are none. Nothing is evaluated."""
    return sum(size for path in df.inputFiles() for _, size, _ in versions(df.sparkSession, unquote(path)))


def cuts_of(df: DataFrame, column: str) -> list[str]:
    """Values, ascending, that cut ``df`` into ranges of ``column`` with about the session's pass size of input files behind each; none if it is small.

    They are evenly spaced among the values whose hash falls on one of a few;
    that condition reaches the scan where the column depends on one table, so
    only those rows are joined.
    """
    most = pass_bytes(df.sparkSession)
    n = -(-input_bytes(df) // most)
    if n <= 1:
        return []
    at, h = F.col(column), F.xxhash64(column)
    drawn = df.where(F.pmod(h, F.lit(max(1, most >> 16))) == 0).select(at, h.alias("_h")).where(at.isNotNull()).distinct()
    drawn = drawn.orderBy("_h", column).limit(MOST_SPLITTERS).agg(F.array_sort(F.collect_set(column))).first()[0]
    return sorted({drawn[len(drawn) * k // n] for k in range(1, n)}) if drawn else []


def in_range(column: str, low: str | None, high: str | None) -> Column:
    """Whether ``column`` is at least ``low`` and below ``high``; None is no bound, and a null lies in the first range."""
    at = F.col(column)
    above = F.lit(True) if low is None else at >= F.lit(low)
    below = F.lit(True) if high is None else at < F.lit(high)
    return at.isNull() | below if low is None else above & below


def splitters(rows: DataFrame, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Splitters of the large groups ``_g`` of rows (_g, _at): every FANOUT-th as an array, and those between by the number ``_c`` of the former before them.

    A row is sampled when a hash of its order columns falls on one of
    ``slice_rows`` values; of all sampled rows those of the MOST_SPLITTERS
    smallest hashes count.  So the summary depends on the rows alone (not on
    partitions, the order of tasks or how often it is computed), summaries of
    parts merge into that of the whole, and its size is bounded.  A group
    keeps at most FANOUT * FANOUT - 1 evenly spaced splitters; one without a
    sampled row has none and stays one slice.
    """
    drawn = rows.withColumn("_h", F.xxhash64("_at")).where(F.pmod("_h", F.lit(slice_rows)) == 0).distinct()
    drawn = drawn.orderBy("_h", "_g", "_at").limit(MOST_SPLITTERS)
    by_group = Window.partitionBy("_g")
    every = F.ceil(F.count(F.lit(1)).over(by_group) / F.lit(FANOUT * FANOUT - 1)).cast("long")
    drawn = drawn.select("*", F.row_number().over(by_group.orderBy("_at")).alias("_k"), every.alias("_every"))
    fixed = drawn.where(F.col("_k") % F.col("_every") == 0).withColumn("_k", F.row_number().over(by_group.orderBy("_at")))
    at = F.array_sort(F.collect_list("_at")).alias("_splits")
    every_nth = fixed.where(F.col("_k") % FANOUT == 0).groupBy("_g").agg(at)
    between = fixed.where(F.col("_k") % FANOUT != 0).groupBy("_g", F.floor(F.col("_k") / FANOUT).cast("int").alias("_c")).agg(at)
    return every_nth, between


def _not_above(splits: str, at: str) -> Column:
    """How many elements of a sorted array (fewer than FANOUT) aren't above ``at``, by halving; 0 for a null array."""
    halves = F.array(*[F.lit(FANOUT >> k) for k in range(1, FANOUT.bit_length())])
    found = F.aggregate(halves, F.lit(0), lambda n, half: n + F.when(F.get(splits, n + half - 1) <= F.col(at), half).otherwise(0))
    return F.coalesce(found, F.lit(0))  # never null, which spares a join on it a filter that would search again


def in_slices(rows: DataFrame, split: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` (with _g and _at) and their ``_slice``: how many splitters of the group aren't above the row."""
    coarse, fine = (s.withColumnsRenamed({"_g": "_s_g", "_c": "_s_c"}) for s in split)  # at most MOST_SPLITTERS splitters
    df = rows.join(F.broadcast(coarse), F.col("_g") == F.col("_s_g"), "left")
    df = df.withColumn("_c", _not_above("_splits", "_at")).drop("_s_g", "_splits")
    df = df.join(F.broadcast(fine), (F.col("_g") == F.col("_s_g")) & (F.col("_c") == F.col("_s_c")), "left")
    return df.withColumn("_slice", F.col("_c") * FANOUT + _not_above("_splits", "_at")).drop("_c", "_s_g", "_s_c", "_splits")


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str = "seq",
                  slice_rows: int = SLICE_ROWS, given: DataFrame | None = None) -> DataFrame:
    """Row number 1..n inside each ``keys`` group in ``order``, for groups of any size.

    A window partitioned by the group would send a whole group to one task.
    Instead the splitters cut a large group into slices of about
    ``slice_rows`` rows; a row's number is the count of rows in the slices
    before plus its rank in its own.  The splitters depend on the rows alone,
    so the plan is lazy: nothing runs or is written while it is built, and a
    lost executor's rows come out the same.  Only keys are read for splitters
    and counts, and the rows are shuffled once, by slice.  Columns that joins
    add to each row are better added afterwards.

    Rows that are equal in ``order`` are numbered in any order; nulls come first.
    ``given`` (``keys`` and ``ultima``): numbers go on from there in the groups that it has.
    """
    # a struct is never null and equals one with the same nulls: a null scope is still a group
    group, at = F.struct(*keys).alias("_g"), (F.col(order[0]) if len(order) == 1 else F.struct(*order)).alias("_at")
    own = df.select(group, at)
    split = splitters(own, slice_rows)
    counts = in_slices(own, split).groupBy("_g", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_g").alias("_b_g"), F.col("_slice").alias("_b_slice"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if given is not None:
        last = given.select(F.struct(*keys).alias("_l_g"), "ultima")
        counts = counts.join(last, F.col("_b_g") == F.col("_l_g"), "left")
        counts = counts.select("_b_g", "_b_slice", (F.col("_before") + F.coalesce("ultima", F.lit(0))).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_g", "_slice").orderBy("_at"))
    # keys and order are moved once, as the group and the place
    moved = df.select(*[c for c in df.columns if c not in (*keys, *order)], group, at)
    out = in_slices(moved, split).withColumn("_rank", rank)
    out = out.join(counts, (F.col("_g") == F.col("_b_g")) & (F.col("_slice") == F.col("_b_slice")))
    back = {c: F.col("_g")[c] for c in keys} | ({order[0]: F.col("_at")} if len(order) == 1 else {c: F.col("_at")[c] for c in order})
    return out.select(*[back[c].alias(c) if c in back else c for c in df.columns], (F.col("_before") + F.col("_rank")).cast("bigint").alias(name))


def null_if_blank(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)
