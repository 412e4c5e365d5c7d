"""Shared helpers of the text operators: tables, staged results and vectorised words over Arrow strings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.session import ensure_checkpoint_dir
from covercost.sources.files import remove

#: Text bytes handled at once inside a task; longer single texts are handled whole.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``."""
    return spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage: what later steps read is fixed by one committed write,
    so a lost executor or a repeated task can't change it.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _staged.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are removed at the end, but for those staged by the function that this yields."""
    outer, paths = _staged.get(), []
    token = _staged.set(paths)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _staged.set(outer)
        try:
            return stage(spark, df, name)
        finally:
            _staged.reset(inner)

    try:
        yield keep
    finally:
        _staged.reset(token)
        for path in paths:
            remove(spark, path)


#: Bytes up to which a table that has been written and counted is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(staged: DataFrame, row_bytes: int) -> DataFrame:
    """``staged`` (a written table), marked for broadcast when its counted rows are small; else Spark joins by shuffling."""
    return F.broadcast(staged) if staged.count() * row_bytes <= BROADCAST_BYTES else staged


def few_of(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """The rows of the ``n`` ids with the smallest hashes (all, if there are fewer); null ids are left out.

    Ids are chosen by a bounded top-k and broadcast, so the same number is
    taken from tables of any size, and no text of another row moves.
    """
    own = docs.select(F.col("doc_id").alias("_few")).where("_few is not null")
    chosen = own.orderBy(F.xxhash64("_few", F.lit(seed)), "_few").limit(n)
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_few"), "left_semi")


def bucket_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets into them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a fresh uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE_VALUES = stream(17, 256)
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums over bytes, for ``span_hashes``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal spans have equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(_BASE_INVERSE, len(prefix))[starts])


#: True for bytes that separate words: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: True for every ASCII byte that isn't a letter or digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
    """(document index, start, end) of each maximal run of non-separator bytes; runs never cross documents."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # between documents
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.empty(len(data) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True):
    """(document index, hash, start, end) of each word; A-Z count as a-z when ``lower``."""
    data = LOWER[data] if lower else data
    doc, starts, ends = word_spans(data, offsets, separators)
    return doc, span_hashes(prefix_hashes(data), starts, ends), starts, ends


def counts_per(doc: np.ndarray, n: int) -> np.ndarray:
    """Boundaries (n + 1) of the rows of each document in arrays sorted by document."""
    return np.searchsorted(doc, np.arange(n + 1))
