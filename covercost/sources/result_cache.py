"""Results kept by what they were made from: a name, arguments and the contents of input files.

A kept result lies in shared storage under a key of its name, its arguments
and the digests of its inputs, so any session finds it, a changed input (local
or remote) gives another key, and the same content under a new modification
time the same one.  Digests of files are kept as well: of files whose path,
length and modification time are known, the content isn't read again.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from covercost.session import ensure_checkpoint_dir
from covercost.sources import files
from covercost.sources.manifest import digests, file_list

#: Results of one name that stay; the longest unused go first.
KEEP = 16


def _known(spark: SparkSession, root: str) -> list[str]:
    """Folders of file digests, oldest first."""
    fs, at = files.file_system(spark, root)
    if not fs.exists(at):
        return []
    found = [s for s in fs.listStatus(at) if s.getPath().getName().startswith("digests-") and fs.exists(files.file_system(spark, f"{s.getPath()}/_SUCCESS")[1])]
    return [s.getPath().toString() for s in sorted(found, key=lambda s: s.getModificationTime())]


def input_digest(spark: SparkSession, inputs: list[str], root: str) -> str:
    """One digest of the paths and contents of all input files; only files that aren't known yet are read."""
    listed = None
    for glob in inputs:
        one = file_list(spark, glob)
        listed = one if listed is None else listed.unionByName(one)
    known = _known(spark, root)
    key = ["path", "length", "modificationTime"]
    if known:
        old = spark.read.parquet(known[-1])
        fresh = digests(listed.join(old, key, "left_anti"))
        held = listed.join(old, key).select(*key, "md5")
    else:
        fresh, held = digests(listed), None
    now = listed.join(fresh, ["path", "length"]).select(*key, "md5")
    now = now if held is None else held.unionByName(now)
    path = f"{root}/digests-{uuid.uuid4().hex}"
    now.distinct().write.parquet(path)
    for old_path in known[:-1]:  # the last one may still be read by another session
        files.remove(spark, old_path)
    whole = hashlib.sha256()
    for row in spark.read.parquet(path).orderBy("path").select("path", "md5").toLocalIterator():
        whole.update(f"{row.path}\0{row.md5}\0".encode())
    return whole.hexdigest()


def cached(spark: SparkSession, name: str, args: dict, inputs: list[str], build: Callable[[], DataFrame],
           root: str | None = None, keep: int = KEEP) -> DataFrame:
    """The result of ``build()``, read from shared storage when it was made before from the same inputs and arguments."""
    root = (root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/covercost-results").rstrip("/")
    key = hashlib.sha256(json.dumps([name, args, input_digest(spark, inputs, root)], sort_keys=True).encode()).hexdigest()
    path = f"{root}/{name}/{key}"
    fs, done = files.file_system(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    fs.setTimes(done, int(time.time() * 1000), -1)  # the time of its last use
    _evict(spark, f"{root}/{name}", keep)
    return spark.read.parquet(path)


def _evict(spark: SparkSession, folder: str, keep: int) -> None:
    fs, at = files.file_system(spark, folder)
    used = []
    for status in fs.listStatus(at):
        done = files.file_system(spark, f"{status.getPath()}/_SUCCESS")[1]
        if fs.exists(done):  # others are being written
            used.append((fs.getFileStatus(done).getModificationTime(), status.getPath().toString()))
    for _, path in sorted(used)[:-keep]:
        files.remove(spark, path)


