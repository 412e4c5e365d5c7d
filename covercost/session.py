"""Session helpers: local sessions for tests/bench and cluster-safe settings."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import SparkSession

from covercost.constants import (DEFAULT_MAX_BROADCAST_ROWS, DEFAULT_PASS_BYTES, EDITED_ROWS, EDITED_ROWS_CONF, MAX_BROADCAST_ROWS_CONF,
                                 PASS_BYTES_CONF)

# Settings every job relies on: adaptive execution re-plans joins from runtime
# sizes and splits skewed shuffle partitions; timestamps are pinned to UTC.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Generated methods above the JIT's 8000-byte limit run interpreted; let
    # such (wide) stages fall back instead of running slowly.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "covercost", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark.

    A checkpoint folder is created only here, because a local run has no
    shared storage; cluster jobs must pass ``spark.checkpoint.dir``.
    """
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, reading it from the session.

    On a cluster ``spark.checkpoint.dir`` must name shared storage; it is used
    as given.  Only a local-mode session without one gets a scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # remote (Connect) sessions expose only the conf
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc is not None:
            sc.setCheckpointDir(conf_dir)
            return sc.getCheckpointDir()
        return conf_dir
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    local_dir = tempfile.mkdtemp(prefix="covercost-ckpt-", dir="/tmp")
    if sc is not None:
        sc.setCheckpointDir(local_dir)
        return sc.getCheckpointDir()
    spark.conf.set("spark.checkpoint.dir", local_dir)
    return local_dir


def app_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def num_partitions(df, default: int | None = None) -> int | None:
    """Partition count of a DataFrame's plan (None when the session cannot tell)."""
    try:
        return df.rdd.getNumPartitions()
    except Exception:
        return default


def parallelism(spark: SparkSession) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


def max_broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_BROADCAST_ROWS_CONF, str(DEFAULT_MAX_BROADCAST_ROWS)))


def pass_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(PASS_BYTES_CONF, str(DEFAULT_PASS_BYTES)))


def edited_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(EDITED_ROWS_CONF, str(EDITED_ROWS)))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs, which otherwise stay until the driver collects its garbage."""
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # remote (Connect) sessions have no JVM here
        pass
