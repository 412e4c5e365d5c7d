"""Session helpers: checkpoint folder from the session, metadata probes."""

from covercost import session as S


def test_checkpoint_dir_is_read_from_session(spark):
    d = S.ensure_checkpoint_dir(spark)
    assert d and d == S.ensure_checkpoint_dir(spark)      # stable, not re-created


def test_probes(spark):
    df = spark.range(100).repartition(3)
    assert S.num_partitions(df) == 3
    assert S.parallelism(spark) >= 1
    assert S.app_id(spark)
    assert S.max_broadcast_rows(spark) > 0
