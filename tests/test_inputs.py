"""Manifests, kept results, broken input lines, replicated requests, rules that fire, changed pages."""

import os

from pyspark.sql import functions as F

import covercost.plans.queries as Q
from conftest import FACT_SCHEMA, fact
from covercost.operators import edits as E
from covercost.operators import intake as I
from covercost.operators import report as R
from covercost.operators.enrich import enrich
from covercost.plans.context import context
from covercost.sources import files, manifest, result_cache
from covercost.sources import masters as SM

SMALL = "/root/testdata/sf0.001"


def test_manifest_states(spark, tmp_path):
    for name, text in (("a", "uno"), ("b", "dos"), ("c", "tres")):
        (tmp_path / name).write_text(text)
    last = manifest.file_manifest(spark, str(tmp_path)).drop("estado").cache()
    assert last.count() == 3
    (tmp_path / "b").write_text("DOS")
    (tmp_path / "c").unlink()
    (tmp_path / "d").write_text("")
    got = {os.path.basename(r.path): (r.estado, r.length) for r in manifest.file_manifest(spark, str(tmp_path), last).collect()}
    assert got == {"a": ("unchanged", 3), "b": ("changed", 3), "c": ("removed", None), "d": ("new", 0)}


def test_large_sparse_file_in_ranges(spark, tmp_path):
    """A file over 2 GB is read in ranges by many tasks; a changed byte far inside is seen."""
    path = tmp_path / "big"
    with open(path, "wb") as f:
        f.truncate(5 << 30)
    listed = manifest.file_list(spark, str(tmp_path))
    assert listed.first().length == 5 << 30
    first = manifest.digests(listed).first()
    with open(path, "r+b") as f:
        f.seek((4 << 30) + 12345)
        f.write(b"x")
    assert manifest.digests(listed).first().md5 != first.md5


def test_ranges_make_one_digest(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(256)) * 40)
    listed = manifest.file_list(spark, str(tmp_path))
    assert manifest.digests(listed, 1000).first().md5 != manifest.digests(listed, 100_000).first().md5
    assert manifest.digests(listed, 1000).first().md5 == manifest.digests(listed, 1000).first().md5


def test_kept_results(spark, tmp_path):
    data, root = tmp_path / "in", f"file://{tmp_path}/kept"
    data.mkdir()
    (data / "t.txt").write_text("1\n2\n")
    built = []

    def result(n=1, keep=16):
        def build():
            built.append(n)
            return spark.read.text(f"file://{data}").select((F.col("value").cast("int") * n).alias("x"))
        return sorted(r.x for r in result_cache.cached(spark, "double", {"n": n}, [f"file://{data}"], build, root, keep).collect())

    assert result() == [1, 2] and result() == [1, 2] and built == [1]
    assert result(2) == [2, 4] and built == [1, 2]
    (data / "t.txt").write_text("1\n3\n")  # the same length
    os.utime(data / "t.txt", (1, 1))
    assert result() == [1, 3] and built == [1, 2, 1]
    os.utime(data / "t.txt", (9, 9))  # another time, the same content
    assert result() == [1, 3] and len(built) == 3
    assert result(3, keep=2) == [3, 9] and len(os.listdir(tmp_path / "kept" / "double")) == 2
    assert len([d for d in os.listdir(tmp_path / "kept") if d.startswith("digests-")]) <= 2


def test_only_unknown_files_are_read(spark, tmp_path, monkeypatch):
    for name in "ab":
        (tmp_path / name).write_text(name)
    root = f"{tmp_path}/../known-{tmp_path.name}"
    one = result_cache.input_digest(spark, [str(tmp_path)], root)
    (tmp_path / "b").write_text("new")
    read = []
    own = manifest.digests
    monkeypatch.setattr(result_cache, "digests", lambda df: (read.extend(os.path.basename(r.path) for r in df.collect()), own(df))[1])
    assert result_cache.input_digest(spark, [str(tmp_path)], root) != one and read == ["b"]


def test_changed_input_gets_a_new_context(spark, tmp_path):
    """Inputs are known by their versions on any file system, and old dimensions are freed."""
    tables = ("supplier", "nation", "customer", "part")
    for t in tables:
        (tmp_path / f"{t}.parquet").write_bytes(open(f"{SMALL}/{t}.parquet", "rb").read())
    folder = f"file://{tmp_path}"
    first = context(spark, folder)
    dim = first.masters.worker_dim
    assert context(spark, folder) is first and dim.df.storageLevel.useMemory
    os.utime(tmp_path / "customer.parquet", (5, 5))
    assert context(spark, folder) is not first and not dim.df.storageLevel.useMemory
    assert len(files.versions(spark, folder)) == len(tables) and files.versions(spark, f"{folder}/none") == ()


def test_broken_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(" Nombre ,centro_preferente,coste_hora,otra\npepe,101,5.5,x\nana,102\nluis,103,caro,x\neva,104,,x\nmar,105,1,x,y,z\n")
    good, bad, counts = SM.load_checked(spark, str(tmp_path / "in"), "trabajadores", str(tmp_path / "out"))
    assert [(r.nombre_empleado, r.coste_hora) for r in good.orderBy("row_idx").collect()] == [("pepe", 5.5), ("eva", None)]
    assert [r[SM.REJECTED] for r in bad.orderBy("row_idx").collect()] == ["ana,102", "luis,103,caro,x", "mar,105,1,x,y,z"]
    assert counts == {"n_filas": 5, "n_rechazadas": 3}
    t = SM.load_table(spark, str(tmp_path / "in"), "trabajadores", "csv", True, checked=str(tmp_path / "out2"))
    assert t.count() == 2 and spark.read.parquet(str(tmp_path / "out2")).where("rechazada = 'true'").count() == 3


def test_csv_is_split_unless_its_header_goes_over_lines(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.csv").write_text("motivo,desc_cuenta\n" + "Absentismo,72 x\n" * 300_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert SM.load_table(spark, str(tmp_path / "one"), "motivos", "csv").rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text('"nombre\nempleado",centro_preferente\npepe,1\n')
    assert SM.load_table(spark, str(tmp_path / "two"), "trabajadores", "csv").columns[1:] in (["nombre empleado", "centro_preferente"], ["nombre_empleado", "centro_preferente"])


def test_a_large_request_spreads(spark, tiny):
    """Copies are made by all tasks, in ranges; their identifiers are those of one long count."""
    r = spark.createDataFrame([(1, "S", "01-Enero", "trabajador", "", "PEPE", "101", 200_000)],
                              "request_id long, session_jefe string, imputacion_nomina string, kind string, centro_origen string, trabajador string, destinos_csv string, num_rows long")
    out = I.intake_replicate(r, tiny, range_rows=500).select("incidencia_id", F.spark_partition_id().alias("p"))
    sizes = [x["count"] for x in out.groupBy("p").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 80_000 and sum(sizes) == 200_000
    ids = out.agg(F.count_distinct("incidencia_id"), F.min("incidencia_id"), F.max("incidencia_id")).first()
    assert tuple(ids) == (200_000, "R:1:trabajador:0000000000:0000000001", "R:1:trabajador:0000000000:0000200000")


def test_every_rule_fires(spark):
    rules = {r.regla for r in Q.domain_rules(spark, "/root/testdata/sf0.01").select("regla").distinct().collect()}
    assert rules >= {"falta_observaciones", "facturable_fuera_de_dominio", "motivo_fuera_de_dominio", "empresa_fuera_de_dominio", "mes_fuera_de_dominio",
                     "trabajador_desconocido", "centro_destino_desconocido", "incidencia_horas_negativo", "incidencia_precio_negativo", "nocturnidad_horas_negativo", "traslados_total_negativo"}
    reasons = {r.motivo_rechazo for r in Q.intake_rules(spark, "/root/testdata/sf0.01").collect()}
    assert reasons == {"tipo_desconocido", "sin_centro_origen", "sin_trabajador", "sin_destino", "demasiados_destinos"}
    states = {r.estado for r in Q.manifest_states(spark, "/root/testdata/sf0.01").collect()}
    assert states == {"new", "changed", "unchanged", "removed"}


def test_one_edit_reprices_one_page(spark, tiny):
    facts = enrich(spark.createDataFrame([fact(f"{i:04d}", jefe="AB"[i % 2]) for i in range(260)], FACT_SCHEMA), tiny)
    before = R.page_fingerprint(R.paged_incidents(facts))
    edits = spark.createDataFrame([("0120", "7.5")], "incidencia_id string, incidencia_horas string")
    after = R.paged_incidents(E.apply_edits(facts, edits, tiny))
    changed = R.changed_pages(R.page_fingerprint(after), before)
    assert [(r.session_jefe, r.pagina, r.estado) for r in changed.collect()] == [("A", 2, "changed")]
    priced = R.reprice_pages(after, changed, tiny)
    assert priced.count() == 50 and {(r.session_jefe, r.pagina) for r in priced.collect()} == {("A", 2)}
    rolled = {r.session_jefe: r.n_paginas for r in R.digest_rollup(before, ["session_jefe"]).collect()}
    assert rolled == {"A": 3, "B": 3}
    shorter = E.delete_marked(facts, spark.createDataFrame([(f"{i:04d}", True) for i in range(0, 260, 2)][:100], "incidencia_id string, borrar boolean"))
    gone = R.changed_pages(R.page_fingerprint(R.paged_incidents(shorter)), before)
    assert sorted((r.pagina, r.estado) for r in gone.collect()) == [(1, "changed"), (2, "removed"), (3, "removed")]


def test_first_manifest_is_all_new(spark, tmp_path):
    (tmp_path / "x").write_text("x")
    assert [r.estado for r in manifest.file_manifest(spark, str(tmp_path)).collect()] == ["new"]
