"""Master-table rules: cleaning, fan-out, last/first wins, defaults."""


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_centros_clean(tiny):
    c = tiny.centros_clean
    # closed, excluded, null and blank codes are gone; null supervisor is kept
    assert rows(c, "row_idx", "cod_centro_preferente", "nombre_jefe_ope") == [
        (1, "101", "Ana"), (2, "102", None), (7, "101", "Luis")]
    assert set(c.columns) >= {"codigo_centro"} and "almacen_centro" not in c.columns


def test_lookup_and_first(tiny):
    assert rows(tiny.centros_lookup, "nombre_centro_display") == [
        ("101 - Centro Uno",), ("101 - Centro Uno bis",), ("102 - Centro Dos",)]
    assert rows(tiny.centre_first.df, "cod_centro_preferente", "desc_centro_preferente") == [
        ("101", "Centro Uno"), ("102", "Centro Dos")]


def test_workers_enriched_fans_out(tiny):
    e = tiny.workers_enriched
    pepe101 = rows(e.filter("nombre_empleado = 'PEPE' and centro_preferente = '101'"), "nombre_jefe_ope")
    assert pepe101 == [("Ana",), ("Luis",)]        # one row per matching centre
    assert rows(e.filter("nombre_empleado = 'JUAN'"), "nombre_jefe_ope", "nombre_centro_preferente") == [
        ("OWNJ", None)]                              # no centre: own supervisor


def test_worker_dim_last_wins_with_defaults(tiny):
    d = {r["nombre_empleado"]: r for r in tiny.worker_dim.df.collect()}
    assert set(d) == {"PEPE", "MARIA", "JUAN"}      # null name dropped
    assert d["PEPE"]["cat_empleado"] == "g Cocina" and d["PEPE"]["centro_preferente"] == "102"
    assert d["PEPE"]["nombre_jefe_ope"] == "" and d["PEPE"]["coste_hora"] == 6.0
    assert d["MARIA"]["coste_hora"] == 0.0 and d["MARIA"]["cod_crown"] == ""
    assert d["JUAN"]["servicio"] == "020 Limpieza" and d["JUAN"]["centro_preferente"] == ""


def test_tariff_and_account_dims(tiny):
    assert rows(tiny.tariff_dim.df, "cat_key", "conv_key", "tarifa") == [
        ("ASL", "99100165012001", 3.0), ("COCINA", "99100165012003", 4.0), ("H ASL", "99100165012001", 9.0)]
    assert rows(tiny.account_dim.df, "motivo", "cuenta_codigo") == [
        ("Absentismo", "73"), ("Festivos y Fines de Semana", "70_71"), ("Nocturnidad", "74"), ("Refuerzo", "72")]


def test_pickers(tiny):
    from covercost.operators import masters as M
    assert [r[0] for r in M.supervisors(tiny.centros_clean).collect()] == ["Ana", "Luis"]
    assert [r[0] for r in M.centre_codes(tiny.centros_clean).collect()] == ["101", "102"]
    assert rows(M.centre_options(tiny.centros_clean), "option") == [("",), ("101",), ("102",)]
    labels = [r[0] for r in M.employees_with_centre(tiny.workers_enriched).collect()]
    assert labels == sorted(labels) and "nan - JUAN" in labels and "101 - nan" in labels
    assert rows(M.workers_per_centre(tiny.workers_enriched), "codigo_centro", "n_trabajadores") == [
        ("101", 1), ("102", 2)]


def test_t18_missing_supervisor_column(spark, tiny):
    from covercost.operators import masters as M
    no_sup = tiny.centros.drop("nombre_jefe_ope")
    clean = M.centros_clean(no_sup, excluded=("EXCLUDED",))
    assert clean.count() == 4 and dict(clean.dtypes)["nombre_jefe_ope"] == "string"
