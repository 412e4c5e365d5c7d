import duckdb
import pytest

ODD = [
    # doc_id, text, lang, source, kept (a clashing extra column)
    (1, None, "en", "a", 7), (2, "", None, None, 7), (3, " \t\n ", "en", None, 7), (None, "the one without an id " * 20, "en", "a", 7),
    (5, "word", "xx", "a", 7), (6, "a b", None, "a", 7), (7, "same words here " * 30, "en", "a", 7), (8, "same words here " * 30, "en", "a", 7),
    (8, "same words here " * 30, "en", "a", 7), (9, "tie tie tie\n" * 40, "en", "b", 7), (10, "x" * 30_000, "en", "b", 7),
    (11, " ".join(f"w{k}" for k in range(20_000)), "de", "b", 7), (12, "ßéñ 中文 \U0001F600 mail a.b@c.de +1 (234) 555-6789", "de", "b", 7),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, kept int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")


def rows(df, columns=None):
    df = df.select(columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)


def duck(tables, sql):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, sorted((tuple(r) for r in got.fetchall()), key=repr)
