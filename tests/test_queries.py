"""Every registered query of the library against its SQL on small tables."""

from pathlib import Path

import pytest

from gridlark.plans.oracle import ORACLE
from gridlark.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    want = duck.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = lambda x: sorted(map(repr, x))
    assert rows(map(tuple, df.select(*[f"`{c}`" for c in cols]).collect())) == rows(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry_points_have_sql(spark):
    import __spark_entry__ as entry

    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize(
    "odd",
    [
        [(0, "a"), (1, ""), (2, None), (3, " "), (4, "\r\n"), (5, "\ufeffé\x00")],
        [(5, "a"), (-5, "b"), (-(2**63), "c"), (2**63 - 1, "d")],
        [(None, "e"), (None, "f"), (None, ""), (0, "e")],
        [(7, "g"), (7, "g"), (7, "h"), (7, None), (1007, "g")],
    ],
    ids=["empty", "negative", "null", "repeated"],
)
def test_digests_of_odd_documents(spark, tmp_path, odd):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(odd, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES["file_digests"](spark, str(tmp_path)).collect(), con.sql(ORACLE["file_digests"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and want
