"""Each registered query of the section operators gives the rows of its SQL in DuckDB."""

import math

import duckdb
import pytest

from tissueflow.plans.registry import ORACLE_SQL, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings")


def rows(found, columns):
    out = [tuple(None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in found]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r)), columns


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    assert not [t for _, t in df.dtypes if t.startswith("decimal")]
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]}) t").fetchall()
    assert rows([tuple(r) for r in df.select(*columns).collect()], 0) == rows(expected, 0)
    assert expected
