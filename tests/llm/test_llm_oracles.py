"""The training-data queries that SQL can express against their DuckDB SQL, on the smallest driver tables."""

import math
from pathlib import Path

import pytest
from factloom.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    made = con.execute(ORACLES[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(row[k]) for k in at) for row in made.fetchall())
