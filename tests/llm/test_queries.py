"""The registered queries on the smallest tables: a row for each document, and their SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

from tarnwick.llm import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_rows(spark, name):
    import duckdb

    rows = catalogue.queries()[name](spark, SF).collect()
    table = "embeddings" if name.startswith("op1_") else "documents"
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{SF}/{table}.parquet'").fetchall()[0][0]
    if sql := catalogue.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(sql)
        cols = [d[0] for d in want.description]
        assert sorted(rows[0].asDict()) == sorted(cols)
        assert sorted((tuple(r[c] for c in cols) for r in rows), key=str) == sorted(want.fetchall(), key=str)
