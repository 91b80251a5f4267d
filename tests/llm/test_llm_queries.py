from __future__ import annotations

import pytest

from sonarlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_on_whole_tables(spark, data, name):
    rows = queries.QUERIES[name](spark, data).collect()
    assert len(rows) == len({str(r) for r in rows})


def test_cut_documents_against_sql(spark, data):
    import duckdb

    for t in ("documents", "containers"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = sorted(duckdb.sql(queries.SQL["p7_found"]).fetchall())
    assert sorted(map(tuple, queries.p7_found(spark, data).select("container_id", "doc_id").collect())) == want


def test_every_vector_that_asks_has_ten_neighbours(spark, data):
    from sonarlake.llm.neighbours import canonical_vectors
    from sonarlake.sources.tables import table

    asking = {r.vec_id for r in canonical_vectors(table(spark, data, "feature_vectors")).where("vec_id % 20 = 0").select("vec_id").distinct().collect()}
    got = queries.p1_neighbours(spark, data).toPandas()
    assert set(got.vec_id) == asking and (got.groupby("vec_id").size() == 10).all()
