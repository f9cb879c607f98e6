"""Queries with SQL, against DuckDB: on a small corpus of the test tables and on one of edge rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, docs, tmp_path, name):
    # ids of the edge rows are null and repeat; here they are set and differ
    docs.coalesce(1).withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for folder, files in ((sf, f"{sf}/documents.parquet"), (str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{files}'")
        con.execute(f"create view benchmark as select * from '{sf}/benchmark.parquet'")
        found = queries.queries()[name](spark, folder)
        want = con.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(found.columns)
        order = lambda rows: sorted(rows, key=repr)
        assert order(map(tuple, found.select(*columns).collect())) == order(want.fetchall())
