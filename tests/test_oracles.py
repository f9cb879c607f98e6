"""Every registered query with a SQL twin, against DuckDB on the same tables."""

import duckdb
import pytest

from glyphweave.plans import registry

TABLES = ["documents", "embeddings", "events"]


def rounded(con, relation):
    """Select list of a relation: doubles, and those in lists, to six places."""
    exprs = []
    for name, kind, *_ in con.execute(f"describe {relation}").fetchall():
        if kind in ("DOUBLE", "FLOAT"):
            exprs.append(f"round({name}::double, 6) + 0.0 as {name}")
        elif kind in ("DOUBLE[]", "FLOAT[]"):
            exprs.append(f"list_transform({name}, lambda x: round(x::double, 6) + 0.0) as {name}")
        else:
            exprs.append(f"{name}::varchar as {name}" if kind.endswith("[]") else f"{name} as {name}")
    return ", ".join(sorted(exprs, key=lambda e: e.rsplit(" ", 1)[1]))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = [c[0] for c in duck.execute(f"describe {registry.oracle_sql()[name]}").fetchall()]
    assert sorted(columns) == sorted(df.columns)
    con = duck.cursor()
    con.register("got", df.select(*columns).toArrow())
    con.execute(f"create temp table want as {registry.oracle_sql()[name]}")
    got, want = (f"select {rounded(con, r)} from {r}" for r in ("got", "want"))
    assert con.execute("select count(*) from want").fetchone()[0] > 0
    extra, missing = (con.execute(f"{x} except all {y} limit 3").fetchall() for x, y in ((got, want), (want, got)))
    assert not extra and not missing, f"extra {extra}, missing {missing}"


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
