"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from sequora.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The grid is slow in DuckDB; one of its queries is compared here, the others are views of the same rows.
SLOW = {"grid_search_ce", "best_params", "params_general", "params_taxa", "heatmap", "recount", "params_consensus"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    return f"{float(x):.5f}" if isinstance(x, (int, float)) or hasattr(x, "as_tuple") else str(x)


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - SLOW))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    got = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_pairs_count_bits(spark):
    """Sites of a pair are compared as bits, not one by one in a lambda."""
    plan = catalog.QUERIES["cumulative_distance"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "zip_with" not in plan
