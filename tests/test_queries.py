"""Every registered query against its SQL, and the driver's entry points."""

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_points
from swaplens.plans import catalog

#: Queries that only differ in the last step from others are compared by the driver; here one of each kind.
SHARED = [
    "coverage_annotated", "attrition", "triplets_common_support", "donor_reuse_detail", "slide_reuse_detail", "match_identity", "hce_pair_weighted", "hce_common_support",
    "pairs_with_sources", "hcs_incomplete", "donor_reuse_distribution", "slide_reuse_distribution", "gate_coverage", "bootstrap_grouped", "seed_estimates", "assembled", "robustness",
]


def norm(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", [n for n in sorted(catalog.oracle_sql()) if n not in SHARED])
def test_query_agrees_with_its_sql(spark, duck, tiny, name):
    df = catalog.queries()[name](spark, tiny)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = (Counter(norm(tuple(r)) for r in rows) for rows in (df.select(columns).collect(), found.fetchall()))
    spark.catalog.clearCache()
    assert got == want


def test_entry_points(spark, tiny):
    df = entry_points.entry(spark)
    assert df.columns and df.count() >= 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(catalog.queries()) <= set(entry_points.queries())


def test_every_sql_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and set(SHARED) <= set(catalog.oracle_sql())
