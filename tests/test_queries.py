"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens import registry
from ledgerlens.plans.base import WITH_ORDERS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "∅"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name in registry.ORACLE_SQL:
        r = con.execute(registry.ORACLE_SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(df.columns)
        assert plain(got, df.columns) == plain(r.fetchall(), names)


def test_whole_tables(spark):
    """These queries answer for every row of their tables, and the compared sides have rows without a match."""
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    run = lambda name: registry.QUERIES[name](spark, SF).collect()
    dates = {str(r.d)[:10] for r in read("orders").selectExpr("to_date(o_orderdate) as d").collect()}
    assert {r.today for r in run("filing_windows")} == dates
    orders, items, docs = read("orders").count(), read("lineitem").select("l_orderkey").distinct().count(), read("documents").count()
    compared = run("full_outer_compare")
    assert sum(r.status != "new_only" for r in compared) == orders and sum(r.status != "old_only" for r in compared) == items
    assert {"new_only", "old_only", "mismatch"} == {r.status for r in compared}
    applied = run("review_apply")
    assert sum(r.origin != "review_only" for r in applied) == docs and {"extracted", "review_only", "reviewed"} == {r.origin for r in applied}
    assert "not_found" in {r.applied_status for r in run("review_applied_status")}
    covered = run("target_coverage")
    assert sum(r.documents for r in covered if r.metric == "F") == orders
    assert sum(r.parsed for r in covered) == read("orders").where("o_orderstatus in ('F', 'P')").count()
    statuses = {tuple(x) for x in read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderstatus").distinct().collect()}
    assert {(r.item, c) for r in run("contradictory_maps") for c in r.concepts.split(",")} == {x for x in statuses if sum(y[0] == x[0] for y in statuses) > 1}


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_findings_of_large_sums(spark, tmp_path):
    """A value that is one off differs however large it is."""
    c = duckdb.connect()
    for t, k in (("orders", 1e5), ("customer", 1), ("nation", 1)):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.withColumn("o_totalprice", F.col("o_totalprice") * k) if t == "orders" else df).write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES["consistency_findings"](spark, str(tmp_path))
    r = c.execute(registry.ORACLE_SQL["consistency_findings"])
    names, want = [x[0] for x in r.description], r.fetchall()
    assert plain(df.collect(), df.columns) == plain(want, names)
    assert c.execute(WITH_ORDERS + "SELECT min(value) FROM c WHERE field_id = 'total_p' AND year = 1996").fetchone()[0] > 1e9
