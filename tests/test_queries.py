"""Every registered query runs, and gives the rows of its SQL where it has one."""

import datetime
import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.plans import made as Q
from lectern.plans import stages
from lectern.sources.stored import stored

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def test_markup_stripped_strips(spark, tmp_path):
    spark.createDataFrame([(1, "<b>a&gt;b</b> m<sup>2</sup>"), (2, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert dict(Q.QUERIES["markup_stripped"](spark, str(tmp_path)).collect()) == {1: "a greater than b m squared", 2: ""}


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, sf, con, name):
    got = Q.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*cols).collect()]
    assert rows or name in ("running_artifacts",)
    if name in Q.SQL:
        want = con.sql(Q.SQL[name])
        assert sorted(want.columns) == cols
        want = [tuple(map(plain, r)) for r in want.select(*cols).fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


@pytest.mark.parametrize("name,most", [("scripts_repaired", 6), ("scripts_by_models", 2)])
def test_plans_start_from_written_tables(spark, sf, name, most):
    """Rounds and stages don't multiply what the driver has to plan."""
    plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= most


def test_scripts_by_models_broadcast_nothing(spark, sf, monkeypatch):
    """Neither written tables, which look small where they compress, nor what a model joins."""
    plans = []
    monkeypatch.setattr(stages, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    plans.append(Q.QUERIES["scripts_by_models"](spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 8
    assert not [p for p in plans if "Broadcast" in p]


def test_silences_of_long_texts(spark, tmp_path):
    """Files that fit in no row (2 GB), and whose sizes fit in no header (4 GB), come out as the SQL says."""
    sizes = spark.createDataFrame([(1, 0, 0), (1, 1, None), (1, 2, 30), (2, 0, 800_000), (2, 1, 1_460_873), (2, 2, 1_460_874), (2, 3, 3_000_000)], "conv_id long, turn long, n int")
    sizes.select("conv_id", "turn", F.lit("user").alias("role"), F.expr("repeat('x', n)").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = Q.QUERIES["silences"](spark, str(tmp_path)).select("conv_id", "turn", "seconds", "bytes")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select conv_id, turn, seconds, bytes from ({Q.SQL['silences']})").fetchall())
