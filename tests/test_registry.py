"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, normal
from workload.oracles import ORACLES
from workload.registry import QUERIES

# Results that plain SQL cannot restate; other tests cover them.
WITHOUT_SQL = {"baseline_metrics"}
FITTED = {"baseline_metrics"}


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return connection


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row.total_reviews == 200


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, db, name):
    df = contract.queries()[name](spark, small)
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    assert mine == normal(columns, cursor.fetchall())


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_plan_is_native_and_free_of_cross_products(spark, small, name):
    plan = physical_plan(QUERIES[name](spark, small))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert word not in plan


@pytest.mark.parametrize("name", ["trends_daily", "aspect_summary", "keywords_freq", "spam_report", "mismatch_table"])
def test_no_single_partition_exchange(spark, small, name):
    assert "SinglePartition" not in physical_plan(QUERIES[name](spark, small))


def test_filters_and_columns_reach_the_scan(spark, small, tmp_path):
    from reviewlens.plans import dashboard
    from workload import views

    path = str(tmp_path / "scored")
    views.mismatches(spark, small).write.parquet(path)
    stored = spark.read.parquet(path).selectExpr("*", "false as is_spam")
    matching = dashboard.matching_reviews(stored, sentiment="Positive", min_stars=4)
    plan = physical_plan(dashboard.reviews_total(matching))
    pushed = plan.split("PushedFilters")[1]
    assert "EqualTo(sentiment_label,Positive)" in pushed and "GreaterTh" in pushed
    assert "review_text" not in plan.split("ReadSchema")[1]


def test_top_k_is_cut_before_the_shuffle(spark, small):
    plan = physical_plan(QUERIES["keywords_freq"](spark, small))
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in physical_plan(QUERIES["reviews_page"](spark, small))
