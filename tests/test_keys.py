import pytest
from pyspark.sql import functions as F

from reviewlens.operators import keys


@pytest.fixture(scope="module")
def numbered(spark):
    # Three quarters of the rows carry one label.
    return spark.range(0, 4001).select(
        F.col("id").alias("seq"),
        F.concat(F.lit("r"), "id").alias("key"),
        F.when(F.col("id") % 4 == 0, "Negative").otherwise("Positive").alias("label"),
    )


def test_first_per_key(spark):
    df = spark.createDataFrame(
        [(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (5, None, "w")], "seq long, k string, v string"
    )
    rows = keys.first_per_key(df, ["k"], "seq").orderBy("seq").collect()
    assert [(r.seq, r.k, r.v) for r in rows] == [(1, "a", "y"), (2, None, "z")]


def test_ordinals(spark):
    df = spark.createDataFrame([(v,) for v in (500, -3, 7, 12, 1_000_000, 8)], "line long")
    rows = keys.ordinal_ids(df, "line", "n", width=10).orderBy("line").collect()
    assert [r.n for r in rows] == list(range(6))


def test_first_rows(numbered):
    assert keys.first_rows(numbered, "seq", None).count() == 4001
    assert [r.seq for r in keys.first_rows(numbered, "seq", 3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("n", [0, 1, 17, 4000, 4001, 9999])
def test_sample_is_exact(numbered, n):
    assert keys.seeded_sample(numbered, "key", n).count() == min(n, 4001)


def test_sample_is_repeatable(numbered):
    once = {r.key for r in keys.seeded_sample(numbered, "key", 50).collect()}
    again = {r.key for r in keys.seeded_sample(numbered.repartition(7), "key", 50).collect()}
    other = {r.key for r in keys.seeded_sample(numbered, "key", 50, seed=1).collect()}
    assert once == again != other


@pytest.mark.parametrize("share, tests", [(0.2, {"Negative": 200, "Positive": 601}), (0.5, {"Negative": 501, "Positive": 1500})])
def test_split_is_exact(numbered, share, tests):
    split = keys.stratified_split(numbered, "label", "key", share)
    assert split.count() == 4001
    assert {r.label: r["count"] for r in split.where("is_test").groupBy("label").count().collect()} == tests


def test_split_is_repeatable(numbered):
    once = {r.key for r in keys.stratified_split(numbered, "label", "key").where("is_test").collect()}
    again = {r.key for r in keys.stratified_split(numbered.orderBy(F.desc("seq")), "label", "key").where("is_test").collect()}
    assert once == again


def test_ordinals_keep_rows_without_order(spark):
    from reviewlens.operators.keys import ordinal_ids

    rows = spark.createDataFrame([(5, "a"), (None, "b"), (9, "c")], "line long, x string")
    assert {r.x: r.n for r in ordinal_ids(rows, "line", "n", width=4).collect()} == {"b": 0, "a": 1, "c": 2}
