from pyspark.sql import functions as F

from reviewlens.operators.columns import with_computed


def test_computed_column_is_not_repeated(spark):
    df = spark.range(3).select(F.concat(F.lit("x"), "id").alias("t"))
    out = with_computed(df, "u", F.upper(F.col("t"))).where("u <> 'X1'")
    assert sorted(r.u for r in out.collect()) == ["X0", "X2"]
    optimised = out._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("upper(") == 1


def test_computed_column_keeps_null_rows(spark):
    df = spark.createDataFrame([(None,), ("a",)], "t string")
    assert with_computed(df, "u", F.upper(F.col("t"))).count() == 2
