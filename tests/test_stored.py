"""Tables stored for their reader: pages by range, views by bucket."""

import pytest
from pyspark.sql import functions as F

from reviewlens.plans import dashboard
from reviewlens.sources import bucketed, paged


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(spark, tmp_path):
    """2,000 rows with gaps and one null in their order, dealt at random."""
    rows = spark.range(2000).selectExpr("if(id = 7, null, id * 3) as seq", "id % 7 = 0 as odd", "if(id % 5 = 0, null, id > 1900) as late")
    rows = rows.repartition(5, F.rand(3))
    root = str(tmp_path / "paged")
    paged.write_paged(rows, "seq", root, {"odd": F.col("odd"), "late": F.col("late"), "none": F.lit(False)}, ranges=8)
    return rows, root


def test_pages_equal_the_offset_form(spark, stored):
    rows, root = stored
    for name, condition in ((paged.ALL, None), ("odd", F.col("odd")), ("late", F.col("late")), ("none", F.lit(False))):
        matching = rows if condition is None else rows.where(condition)
        assert paged.matching_rows(spark, root, name) == matching.count()
        whole = [tuple(r) for r in matching.orderBy("seq").collect()]
        for page, size in ((1, 20), (2, 20), (14, 20), (50, 20), (100, 20), (101, 20), (1, 700), (3, 300)):
            got = paged.read_page(spark, root, "seq", page, size, name, condition)
            assert got.columns == rows.columns
            assert [tuple(r) for r in got.collect()] == whole[(page - 1) * size : page * size], (name, page, size)


def test_a_deep_page_reads_one_range(spark, stored):
    rows, root = stored
    directory = spark.read.parquet(f"{root}/directory").where("filter = 'all'").orderBy("_range").collect()
    assert len(directory) == 8 and sum(r.rows for r in directory) == 2000
    sixth = directory[5]
    page = sixth.before // 10 + 2
    found = paged.read_page(spark, root, "seq", page, 10)
    scans = plan_of(found).split("PartitionFilters")[1]
    assert "_range" in scans and found.count() == 10
    # The scan's own metric: one folder of eight, its rows and no others.
    executed = found._jdf.queryExecution()
    found._jdf.collectToPython()
    leaves = executed.executedPlan().collectLeaves()
    scanned = [leaves.apply(i) for i in range(leaves.size())]
    inner = [leaf.finalPhysicalPlan().collectLeaves().apply(0) if "AdaptiveSparkPlan" in leaf.nodeName() else leaf for leaf in scanned]
    metrics = inner[0].metrics()
    assert metrics.apply("numPartitions").value() == 1
    assert metrics.apply("numOutputRows").value() <= sixth.rows


def test_odd_paged_tables(spark, tmp_path):
    empty, root = spark.createDataFrame([], "seq long, odd boolean"), str(tmp_path / "none")
    paged.write_paged(empty, "seq", root)
    assert paged.matching_rows(spark, root) == 0
    assert paged.read_page(spark, root, "seq").count() == 0
    with pytest.raises(ValueError):
        paged.write_paged(empty, "seq", root, {paged.ALL: F.lit(True)})
    with pytest.raises(ValueError):
        paged.write_paged(empty.withColumn("_range", F.lit(1)), "seq", root)
    with pytest.raises(ValueError):
        paged.read_page(spark, root, "seq", 0)
    with pytest.raises(ValueError):
        paged.read_page(spark, root, "seq", name="odd")


def test_bucketed_view_joins_without_an_exchange(spark, tmp_path, raw, mismatch_rows, flagged):
    tables = {"raw_reviews": raw, "mismatches": mismatch_rows, "flagged_reviews": flagged}
    root = str(tmp_path / "bucketed")
    for _ in range(2):  # the second write replaces the first
        bucketed.write_bucketed(tables, root, 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = dashboard.enriched_reviews(*[bucketed.read_bucketed(spark, root, name) for name in tables])
        plan, rows = plan_of(view), view.collect()
        plain = dashboard.enriched_reviews(raw, mismatch_rows, flagged)
        assert "Exchange hashpartitioning" in plan_of(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and plan.count("Join") == 2
    assert sorted(rows) == sorted(plain.select(view.columns).collect())
    bucketed.forget_bucketed(spark, root, list(tables))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("mismatches_")]
