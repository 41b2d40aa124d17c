import pytest

from pyspark.sql import functions as F

from reviewlens.functions.text import clean_for_model
from reviewlens.operators.emoji import clean_for_model_with_names

NAMES = {"❤": "heart", "❤️": "red_heart", "\U0001f469‍\U0001f4bb": "coder", "\U0001f469": "woman", "#️⃣": "keycap"}
TEXTS = ["love ❤️❤", "\U0001f469‍\U0001f4bb and \U0001f469", "press #️⃣ or 1#️⃣❤", "日本語 café❤", "plain", "", None,
         "http://x❤ <b>❤</b>", "❤" * 3000, "\U0001f44d"]


@pytest.mark.parametrize("given", [NAMES, {}])
def test_table_of_names_equals_map(spark, given):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "review_id long, review_text string").withColumn("mark", F.lit("clash"))
    names = spark.createDataFrame(list(given.items()), "mark string, name string")
    got = {r.review_id: r.clean_text for r in clean_for_model_with_names(rows, names).collect()}
    # A map without a hit leaves other scripts and marks to the last step, as the table does.
    whole = rows.select("review_id", clean_for_model(F.col("review_text"), given or {"\U0001f9ea": "unused"}).alias("clean_text"))
    assert got == {r.review_id: r.clean_text for r in whole.collect()} and len(got) == len(TEXTS)


def test_no_texts(spark):
    names = spark.createDataFrame(list(NAMES.items()), "mark string, name string")
    assert clean_for_model_with_names(spark.createDataFrame([], "review_id long, review_text string"), names).count() == 0
