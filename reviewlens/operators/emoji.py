"""Emoji names from a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import lowered_without_markup, without_marks
from reviewlens.operators.columns import with_computed

# Runs that can hold a mark; keycaps start with an ASCII character.
_RUN = r"[0-9#*]?[^\x00-\x7F]+"


def clean_for_model_with_names(df: DataFrame, names: DataFrame, key: str = "review_id", text: str = "review_text") -> DataFrame:
    """``df`` with ``clean_text``: cleaning ahead of a model, each mark of ``names(mark, name)`` replaced by its name.

    Equals ``clean_for_model`` with the same names as a map: longer marks first, equally long ones in their order. Only
    pieces of non-ASCII runs, as long as some mark is, are looked up; a text without any meets no join. ``key`` is unique
    and not null. A null text is empty; a mark has to hold a non-ASCII character; of names for one mark the first counts.
    """
    known = names.where(F.col("mark").rlike(f"^{_RUN}$")).groupBy("mark").agg(F.min("name").alias("name"))
    # As many numbers as there are lengths of marks.
    sizes = known.agg(F.array_sort(F.collect_set(F.length("mark")))).scalar()
    lowered = with_computed(df, "_lowered", lowered_without_markup(F.col(text)))
    marked = lowered.select(key, F.explode(F.regexp_extract_all("_lowered", F.lit(_RUN), 0)).alias("run")).distinct()

    def pieces(start):
        fitting = F.filter("_sizes", lambda n: start + n - 1 <= F.length("run"))
        return F.transform(fitting, lambda n: F.col("run").substr(start, n))

    placed = marked.withColumn("_sizes", sizes).select(
        key, F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), pieces)))).alias("mark")
    )
    entry = F.struct((-F.length("mark")).alias("order"), "mark", F.concat(F.lit(" "), "name", F.lit(" ")).alias("name"))
    found = placed.distinct().join(known, "mark").groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_found"))
    named = F.reduce(F.coalesce("_found", F.array()), F.col("_lowered"), lambda t, m: F.replace(t, m["mark"], m["name"]))
    joined = lowered.join(found, key, "left")
    return joined.withColumn("clean_text", without_marks(named)).drop("_lowered", "_found")
