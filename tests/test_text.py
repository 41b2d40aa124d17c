import pytest
from pyspark.sql import functions as F

from reviewlens.functions import text


def run(spark, fn, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(fn(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("HELLO World", "hello world"),
        ("see https://a.b/c?d now", "see now"),
        ("wwwhatever stays", "stays"),
        ("a <b>bold</b> c", "a bold c"),
        ("open < but\nno close >", "open but no close"),
        ("tag <a\rb> gone", "tag gone"),
        ("so   many\t\tgaps ", "so many gaps"),
        ("Is it good? Yes!", "is it good? yes!"),
        ("a;b:c(d)", "a b c d"),
        ("fine 👍👍 app", "fine app"),
        ("naïve café", "na ve caf"),
        ("x\x1cy\x0bz\x85w", "x y z w"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean_for_model(spark, value, expected):
    assert run(spark, text.clean_for_model, value) == expected


def test_emoji_names(spark):
    clean = lambda c: text.clean_for_model(c, {"👍": "thumbs_up", "👍🏽": "thumbs_up_medium"})
    assert run(spark, clean, "ok👍 and 👍🏽 café") == "ok thumbs_up and thumbs_up_medium café"


@pytest.mark.parametrize(
    "value, expected",
    [("Don't stop!", "don t stop"), ("Größe, ça va?", "größe ça va"), ("a_b-c", "a_b c"), (None, "")],
)
def test_clean_for_keywords(spark, value, expected):
    assert run(spark, text.clean_for_keywords, value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Hello, World! #1", "hello world 1"),
        ("café 😊ok", "caf ok"),
        ("don't_do", "dontdo"),
        (" two  gaps ", " two  gaps "),
        (None, ""),
    ],
)
def test_clean_for_features(spark, value, expected):
    assert run(spark, text.clean_for_features, value) == expected


@pytest.mark.parametrize("name", ["clean_for_model", "clean_for_keywords"])
def test_cleaning_twice_changes_nothing(spark, small, name):
    clean = getattr(text, name)
    docs = spark.read.parquet(f"{small}/documents.parquet").select(clean(F.col("text")).alias("once"))
    assert docs.where(clean(F.col("once")) != F.col("once")).count() == 0


def test_tokens(spark):
    assert run(spark, text.tokens, "  a b c\x1dd ") == ["a", "b", "c", "d"]
    assert run(spark, text.tokens, "") == []
    assert run(spark, text.word_tokens, "A I'm über-cool x_1 !") == ["über", "cool", "x_1"]


def test_stop_words(spark):
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 127
    assert run(spark, text.keyword_tokens, "The app, the APP is so ok and fun") == ["app", "app", "fun"]


def test_feature_text(spark):
    words = "The new filters are quick and they show nearby people first"
    assert run(spark, text.feature_text, words) == "new filters quick show nearby people first"
    assert run(spark, text.feature_text, "just five stars") == ""
    assert run(spark, text.feature_text, "cannot gonna stay wanna play") == "gon na stay wan na play"
    lemmas = lambda c: text.feature_text(c, lemmas={"filters": "filter"})
    assert run(spark, lemmas, words) == "new filter quick show nearby people first"


def test_word_counts(spark):
    assert run(spark, text.word_count, "one two  three") == 3
    assert run(spark, text.word_count, None) == 0
    for value, size in [("", 0), ("one", 1), ("one two three", 3)]:
        assert run(spark, text.squeezed_word_count, value) == size
