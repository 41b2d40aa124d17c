import datetime as dt

import pytest

from reviewlens.session import build_session

SMALL = "/root/testdata/sf0.001"

# Ten reviews of two apps: text, stars, sentiment, aspect.
_TEXTS = [
    ("amber", "Met someone kind in week one, thank you", 5, "Positive", "Matches"),
    ("amber", "It closes itself whenever I send a photo", 1, "Negative", "Bugs"),
    ("amber", "Does what it says and no more than that", 3, "Positive", "General"),
    ("amber", "Clear menu", 5, "Positive", "UI/UX"),
    ("amber", "Monthly fee keeps rising", 1, "Negative", "Pricing"),
    ("cobalt", "Five stars from me", 5, "Positive", "General"),
    ("cobalt", "Login fails again", 1, "Negative", "Bugs"),
    ("cobalt", "Pleasant enough, yet overpriced for what you get", 2, "Negative", "Pricing"),
    ("cobalt", "We are getting married in the spring", 5, "Positive", "Matches"),
    ("cobalt", "Half of the accounts I see are not real people", 1, "Positive", "Safety"),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        4,
        **{
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def raw(spark):
    rows = [
        (i, str(i), app, text, float(stars), dt.date(2025, 1, i + 1), 0)
        for i, (app, text, stars, _, _) in enumerate(_TEXTS)
    ]
    return spark.createDataFrame(
        rows,
        "seq long, review_id string, app_name string, review_text string, star_rating double,"
        " review_date date, thumbs_up long",
    )


@pytest.fixture(scope="session")
def aspect_table(spark):
    # The aspect table sees review 9 as negative, the mismatch table as positive.
    rows = [
        (str(i), app, aspect, "Negative" if i == 9 else label)
        for i, (app, _, _, label, aspect) in enumerate(_TEXTS)
    ]
    return spark.createDataFrame(rows, "review_id string, app_name string, aspect string, sentiment string")


@pytest.fixture(scope="session")
def mismatch_rows(spark):
    rows = [
        (str(i), text, float(stars), label, 0.6 + i / 100, i == 9)
        for i, (_, text, stars, label, _) in enumerate(_TEXTS)
    ]
    return spark.createDataFrame(
        rows,
        "review_id string, review_text string, star_rating double, sentiment_label string,"
        " sentiment_score double, is_mismatch boolean",
    )


@pytest.fixture(scope="session")
def flagged(spark):
    return spark.createDataFrame([(str(i), i == 9) for i in range(10)], "review_id string, is_spam boolean")
