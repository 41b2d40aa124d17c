import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import similarity
from reviewlens.operators.similarity import near_duplicate_ids


def flagged_ids(spark, texts, **options):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "review_id string, review_text string")
    found = [r.review_id for r in near_duplicate_ids(docs, **options).collect()]
    assert len(found) == len(set(found))
    return {int(i) for i in found}


def brute_force(texts, threshold=0.9):
    """All pairs, for texts of plain words; fixture-sized input only."""
    counts = [Counter(w for w in t.split() if len(w) > 1) for t in texts]
    df = Counter(w for c in counts for w in c)
    vectors = []
    for c in counts:
        v = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({w: x / norm for w, x in v.items()})
    found = set()
    for i, a in enumerate(vectors):
        for j in range(i):
            if sum(x * vectors[j].get(w, 0.0) for w, x in a.items()) > threshold:
                found |= {i, j}
    return found


def test_identical(spark):
    twice = "Slow to load on older phones but worth the wait"
    assert flagged_ids(spark, [twice, twice, "My account vanished overnight"]) == {0, 1}


def test_distinct(spark):
    texts = [
        "Slow to load on older phones but worth the wait",
        "My account vanished overnight without any notice",
        "Please bring back last year's colours",
    ]
    assert flagged_ids(spark, texts) == set()


def test_texts_without_words_are_never_duplicates(spark):
    assert flagged_ids(spark, ["👍", "👍", "", None, None, "a", "a", "real words", "real words"]) == {7, 8}


def test_empty_table(spark):
    assert flagged_ids(spark, []) == set()


def test_order_and_case_do_not_matter(spark):
    assert flagged_ids(spark, ["Alpha beta gamma", "gamma BETA alpha", "delta epsilon zeta"]) == {0, 1}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    """Random texts, near copies of them at every distance, and one large group of near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(2, 40))) for _ in range(150)]
    for text in rng.sample(texts, 60):
        parts = text.split()
        for _ in range(rng.randint(1, 6)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        texts.append(" ".join(parts))
    seedling = rng.choices(words, k=60)
    for _ in range(100):
        copy = list(seedling)
        copy[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(copy))
    expected = brute_force(texts)
    assert 100 < len(expected) < len(texts)
    assert flagged_ids(spark, texts) == expected


def test_equals_brute_force_with_tiny_parts(spark, monkeypatch):
    """The same when every hot-group rule takes effect."""
    monkeypatch.setattr(similarity, "_HOT_SIGNATURE", 3)
    monkeypatch.setattr(similarity, "_MEMBER_PARTS", 3)
    monkeypatch.setattr(similarity, "_POSTINGS_PER_PART", 4)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(rng.choices(words, k=rng.randint(2, 25))) for _ in range(120)]
    texts += [texts[0]] * 5 + [texts[1]] * 2
    texts += [f"{t} {rng.choice(words)}" for t in texts[:60]]
    assert flagged_ids(spark, texts) == brute_force(texts)


def test_copies_never_meet_in_pairs(spark):
    """A third of the rows being copies adds no candidate pairs."""
    docs = spark.range(3000).select(
        F.col("id").cast("string").alias("review_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the very same words again"))
        .otherwise(F.concat_ws(" ", F.lit("text"), F.hex(F.xxhash64("id")), F.hex(F.xxhash64("id", F.lit(1)))))
        .alias("review_text"),
    )
    vectors = similarity.document_vectors(docs, "review_id", "review_text")
    bags = similarity.collapse_bags(vectors, "review_id")
    assert bags.count() == 2001
    assert bags.agg(F.max("members")).first()[0] == 1000
    assert near_duplicate_ids(docs).count() == 1000


def test_threshold_is_a_parameter(spark):
    texts = ["aa bb cc dd", "aa bb cc ee", "ff gg hh ii"]
    assert flagged_ids(spark, texts, threshold=0.3) == {0, 1}
    assert flagged_ids(spark, texts, threshold=0.99) == set()


def test_texts_are_stored_as_numbers_and_rows_of_a_key_are_one_document(spark):
    """The texts were shuffled to be counted, and weights of eight bytes were stored twice and shuffled five times."""
    rows = [("1", "red blue red"), ("2", "blue"), ("2", "red"), (None, "green red"), (None, "green"), ("3", "green green red"), ("4", "--")]
    docs = spark.createDataFrame(rows, "review_id string, review_text string")
    coded, idf = similarity.coded_documents(docs, "review_id", "review_text")
    terms = ["red", "green", "blue"]  # by total count
    found = {r.review_id: (sorted(zip((terms[i] for i in r["rank"]), r["tf"])), bytes(r.bag_hash)) for r in coded.collect()}
    assert {key: counts for key, (counts, _) in found.items()} == {
        "1": [("blue", 1), ("red", 2)],
        "2": [("blue", 1), ("red", 1)],
        None: [("green", 2), ("red", 1)],
        "3": [("green", 2), ("red", 1)],
    }
    assert found[None][1] == found["3"][1] and len({digest for _, digest in found.values()}) == 3
    assert idf == pytest.approx([math.log(8 / (1 + df)) + 1 for df in (4, 2, 2)])
    assert "Exchange" not in similarity.document_vectors(docs, "review_id", "review_text")._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_by_the_text_and_signatures_need_no_row_per_term(spark, monkeypatch):
    """A row per word was made to count words, and signatures took longer than all other steps before the comparison but two."""
    seen, written = [], similarity.materialise

    def looked(df, name, *others):
        seen.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, name, *others)

    monkeypatch.setattr(similarity, "materialise", looked)
    texts = ["one two three four five six", "six five four three two one seven", "another text of words", None, "", "one one one"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "review_id string, review_text string")
    coded, idf = similarity.coded_documents(docs, "review_id", "review_text")
    assert all("Generate" not in plan for name, plan in seen if name == "terms")
    bags = similarity.collapse_bags(coded, "review_id").cache()
    pairs = {frozenset((r.left, r.right)) for r in similarity.witness_pairs(bags, idf).collect()}
    place = {r.first_id: r.bag for r in bags.collect()}
    assert any(frozenset((place["0"], place["1"])) == p for p in pairs)
    assert all("array_sort" not in plan and "transform" not in plan for name, plan in seen if name == "signatures")
