import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import blocks, similarity


def unit(entries):
    norm = sum(w * w for w in entries.values()) ** 0.5
    return {r: w / norm for r, w in sorted(entries.items())}


def some_vectors(seed, n=160, terms=60):
    """Vectors of few terms and, behind them, near copies at every distance."""
    rng = random.Random(seed)
    made = [{rng.randrange(terms): rng.uniform(0.5, 3) for _ in range(rng.randint(1, 12))} for _ in range(n)]
    for vector in rng.sample(made, n // 2):
        made.append({r: w * rng.uniform(0.5, 1.6) for r, w in vector.items()})
    return [unit(v) for v in made]


def cosine(a, b):
    return sum(w * b.get(r, 0.0) for r, w in a.items())


def with_partner(vectors, threshold):
    return {i for i, a in enumerate(vectors) if any(i != j and cosine(a, b) > threshold for j, b in enumerate(vectors))}


def found(spark, vectors, known=(), threshold=0.9, at_once=50):
    rows = [(i, i in known, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "bag long, known boolean, vector map<int,double>")
    return [tuple(r) for r in blocks.compared(df, threshold, at_once).collect()]


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs_over_many_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(blocks, "_BLOCK_ENTRIES", 300)
    vectors = some_vectors(seed)
    expected = with_partner(vectors, 0.9)
    assert 20 < len(expected) < len(vectors) - 20
    rows = found(spark, vectors)
    assert {left for left, right in rows if right is None} == expected
    assert all(right is None for _, right in rows)


def test_every_cut_of_rows_and_columns(monkeypatch):
    monkeypatch.setattr(blocks, "_ROWS", 16)
    monkeypatch.setattr(blocks, "_COLUMNS", 24)
    monkeypatch.setattr(blocks, "_GROUPS", 8)
    vectors = some_vectors(5)

    def block(own):
        ranks = [r for i in own for r in vectors[i]]
        weights = [w for i in own for w in vectors[i].values()]
        at = np.concatenate(([0], np.cumsum([len(vectors[i]) for i in own])))
        return blocks._Block(np.array(own), np.zeros(len(own), bool), at, np.array(ranks, "i4"), np.array(weights, "f4"))

    a, b = block(range(100)), block(range(100, len(vectors)))
    for pair in ((a, a), (b, b), (a, b)):
        assert not [batch for batch in blocks._compared(*pair, 0.9, 7) if batch.column("right").null_count < batch.num_rows]
    flagged = {*a.bag[a.known].tolist(), *b.bag[b.known].tolist()}
    assert flagged == with_partner(vectors, 0.9)


def test_known_vectors_serve_as_partners_and_are_not_listed(spark):
    vectors = [unit({1: 1.0, 2: 1.0}), unit({1: 1.0, 2: 1.1}), unit({3: 1.0})]
    assert found(spark, vectors, known={0, 2}) == [(1, None)]
    assert found(spark, vectors, known={0, 1, 2}) == []


def test_a_cosine_at_the_threshold_is_left_to_the_full_check(spark):
    """Single precision cannot tell; the pair itself comes out."""
    vectors = [unit({1: 1.0}), {1: 0.9, 2: 0.19**0.5}]
    assert [set(r) for r in found(spark, vectors)] == [{0, 1}]


def test_no_vectors(spark):
    assert found(spark, []) == []


def test_pairs_below_the_threshold_leave_no_rows(spark):
    """Texts that all share rare words were pairs in a shuffle before; only vectors move now, once per other block."""
    docs = spark.range(400).select(
        F.col("id").cast("string").alias("review_id"),
        F.concat_ws(" ", F.lit("the same three"), F.hex(F.xxhash64("id")), F.hex(F.xxhash64("id", F.lit(1)))).alias("review_text"),
    )
    bags = similarity.collapse_bags(similarity.document_vectors(docs, "review_id", "review_text"), "review_id")
    found = blocks.compared(bags.withColumn("known", F.lit(False)), similarity.THRESHOLD, 1000)
    assert found.count() == 0
    assert similarity.near_duplicate_ids(docs).count() == 0


def test_blocks_are_stored_once_and_not_shuffled(spark, monkeypatch):
    """Every block was shuffled once per other block, so the disk in use grew with the square of the vectors."""
    monkeypatch.setattr(blocks, "_BLOCK_ENTRIES", 300)
    rows = [(i, False, v) for i, v in enumerate(some_vectors(3))]
    df = spark.createDataFrame(rows, "bag long, known boolean, vector map<int,double>")
    found = blocks.compared(df, 0.9, 50)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() > 6
    assert {r.left for r in found.collect()} == with_partner([v for _, _, v in rows], 0.9)


def test_partners_share_the_terms_that_are_needed():
    vectors = some_vectors(6)
    at = np.concatenate(([0], np.cumsum([len(v) for v in vectors])))
    ranks, weights = [r for v in vectors for r in v], [w for v in vectors for w in v.values()]
    block = blocks._Block(np.arange(len(vectors)), np.zeros(len(vectors), bool), at, np.array(ranks, "i4"), np.array(weights, "f4"))
    needed = blocks._needed(block, 0.9)
    for i, a in enumerate(vectors):
        heaviest = np.cumsum(sorted((w * w for w in a.values()), reverse=True))
        assert needed[i] == 1 + np.count_nonzero(heaviest < (0.9 - blocks._BOUND_SLACK) ** 2)
        assert all(len(a.keys() & b.keys()) >= needed[i] for b in vectors if cosine(a, b) > 0.9)


@pytest.mark.parametrize("count", [*range(1, 12), 16, 33])
def test_every_two_blocks_meet_once_in_the_rounds(count):
    """Each block has one task in all rounds but the last, which is what makes its file of known vectors safe."""
    rounds = blocks._rounds(count)
    met = [tuple(sorted((i, j))) for meetings in rounds for i, others in meetings for j in others]
    assert sorted(met) == [(i, j) for i in range(count) for j in range(i, count)]
    assert all(sorted(i for i, _ in meetings) == list(range(count)) for meetings in rounds[:-1])


def test_vectors_far_apart_and_known_ones_are_not_compared(monkeypatch):
    """Every pair of two blocks was bounded, whatever the terms of the two and also where a round before had found both."""
    monkeypatch.setattr(blocks, "_ROWS", 16)
    rng = random.Random(4)
    vectors = []
    for number in range(120):
        low = 100 * (number % 3)
        vectors.append(unit({low: 3.0} | {low + rng.randrange(1, 60): rng.uniform(0.5, 1) for _ in range(8)}))
    vectors += [unit({r: w * rng.uniform(0.9, 1.1) for r, w in v.items()}) for v in vectors[:40]]
    at = np.concatenate(([0], np.cumsum([len(v) for v in vectors])))
    ranks, weights = [r for v in vectors for r in v], [w for v in vectors for w in v.values()]
    block = blocks._Block(np.arange(len(vectors)), np.zeros(len(vectors), bool), at, np.array(ranks, "i4"), np.array(weights, "f4"))
    directions = np.zeros((300, 3))
    directions[[0, 100, 200], [0, 1, 2]] = 1
    place = blocks._laid_out(block, directions)
    apart = np.sum((place[:, None] - place[None]) ** 2, axis=2)
    assert all(apart[i, j] <= 2 - 2 * cosine(a, b) + blocks._PLACE_SLACK for i, a in enumerate(vectors) for j, b in enumerate(vectors))
    order, tile = blocks._tiles(np.diff(at), place)
    assert sorted(order) == list(range(len(vectors))) and np.bincount(np.unique(tile, return_inverse=True)[1]).max() <= 16
    alike = blocks._tiles(np.ones(5000, int), np.ones((5000, 2), "f4"))[1]  # vectors of one place fill their tiles
    assert len(np.unique(alike)) <= 2 * 5000 / 16
    rows = [vectors[i] for i in order]
    at = np.concatenate(([0], np.cumsum([len(v) for v in rows])))
    ranks, weights = [r for v in rows for r in v], [w for v in rows for w in v.values()]
    known = np.zeros(len(rows), bool)
    block = blocks._Block(order, known, at, np.array(ranks, "i4"), np.array(weights, "f4"), tile=tile, place=place[order])
    bounded, left = [], blocks._left

    def counted(a, own_rows, b, columns, *others):
        bounded.append(len(own_rows) * len(columns))
        return left(a, own_rows, b, columns, *others)

    monkeypatch.setattr(blocks, "_left", counted)
    list(blocks._compared(block, block, 0.9, 50))
    assert set(order[block.known].tolist()) == with_partner(vectors, 0.9)
    assert 0 < sum(bounded) < len(vectors) ** 2 / 3
    bounded.clear()
    block.known[:] = True
    list(blocks._compared(block, block, 0.9, 50))
    assert not bounded
