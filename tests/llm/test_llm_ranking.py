"""Ranked search against a plain version that scores every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from reviewlens.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_ranking(docs, items, k=10):
    held = [(doc, plain_terms(text)) for doc, text in docs]
    total, length = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(t for _, ts in held for t in set(ts))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    rows = []
    for item, wanted in asked.items():
        scored = []
        for doc, ts in held:
            counts, score = Counter(ts), 0
            for t in wanted & counts.keys():
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + 90 * len(ts) * total // length
                score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, i + 1, row[3], -row[0]) for i, row in enumerate(sorted(scored, key=lambda row: row[:3])[:k])]
    return sorted(rows, key=repr)


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "x1", "Ab", "aB", "日本語"]
    common = rng.zipf(1.4, 20_000) % len(words)
    docs = [(i, " ".join(words[j] for j in common[i * 30 : i * 30 + int(rng.integers(1, 60))])) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " .,- \x7f\n"), (None, "rare w1"), (None, "rare w1"), (503, "rare w1"), (503, "rare w1"), (504, "w1 " * 50_000 + "rare")]
    # Copies: a third of all rows are one text.
    docs += [(1000 + i, "one text that many rows share w3 w4") for i in range(200)]
    items = [(i, " ".join(words[j] for j in rng.integers(0, len(words), 12))) for i in range(20)]
    items += [(30, "rare"), (31, None), (32, ""), (33, "nowhere"), (34, "Ab_aB-ab`AB"), (35, "été Été ÉTÉ"), (36, "share w3")]
    items += [(36, "share w3"), (37, "w1"), (37, "w2"), (None, "rare w9"), (38, " ".join(words * 2))]
    return docs, items


def collected(found):
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(row) for row in found.collect()), key=repr)


@pytest.mark.parametrize("most_terms, cells", [(1 << 18, 1 << 23), (40, 1)])
def test_ranking_equals_scoring_everything(spark, monkeypatch, most_terms, cells):
    monkeypatch.setattr(ranking, "_MOST_TERMS", most_terms)
    monkeypatch.setattr(ranking, "_CELLS", cells)
    docs, items = corpus()
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, score int").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, terms string")
    assert collected(ranking.ranked_documents(df, asked)) == plain_ranking(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert collected(ranking.ranked_documents(docs.where("false"), items)) == []
    assert collected(ranking.ranked_documents(docs, items.where("false"))) == []
    # The only document holds the term, so its weight and score are 0 or more: floor(1000 ln(4 / 3)) = 287.
    assert collected(ranking.ranked_documents(docs, items)) == plain_ranking([(1, "a b")], [(1, "a")])


def test_masks_group_documents_by_the_terms_they_hold():
    rng = np.random.default_rng(3)
    for n_terms in (1, 7, 64, 65, 150):
        held = rng.random((n_terms, 300)) < 0.02
        masks, group = ranking.presence_masks(np.packbits(held, axis=1), 300)
        assert (masks[group] == held.T).all()
        assert len({row.tobytes() for row in masks}) == len(masks)


def test_groups_below_the_bound_are_not_scored():
    rng = np.random.default_rng(4)
    held = rng.random((12, 4000)) < 0.1
    contributions = np.where(held.T, rng.integers(90, 101, (4000, 12)), 0)
    best = ranking.Best(10)
    scored = ranking.search_block(best, np.packbits(held, axis=1), contributions, list(range(4000)))
    order = sorted(range(4000), key=lambda i: (-contributions[i].sum(), i))[:10]
    assert best.rows == [(contributions[i].sum(), i) for i in order]
    assert scored < 400
