"""The near-duplicate stage of the pipeline against all pairs of plain fingerprints; odd tables through every stage."""

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_llm_documents import plain_fingerprint


def plain_kept(rows):
    """Smallest id of each component of fingerprints at two bits or less, comparing everything with everything."""
    marks, root = [plain_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    return sorted(min(d for d in x if d is not None) for x in ids.values() if any(d is not None for d in x))


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(30):
        words = list(rng.choice(vocabulary, 2000))
        texts += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(words).upper()]
    texts += ["", " \n", None, "two words", "Two  WORDS", "one"]
    return [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[3])]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, node long, fp long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, 3) for i, t in rows], SCHEMA)


def test_near_duplicate_stage_equals_all_pairs(spark):
    rows = corpus()
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert got.columns == frame(spark, rows).columns
    kept = sorted(r.doc_id for r in got.collect())
    assert kept == plain_kept(rows) and len(kept) < len(rows) - 60


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (1, ""), (2, "some words " * 40), (2, "some words " * 40), (None, "w " * 100_000)]])
def test_every_stage_takes_odd_tables(spark, rows):
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.agg({"length": "sum"}).first()[0] == (None if not rows else sum(r.length for r in packed.collect()))
