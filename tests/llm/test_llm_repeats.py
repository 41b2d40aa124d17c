"""Removal of repeated strings against a plain version that counts every string."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from reviewlens.llm import repeats


def plain_covered(texts, length):
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    covered = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = True
        covered.append(gone)
    return covered


def plain_report(rows, length=400):
    texts = [(text or "").encode() for _, text in rows]
    out = []
    for (doc, _), t, gone in zip(rows, texts, plain_covered(texts, length), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(length):
    rng = np.random.default_rng(23)
    words = [f"w{i}é" if i % 5 == 0 else f"word{i}" for i in range(500)]

    def prose(n):
        return " ".join(words[int(i)] for i in rng.integers(0, len(words), n))

    passages = [prose(n)[: length + extra] for n, extra in ((200, 0), (200, 1), (200, -1), (200, 37), (400, length))]
    texts = [prose(int(rng.integers(1, 250))) for _ in range(40)]
    for passage in passages:  # the same passage with its own surroundings, at starts and ends too
        texts += [prose(int(rng.integers(0, 60))) + passage + prose(int(rng.integers(0, 60))) for _ in range(6)]
        texts += [passage + prose(30), prose(30) + passage]
    base = prose(400)
    for at in rng.integers(0, len(base), 12):  # near copies
        texts.append(base[: int(at)] + "#" + base[int(at) + 1 :])
    texts += [base] * 4 + ["a" * (length + 1), "b" * length, "c" * (length - 1), "c" * (length - 1), "ab" * length, "abc" * length + "x", "", " ", "\n"]
    texts += [passages[3] + "!" + passages[3], "z" * (3 * length)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (900, None), (900, None), (901, rows[0][1]), (901, rows[0][1]), (None, rows[1][1])]


def frame(spark, rows):
    schema = "doc_id long, text string, core int, kept string, n int, starts int, text_key string"
    return spark.createDataFrame([(*row, 1, "x", 2, 3, "y") for row in rows], schema).repartition(3)


def collected(report):
    assert report.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(row) for row in report.collect()), key=repr)


@pytest.mark.parametrize("length, most", [(400, 4096), (60, 4096), (60, 2)])
def test_report_equals_counting_every_string(spark, monkeypatch, length, most):
    monkeypatch.setattr(repeats, "_MOST", most)
    rows = corpus(length)
    wanted = plain_report(rows, length)
    assert collected(repeats.removal_report(frame(spark, rows), length=length)) == wanted
    assert any(0 < row[2] < row[1] for row in wanted)


def test_smallest_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert collected(repeats.removal_report(docs)) == plain_report(rows)


def test_empty_table_and_kept_bytes(spark):
    rows = corpus(60)
    df = frame(spark, rows)
    assert repeats.removal_report(df.where("false")).count() == 0
    kept = repeats.without_repeats(df, length=60)
    assert kept.columns == [*df.columns, "kept_"]
    got = sorted(((r.doc_id, hashlib.sha256(r.kept_).hexdigest()) for r in kept.collect()), key=repr)
    assert got == sorted(((row[0], row[4]) for row in plain_report(rows, 60)), key=repr)


def test_anchors_are_those_of_every_window(monkeypatch):
    rng = np.random.default_rng(1)
    for chunk in (1 << 16, 7, 64):
        monkeypatch.setattr(repeats, "_CHUNK", chunk)
        finder = repeats.Anchors(20, 5)
        for size in (0, 19, 20, 21, 300):
            text = bytes(rng.integers(97, 100, size, dtype=np.uint8))
            wanted = set()
            for i in range(size - 19):
                hashes = finder._hashes(np.frombuffer(text[i : i + 20], dtype=np.uint8))
                wanted.add(i + int(np.argmin(hashes >> np.uint64(17))))
            assert finder.starts(text).tolist() == sorted(wanted)


def test_rounds_equal_comparing_every_pair():
    rng = np.random.default_rng(9)
    for _ in range(60):
        width, middle = int(rng.integers(0, 12)), int(rng.integers(1, 5))
        n = int(rng.integers(1, 30))
        group = np.sort(rng.integers(0, 4, n))
        left = [bytes(rng.integers(97, 99, int(rng.integers(0, width + 1)) if rng.random() < 0.3 else width, dtype=np.uint8)) for _ in range(n)]
        right = [bytes(rng.integers(97, 99, int(rng.integers(0, width + 1)) if rng.random() < 0.3 else width, dtype=np.uint8)) for _ in range(n)]
        padded = [(b"." * (width - len(a)) + a, b + b"." * (width - len(b))) for a, b in zip(left, right, strict=True)]
        wanted = set()
        for i in range(n):
            for t in range(width - len(left[i]), len(right[i]) + 1):
                for j in range(n):
                    if i != j and group[i] == group[j] and padded[i][0][t:] == padded[j][0][t:] and padded[i][1][:t] == padded[j][1][:t]:
                        wanted.add((i, t))
        runs = repeats.repeated_windows(group, left, right, width, middle)
        assert {(i, t) for i, a, b in runs for t in range(a, b + 1)} == wanted
