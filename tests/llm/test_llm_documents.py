"""Operators on documents against plain versions, with odd rows: nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from check import normal
from reviewlens.llm import components, mixing, pii, quality, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, digest string, n_words int, `size` int"


def rows_of(small):
    db = duckdb.connect()
    return db.execute(f"select doc_id, text, lang, source, n_chars from '{small}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def documents(spark, small):
    """The smallest table with odd rows and clashing columns."""
    rows = [(*row, "x", "y", 1, 2) for row in rows_of(small)]
    known = rows[3][1]
    odd = [
        (1000, None, None, None, None),
        (1001, "", "en", None, 0),
        (1002, " \n\t ", None, "src1", 4),
        (None, known, "en", "src1", 1),
        (1003, known, "en", "src2", 1),
        (1003, known, "en", "src2", 1),
        (1004, "word " * 40_000, "en", "", 200_000),
        (1005, "A\x0bb\x1cc\x85d   e" * 5, "en", "src1", 9),
        (1006, "ten words " * 8 + "mail a.b@c.de.f, 1.2.3.4.5 and +1 (234) 567-89", "en", "src3", 9),
    ]
    return spark.createDataFrame(rows + [(*row, None, None, None, None) for row in odd], SCHEMA)


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.where("false")


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_quality_statistics_and_base_rules(documents):
    got = quality.quality_report(documents).join(documents.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == documents.where("doc_id is not null").count()
    for row in got:
        n = plain_statistics(row.text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == n
        assert row.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (row.base_failed and row.kept)


def test_quality_estimates_find_planted_outliers(spark):
    rng = np.random.default_rng(3)
    rows = [
        (i, int(n), int(n * rng.normal(5, 0.2)), 0, 0, 0, "en", "hot" if i % 3 else "rare")
        for i, n in enumerate(rng.integers(150, 400, 900))
    ]
    rows += [(1000 + i, 200, 4000, 900, 0, 0, "en", "hot") for i in range(60)]
    table = spark.createDataFrame(
        rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, source string"
    )
    got = quality.judged(table, quality.fit(table)).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(1000, 1060))
    # The distance against numpy, with the final estimate.
    estimate = {r.group: r.p for r in quality.fit(table).collect()}
    row = got[0]
    p = next(p for g, p in estimate.items() if row.source in g)
    inverse = np.zeros((5, 5))
    inverse[np.tril_indices(5)] = p.inverse
    x = np.round(256 * np.log([1 + row.n_words, (row.word_chars + 1) / (row.n_words + 1), 1, 1, 1])) / 256
    assert row.distance == pytest.approx(((inverse @ (x - np.array(p.mean))) ** 2).sum(), rel=1e-6)
    assert quality._chi2_cdf(quality._chi2_quantile(0.975, 5), 5) == pytest.approx(0.975)
    assert quality._chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)


def test_quality_rejects_outliers_in_one_statistic_and_keeps_clean_rows(spark):
    rng = np.random.default_rng(4)
    lengths = rng.normal(6, 0.2, 3000)
    rows = [(i, int(np.exp(x)), int(np.exp(x) * 5 * np.exp(rng.normal(0, 0.06))), 0, 0, 0) for i, x in enumerate(lengths)]
    # Ordinary rows with a single symbol, repeated line or passage.
    clean = [(5000, 400, 2000, 1, 0, 0), (5001, 400, 2000, 0, 1, 0), (5002, 400, 2000, 0, 0, 16), (5003, 400, 2000, 0, 1, 16)]
    planted = [(9000, 400, 4000, 0, 0, 0), (9001, 400, 2000, 40, 0, 0), (9002, 400, 2000, 0, 12, 0), (9003, 400, 2000, 0, 0, 110)]
    planted += [(9004, 40, 200, 0, 0, 0), (9005, 4000, 20000, 0, 0, 0)]
    table = spark.createDataFrame(
        [(*r, "en", "src") for r in rows + clean + planted],
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, source string",
    )
    gone = {r.doc_id for r in quality.judged(table, quality.fit(table)).collect() if not r.kept}
    assert {r[0] for r in planted} <= gone and not gone & {r[0] for r in clean}
    assert len(gone) - len(planted) <= 3


def test_quality_filter_keeps_columns_and_empty_tables(documents, nothing):
    kept = quality.quality_filtered(documents)
    assert kept.columns == documents.columns
    verdicts = {(r.doc_id): r.kept for r in quality.quality_report(documents).collect()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in documents.collect() if verdicts[r.doc_id])
    assert quality.quality_report(nothing).count() == 0 and quality.quality_filtered(nothing).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Component ids by comparing everything with everything."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_equals_brute_force(documents, nothing):
    rows = documents.collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    expected = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(prints, plain_components(prints), strict=True))
    got = simhash.near_duplicates(documents)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == expected
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.without_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({int(c) for _, _, c in expected})


def test_pigeonring_keys_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    near = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))} | set(base)
    far = {b ^ 0b111 for b in base}
    values = sorted(near | far)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    got = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    expected = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {frozenset((r.a, r.b)) for r in got} == expected and len(got) == len(expected)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, x) for x in range(200, 260)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    expected = {i: 100 for i in range(100, 141)} | {x: 5 for x in [5, *range(200, 260)]} | {8: 8, 9: 8}
    assert got == expected
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_entities(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    out += [("ip", *m.span()) for m in ips if all(int(p) <= 255 for p in m[0].split("."))]
    cards = [(m, re.sub("[ -]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out += [("card", *m.span()) for m, d in cards if 16 <= len(d) <= 19 and luhn(d)]
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    return out + [("phone", *m.span()) for m in phones if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


ODD_TEXTS = [
    "a@b.c@d.e f", "@x.y", "a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.01", "+1 (2) 345678 9-", "4111 1111 1111 1111 1",
    "0000000000000000", "a@b..c a.b+@x-.y-z.", "..@a.b", "é@x.com", "4111-1111-1111-1111 ++1 234 56789", "1" * 5000, "😀 a@b.co", "",
]


@pytest.mark.parametrize("text", [*ODD_TEXTS, None])
def test_entities_equal_the_patterns(text):
    assert pii.find_entities(text) == plain_entities(text)


def test_pii_report(documents, nothing):
    report = pii.pii_report(documents).collect()
    texts = Counter((r.doc_id, pii.joined(plain_entities(r.text))) for r in documents.collect())
    assert len(report) == documents.count()
    for row in report:
        base = ",".join(s for s in row.spans.split(",") if s and not s.startswith("term"))
        assert texts[(row.doc_id, base)] and row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert row.n_email + row.n_ip + row.n_card + row.n_phone == len(base.split(",")) * bool(base)
    assert pii.pii_report(nothing).count() == 0 and pii.sanitised(nothing).count() == 0


def test_terms_that_reveal_an_entity_go_everywhere(spark):
    fill = ["alpha beta", "gamma delta", "epsilon zeta", "eta theta", "iota kappa", "lambda sigma"]
    rows = [(i, f"{fill[i]} reach Zorblatt via z@mail.org {fill[-i]} today {i} {fill[(i * 2) % 6]}") for i in range(6)]
    rows += [(10 + i, f"reach {fill[i % 6]} via today or never") for i in range(200)]
    rows += [(500, "only Zorblatt stands here"), (501, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    spans = {r.doc_id: r.spans for r in pii.pii_report(df).collect()}
    assert spans[500] == "term-email:5:13" and spans[501] == "" and spans[10] == ""
    clean = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert clean[500].text == "only [TERM-EMAIL] stands here" and clean[500].n_chars == len(clean[500].text)
    assert "z@mail.org" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[501].text is None
    assert clean[10].text == rows[6][1]


def test_copies_of_a_context_count_once(spark):
    df = spark.createDataFrame([(i, "call Quux at q@mail.org now") for i in range(50)] + [(99, "Quux")], "doc_id long, text string")
    assert {r.spans for r in pii.pii_report(df).collect()} == {"email:13:23", ""}


def test_copies_of_a_page_do_not_hide_a_revealing_term(spark):
    fill = ["alpha beta", "gamma delta", "epsilon zeta", "eta theta", "iota kappa", "lambda sigma"]
    rows = [(i, f"{fill[i]} reach Zorblatt via z@mail.org {fill[-i]} today {i} {fill[(i * 2) % 6]}") for i in range(6)]
    rows += [(10 + i, f"number {i} {fill[i % 6]} via today or reach never") for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(1000)] + [(5000, "only Zorblatt stands here")]
    spans = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(spans) == len(rows) and spans[5000] == "term-email:5:13" and spans[10] == ""


def test_shards_are_whole_gapless_and_move_only_to_the_new_one(documents, nothing):
    rows = sharding.assign_shards(documents, sharding.HashTree.even(40)).collect()
    assert len(rows) == documents.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    import zlib

    assert all((r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id])) for r in rows)
    assert sharding.assign_shards(nothing, sharding.HashTree.even(40)).count() == 0


def test_one_id_is_many_parts_and_slots_stay_gapless(spark):
    rows = [(1, f"text {i}") for i in range(3000)] + [(None, "same")] * 500 + [(i, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit(1), "size": F.lit(2), "slot": F.lit("z")})
    got = sharding.assign_shards(df, sharding.HashTree.even(40)).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.doc_id == 1}) == 1
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_weights_decide_and_confine_movement(spark):
    ids = spark.range(20000)
    tree = sharding.HashTree((({0: 1.0, 1: 3.0}, {2: 2.0}), ({3: 2.0, 4: 0.0},)))
    heavier = sharding.HashTree((({0: 1.0, 1: 5.0}, {2: 2.0}), ({3: 2.0, 4: 0.0},)))
    moved = ids.select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b"))
    counts = {(r.a, r.b): r["count"] for r in moved.groupBy("a", "b").count().collect()}
    share = Counter()
    for (a, _), n in counts.items():
        share[a] += n / 20000
    assert share == pytest.approx({0: 0.125, 1: 0.375, 2: 0.25, 3: 0.25}, abs=0.02)
    # Only into the heavier rack's region, and inside a rack only to the heavier shard.
    assert all(a == b or b in (0, 1, 2) for a, b in counts) and (1, 0) not in counts and (2, 3) not in counts


def test_shards_are_written_whole(documents, tmp_path, spark):
    sharding.write_shards(documents, sharding.HashTree.even(4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents.count()


def best_segments(gains):
    """All maximal segments from their definition: the best one, then the same to its left and right."""
    if not gains or max(gains) <= 0:
        return []
    total = np.concatenate(([0], np.cumsum(gains)))
    spans = [(total[b] - total[a], -(b - a), -a, a, b) for a in range(len(gains)) for b in range(a + 1, len(gains) + 1)]
    score, _, _, a, b = max(spans)
    left = [(s, x, y) for s, x, y in best_segments(gains[:a])]
    right = [(s, x + b, y + b) for s, x, y in best_segments(gains[b:])]
    return [*left, (score, a, b), *right]


@pytest.mark.parametrize("seed", range(20))
def test_segments_equal_their_definition(seed):
    gains = np.random.default_rng(seed).normal(-0.2, 1, 24)
    got = toxicity.segments(gains)
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in best_segments(gains.tolist())]


def test_toxicity_on_held_out_rows(spark, documents, nothing):
    rng = np.random.default_rng(1)
    words, bad = [f"w{i}" for i in range(300)], ["vile", "rotten", "awful"]
    rows, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, 60))
        if i % 5 == 0:
            text[20:20] = list(rng.choice(bad, 6))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(df, marks).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.98 * len(held)
    spans = [(rows[r.doc_id][1][p.start : p.end]) for r in held for p in r.passages]
    assert spans and all(any(w in span for w in bad) for span in spans)
    # Labels of held-out rows make no difference.
    import zlib

    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    again = toxicity.toxicity(df, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}
    odd = toxicity.toxicity(documents, marks).collect()
    assert len(odd) == documents.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.toxicity(nothing, marks.where("false")).count() == 0
    assert {r.predicted for r in toxicity.toxicity(df, marks.where("false")).collect()} == {0}


def test_mixture_equals_sql(spark, documents, nothing):
    db = duckdb.connect()
    frame = documents.select("doc_id", "text", "source").toPandas()
    db.register("documents", frame.astype({"doc_id": "Int64"}))
    cursor = db.execute(mixing.mixture_sql())
    theirs = normal([d[0] for d in cursor.description], cursor.fetchall())
    got = mixing.mixture_plan(documents)
    plan = got.drop("copies")
    rows = [tuple(r) for r in plan.collect()]
    assert Counter(normal(plan.columns, rows)[1]).keys() == Counter(theirs[1]).keys() and len(rows) == documents.count()
    assert mixing.mixed(documents).count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.mixed(documents).columns == documents.columns
    assert mixing.mixture_plan(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_rows_of_one_id_draw_apart(spark):
    rows = [(7 if i % 3 == 0 else i, "word " * (1 + i % 20) + f"w{i}", "a" if i % 2 else "b") for i in range(6000)]
    rows += [(7, f"text number {i} of the only id", "c") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mixture_plan(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 0.02 * r.target


def test_targets_by_repeated_sharing(spark):
    sizes = {"a": 10, "b": 500, "c": 40, "d": 0, None: 900, "e": 3}
    table = spark.createDataFrame([(str(s), s, n) for s, n in sizes.items()], "key string, source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    weights = dict(zip(sorted(k for k in sizes if k) + [None], [5, 2, 1] * 2, strict=True))
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        sharing = sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and left * weights[s] / sharing > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({s: 3 * sizes[s] if s in capped else left * weights[s] / sharing for s in sizes})
