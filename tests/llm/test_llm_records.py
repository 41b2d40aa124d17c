"""Archives, conversations, packing, vectors and the pipeline against plain versions and round trips."""

import base64
import gzip
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reviewlens.llm import chat, hnsw, packing, queries, vectors, warc


def test_url_keys():
    assert warc.url_key("https://m.Site.org:443/a?b=1#c") == "org,site,m)/a?b=1"
    assert warc.url_key("http://u:p@a.b:99") == "b,a:99)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad" and "\n" not in warc.url_key("x y\n")


def test_archives_round_trip(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    odd = [(1000, "http://x/ y\r\nz", None), (1001, None, ""), (1001, None, ""), (None, "http://[bad", "é\r\n\r\nWARC/1.1"),
           (-5, "", "é\r\n\r\nWARC/1.1"), (2000, "http://a.b:99/", pages.first().html), (2001, "u", "x" * 300_000)]
    pages = pages.union(spark.createDataFrame(odd, pages.schema)).withColumn("sha1", F.lit("clash")).withColumn("first", F.lit(1))
    rows, groups = pages.collect(), {}
    for row in rows:
        groups.setdefault((row.html or "").encode(), []).append(row.page_id)
    expected = []
    for row in rows:
        payload = (row.html or "").encode()
        first = min(p for p in groups[payload] if p is not None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = row.page_id != first
        expected.append((str(row.page_id), len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    got = warc.archived_pages(pages).collect()
    assert Counter((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(expected)
    assert warc.archived_pages(pages.where("false")).count() == 0
    big = [r.record_type for r in warc.archived_pages(pages, least_bytes=100).collect() if r.payload_bytes < 100]
    assert big and set(big) == {"response"}


def test_index_finds_all_captures_of_a_url_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "_BLOCK_ROWS", 7)
    pages = spark.range(100).selectExpr("id as page_id", "concat('http://h', id % 3, '.org/p') as url", "cast(id as string) as html")
    folder = f"file://{tmp_path}"
    captures = warc.write_archives(pages, f"{folder}/a")
    index = warc.build_index(captures, f"{folder}/i")
    wanted = spark.createDataFrame([("https://H1.org/p",), ("http://none.org/",), ("http://h1.org/p",)], "url string")
    found = warc.read_records(warc.look_up(index, wanted), f"{folder}/a", with_payload=True).collect()
    assert sorted(r.page_id for r in found) == [i for i in range(100) if i % 3 == 1]
    assert all(bytes(r.payload).decode() == str(r.page_id) for r in found)
    raw = b"".join(gzip.open(p).read() for p in (tmp_path / "a").iterdir())
    assert raw.count(b"WARC/1.1\r\n") == 100


EVENTS = [
    (1, 1, 1, "message", "user", "hi"),
    (1, 2, 2, "delta", "assistant", "Hel"),
    (1, 2, 3, "delta", None, "lo"),
    (1, 1, 4, "edit", None, "hi there"),
    (1, 2, 5, "regenerate", None, None),
    (1, 2, 6, "delta", None, "Good "),
    (1, 2, 7, "delta", None, "day"),
    (1, 2, 8, "seen", None, "ignored"),
    (2, 9, None, "message", None, None),
]


def test_events_fold_into_messages(spark):
    got = chat.reconstruct(spark.createDataFrame(EVENTS[::-1], chat.EVENTS)).collect()
    assert sorted((r.conv_id, r.message_id, r.seq, r.role, r.text) for r in got if r.seq) == [
        (1, 1, 1, "user", "hi there"),
        (1, 2, 2, "assistant", "Good day"),
    ]
    assert [(r.role, r.text) for r in got if r.conv_id == 2] == [(None, "")]


@pytest.fixture(scope="module")
def turns(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    odd = [(-8, 0, None, None), (-8, 1, "we:ird: @ ### \\ role\n", "<\\/turn></turn>###\\ #### x\\"), (-8, 1, "assistant", ""),
           (-8, None, "User", "u"), (-9, 2, "assistant", "a"), (-9, 2, "assistant", "a"), (None, 1, "assistant", "😀\\</turn>" * 50),
           (-10, 1, "", "x"), (-10, 2, "assistant", "long " * 20_000), (-10, 3, "tool", "\\" * 7)]
    return table.union(spark.createDataFrame(odd, table.schema))


def test_chat_round_trip(turns):
    rendered = chat.render(chat.reconstruct(chat.turn_events(turns)))
    got = {r.conv_id: r for r in chat.chat_digests(rendered).collect()}
    formatted = {r.conv_id: r for r in rendered.collect()}
    groups = {}
    for row in turns.collect():
        groups.setdefault(row.conv_id, []).append(row)
    assert set(groups) == set(got)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
        whole = "".join(f"{r.role or ''}\n{r.text or ''}\n" for r in rows)
        learned = "".join(r.text or "" for r in rows if r.role == "assistant")
        row, shown = got[conv], formatted[conv]
        assert (row.n_turns, row.turns_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert row.formatted_chars == len(shown.formatted) and shown.formatted.count("</turn>") == len(rows)
        masked = "".join(shown.formatted[s.start : s.end] for s in shown.loss_spans)
        for plain, marked in (("### ", "###\\ "), ("</turn>", "<\\/turn>"), ("\\", "\\\\")):
            masked = masked.replace(marked, plain)
        assert masked == learned
    assert chat.chat_digests(chat.render(chat.reconstruct(chat.turn_events(turns.where("false"))))).count() == 0


def test_native_plans(spark, small):
    for name in ("op2_quality_rules", "op3_chat_format"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


TEXTS = ["a  b", "a \n b", "\n x", "x \t y", "it's  don't", "", "  ", " a", "a ", "\x1c x \x1c", "a b c", "<|endoftext|> hi <|endoftext|>",
         "日本 語　x y", "a\n\nb c\n d", "x" * 3000, "1 22 333", None]


def test_fast_encoding_equals_tokenizers(spark, small):
    encode, plain = packing.Encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    for text in TEXTS[:-1] + texts:
        assert np.frombuffer(encode(text), encode.width).tolist() == plain.encode(text, add_special_tokens=False).ids


def check_packing(spark, rows, window=2048, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("part", F.lit("clash")).repartition(3)
    got = packing.packed(df, window=window, with_ids=True, **options).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    coded = {t: plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t, _ in rows}
    sequences, held = {}, Counter()
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length
        held[(r.doc_id, r.doc_tokens)] += r.length
    for number, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0), number
    expected = Counter()
    for d, t, _ in rows:
        expected[(d, len(coded[t]))] += len(coded[t])
    assert held == expected
    return got, coded


def test_packing_places_every_token_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(80).collect()
    rows = [(d.doc_id, d.text, d.source) for d in docs] + [(900 + i, t, None if i % 2 else "s") for i, t in enumerate(TEXTS)]
    got, coded = check_packing(spark, rows)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.ids))
    for doc, text, _ in rows:
        assert [i for _, ids in sorted(by_doc[doc]) for i in ids] == coded[text]
    check_packing(spark, [(1, "same", "a"), (1, "same", "a"), (None, None, None), (None, "x", None)], window=4, quantum=2)
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_windows_hold_the_mixture(spark):
    rows = [(i, "one two three four five six seven eight " * 20, "abcd"[min(3, i % 10)]) for i in range(400)]
    got, _ = check_packing(spark, rows, window=512, quantum=32)
    source = {i: s for i, _, s in rows}
    shares = Counter()
    for i, _, s in rows:
        shares[s] += 0.0025
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, Counter())[source[r.doc_id]] += r.length
    due, had = Counter(), Counter()
    for number in sorted(windows):
        if sum(windows[number].values()) < 512:
            continue
        for s, share in shares.items():
            due[s] += 512 * share
            had[s] += windows[number][s]
            assert abs(due[s] - had[s]) <= 3 * 32


def test_windows_hold_target_proportions_until_a_queue_is_empty(spark):
    rows = [(i, "one two three four five six seven eight " * 20, ["a", "b", None, "d"][i % 4]) for i in range(400)]
    targets = {"a": 0.5, "b": 0.2, None: 0.1, "absent": 0.01}
    got, coded = check_packing(spark, rows, window=512, quantum=32, targets=targets)
    source = {i: s for i, _, s in rows}
    shares = {"a": 0.5, "b": 0.2, None: 0.1, "d": 0.2}
    left = Counter()
    for _, t, s in rows:
        left[s] += len(coded[t])
    windows, due, had, seen = {}, Counter(), Counter(), 0
    for r in got:
        windows.setdefault(r.sequence_id, Counter())[source[r.doc_id]] += r.length
    for number in sorted(windows):
        had.update(windows[number])
        if any(had[s] >= left[s] for s in shares):
            break
        seen += 1
        for s, share in shares.items():
            due[s] += 512 * share
            assert abs(due[s] - had[s]) <= 3 * 32, (number, s)
    assert seen > 40 and had["a"] >= left["a"] and windows[number + 5]["a"] == 0


@pytest.mark.parametrize("targets", [{"a": 0.0}, {"a": 0.7, "b": 0.4}, {"a": -0.1}])
def test_targets_have_to_be_proportions(spark, targets):
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string"), targets=targets)


def test_queues_beyond_the_most_share_one(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 3)
    check_packing(spark, [(i, "some words here " * (1 + i % 7), f"s{i % 9}") for i in range(90)], window=64, quantum=8)


def test_each_of_many_sources_keeps_its_share(spark):
    """3,000 sources, three times as many as there are queues of their own; one holds a third of all rows."""
    rows = [(i, "one two three four " * (1 + i % 5), f"s{i // 3}") for i in range(9000)]
    rows += [(9000 + i, "one two three four " * 3, "hot") for i in range(4500)]
    got, coded = check_packing(spark, rows, window=4096, quantum=8)
    source, size = {i: s for i, _, s in rows}, Counter()
    for _, t, s in rows:
        size[s] += len(coded[t])
    total = sum(size.values())
    windows, had = {}, Counter()
    for r in got:
        windows.setdefault(r.sequence_id, Counter())[source[r.doc_id]] += r.length
    for number in sorted(windows):
        had.update(windows[number])
        seen = sum(had.values())
        off = {s: abs(seen * n / total - had[s]) for s, n in size.items()}
        # What thousands of roundings leave falls on the large source: under 2 % of a window.
        assert off.pop("hot") <= 10 * 8 and max(off.values()) <= 2 * 8, number
    assert len(windows) > 30


def plain_vectors(rows, threshold=0.98):
    fit = [i for i, r in enumerate(rows) if r.label is not None and r.embedding and None not in r.embedding
           and np.isfinite(r.embedding).all() and any(r.embedding)]
    links = {i: set() for i in range(len(rows))}
    for i in fit:
        for j in fit:
            if i != j and rows[i].label == rows[j].label and len(rows[i].embedding) == len(rows[j].embedding):
                a, b = np.array(rows[i].embedding, float), np.array(rows[j].embedding, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k].vec_id for k in seen if rows[k].vec_id is not None]
        out.append((row.vec_id, len(links[i]), min(ids, default=None)))
    return out


@pytest.mark.parametrize("shard_rows", [60, 8192])
def test_vectors_equal_brute_force(spark, shard_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.12 * rng.normal(size=16)).astype(np.float32).tolist(), i % 3) for i in range(300)]
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(30)] + [rows[7], rows[7], (None, rows[8][1], rows[8][2])]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, [float("nan")] * 16, 1),
             (505, [float("inf")] * 16, 1), (506, rows[5][1], None), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1), (509, [-0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    expected = plain_vectors(df.collect())
    got = vectors.near_duplicate_vectors(df, shard_rows=shard_rows).collect()
    assert Counter((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == Counter((str(v), n, str(c)) for v, n, c in expected)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_duplicate_vectors(df.where("false")).count() == 0


def test_graph_recall_without_exhaustive_search():
    rng = np.random.default_rng(4)
    points = hnsw._unit(rng.normal(size=(3000, 24)))
    graph = hnsw.Graph.build(points)
    found, _ = graph.search(points[:300].astype(np.float32), 48)
    truth = np.argsort(-(points[:300] @ points.T), axis=1)[:, :5]
    recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.tolist(), truth.tolist(), strict=True)])
    assert recall >= 0.9 and len(graph.layers) > 1
    beam, audited = graph.audited_beam(0.98)
    assert audited >= 0.99 and beam <= hnsw._WIDEST


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small)
        assert after.columns == docs.columns
        before = spark.createDataFrame(after.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, small)
    tokens = Tokenizer.from_file(packing.default_tokenizer())
    expected = sum(len(tokens.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    assert pieces.agg(F.sum("length")).first()[0] == expected
    assert corpus_pipeline.run(spark, small).agg(F.sum("length")).first()[0] == expected
