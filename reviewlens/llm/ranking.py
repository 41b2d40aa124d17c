"""Ranked lexical search by presence masks.

Every item of a query set is ranked against every document. Documents are taken in blocks: a bitmap per term
says which documents of the block hold it, the bitmaps of an item's terms are read across into one mask per
document, and equal masks form a group. A group's score can be no higher than the sum of the block's highest
contributions of the terms in its mask. Groups are scored from the highest such sum downwards until the sum is
below the k-th best score found so far in the task, in this block or an earlier one: no later group can enter
the list. Whole documents are read and none is left out but by that bound.

A term weighs ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and contributes ``w * (10^9 tf div (1000 tf + 8 m))``
with ``m = 10 + 90 n N div L``; all but the logarithm is integer arithmetic.

The query set goes through in parts of some ``_MOST_TERMS`` terms, each part one pass over the documents; the
terms of a part and their weights are all that a task is sent. What a task returns is k rows per item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.sources.scratch import materialise

# Terms of the query set per pass.
_MOST_TERMS = 1 << 18
# Documents of a block, and the largest table of contributions (documents x terms of the part).
_BLOCK, _CELLS = 4096, 1 << 23
# ASCII letters and digits and all of UTF-8 beyond ASCII make terms; A-Z become a-z, the rest blanks.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order; none for null."""
    return (text or b"").translate(_TERM_BYTES).split()


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [sorted(set(terms(text))) for text in _texts(batch)]
        yield batch.drop_columns(["text"]).append_column("terms", pa.array(held, pa.list_(pa.binary())))


def _counted(vocabulary: dict[bytes, int]) -> Callable:
    """Length of every document, and number and frequency of the vocabulary's terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers, times = [], [], []
            for text in _texts(batch):
                found = terms(text)
                counts = Counter(found)
                hits = sorted((vocabulary[term], counts[term]) for term in vocabulary.keys() & counts.keys())
                sizes.append(len(found))
                numbers.append([number for number, _ in hits])
                times.append([tf for _, tf in hits])
            made = batch.drop_columns(["text"])
            made = made.append_column("n", pa.array(sizes, pa.int64()))
            made = made.append_column("terms", pa.array(numbers, pa.list_(pa.int32())))
            yield made.append_column("tfs", pa.array(times, pa.list_(pa.int64())))

    return run


def presence_masks(bitmaps: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Group ``width`` documents by mask: the distinct masks (a row of booleans per mask) and each document's group.

    ``bitmaps`` has a row of packed bits per term, a bit per document.
    """
    held = np.unpackbits(bitmaps, axis=1, count=width)
    packed = np.packbits(held, axis=0).T
    padded = np.zeros((width, -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : packed.shape[1]] = packed
    words = padded.view(np.uint64)
    if words.shape[1] == 1:
        distinct, group = np.unique(words[:, 0], return_inverse=True)
        distinct = distinct[:, None]
    else:
        distinct, group = np.unique(words, axis=0, return_inverse=True)
    masks = np.unpackbits(np.ascontiguousarray(distinct).view(np.uint8), axis=1, count=len(bitmaps)).astype(bool)
    return masks, group.reshape(-1)


class Best:
    """The ``k`` best ``(score, doc_id)`` seen so far: higher scores first, then smaller ids, a null id last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """The score that a further document has to reach."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        reached = np.flatnonzero(scores >= self.floor)
        if len(reached):
            rows = self.rows + [(int(scores[i]), ids[i]) for i in reached]
            self.rows = sorted(rows, key=lambda row: (-row[0], row[1] is None, row[1] or 0))[: self.k]


def search_block(best: Best, bitmaps: np.ndarray, contributions: np.ndarray, ids: list) -> int:
    """Rank one block's documents for one item; returns how many documents were scored.

    ``bitmaps`` and the columns of ``contributions`` (weights included) belong to the item's terms.
    """
    if not len(bitmaps):
        return 0
    masks, group = presence_masks(bitmaps, len(ids))
    bounds = masks @ contributions.max(axis=0)
    order = np.argsort(-bounds, kind="stable")
    members = np.argsort(group, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(masks)))))
    at, step, scored = 0, 16, 0
    while at < len(order) and bounds[order[at]] >= best.floor:
        taken = order[at : at + step]
        taken = taken[bounds[taken] >= best.floor]
        rows = np.concatenate([members[starts[g] : starts[g + 1]] for g in taken])
        best.add(contributions[rows].sum(axis=1), [ids[i] for i in rows])
        scored += len(rows)
        at, step = at + step, step * 2
    return scored


def _ranked(items: list[np.ndarray], weights: np.ndarray, total: int, length: int, k: int) -> Callable:
    """Best documents of a task for every item (an array of term numbers)."""
    width = max(64, min(_BLOCK, _CELLS // max(1, len(weights))))

    def rank(bests: list[Best], ids: list, sizes: list[int], numbers: list[list[int]], times: list[list[int]]) -> None:
        rows = np.repeat(np.arange(len(ids)), [len(x) for x in numbers])
        columns = np.array([t for held in numbers for t in held], dtype=np.int64)
        tfs = np.array([t for held in times for t in held], dtype=np.int64)
        m = np.array([10 + 90 * n * total // length for n in sizes], dtype=np.int64)[rows]
        contributions = np.zeros((len(ids), len(weights)), dtype=np.int64)
        contributions[rows, columns] = weights[columns] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))
        present = np.zeros((len(weights), len(ids)), dtype=bool)
        present[columns, rows] = True
        bitmaps = np.packbits(present, axis=1)
        for best, own in zip(bests, items, strict=True):
            search_block(best, bitmaps[own], contributions[:, own], ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(k) for _ in items]
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width).to_pydict()
                rank(bests, part["doc_id"], part["n"], part["terms"], part["tfs"])
        found = [{"item": i, "doc_id": doc, "score": score} for i, best in enumerate(bests) for score, doc in best.rows]
        yield pa.RecordBatch.from_pylist(found, pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return run


def _search_part(spark, docs: DataFrame, rows: list, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the best documents of every task for the items of one part, by their place in ``rows``."""
    vocabulary = {term: number for number, term in enumerate(sorted({bytes(t) for row in rows for t in row.terms}))}
    schema = "doc_id long, n long, terms array<int>, tfs array<long>"
    postings = materialise(docs.mapInArrow(_counted(vocabulary), schema), "postings")
    sizes = postings.where("n > 0").agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("length")).first()
    total, length = sizes.total, sizes.length or 1
    # One row per term of the part: bounded as the vocabulary is.
    holders = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for row in holders:
        weights[row.term] = math.floor(1000 * math.log((2 * total + 2) / (2 * row["count"] + 1)))
    items = [np.array(sorted(vocabulary[bytes(t)] for t in row.terms), dtype=np.int64) for row in rows]
    return postings.where("size(terms) > 0").mapInArrow(_ranked(items, weights, total, length, k), "item int, doc_id long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item, all if fewer score above 0.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; further columns are not read.
    Null and empty texts hold no term. Equal scores rank by ascending ``doc_id``, a null id last; repeated rows
    of ``docs`` are documents of their own. Rows of ``items`` with one id, repeated or not, are one item with the
    terms of them all; so are rows with a null id. An item without a match has no row; an empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    queries = items.select("item_id", F.col("text").alias("text"))
    item_type = queries.schema["item_id"].dataType.simpleString()
    held = queries.mapInArrow(_item_terms, f"item_id {item_type}, terms array<binary>")
    held = held.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    held = materialise(held.where("size(terms) > 0"), "items")
    parts = -(-(held.agg(F.sum(F.size("terms"))).first()[0] or 0) // _MOST_TERMS)
    found = None
    for part in range(parts):
        # Some _MOST_TERMS terms.
        rows = held.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        if not rows:
            continue
        named = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(rows)], f"item int, item_id {item_type}")
        best = _search_part(spark, docs, rows, k).join(named, "item").select("item_id", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return held.selectExpr("item_id", "0 as rank", "0L as doc_id", "0L as score").where("false")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked_sql(k: int = 10) -> str:
    """The same ranking in SQL over ``documents`` and ``benchmark``, by plain joins."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{pattern}')"
    return f"""
with docs as (select row_number() over () as node, doc_id, {split} as ts from documents),
corpus as (select count(*) as total, cast(sum(len(ts)) as bigint) as length from docs where len(ts) > 0),
counted as (select node, term, count(*) as tf from (select node, unnest(ts) as term from docs) group by node, term),
weighted as (select term, cast(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) as bigint) as w
             from counted, corpus group by term, total),
queries as (select distinct item_id, term from (select item_id, unnest({split}) as term from benchmark)),
scored as (
  select item_id, node, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * total) // length)))) as bigint) as score
  from queries join weighted using (term) join counted using (term) join docs using (node), corpus group by item_id, node),
ranked as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id asc nulls last) as rank
  from scored join docs using (node) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= {k}"""
