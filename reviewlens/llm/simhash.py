"""SimHash near-duplicates with pigeonring filtering.

A text becomes a 64-bit fingerprint. Fingerprints link when they differ in at most ``_BUDGET`` = 2 bits. The
64 bits form a ring of three segments. By the pigeonring principle a linked pair has a segment from which
every chain of consecutive segments stays within its share of the budget: the first differs in
``floor(2/3)`` = 0 bits, the first two together in ``floor(4/3)`` = 1, all three in 2. The join key is
therefore the chain of two segments: one side stores its own, the other asks for its own and for every one
that differs in one bit of the second segment. Some 42 equal bits make a candidate, so chance matches hardly
grow with the corpus, and the full Hamming check follows.

A fingerprint has at most 2,080 others within two bits, so links between distinct fingerprints grow with
their number, not with its square; copies share a fingerprint and never meet in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.components import connected_components
from reviewlens.llm.names import unused
from reviewlens.sources.scratch import materialise

_BUDGET = 2
# First bit and width of each segment of the ring.
_RING = ((0, 22), (22, 21), (43, 21))
_SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles of a text, an unsigned 64-bit number; 0 without words.

    Only A-Z are lower-cased; ASCII white space separates words. Fewer words than a shingle count as one.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words])
    first = np.concatenate(([0], ends[:-1]))
    last = max(1, len(words) - size + 1)
    spans = zip(first[:last].tolist(), (ends[-last:] - 1).tolist(), strict=True)
    hashes = [xxhash.xxh64_intdigest(joined[start:end], _SEED) for start, end in spans]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a block at a time: a very long text needs no long bit table
        block = np.array(hashes[at : at + (1 << 14)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _with_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = np.array([fingerprint(text) for text in batch.column("text").to_pylist()], dtype=np.uint64)
        kept = batch.drop_columns(["text"])
        yield kept.append_column("fp", pa.array(signed.view(np.int64)))


def fingerprints(df: DataFrame, keys: list[Column], text: str = "text") -> DataFrame:
    """The given key columns and ``fp``, the fingerprint as a signed long. Texts leave the plan here."""
    narrow = df.select(*keys, F.col(text).alias("text"))
    schema = narrow.drop("text").schema.add("fp", "long")
    return narrow.mapInArrow(_with_fingerprints, schema)


def _segment(fp: Column, segment: tuple[int, int]) -> Column:
    start, width = segment
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _chains(own: bool) -> Column:
    """Keys of the two-segment chains of ``fp``: the stored ones, or the ones to ask for."""
    keys = []
    for i, here in enumerate(_RING):
        after = _RING[(i + 1) % len(_RING)]
        second = _segment(F.col("fp"), after)
        # 2 bits for the start of the chain, 22 and 22 for its segments.
        head = F.shiftleft(F.lit(i).cast("long"), 44).bitwiseOR(F.shiftleft(_segment(F.col("fp"), here), 22))
        keys.append(head.bitwiseOR(second))
        if not own:
            keys += [head.bitwiseOR(second.bitwiseXOR(F.lit(1 << bit))) for bit in range(after[1])]
    return F.explode(F.array(*keys))


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """``(a, b)``, a > b: every pair of different values in ``fp`` that differ in two bits or fewer."""
    stored = distinct.select(_chains(own=True).alias("chain"), F.col("fp").alias("b"))
    asked = distinct.select(_chains(own=False).alias("chain"), F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= _BUDGET
    return asked.join(stored, "chain").where((F.col("a") > F.col("b")) & near).select("a", "b").distinct()


def components(marked: DataFrame, order: list[str]) -> DataFrame:
    """Component of every fingerprint in ``marked``: ``(fp, head)``.

    ``head`` is the smallest struct of the ``order`` columns in the component; nulls come first.
    """
    heads = materialise(marked.groupBy("fp").agg(F.min(F.struct(*order)).alias("head")), "heads")
    roots = connected_components(linked_fingerprints(heads.select("fp")), "a", "b")
    rooted = heads.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "fp")), "rooted")
    smallest = materialise(rooted.groupBy("root").agg(F.min("head").alias("head")), "smallest")
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "head")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``df``.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest id reachable over links. A null or empty
    text has fingerprint zero and links like any other. Repeated rows come back repeated. A null id counts
    as larger than all others; it is the component's id only where there is no other. Columns beyond the
    two named are not read, whatever their names.
    """
    marked = materialise(fingerprints(df, [F.col(doc_id).alias("doc_id")], text), "fingerprints")
    ordered = marked.select("fp", F.col("doc_id").isNull().alias("missing"), "doc_id")
    heads = materialise(components(ordered, ["missing", "doc_id"]), "components")
    return marked.join(heads, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
    )


def without_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the one with the smallest id stays.

    All columns are kept. Rows with equal id and text count as one row. A null id sorts last.
    """
    key = F.xxhash64(F.col(text), F.length(text), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    marked = materialise(fingerprints(df, [F.col(doc_id).alias("id"), key.alias("digest")], text), "fingerprints")
    ordered = marked.select("fp", F.col("id").isNull().alias("missing"), "id", "digest")
    heads = components(ordered, ["missing", "id", "digest"])
    keepers = materialise(heads.select("head.id", "head.digest").distinct(), "keepers")
    digest = unused(df, "digest")
    keyed = df.withColumn(digest, key)
    same = keyed[doc_id].eqNullSafe(keepers["id"]) & (keyed[digest] == keepers["digest"])
    kept = keyed.join(keepers, same, "left_semi")
    return kept.dropDuplicates([doc_id, digest]).drop(digest)
