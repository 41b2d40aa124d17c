"""Near-duplicate texts by TF-IDF cosine, exact and without a row cap.

Two documents are near-duplicates when the cosine of their TF-IDF vectors is above
``threshold``; asked for are the documents that have at least one. The steps:

1. Texts become term numbers and counts in the task that reads them; no text is shuffled, and what is
   stored and moved below are those numbers, from which tasks work out the weights.
2. Documents with the same vocabulary terms and counts have cosine one. They
   collapse to one *bag* (partial aggregation), so copies never meet in pairs.
3. Witnesses: a few signatures per bag; every bag is compared with one
   representative per signature. This costs a constant number of comparisons per
   bag and settles clusters of near copies, however large.
4. The bags left are compared with all bags in pairs of blocks (``operators.blocks``):
   the norms of a vector over groups of terms bound its cosine with any other from
   above, and pairs that the bound leaves get their dot product where they meet. No
   candidate pair is shuffled.
5. Pairs too near the threshold for single precision are checked with the full dot product.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructType

from reviewlens.functions.text import word_tokens
from reviewlens.operators import blocks
from reviewlens.operators.tfidf import smoothed_idf, vocabulary
from reviewlens.sources.scratch import discard, materialise, outcome

THRESHOLD = 0.90
MAX_FEATURES = 10_000

_SALTS = 256  # parts of a hot signature
_HOT_SIGNATURE = 10_000  # bags above which a signature gets one representative per part
_MEMBER_PARTS = 16  # parts of the members of a bag
_POSTINGS_PER_PART = 1 << 18  # entries of vectors that a task multiplies at once
_AT_ONCE = 1_000  # rows whose numbers a task works out at once
_NUMBERS = ArrayType(IntegerType())


def coded_documents(
    docs: DataFrame, key: str, text: str, max_features: int = MAX_FEATURES
) -> tuple[DataFrame, list[float]]:
    """``(key, bag_hash, rank, tf)``, ranks of terms ascending, and the IDF of each rank.

    Written to the shared checkpoint folder; a text leaves its task as numbers only. Rows of one ``key`` are one
    document. Documents without a vocabulary term have no row.
    """
    docs = docs.where(F.col(text).isNotNull()).select(key, word_tokens(F.col(text)).alias("words"))
    counted = docs.select("words").mapInArrow(_counted, "term string, n long")
    totals = counted.groupBy("term").agg(F.sum("n").alias("total"))
    # Ranked in a task: collected as it is, every partition would send its most frequent terms to the driver.
    ranked = materialise(vocabulary(totals, max_features), "terms").orderBy(F.desc("total"), F.asc("term"))
    terms = [r.term for r in ranked.collect()]  # bounded by max_features
    schema = StructType([docs.schema[key]]).add("bag_hash", BinaryType()).add("rank", _NUMBERS).add("tf", _NUMBERS)
    coded = materialise(docs.mapInArrow(_coded(terms), schema), "coded")
    repeated = coded.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if not repeated.isEmpty():
        apart, coded = coded, materialise(_one_per_key(coded, repeated.select(F.col(key).alias("_key")), key), "coded")
        discard(apart)
    spread = coded.select(F.explode("rank").alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("df"))
    found = spread.select("rank", smoothed_idf(F.col("df"), F.lit(docs.count())).alias("idf")).orderBy("rank")
    return coded, [r.idf for r in found.collect()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(term, n)``: how often a term stands in some texts. A row per word took Spark longer than finding the words."""
    for batch in batches:
        counts = batch.column("words").flatten().value_counts()
        yield pa.record_batch([counts.field("values"), counts.field("counts")], ["term", "n"])


def _coded(terms: list[str]) -> Callable:
    """``(key, words)`` to ``(key, bag_hash, rank, tf)``; a term's rank is its place in ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words = batch.column("words")
            listed = pa.array(terms, words.type.value_type)
            rank = pc.fill_null(pc.index_in(words.flatten(), value_set=listed), -1).to_numpy()
            row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
            pair, tf = np.unique((row * len(terms) + rank)[rank >= 0], return_counts=True)
            row, rank = np.divmod(pair, max(len(terms), 1))
            rows, sizes = np.unique(row, return_counts=True)
            at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(numbers, pa.int32())) for numbers in (rank, tf)]
            yield _hashed(batch.column(0).take(pa.array(rows)), *lists, batch.schema.names[0])

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(low, _AT_ONCE) for batch in batches for low in range(0, len(batch), _AT_ONCE))


def _hashed(keys: pa.Array, rank: pa.ListArray, tf: pa.ListArray, key: str) -> pa.RecordBatch:
    numbers = np.stack([rank.flatten().to_numpy(), tf.flatten().to_numpy()], axis=1).astype("<i4")
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(rank).to_numpy()))).tolist()
    hashes = pa.array([hashlib.sha256(numbers[low:high]).digest() for low, high in itertools.pairwise(at)], pa.binary())
    return pa.record_batch([keys, hashes, rank, tf], [key, "bag_hash", "rank", "tf"])


def _one_per_key(coded: DataFrame, repeated: DataFrame, key: str) -> DataFrame:
    """Rows whose key is ``repeated`` (null is a key, too) become one with the sums of their counts."""
    marked = coded.join(repeated.withColumn("_again", F.lit(True)), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    entries = marked.where("_again").select(key, F.explode(F.arrays_zip("rank", "tf")).alias("e"))
    sums = entries.groupBy(key, "e.rank").agg(F.sum("e.tf").cast("int").alias("tf"))
    merged = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "tf"))).alias("e")).select(key, "e.rank", "e.tf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _hashed(*batch.columns, key)

    return marked.where(F.col("_again").isNull()).drop("_again").unionByName(merged.mapInArrow(run, coded.schema))


def with_vectors(coded: DataFrame, idf: list[float]) -> DataFrame:
    """``rank`` and ``tf`` become ``vector``, a map of term rank to weight, of length one."""
    kept = [f for f in coded.schema.fields if f.name not in ("rank", "tf")]
    schema = StructType([*kept]).add("rank", _NUMBERS).add("weight", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, rank, weight = _weights(batch.column("rank"), batch.column("tf"), idf)
            at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(batch)))))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(numbers)) for numbers in (rank, weight)]
            own = batch.drop_columns(["rank", "tf"])
            yield pa.record_batch([*own.columns, *lists], [*own.schema.names, "rank", "weight"])

    made = coded.select(*[f.name for f in kept], "rank", "tf").mapInArrow(run, schema)
    return made.select(*[f.name for f in kept], F.map_from_arrays("rank", "weight").alias("vector"))


def _weights(rank: pa.ListArray, tf: pa.ListArray, idf: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, rank and weight of every entry."""
    row = np.repeat(np.arange(len(rank)), pc.list_value_length(rank).to_numpy())
    rank = rank.flatten().to_numpy()
    weight = tf.flatten().to_numpy() * np.array(idf)[rank]
    return row, rank, weight / np.sqrt(np.bincount(row, weights=weight**2, minlength=1))[row]


def document_vectors(
    docs: DataFrame, key: str, text: str, max_features: int = MAX_FEATURES
) -> DataFrame:
    """``(key, bag_hash, vector)``; ``vector`` maps term rank to weight.

    Documents without a vocabulary term have no row.
    """
    return with_vectors(*coded_documents(docs, key, text, max_features))


def collapse_bags(vectors: DataFrame, key: str) -> DataFrame:
    """One row per distinct bag: ``(bag, first_id, bag_hash, members)`` and the other columns of its documents."""
    own = [name for name in vectors.columns if name not in (key, "bag_hash")]
    bags = vectors.groupBy("bag_hash").agg(
        F.min(key).alias("first_id"),
        F.count(F.lit(1)).alias("members"),
        *[F.first(name).alias(name) for name in own],  # equal in all
    )
    return bags.where(F.col("first_id").isNotNull()).withColumn("bag", F.monotonically_increasing_id())


def verified_pairs(pairs: DataFrame, bags: DataFrame, idf: list[float], threshold: float) -> DataFrame:
    """Pairs ``(left, right)`` of bags whose full cosine is above the threshold."""
    left = bags.select(F.col("bag").alias("left"), F.col("rank").alias("rank_a"), F.col("tf").alias("tf_a"))
    right = bags.select(F.col("bag").alias("right"), F.col("rank").alias("rank_b"), F.col("tf").alias("tf_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            (row, rank, a), (other, rank_b, b) = (_weights(batch.column(f"rank_{x}"), batch.column(f"tf_{x}"), idf) for x in "ab")
            shared, i, j = np.intersect1d(row * len(idf) + rank, other * len(idf) + rank_b, True, True)
            cosine = np.bincount(shared // max(len(idf), 1), weights=a[i] * b[j], minlength=len(batch))
            yield batch.select(["left", "right"]).filter(pa.array(cosine > threshold))

    return pairs.join(left, "left").join(right, "right").mapInArrow(run, "left long, right long")


def _both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("left", "right")).alias("bag")).distinct()


def _signatures(idf: list[float]) -> Callable:
    """``(bag, rank, tf)`` to ``(bag, signatures)``, which near copies are likely to share: heaviest terms, and two pairs of min-hashes."""
    width = len(idf) + 1
    places = [np.random.default_rng(seed).permutation(width) for seed in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, rank, weight = _weights(batch.column("rank"), batch.column("tf"), idf)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            heaviest = []
            for _ in range(3):
                at = np.flatnonzero(weight == np.maximum.reduceat(weight, first)[row])
                at = at[np.flatnonzero(np.diff(row[at], prepend=-1))]
                heaviest.append(np.where(weight[at] < 0, 0, rank[at] + 1).astype("i8"))
                weight[at] = -1
            terms = np.sort(heaviest, axis=0)
            least = [np.minimum.reduceat(own[rank], first) for own in places]
            codes = (terms[0] * width + terms[1]) * width + terms[2], least[0] * width + least[1], least[2] * width + least[3]
            numbers = pa.array(np.stack([3 * code + kind for kind, code in enumerate(codes)], axis=1).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(numbers) + 1, 3), pa.int32()), numbers)
            yield pa.record_batch([batch.column("bag"), lists], ["bag", "signatures"])

    return run


def witness_pairs(bags: DataFrame, idf: list[float]) -> DataFrame:
    """Each bag with the first bag of every signature it has; a hot signature has one per part."""
    made = bags.select("bag", "rank", "tf").mapInArrow(_signatures(idf), "bag long, signatures array<long>")
    signatures = materialise(made, "signatures")
    signed = signatures.select("bag", F.explode("signatures").alias("signature")).withColumn(
        "part", F.pmod(F.xxhash64("bag"), F.lit(_SALTS))
    )
    parts = signed.groupBy("signature", "part").agg(
        F.min("bag").alias("part_first"), F.count(F.lit(1)).alias("n")
    )
    whole = parts.groupBy("signature").agg(F.min("part_first").alias("first"), F.sum("n").alias("total"))
    firsts = (
        parts.join(whole.where(F.col("total") > 1), "signature")
        .withColumn("left", F.when(F.col("total") > _HOT_SIGNATURE, F.col("part_first")).otherwise(F.col("first")))
        .select("signature", "part", "left")
    )
    return (
        signed.join(firsts, ["signature", "part"])
        .where(F.col("left") != F.col("bag"))
        .select("left", F.col("bag").alias("right"))
        .distinct()
    )


def _members_of_copied_bags(vectors: DataFrame, bags: DataFrame, key: str) -> DataFrame:
    """Ids of documents whose bag occurs more than once.

    Members are dealt over ``_MEMBER_PARTS`` parts of their bag and each copied bag is
    repeated per part, so that a bag of any size is spread over tasks.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(_MEMBER_PARTS - 1))).alias("part")
    copied = bags.where(F.col("members") > 1).select("bag_hash", parts)
    slim = vectors.select(key, "bag_hash", F.pmod(F.xxhash64(key), F.lit(_MEMBER_PARTS)).cast("int").alias("part"))
    return slim.join(copied, ["bag_hash", "part"], "left_semi").select(key)


def near_duplicate_ids(
    docs: DataFrame,
    key: str = "review_id",
    text: str = "review_text",
    threshold: float = THRESHOLD,
    max_features: int = MAX_FEATURES,
) -> DataFrame:
    """The ``key`` of every document with a near-duplicate, each once.

    The result is written to the shared checkpoint folder; the tables on the way to it are deleted when it stands there.
    """
    return outcome("near_duplicates", lambda: _near_duplicate_ids(docs, key, text, threshold, max_features))


def _near_duplicate_ids(docs: DataFrame, key: str, text: str, threshold: float, max_features: int) -> DataFrame:
    coded, idf = coded_documents(docs, key, text, max_features)
    bags = materialise(collapse_bags(coded, key), "bags")
    # Of single documents only the bag is asked for below.
    members = materialise(coded.select(key, "bag_hash"), "members")
    discard(coded)
    # Written, so that the shuffles behind the pairs are gone when the bags are moved to them.
    witnesses = materialise(witness_pairs(bags, idf), "witnesses")
    witnessed = _both_ends(verified_pairs(witnesses, bags, idf, threshold))
    settled = materialise(
        bags.where(F.col("members") > 1).select("bag").union(witnessed).distinct(), "settled"
    )
    marked = bags.join(settled.withColumn("_settled", F.lit(True)), "bag", "left").select(
        "bag", F.coalesce("_settled", F.lit(False)).alias("known"), "rank", "tf"
    )
    size = bags.agg(F.count(F.lit(1)), F.sum(F.size("rank"))).first()
    some = with_vectors(bags.select("bag", "rank", "tf").limit(blocks.LAID_OUT), idf)
    compared = outcome("compared", lambda: blocks.compared(with_vectors(marked, idf), threshold, _POSTINGS_PER_PART, size, some))
    close = verified_pairs(compared.where(F.col("right").isNotNull()), bags, idf, threshold)
    found = compared.where(F.col("right").isNull()).select(F.col("left").alias("bag")).union(_both_ends(close))
    flagged = settled.union(found).distinct()
    single = bags.where(F.col("members") == 1).join(flagged, "bag", "left_semi").select(F.col("first_id").alias(key))
    return single.unionByName(_members_of_copied_bags(members, bags, key))
