"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens with a weight: its target proportion, or by default the share that it has of all
tokens. Served in quanta, a quantum of a queue of weight ``W`` is due at virtual time ``p / W`` with ``p`` the middle of its
tokens; the first quantum is cut short by a part of its own per queue, so that queues of one size are not in step. Serving
quanta in that order is deficit round-robin: after any window a queue that still has tokens has had its share up to
about one quantum, and what it missed or took too much carries over, across windows and across partitions, because
the due times do not depend on where a task begins. Once a queue is empty the others share by their weights. A
quantum's place in the whole stream is a sum over queues, so tasks work out where their documents go without
talking to each other.

Windows are cut from that stream every 2048 tokens, so only the end of the stream is short; it is cut into
sequences of powers of two and nothing is padded.

Tasks are told the totals of at most ``MOST_QUEUES`` queues. Smaller sources share the last of them, which is itself a
stream of quanta in the order of their due times: there every quantum is a row, ranked in Spark by ranges and running
sums, however many sources there are. So a source of any size has had its share up to about two quanta; one that stands
against thousands of others also carries what their roundings leave, a few quanta more.

Texts are tokenised once. Token ids stay in the partition that made them, except those of the smaller sources, which are
joined with the places of their quanta; else what is shuffled are counts per (source, partition).
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.names import null_safe_key
from reviewlens.sources.scratch import materialise

WINDOW = 2048
QUANTUM = 256
END_ID = 1
# Queues at most; sources beyond the largest share the last queue by due times. Bounds what tasks are told.
MOST_QUEUES = 1024
_KEPT_CHUNKS = 500_000
# Its multiples fill the unit interval evenly.
_GOLDEN = (5**0.5 - 1) / 2
# Units that target proportions are rounded to.
_PARTS = 1 << 24


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _NoChunk(Exception):
    """White space at the edge of a chunk."""


class Encoder:
    """Token ids of texts, as the ``tokenizers`` file says, several times faster on running text.

    A blank between two characters that are no white space starts a token, whatever stands around, so the
    chunk up to the next such blank always becomes the same ids. Chunks are encoded once and looked up
    afterwards. Texts with other white space next to a blank, or with a special token, are encoded whole.
    Only files with the byte-level pattern get the fast path; the result is the same.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self._special = [t["content"] for t in parts.get("added_tokens", [])]
        size = self._whole.get_vocab_size(with_added_tokens=True)
        self.width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self._fast = None
        plain = not parts.get("normalizer") and (parts.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        if plain and parts["model"].get("type") == "BPE" and not parts["pre_tokenizer"].get("add_prefix_space"):
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            byte_of = _byte_alphabet()
            ranks = {bytes(byte_of[c] for c in token): i for token, i in parts["model"]["vocab"].items() if token not in self._special}
            self._fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        fast, code = self._fast, "H" if self.width.itemsize == 2 else "I"

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                # A blank next to white space, or at the end, leaves a chunk empty or with white space at its edge.
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    raise _NoChunk
                # No special token stands in the text, so none in a chunk.
                own = array(code, fast.encode_ordinary(" " + chunk))
                if sys.byteorder == "big":
                    own.byteswap()
                ids = own.tobytes()
                if len(self) < _KEPT_CHUNKS:
                    self[chunk] = ids
                return ids

        self._chunk = Chunks().__getitem__

    def _encode(self, text: str) -> bytes:
        if self._fast is not None and not any(s in text for s in self._special):
            return np.asarray(self._fast.encode_ordinary(text), dtype=self.width).tobytes()
        return np.asarray(self._whole.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian numbers of ``width``."""
        if self._fast is None or any(s in text for s in self._special):
            return self._encode(text)
        first, *chunks = text.split(" ")
        if chunks and (not first or first[-1].isspace()):
            return self._encode(text)
        # Chunks are looked at when they are new; those that stand in the table are sound.
        try:
            return b"".join([self._encode(first), *map(self._chunk, chunks)])
        except _NoChunk:
            return self._encode(text)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks that a Python worker runs: its tables and chunks are made once."""
    return Encoder(path)


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _tokenised(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        end = np.array([END_ID], dtype=encode.width).tobytes()
        part, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            # A few hundred texts at a time keep the ids in memory few.
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids, starts, lengths = [], [], []
                for text, source in zip(piece.column("text").to_pylist(), piece.column("source").to_pylist(), strict=True):
                    coded = encode(text or "") + end
                    n = len(coded) // encode.width.itemsize
                    starts.append(before.get(source, 0))
                    before[source] = starts[-1] + n
                    ids.append(coded)
                    lengths.append(n)
                made = {name: piece.column(name) for name in piece.schema.names if name != "text"}
                made |= {
                    "part": pa.array([part] * len(ids), pa.int32()),
                    "start": pa.array(starts, pa.int64()),
                    "n": pa.array(lengths, pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                    "width": pa.array([encode.width.itemsize] * len(ids), pa.int32()),
                }
                yield pa.RecordBatch.from_pydict(made)

    return run


class Stream:
    """Places of quanta in the stream that serves queues of the given token totals, by weights or by their totals.

    Due times are numbers in double precision, worked out alike for every comparison, so all tasks see one order.
    """

    def __init__(self, totals: list[int], quantum: int = QUANTUM, window: int = WINDOW, weights: list[int] | None = None) -> None:
        self.quantum, self.window = quantum, window
        self._n = np.array(totals, dtype=np.int64)
        weights = np.array(totals if weights is None else weights, dtype=np.float64)
        # Queues of like weights are told apart by phases that fill the quantum evenly.
        rank = np.empty(len(totals))
        rank[np.lexsort((np.arange(len(totals)), weights))] = np.arange(len(totals))
        phase = rank * _GOLDEN % 1.0 * quantum
        self._cut, self._phase = np.floor(phase).astype(np.int64), phase - 0.5
        self._c = -(-(self._n + self._cut) // quantum)
        self._step = 1.0 / np.maximum(weights, 1.0)
        opening, closing = quantum - self._phase, self._n - (self._c - 1) * quantum + self._phase
        alone = phase / np.maximum(quantum - self._n + 1, 1) * self._n
        self._opens = np.where(self._c == 1, alone, opening**2 / (2 * quantum))
        self._closes = np.where(self._c == 1, alone, self._n - closing**2 / (2 * quantum))
        self.all = int(self._n.sum())
        self._full = self.all // window * window

    def _due(self, k: np.ndarray, queues: np.ndarray) -> np.ndarray:
        """When quanta ``k`` of ``queues`` are due: at the middle of their tokens, divided by the weight.

        Short quanta at the ends are due as much earlier or later as makes queues of all phases together have had, at
        any time, what they should; a queue of one quantum is due anywhere.
        """
        middle = (k + 0.5) * self.quantum - self._phase[queues]
        tokens = np.where(k >= self._c[queues] - 1, self._closes[queues], np.where(k == 0, self._opens[queues], middle))
        return tokens * self._step[queues]

    def places(self, queue: int, quanta: np.ndarray) -> np.ndarray:
        """Tokens of all queues that are served before each of the queue's quanta."""
        due = self._due(quanta[:, None], np.array([queue]))
        first_on_tie = (np.arange(len(self._c)) < queue)[None, :]
        everyone = np.arange(len(self._c))

        def early(k: np.ndarray) -> np.ndarray:
            theirs = self._due(k, everyone)
            return (theirs < due) | ((theirs == due) & first_on_tie)

        # How many quanta of the other queues come first: an estimate less one, then two steps of comparison.
        count = np.maximum(np.ceil((due / self._step + self._phase) / self.quantum - 0.5) - 1, 0)
        count += early(count)
        count += early(count)
        count = np.minimum(count, self._c).astype(np.int64)
        count[:, queue] = quanta
        return np.clip(count * self.quantum - self._cut, 0, self._n).sum(axis=1)

    def sequence(self, place: int) -> tuple[int, int, int]:
        """``(sequence, offset in it, tokens to its end)`` of a place in the stream."""
        if place < self._full:
            return place // self.window, place % self.window, self.window - place % self.window
        number, at, left = self._full // self.window, self._full, self.all - self._full
        while True:  # the rest, largest power of two first
            size = 1 << (left.bit_length() - 1)
            if place < at + size:
                return number, place - at, at + size - place
            number, at, left = number + 1, at + size, left - size

    def pieces(self, queue: int, begin: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """``(start, length, sequence, offset)`` for tokens ``begin`` and on of a queue."""
        cut = int(self._cut[queue])
        first, last = (begin + cut) // self.quantum, (begin + cut + length - 1) // self.quantum
        at = self.places(queue, np.arange(first, last + 1, dtype=np.int64)).tolist()
        open_: list[int] | None = None
        for c, place in zip(range(first, last + 1), at, strict=True):
            low, high = max(begin, c * self.quantum - cut), min(begin + length, (c + 1) * self.quantum - cut)
            place += low - max(0, c * self.quantum - cut)
            while low < high:
                sequence, offset, room = self.sequence(place)
                take = min(room, high - low)
                if open_ and open_[2] == sequence and open_[3] + open_[1] == offset:
                    open_[1] += take
                else:
                    if open_:
                        yield tuple(open_)
                    open_ = [low - begin, take, sequence, offset]
                low, place = low + take, place + take
        if open_:
            yield tuple(open_)


def _weights(totals: list[int], targets: list[float | None]) -> list[int]:
    """Whole weights of queues, some with a target; the others share what the targets leave, by their sizes.

    Nothing weighs less than one part of ``_PARTS``, so that no queue waits for ever.
    """
    left = max(0.0, 1.0 - sum(t for t in targets if t is not None))
    rest = sum(n for n, t in zip(totals, targets, strict=True) if t is None)
    shares = [left * n / rest if t is None else t for n, t in zip(totals, targets, strict=True)]
    return [max(1, round(share * _PARTS)) for share in shares]


def _running(df: DataFrame, order: list[str], size: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows before a row in the unique ``order``: by ranges, then their totals."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn("size", size).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    cut = materialise(cut, "ranges")
    # One row per range.
    earlier = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("range").agg(F.sum("size").alias("size"))
    base = totals.select("range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return ranked.join(F.broadcast(base), "range").select(*df.columns, (F.col("base") + F.col("inside")).alias(name))


def _shared_places(sources: DataFrame, quantum: int) -> DataFrame:
    """``(source, c, cut, place)``: tokens of all ``sources(source, n)`` due before quantum ``c`` of a source.

    The first quantum of a source is ``cut`` tokens short. Equal due times go by source, then number.
    """
    ranked = _running(sources, ["n", "source"], F.lit(1).cast("long"), "rank")
    phased = ranked.withColumn("phase", F.col("rank") * F.lit(_GOLDEN) % 1.0 * quantum).withColumn("cut", F.floor("phase").cast("long"))
    # Blocks of quanta first: no array is longer than a block.
    block = 1 << 16
    low = F.explode(F.expr(f"sequence(0L, (n + cut - 1) div {quantum}, {block}L)"))
    blocks = phased.select("source", "n", "cut", "phase", low.alias("low"))
    each = blocks.withColumn("c", F.explode(F.expr(f"sequence(low, least(low + {block - 1}, (n + cut - 1) div {quantum}))")))
    held = F.least(F.col("n"), (F.col("c") + 1) * quantum - F.col("cut")) - F.greatest(F.lit(0), F.col("c") * quantum - F.col("cut"))
    opens, closes = F.col("c") == 0, F.col("c") == F.expr(f"(n + cut - 1) div {quantum}")
    # As in ``Stream``.
    opening = quantum + 0.5 - F.col("phase")
    closing = F.col("n") - F.col("c") * quantum + F.col("phase") - 0.5
    due = (
        F.when(opens & closes, F.col("phase") / (quantum - F.col("n") + 1) * F.col("n"))
        .when(closes, F.col("n") - closing * closing / (2.0 * quantum))
        .when(opens, opening * opening / (2.0 * quantum))
        .otherwise((F.col("c") + 0.5) * quantum - F.col("phase") + 0.5)
    ) / F.col("n")
    quanta = each.select("source", "c", "cut", due.alias("due"), held.alias("held"))
    return _running(quanta, ["due", "source", "c"], F.col("held"), "place").select("source", "c", "cut", "place")


def _by_quanta(documents: DataFrame, places: DataFrame, quantum: int) -> DataFrame:
    """Documents of the shared queue, cut at the quanta of their sources; ``begin`` is then a place in that queue."""
    cuts = places.where("c = 0").select("source", "cut")
    phased = documents.join(cuts, "source")
    each = phased.withColumn("c", F.explode(F.expr(f"sequence((begin + cut) div {quantum}, (begin + cut + n - 1) div {quantum})")))
    opening = F.greatest(F.lit(0), F.col("c") * quantum - F.col("cut"))
    low = F.greatest(F.col("begin"), opening)
    high = F.least(F.col("begin") + F.col("n"), (F.col("c") + 1) * quantum - F.col("cut"))
    each = each.withColumns({"into": low - opening, "first": low - F.col("begin"), "length": high - low})
    ids = F.expr("substring(ids, cast(first * width + 1 as int), cast(length * width as int))")
    placed = each.withColumn("ids", ids).join(places.drop("cut"), ["source", "c"])
    return placed.withColumn("begin", F.col("place") + F.col("into"))


def _key_of(source: str | None) -> str:
    """The queue's name for a source, as ``null_safe_key`` makes it."""
    return "-" if source is None else "=" + source.replace("\x01", "\x01\x01")


def _packed(stream: Stream, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield _pieces(batch.slice(at, 512), stream, with_ids)

    return run


def _pieces(batch: pa.RecordBatch, stream: Stream, with_ids: bool) -> pa.RecordBatch:
    rows, numbers, crcs, ids = [], [], [], []
    columns = [batch.column(c).to_pylist() for c in ("queue", "begin", "ids", "width", "first", "n")]
    for row, (queue, begin, coded, width, first, n) in enumerate(zip(*columns, strict=True)):
        wide = np.frombuffer(coded, dtype=f"<u{width}").astype("<u4")
        for start, length, sequence, offset in stream.pieces(queue, begin, len(wide)):
            rows.append(row)
            numbers.append((first + start, length, n, sequence, offset))
            own = wide[start : start + length]
            crcs.append(zlib.crc32(own.tobytes()))
            if with_ids:
                ids.append(own.astype(np.int32))
    table = np.array(numbers, dtype=np.int64).reshape(-1, 5)
    made = {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "start": table[:, 0], "length": table[:, 1]}
    made |= {"ids_crc32": pa.array(crcs, pa.int64()), "doc_tokens": table[:, 2], "sequence_id": table[:, 3], "offset": table[:, 4]}
    if with_ids:
        made["ids"] = pa.array(ids, pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(made)


def packed(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    tokenizer: str | None = None,
    quantum: int = QUANTUM,
    window: int = WINDOW,
    with_ids: bool = False,
    targets: Mapping[str | None, float] | None = None,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``, one row per piece.

    Every row of ``df`` is a document of its own, also where ids or rows repeat; a null text is empty and
    still has its end id. A null source is a queue of its own. Sequences hold ``window`` tokens, the last
    few powers of two. Other columns are not read. ``tokenizer`` is the path of a ``tokenizers`` file that
    every machine has.

    ``targets`` are proportions of every window by source, above 0 and 1 at most in sum; None stands for the null
    source. Sources without one share the rest by their sizes. Every document is packed, so windows hold their
    proportions as long as all queues last; then the remaining ones share. Targets of absent sources are ignored.
    """
    targets = dict(targets or {})
    if targets and (min(targets.values()) <= 0 or sum(targets.values()) > 1 + 1e-9 or len(targets) >= MOST_QUEUES):
        raise ValueError(f"targets are above 0, at most 1 in sum and fewer than {MOST_QUEUES}")
    named = {_key_of(source): share for source, share in targets.items()}
    narrow = df.select(F.col(doc_id).alias("doc_id"), null_safe_key(F.col(source)).alias("source"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, part int, start bigint, n bigint, ids binary, width int"
    coded = materialise(narrow.mapInArrow(_tokenised(tokenizer or default_tokenizer()), schema), "tokens")
    counts = materialise(coded.groupBy("source", "part").agg(F.sum("n").alias("n")), "counts")
    sources = counts.groupBy("source").agg(F.sum("n").alias("n"))
    first = F.col("source").isin(list(named))
    largest = sources.orderBy(first.desc(), F.desc("n"), "source").limit(MOST_QUEUES - 1).collect()
    names = sorted(row.source for row in largest)
    # At most ``MOST_QUEUES`` names and totals: the queues by name, and the shared one.
    known = {row.source: row.n for row in largest}
    shared = (sources.agg(F.sum("n")).first()[0] or 0) - sum(known.values())
    totals = [known[name] for name in names] + ([shared] if shared else [])
    shares = [named.get(name) for name in names] + ([None] if shared else [])
    stream = Stream(totals, quantum, window, _weights(totals, shares) if named else None)
    queue: Column = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("source")) - 1
    queue = F.when(queue < 0, len(names)).otherwise(queue).cast("int")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "part", queue.alias("queue"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    offsets = materialise(offsets, "offsets")
    joined = coded.join(offsets, ["source", "part"]).withColumn("begin", F.col("before") + F.col("start"))
    wanted = ("doc_id", "queue", "begin", "ids", "width", "first", "n")
    ready = joined.withColumn("first", F.lit(0).cast("long")).select(*wanted)
    if shared:
        alone = F.col("queue") < len(names)
        listed = df.sparkSession.createDataFrame([(name,) for name in names], "source string")
        places = _shared_places(sources.join(F.broadcast(listed), "source", "left_anti"), quantum)
        own = _by_quanta(joined.where(~alone), materialise(places, "places"), quantum)
        ready = ready.where(alone).unionByName(own.select(*wanted))
    out = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ready.mapInArrow(_packed(stream, with_ids), out + (", ids array<int>" if with_ids else ""))
