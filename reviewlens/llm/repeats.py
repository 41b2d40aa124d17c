"""Removal of every byte covered by a long string that stands more than once in the corpus.

The strings to compare are found without sorting every suffix. In each ``length``-byte window the ``core``-byte
strings with the least hash are its anchors: equal windows have equal anchors at equal places, so only contexts of
equal anchors, up to ``width = length - core`` bytes to either side, have to be put in order. Anchors whose core
stands once are dropped by a count; a context that stands twice as a whole needs no order, as all its windows repeat.

What is left is built column by column, as a collection's Burrows-Wheeler transform is: the documents of one core's
collection are its different contexts, and each round inserts one symbol of every document, sorts the order of the
round before stably by it, and updates the length that neighbours in the order have in common. Contexts are aligned
at their anchor, so a round needs the order of the round before only, not the entries of other columns. A window that
ends at the round's column repeats where a neighbour has ``length`` symbols in common. All of a text's columns would be as
many rounds as the longest text has bytes; here they are twice ``width``, whatever the texts.

Collections of up to ``_MOST`` contexts are built inside a task, many at a time, from a table sorted by collection.
A larger one is split by content: half of the columns at a time, the contexts that agree on all bytes that the
windows of that half have in common make a smaller collection with half the columns. Equal contexts collapse first by
partial counts, so a core that any share of all rows has in common is never one task's work, and at a single window
what is left of a collection is one context.

All steps in between are tables in the shared folder. Equality is that of 128-bit digests or of the bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.names import unused
from reviewlens.sources.scratch import materialise

_LENGTH = 400
# Contexts of a collection that is built inside one task, and contexts per build.
_MOST, _BUILD = 4096, 8192
# Window starts hashed at a time, so that a very long text needs no long table; rows of a batch.
_CHUNK, _ROWS = 1 << 16, 1 << 15
# The low bits of a hash give way to the place in a chunk.
_PLACES = 1 << 17
# Bits of the table of wanted texts; half a megabyte.
_WANTED_BITS = 22
_NO_SYMBOL = 256
_SYMBOLS = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_TWICE = "n > 1"


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, dtype=np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by running values from both ends of blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Finds the anchors of texts for one window and core length."""

    def __init__(self, length: int, core: int):
        self.length, self.core, self.places = length, core, length - core + 1
        size = _CHUNK + length
        self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)

    def _hashes(self, text: np.ndarray) -> np.ndarray:
        """A hash of every core, of its bytes alone."""
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_SYMBOLS[text] * self.up[: len(text)], dtype=np.uint64)))
        found = (sums[self.core :] - sums[: -self.core]) * self.down[: len(text) - self.core + 1]
        found ^= found >> np.uint64(31)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        return found ^ (found >> np.uint64(29))

    def starts(self, text: bytes) -> np.ndarray:
        """Where the cores start that have the least hash of some window, the first of equal ones."""
        data, found = np.frombuffer(text, dtype=np.uint8), []
        for at in range(0, len(data) - self.length + 1, _CHUNK):
            hashes = self._hashes(data[at : at + _CHUNK + self.length - 1])
            placed = hashes & ~np.uint64(_PLACES - 1) | np.arange(len(hashes), dtype=np.uint64)
            found.append((_least(placed, self.places) & np.uint64(_PLACES - 1)).astype(np.int64) + at)
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def context(text: bytes, at: int, length: int, core: int) -> tuple[bytes, bytes, bytes]:
    """The core that starts at ``at`` and what stands left and right of it, as far as a window reaches."""
    return text[max(0, at + core - length) : at], text[at : at + core], text[at + core : at + length]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [text or b"" for text in batch.column("text").cast(pa.binary()).to_pylist()]


def _anchored(length: int, core: int) -> Callable:
    """Anchors of every text, and as rows without a core the runs of starts that repeat within the text.

    Two copies say as much as many, of a text in a task as of a context in a text: others are passed over. A context
    that a text holds twice repeats as a whole, so its starts are known at once; a text of one repeated line has
    few anchors left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, copies = Anchors(length, core), Counter()
        schema = pa.schema([("text_key", pa.binary()), ("at", pa.int64()), ("last", pa.int64()), ("core", pa.int64()), ("extent", pa.binary())])
        rows: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return made

        def add(key: bytes, text: bytes) -> None:
            starts = finder.starts(text).tolist()
            digests = []
            for at in starts:
                left, middle, right = context(text, at, length, core)
                whole = xxhash.xxh3_128(b"%d:" % len(left))
                for part in (left, middle, right):
                    whole.update(part)
                digests.append((xxhash.xxh3_64_intdigest(middle) - (1 << 63), whole.digest()))
            times, told = Counter(digests), Counter()
            own = [at for at, pair in zip(starts, digests, strict=True) if times[pair] > 1]
            edges = [i for i in range(1, len(own)) if own[i] - own[i - 1] > length - core + 1]
            for i, after in zip([0, *edges], [*edges, len(own)], strict=True) if own else ():
                rows.append((key, own[i] - (length - core), own[after - 1], None, None))
            for at, pair in zip(starts, digests, strict=True):
                told[pair] += 1
                if told[pair] <= 2:
                    rows.append((key, at, None, *pair))

        for batch in batches:
            for key, text in zip(batch.column("text_key").to_pylist(), _texts(batch), strict=True):
                copies[key] += 1
                if len(text) >= length and copies[key] <= 2:
                    add(key, text)
                if len(rows) >= _ROWS:
                    yield flushed()
        if rows:
            yield flushed()

    return run


def _wanted_table(keyed: DataFrame) -> bytes:
    """A bit for the first bits of every ``text_key``. It is half a megabyte, whatever the number of keys."""
    at = F.shiftright(F.conv(F.hex(F.substring("text_key", 1, 3)), 16, 10).cast("long"), 24 - _WANTED_BITS) + 1
    parts = keyed.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part"))
    table = bytearray(1 << _WANTED_BITS - 3)
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
        table[(row.part - 1) * len(row.bits) : row.part * len(row.bits)] = row.bits
    return bytes(table)


def _texts_of(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """``keyed`` with the texts, one row per key and task that holds the text.

    Texts whose bit is not set stay out of the shuffle. With very many keys all bits are set and all texts go; the rows
    are the same.
    """
    table = _wanted_table(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def wanted(key: bytes) -> bool:
            at = int.from_bytes(key[:3], "big") >> 24 - _WANTED_BITS
            if not table[at >> 3] >> (at & 7) & 1 or key in seen:
                return False
            seen.add(key)
            return True

        for batch in batches:
            yield batch.filter(pa.array([wanted(key) for key in batch.column("text_key").to_pylist()], pa.bool_()))

    return texts.mapInArrow(run, texts.schema).join(keyed, "text_key")


def _contexts(length: int, core: int) -> Callable:
    """The bytes of the wanted contexts of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(_texts(batch), batch.column("wanted"), strict=True):
                rows = wanted.as_py()
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    cut = [context(text, row["at"], length, core) for row in part]
                    yield pa.RecordBatch.from_pydict({
                        "core": pa.array([row["core"] for row in part], pa.int64()),
                        "extent": pa.array([row["extent"] for row in part], pa.binary()),
                        "n": pa.array([row["n"] for row in part], pa.int64()),
                        "members": pa.array([row["members"] for row in part], pa.int64()),
                        "key": pa.array([xxhash.xxh3_128_digest(middle) for _, middle, _ in cut], pa.binary()),
                        "left": pa.array([left for left, _, _ in cut], pa.binary()),
                        "right": pa.array([right for _, _, right in cut], pa.binary()),
                    })

    return run


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], width: int, middle: int) -> list[tuple[int, int, int]]:
    """``(row, first, last)``: runs of windows that another row of the same group has too.

    A row's columns are ``width`` symbols left of a middle that is equal throughout the group, ``middle`` symbols
    long, and ``width`` right of it; ``left`` ends and ``right`` begins at the middle, and beyond a text's ends there
    is no symbol. Window t of 0..width begins at column t and ends ``width - t`` short of the last; ``width + middle``
    symbols long. ``group`` is ascending.
    """
    n, length = len(group), width + middle
    symbols = np.full((2 * width, n), _NO_SYMBOL, dtype=np.int64)
    for i, (before, after) in enumerate(zip(left, right, strict=True)):
        symbols[width - len(before) : width, i] = np.frombuffer(before, dtype=np.uint8)
        symbols[width : width + len(after), i] = np.frombuffer(after, dtype=np.uint8)
    low = width - np.array([len(x) for x in left], dtype=np.int64)
    high = np.array([len(x) for x in right], dtype=np.int64)
    order, groups = np.arange(n), group.astype(np.int64) * (_NO_SYMBOL + 1)
    common = np.zeros(n, dtype=np.int64)  # symbols in common with the row before in the order
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def least(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least common length from ``first`` to ``last``, both included."""
        ends = np.stack((first, last + 1), axis=1).ravel()
        return np.minimum.reduceat(np.append(common, 0), ends)[::2]

    def insert(column: np.ndarray) -> None:
        nonlocal order, common
        keys = groups[order] + column[order]
        moved = np.argsort(keys, kind="stable")
        keys = keys[moved]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        longer = np.zeros(len(order), dtype=np.int64)
        if len(same):
            longer[same + 1] = least(moved[same] + 1, moved[same + 1]) + 1
        order, common = order[moved], longer

    def report(t: int) -> None:
        nonlocal order, common
        most = np.maximum(common, np.append(common[1:], 0))
        rows = order[most >= length]
        rows = rows[(low[rows] <= t) & (t <= high[rows])]
        found.append((rows, np.full(len(rows), t)))
        if t % 8 == 0:  # rows that can reach no window any more
            kept = np.flatnonzero(most + (width - t) >= length)
            if len(kept) < len(order):
                if len(kept):
                    common[kept] = least(np.append(0, kept[:-1] + 1), kept)
                order, common = order[kept], common[kept]

    for column in symbols[:width]:
        insert(column)
    starts = np.append(True, groups[order][1:] != groups[order][:-1])[:n]
    common = np.where(starts, 0, common + middle)
    report(0)
    for t, column in enumerate(symbols[width:], 1):
        if not len(order):
            break
        insert(column)
        report(t)
    rows, windows = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(rows):
        return []
    by = np.lexsort((windows, rows))
    rows, windows = rows[by], windows[by]
    heads = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (windows[1:] != windows[:-1] + 1)))
    tails = np.append(heads[1:], len(rows))
    return [(int(rows[a]), int(windows[a]), int(windows[b - 1])) for a, b in zip(heads, tails, strict=True)]


def _built(width: int, middle: int) -> Callable:
    """Runs of repeated windows of the collections in a task's rows, sorted by ``key`` and context."""

    def build(rows: list[dict]) -> pa.RecordBatch:
        # A context that came from more than one copy of its text counts once.
        rows = [row for i, row in enumerate(rows) if not i or (row["key"], row["extent"]) != (rows[i - 1]["key"], rows[i - 1]["extent"])]
        group = np.cumsum([i > 0 and row["key"] != rows[i - 1]["key"] for i, row in enumerate(rows)])
        runs = repeated_windows(group, [row["left"] for row in rows], [row["right"] for row in rows], width, middle)
        return pa.RecordBatch.from_pydict({
            "core": pa.array([rows[i]["core"] for i, _, _ in runs], pa.int64()),
            "extent": pa.array([rows[i]["extent"] for i, _, _ in runs], pa.binary()),
            "first": pa.array([first for _, first, _ in runs], pa.int64()),
            "last": pa.array([last for _, _, last in runs], pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            rows += batch.to_pylist()
            if len(rows) >= _BUILD and rows[0]["key"] != rows[-1]["key"]:
                cut = next(i for i in range(len(rows), 0, -1) if rows[i - 1]["key"] != rows[-1]["key"])
                yield build(rows[:cut])
                rows = rows[cut:]
        if rows:
            yield build(rows)

    return run


def _built_runs(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """``(core, extent, first, last)`` of collections that fit in a task, from ``(key, core, extent, left, right)``."""
    dealt = contexts.select("key", "core", "extent", "left", "right").repartition("key").sortWithinPartitions("key", "extent")
    return dealt.mapInArrow(_built(width, length - width), "core long, extent binary, first long, last long")


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _halves(entries: DataFrame, width: int) -> DataFrame:
    """Entries of collections that are too large, by the lower and the upper half of their windows, ``width // 2`` wide.

    With an even width the window in the middle is in both.
    """
    left, right, parts = F.col("left"), F.col("right"), []
    size, half = F.octet_length("left"), width // 2
    for first, last in ((0, half), (width - half, width)):
        held = entries.where((size >= width - last) & (F.octet_length("right") >= first))
        # Of the left, what all windows have is width - last bytes at its end; the half bytes before it vary.
        begin = F.greatest(F.lit(0), size - (width - first))
        fixed = F.substring(left, size - (width - last) + 1, F.lit(width - last))
        key = _digest(F.col("key"), F.lit(b"%d:" % first), fixed, F.substring(right, F.lit(1), F.lit(first)))
        part = held.select(
            "core", "extent", "n", key.alias("key"), (F.col("shift") + first).alias("shift"),
            F.substring(left, begin + 1, size - (width - last) - begin).alias("left"),
            F.substring(right, F.lit(first + 1), F.lit(half)).alias("right"),
        )
        parts.append(part)
    return parts[0].unionByName(parts[1])


def _runs(entries: DataFrame, width: int, length: int) -> DataFrame:
    """``(core, extent, first, last)``: runs of repeated windows of the entries' owners, by way of their collections.

    An entry is a context's part ``left`` and ``right`` of what its collection ``key`` has in common, standing ``n``
    times; its windows are those of its owner ``(core, extent)`` from ``shift`` on.
    """
    size = F.lpad(F.octet_length("left").cast("string"), 6, "0").cast("binary")
    entries = materialise(entries.withColumn("piece", _digest(F.col("key"), size, F.col("left"), F.col("right"))), "entries")
    pieces = materialise(entries.groupBy("key", "piece", "left", "right").agg(F.sum("n").alias("n")), "pieces")
    whole = pieces.where(_TWICE).select(
        "piece", F.greatest(F.lit(0), width - F.octet_length("left")).cast("long").alias("first"),
        F.least(F.lit(width), F.octet_length("right")).cast("long").alias("last"),
    )
    mixed = materialise(_mixed(pieces, "key"), "collections")
    small = pieces.join(mixed.where(F.col("members") <= _MOST), "key")
    built = _built_runs(small.selectExpr("key", "0L as core", "piece as extent", "left", "right"), width, length)
    owned = entries.select("piece", "core", "extent", "shift").join(whole.unionByName(built.selectExpr("extent as piece", "first", "last")), "piece")
    found = materialise(owned.selectExpr("core", "extent", "first + shift as first", "last + shift as last"), "runs")
    large = mixed.where(F.col("members") > _MOST).select("key")
    if large.isEmpty():
        return found
    return found.unionByName(_runs(_halves(entries.join(large, "key"), width), width // 2, length))


def _mixed(contexts: DataFrame, key: str) -> DataFrame:
    """``(key, members)`` of the collections of different contexts of which one stands once."""
    counted = contexts.groupBy(key).agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("fewest"))
    return counted.where("members > 1 and fewest = 1").drop("fewest")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    shown = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(F.substring(F.unhex(F.sha2(shown, 256)), 1, 16).alias("text_key"), F.col(text).alias("text"))


def repeated_starts(docs: DataFrame, text: str = "text", length: int = _LENGTH, core: int | None = None) -> DataFrame:
    """``(text_key, starts)``: of every text with repeated strings, runs ``(first, last)`` of where they start.

    ``text_key`` is the first half of the SHA-256 of the text's UTF-8; null counts as empty. Runs may overlap and
    come in no order, and may reach beyond a text's ends.
    """
    core = core or length // 4
    width = length - core
    texts = _keyed(docs, text)
    cut = texts.mapInArrow(_anchored(length, core), "text_key binary, at long, last long, core long, extent binary")
    cut = materialise(cut, "anchors")
    anchors = cut.where("core is not null").drop("last")
    # What is joined to many rows is written first: the join then has two plain exchanges, and a hot core is split.
    twice = materialise(anchors.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(_TWICE).select("core"), "twice")
    shared = materialise(anchors.join(twice, "core"), "shared")
    place = F.min(F.struct("text_key", "at")).alias("place")
    extents = materialise(shared.groupBy("core", "extent").agg(F.count(F.lit(1)).alias("n"), place), "extents")
    # Contexts of one core of which some stand once: their bytes have to be compared.
    apart = materialise(_mixed(extents, "core"), "apart")
    named = F.struct(F.col("place.at").alias("at"), "core", "extent", "n", "members")
    wanted = extents.join(apart, "core").groupBy("place.text_key").agg(F.collect_list(named).alias("wanted"))
    schema = "core long, extent binary, n long, members long, key binary, left binary, right binary"
    compared = _texts_of(texts, materialise(wanted, "wanted")).mapInArrow(_contexts(length, core), schema)
    compared = materialise(compared, "contexts")
    runs = extents.where(_TWICE).selectExpr("core", "extent", "0L as first", f"{width}L as last")
    runs = runs.unionByName(_built_runs(compared.where(F.col("members") <= _MOST), width, length))
    large = compared.where(F.col("members") > _MOST).drop("members")
    if not large.isEmpty():
        runs = runs.unionByName(_runs(_halves(large.distinct().withColumn("shift", F.lit(0)), width), width // 2, length))
    # One row per context, with at most a run for every second window.
    runs = runs.groupBy("core", "extent").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    found = shared.join(materialise(runs, "runs"), ["core", "extent"]).select("text_key", "at", "runs").distinct()
    moved = F.transform("runs", lambda r: F.struct((F.col("at") + r["first"] - width).alias("first"), (F.col("at") + r["last"] - width).alias("last")))
    own = cut.where("core is null").select("text_key", F.array(F.struct(F.col("at").alias("first"), "last")).alias("starts"))
    starts = found.select("text_key", moved.alias("starts")).unionByName(own.distinct())
    return starts.groupBy("text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def merged_spans(starts: list[tuple[int, int]], size: int, length: int) -> list[tuple[int, int]]:
    """Maximal covered spans of a text of ``size`` bytes, from runs of starts of ``length``-byte strings."""
    spans: list[tuple[int, int]] = []
    for first, last in sorted(starts):
        first, last = max(first, 0), min(last, size - length)
        if first > last:
            continue
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], last + length))
        else:
            spans.append((first, last + length))
    return spans


def _kept(text: bytes, spans: list[tuple[int, int]]) -> list[memoryview]:
    edges = [0, *(edge for span in spans for edge in span), len(text)]
    return [memoryview(text)[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _cuts(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, counts, digests = [], [], []
            for text, starts in zip(_texts(batch), batch.column("starts"), strict=True):
                spans = merged_spans([(run["first"], run["last"]) for run in starts.as_py()], len(text), length)
                digest = hashlib.sha256()
                for part in _kept(text, spans):
                    digest.update(part)
                removed.append(sum(b - a for a, b in spans))
                counts.append(len(spans))
                digests.append(digest.hexdigest())
            made = {"text_key": batch.column("text_key"), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_pydict(made | {"n_spans": pa.array(counts, pa.int64()), "kept_sha256": pa.array(digests)})

    return run


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = _LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``docs``.

    A byte goes if a ``length``-byte string that covers it also starts anywhere else, in the same text or another;
    repeated rows are texts of their own and so go whole. A null text is empty; texts below ``length`` bytes stay
    whole. An empty table gives none; other columns are not read, whatever their names.
    """
    starts = materialise(repeated_starts(docs, text, length), "starts")
    cut = _texts_of(_keyed(docs, text), starts).mapInArrow(_cuts(length), "text_key binary, n_removed long, n_spans long, kept_sha256 string")
    cut = materialise(cut.distinct(), "cuts")
    shown = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    whole = F.sha2(shown, 256)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(shown).cast("long").alias("n_bytes"), whole.alias("whole"))
    rows = rows.withColumn("text_key", F.substring(F.unhex("whole"), 1, 16)).join(cut, "text_key", "left")
    return rows.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", length: int = _LENGTH) -> DataFrame:
    """All rows and columns of ``docs`` and ``kept``, the UTF-8 that remains of the text; cuts may fall inside a character.

    The new column is named ``kept_`` and so on where ``docs`` has a ``kept``. Texts are shuffled once, by their keys.
    """
    starts = materialise(repeated_starts(docs, text, length), "starts")
    key, held, kept = (unused(docs, name) for name in ("text_key", "starts", "kept"))
    shown = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    keyed = docs.withColumn(key, F.substring(F.unhex(F.sha2(shown, 256)), 1, 16))
    joined = keyed.join(starts.select(F.col("text_key").alias(key), F.col("starts").alias(held)), key, "left").drop(key)
    schema = joined.drop(held).schema.add(kept, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, runs in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(held), strict=True):
                value = value or b""
                spans = merged_spans([(run["first"], run["last"]) for run in runs.as_py() or ()], len(value), length)
                out.append(b"".join(_kept(value, spans)))
            yield batch.drop_columns([held]).append_column(kept, pa.array(out, pa.binary()))

    return joined.mapInArrow(run, schema)
