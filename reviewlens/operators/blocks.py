"""Sparse unit vectors compared all with all, in pairs of blocks.

Vectors are written once, as blocks of bounded size in the shared folder; a task reads two blocks at a time, so memory
is that of two blocks however many there are, and nothing is shuffled. In a block, vectors of like size and place stand
together as tiles; tiles whose coordinates along a few directions are too far apart are passed over, and so are those
with fewer terms than a partner needs. Terms fall into groups. By Cauchy-Schwarz the cosine of two vectors is at most
the product of their norms in each group, summed: matrix products bound all pairs of two tiles. Few groups do for short
vectors, long ones need more: what the tiles before left tells with how many to begin. Where few pairs are left, finer
bounds and dot products are worked out for these alone. Blocks meet in rounds, first each with itself, and what a round
has found for a block's vectors is known in the next: two known ones are not compared. Pairs are never stored. The
comparisons remain quadratic in the vectors.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.sources.scratch import fresh_folder, materialise

_GROUPS = 64  # of the first bound
_FINE = (1, 2, 4, 8, 32)  # how many times as many the bounds have
_KEPT = 4  # bounds whose norms are kept for a whole block
_DIRECTIONS = 8  # in which vectors are laid out, so that tiles far from each other need not be compared
LAID_OUT = 1_000  # vectors from which the directions are taken
_LAID_TERMS = 1 << 14  # and the terms that these have to do with
_PLACE_SLACK = 2e-3  # of squared distances: what is left of a length near zero is known to three digits only
_FINER = (256, 256, 128, 16)  # the next bound is worked out for a whole tile where more than one in so many pairs is left
_LOWERED = 1 / 4  # steps of a bound that a tile left with nothing is worth
_FEW = 100  # pairs of a tile below which finer norms are not worked out for them
_BLOCK_ENTRIES = 2_000_000  # entries of the vectors of one block
_BLOCK_ROWS = 4_000  # vectors below which a block is not cut for more tasks
_LEAST_BLOCKS = 8
_LEAST_TASKS = 128  # of the last round, where there are as many meetings
_ROWS, _COLUMNS = 256, 1024  # pairs bounded at once
_ALIKE = 0.05  # vectors of one place
_LEAST_CUT = 8  # vectors on either side of a cut
_LIKE = 4096  # vectors of like size, which are cut into tiles by their place
_NUMBERS = 1 << 20  # numbers of pairs gathered at once
_DENSE = 1 << 22  # numbers of the rows held dense at once
_BOUND_SLACK = 1e-4  # single precision must not lose a pair
_SLACK = 1e-6  # dot products of single precision are nearer than this
_NONE = np.zeros(0, "i8")


class _Block(NamedTuple):
    bag: np.ndarray
    known: np.ndarray
    at: np.ndarray
    rank: np.ndarray
    weight: np.ndarray
    need: np.ndarray | None = None  # terms that a partner has to share
    tile: np.ndarray | None = None  # number of the tile, ascending; the upper bits stand for the size
    place: np.ndarray | None = None  # coordinates, no further from each other than the vectors
    norms: dict[int, tuple[np.ndarray, np.ndarray]] | None = None  # by bound, and for which vectors they are there


def compared(
    vectors: DataFrame,
    threshold: float,
    entries_at_once: int,
    size: tuple[int, int | None] | None = None,
    some: DataFrame | None = None,
) -> DataFrame:
    """``(left, right)`` from ``(bag, known, vector)``; ``vector`` maps ranks to weights and is of length one.

    A bag that is not ``known`` and has a cosine above the threshold with another stands as ``left`` with no
    ``right``, at least once. Pairs nearer to the threshold than ``_SLACK`` are listed as pairs, unless both are known.
    All rounds but the last are run at once. ``size`` is the number of vectors and of their entries, where it is known,
    ``some`` are vectors that tell how to lay all of them out.
    """
    spark = vectors.sparkSession
    rows, entries = size or vectors.agg(F.count(F.lit(1)), F.sum(F.size("vector"))).first()
    blocks = max(min(_LEAST_BLOCKS, 1 + rows // _BLOCK_ROWS), -(-(entries or 0) // _BLOCK_ENTRIES))
    folder = fresh_folder(spark, "blocks")
    pieces = vectors.select(
        "bag",
        "known",
        F.map_keys("vector").alias("rank"),
        F.map_values("vector").cast("array<float>").alias("weight"),
    ).coalesce(blocks)
    write = _write_blocks(folder, 1 + (entries or 0) // blocks, threshold, _directions(vectors.limit(LAID_OUT) if some is None else some))
    written = pieces.mapInArrow(write, "name string").collect()
    names = sorted(r.name for r in written)
    rounds = _rounds(len(names))
    found = None
    for number, meetings in enumerate(rounds):
        last = number == len(rounds) - 1
        new = _met(spark, folder, names, meetings, number, last, threshold, entries_at_once)
        new = new if last else materialise(new, "met")
        found = new if found is None else found.unionByName(new)
    return found


def _directions(vectors: DataFrame) -> np.ndarray:
    """Orthogonal directions along which vectors differ most, judged by a few of them.

    They order the vectors and bound distances; the bounds hold whatever the directions are.
    """
    some = [r.vector for r in vectors.select("vector").collect()]
    dense = np.zeros((len(some), min(1 + max((max(v) for v in some), default=0), _LAID_TERMS)), "f4")
    for row, vector in zip(dense, some):
        inside = [rank for rank in vector if rank < _LAID_TERMS]
        row[inside] = [vector[rank] for rank in inside]
    values, found = np.linalg.eigh((dense @ dense.T).astype("f8"))
    kept = np.flatnonzero(values > 1e-3)[::-1][:_DIRECTIONS]
    return np.linalg.qr((dense.T @ found[:, kept].astype("f4")).astype("f8"))[0]


def _laid_out(block: _Block, directions: np.ndarray) -> np.ndarray:
    """Coordinates of the vectors along the directions, and what is left of their length: no two are further apart in these."""
    along = np.zeros((len(block.bag), directions.shape[1] + 1), "f4")
    for low in range(0, len(along), _COLUMNS):
        rows = np.arange(low, min(low + _COLUMNS, len(along)))
        row, rank, weight = _rows_of(block, rows)
        inside = rank < len(directions)
        row, rank, weight = row[inside], rank[inside], weight[inside].astype("f8")
        for number in range(directions.shape[1]):
            along[rows, number] = np.bincount(row, weights=weight * directions[rank, number], minlength=len(rows))
    along[:, -1] = np.sqrt(np.maximum(1 - (along[:, :-1].astype("f8") ** 2).sum(axis=1), 0))
    return along


def _tiles(size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the vectors and their tiles: those of like size, cut in two where they differ most until tiles are small."""
    order = np.argsort(size, kind="stable")
    likes = np.array_split(order, -(-len(order) // _LIKE)) if len(order) else []
    found, numbers = [], []
    for like, rows in enumerate(likes):
        waiting, number = [rows], 0
        while waiting:
            rows = waiting.pop()
            if len(rows) <= _ROWS:
                found.append(rows)
                numbers.append(np.full(len(rows), like << 16 | number, "i4"))
                number += 1
                continue
            along = place[rows, np.argmax(np.var(place[rows], axis=0))].astype("f8")
            if np.ptp(along) < _ALIKE:
                waiting += np.array_split(rows, -(-len(rows) // _ROWS))[::-1]
                continue
            by = np.argsort(along, kind="stable")
            total = np.cumsum(along[by])
            left = np.arange(1, len(rows))
            apart = (total[-1] * left - total[:-1] * len(rows)) ** 2 / (left * (len(rows) - left))
            cut = _LEAST_CUT + int(np.argmax(apart[_LEAST_CUT - 1 : -_LEAST_CUT]))
            waiting += [rows[by[cut:]], rows[by[:cut]]]
    return (np.concatenate(found), np.concatenate(numbers)) if found else (order, order.astype("i4"))


def _rounds(blocks: int) -> list[list[tuple[int, list[int]]]]:
    """A block and those it meets as one task's work; all meetings, each once, in rounds.

    In all rounds but the last a block has one task of its own.
    """

    def meet(low: int, high: int) -> list[tuple[int, list[int]]]:
        return [(i, [(i + step) % blocks for step in range(low, high)]) for i in range(blocks)]

    made, low = [meet(0, 1)], 1
    while 4 * low < blocks:
        made.append(meet(low, 2 * low))
        low *= 2
    # Half way round, every meeting would come twice.
    rest = [(i, (i + step) % blocks) for i in range(blocks) for step in range(low, blocks // 2 + 1) if 2 * step < blocks or 2 * i < blocks]
    at_once = 1 + len(rest) // _LEAST_TASKS
    last = []
    for i, own in itertools.groupby(rest, key=lambda m: m[0]):
        others = [j for _, j in own]
        last += [(i, others[k : k + at_once]) for k in range(0, len(others), at_once)]
    return [*made, last] if last else made


def _met(
    spark: SparkSession,
    folder: str,
    names: list[str],
    meetings: list[tuple[int, list[int]]],
    number: int,
    last: bool,
    threshold: float,
    entries_at_once: int,
) -> DataFrame:
    """The rows of one round, a task per entry of ``meetings``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, others in (meetings[task] for task in batch.column(0).to_pylist()):
                a = _read(folder, names[i], number)
                for j in others:
                    yield from _compared(a, a if i == j else _read(folder, names[j], number), threshold, entries_at_once)
                if not last:
                    _write_known(folder, names[i], number, a.known)

    return spark.range(0, len(meetings), 1, max(len(meetings), 1)).mapInArrow(compare, "left long, right long")


def _write_blocks(folder: str, size: int, threshold: float, directions: np.ndarray) -> Callable:
    """A file per some ``size`` entries; less than twice as many are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        held, entries = [], 0

        def write() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.arrow"
            table = pa.Table.from_batches(held)
            # Vectors of like size and place stand together: bounds hold or fail for most pairs of a tile.
            block = _block(table)
            place = _laid_out(block, directions)
            order, tile = _tiles(np.diff(block.at), place)
            more = {"need": _needed(block, threshold).astype("i4")[order], "tile": tile}
            more |= {f"place {number}": place[order, number] for number in range(place.shape[1])}
            table = table.take(pa.array(order))
            for name_of, numbers in more.items():
                table = table.append_column(name_of, pa.array(numbers))
            options = pa.ipc.IpcWriteOptions(compression="lz4")
            with system.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_stream(out, table.schema, options=options) as writer:
                writer.write_table(table)
            return pa.record_batch({"name": [name]})

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("rank")).to_numpy(), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(batch)]
            for low, high in itertools.pairwise(cuts):
                if low == high:
                    continue
                held.append(batch.slice(low, high - low))
                entries += int(ends[high - 1] - (ends[low - 1] if low else 0))
                if entries >= size:
                    yield write()
                    held, entries = [], 0
        if held:
            yield write()

    return run


def _read(folder: str, name: str, number: int) -> _Block:
    """A block as it is known when round ``number`` begins."""
    system, path = pa.fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{name}") as file:
        table = pa.ipc.open_stream(file).read_all()
    block = _block(table)
    if number:
        with system.open_input_stream(f"{path}/{name}.{number - 1}") as file:
            block.known[:] = np.frombuffer(file.read(), bool)
    return block


def _block(table: pa.Table) -> _Block:
    rank = table.column("rank").combine_chunks()
    places = [table.column(name).to_numpy() for name in table.column_names if name.startswith("place ")]
    return _Block(
        table.column("bag").to_numpy(),
        np.array(table.column("known").to_numpy()),
        np.concatenate(([0], np.cumsum(rank.value_lengths().to_numpy(), dtype=np.int64))),
        rank.flatten().to_numpy(),
        table.column("weight").combine_chunks().flatten().to_numpy(),
        *[table.column(name).to_numpy() if name in table.column_names else None for name in ("need", "tile")],
        np.stack(places, axis=1) if places else None,
    )


def _write_known(folder: str, name: str, number: int, known: np.ndarray) -> None:
    system, path = pa.fs.FileSystem.from_uri(folder)
    with system.open_output_stream(f"{path}/{name}.{number}") as out:
        out.write(known.tobytes())


def _rows_of(block: _Block, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in ``rows``, rank and weight of each entry."""
    row, entry = _entries(block, rows)
    return row, block.rank[entry], block.weight[entry]


def _entries(block: _Block, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(block.at)[rows]
    first = np.cumsum(sizes) - sizes
    return np.repeat(np.arange(len(rows)), sizes), np.repeat(block.at[rows] - first, sizes) + np.arange(sizes.sum())


def _norms(block: _Block, rows: np.ndarray, groups: int) -> np.ndarray:
    row, rank, weight = _rows_of(block, rows)
    mass = np.bincount(row * groups + rank % groups, weights=weight.astype("f8") ** 2, minlength=len(rows) * groups)
    return np.sqrt(mass).astype("f4").reshape(-1, groups)


def _needed(block: _Block, threshold: float) -> np.ndarray:
    """How many terms a partner above the threshold must share, at least: the heaviest that have that much of the norm."""
    counts = []
    for low in range(0, len(block.bag), _COLUMNS):
        high = min(low + _COLUMNS, len(block.bag))
        row, _, weight = _rows_of(block, np.arange(low, high))
        # One sort of numbers: a row's entries lie between its number and the next, the heaviest first.
        mass = 1 + row - np.sort(1 + row - np.minimum(weight.astype("f8") ** 2, 1))
        total = np.concatenate(([0.0], np.cumsum(mass)))
        at = block.at[low:high] - block.at[low]
        inside = total[1:] - np.repeat(total[at], np.diff(block.at[low : high + 1]))
        counts.append(1 + np.bincount(row, weights=inside < (threshold - _BOUND_SLACK) ** 2, minlength=high - low))
    return np.concatenate(counts)


def _dots(dense: np.ndarray, begin: np.ndarray, b: _Block, j: np.ndarray) -> np.ndarray:
    """Products of rows of ``dense``, which begin at ``begin``, and the vectors ``j``."""
    sizes = np.diff(b.at)[j]
    first = np.cumsum(sizes) - sizes
    entry = np.repeat(b.at[j] - first, sizes)
    entry += np.arange(len(entry))
    at = np.repeat(begin, sizes)
    at += b.rank.take(entry)
    found = dense.take(at)
    found *= b.weight.take(entry)
    return np.add.reduceat(found, first, dtype="f8")


def _bounded(rows: np.ndarray, columns: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs ``i`` and ``j`` those whose bound is above ``least``."""
    step = max(1, _NUMBERS // rows.shape[1])
    above = [np.einsum("ij,ij->i", rows[i[k : k + step]], columns[j[k : k + step]]) > least for k in range(0, len(i), step)]
    kept = np.concatenate(above) if above else np.zeros(0, bool)
    return i[kept], j[kept]


class _Space(NamedTuple):
    """Arrays for the bounds of a tile, used again: fresh ones cost more than the products."""

    bounds: np.ndarray
    above: np.ndarray


def _places(marks: np.ndarray) -> np.ndarray:
    """Where the few ``marks`` are: in most eight at once there is none."""
    whole = len(marks) // 8
    some = np.flatnonzero(marks[: 8 * whole].view("u8"))
    word, place = np.nonzero(marks[: 8 * whole].reshape(-1, 8)[some])
    return np.concatenate((8 * some[word] + place, 8 * whole + np.flatnonzero(marks[8 * whole :])))


def _shaped(flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return flat[: len(x) * len(y)].reshape(len(x), len(y))


def _of(block: _Block, rows: np.ndarray, level: int) -> np.ndarray:
    """Norms of ``rows`` over the groups of a bound."""
    if level >= _KEPT:
        return _norms(block, rows, _GROUPS * _FINE[level])
    if level not in block.norms:
        block.norms[level] = np.empty((len(block.bag), _GROUPS * _FINE[level]), "f4"), np.zeros(len(block.bag), bool)
    norms, there = block.norms[level]
    missing = rows[~there[rows]]
    if len(missing):
        if level == _KEPT - 1:
            norms[missing] = _norms(block, missing, norms.shape[1])
        else:  # pooled from those of the next bound
            mass = _of(block, missing, level + 1) ** 2
            norms[missing] = np.sqrt(mass.reshape(len(missing), -1, norms.shape[1]).sum(axis=1))
        there[missing] = True
    return norms[rows]


def _left(
    a: _Block, rows: np.ndarray, b: _Block, columns: np.ndarray, level: int, least: float, space: _Space
) -> tuple[np.ndarray, np.ndarray, int]:
    """The pairs of places in ``rows`` and ``columns`` whose bound is above ``least``, and the bound that left few of them."""
    while True:
        x, y = _of(a, rows, level), _of(b, columns, level)
        above = np.greater(np.matmul(x, y.T, out=_shaped(space.bounds, x, y)), least, out=_shaped(space.above, x, y))
        left = np.count_nonzero(above)
        if level == len(_FINE) - 1 or left * _FINER[level] <= above.size:
            break
        level += 1
    if not left:
        return _NONE, _NONE, level
    i, j = np.divmod(_places(above.ravel()), above.shape[1])
    for finer in sorted({level + 1, _KEPT - 1} & set(range(level + 1, _KEPT))):
        if len(i) > _FEW:
            i, j = _bounded(_of(a, rows, finer), _of(b, columns, finer), i, j, least)
    return i, j, level


def _compared(a: _Block, b: _Block, threshold: float, entries_at_once: int) -> Iterator[pa.RecordBatch]:
    before = a.known.copy(), b.known.copy()
    own = a is b
    a = _prepared(a, threshold)
    b = a if own else _prepared(b, threshold)
    known = np.flatnonzero(before[0]), np.flatnonzero(before[1])
    rows = np.flatnonzero(~before[0])
    rows = rows if own else np.concatenate((rows, known[0]))
    yield from _part(a, rows, b, np.flatnonzero(~before[1]), own, threshold, entries_at_once)
    # Two vectors known before are of no interest, nor are those that have become known since.
    yield from _part(a, np.flatnonzero(~a.known), b, known[1], False, threshold, entries_at_once)
    for block, known in zip((a,) if own else (a, b), before):
        new = block.bag[block.known & ~known]
        yield pa.record_batch({"left": pa.array(new), "right": pa.nulls(len(new), pa.int64())})


def _prepared(block: _Block, threshold: float) -> _Block:
    if block.norms is not None:
        return block
    number = np.arange(len(block.bag))
    return block._replace(
        need=_needed(block, threshold) if block.need is None else block.need,
        tile=number // _ROWS if block.tile is None else block.tile,
        place=np.zeros((len(number), 1), "f4") if block.place is None else block.place,
        norms={},
    )


class _Tiles:
    """Rows of a block by tile, and what all rows of a tile have in common."""

    def __init__(self, block: _Block, rows: np.ndarray):
        number = block.tile[rows]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        self.rows = np.split(rows, first[1:])
        self.like = number[first] >> 16
        self.longest = np.maximum.reduceat(np.diff(block.at)[rows], first)
        self.need = np.minimum.reduceat(block.need[rows], first)
        self.low = np.minimum.reduceat(block.place[rows], first)
        self.high = np.maximum.reduceat(block.place[rows], first)

    def near(self, other: _Tiles, tile: int, threshold: float) -> np.ndarray:
        """Which tiles may have vectors that are a partner of one in a tile of ``other``."""
        gap = np.maximum(np.maximum(self.low - other.high[tile], other.low[tile] - self.high), 0)
        shared = (self.longest >= other.need[tile]) & (self.need <= other.longest[tile])
        return shared & ((gap.astype("f8") ** 2).sum(axis=1) <= 2 - 2 * threshold + _PLACE_SLACK)


def _part(
    a: _Block, in_a: np.ndarray, b: _Block, in_b: np.ndarray, own: bool, threshold: float, entries_at_once: int
) -> Iterator[pa.RecordBatch]:
    """Compares the vectors ``in_a`` with those ``in_b``, in one block (``own``) each pair once, and marks the known ones."""
    if not len(in_a) or not len(in_b):
        return
    width = 1 + int(max(a.rank.max(), b.rank.max()))
    tiles, others = _Tiles(a, in_a), _Tiles(b, in_b)
    size_b = np.diff(b.at)
    step = max(16, min(_ROWS, _DENSE // width))
    space = _Space(np.empty(step * _COLUMNS, "f4"), np.empty(step * _COLUMNS, bool))
    dense = np.zeros(step * width, "f4")
    # The bound to begin with by size of the columns: longer rows mostly need one as fine.
    begin: dict[int, float] = {}
    for tile, low in ((tile, low) for tile, rows in enumerate(tiles.rows) for low in range(0, len(rows), step)):
        own_rows, filled = tiles.rows[tile][low : low + step], None
        if tile and tiles.like[tile] < tiles.like[tile - 1]:
            begin.clear()
        near = others.near(tiles, tile, threshold)
        if own:
            near[:tile] = False
        chosen = np.flatnonzero(near)
        if len(chosen) and a.known[own_rows].all():
            chosen = np.array([k for k in chosen if not b.known[others.rows[k]].all()], int)
        together = [
            (like, columns[k : k + _COLUMNS])
            for like, group in itertools.groupby(chosen.tolist(), key=lambda k: int(others.like[k]))
            for columns in [np.concatenate([others.rows[k] for k in group])]
            for k in range(0, len(columns), _COLUMNS)
        ]
        for like, own_columns in together:
            level = begin.get(like, 0.0)
            i, j, reached = _left(a, own_rows, b, own_columns, math.ceil(level), threshold - _BOUND_SLACK, space)
            # After some tiles that are left with nothing a coarser bound is tried again.
            level = reached if reached > level else level - _LOWERED * (not len(i))
            begin[like] = min(max(level, 0), _KEPT - 1)
            if not len(i):
                continue
            if filled is None:
                row, rank, weight = _rows_of(a, own_rows)
                filled = row * width + rank
                dense[filled] = weight
            wanted = _open(a, b, own_rows[i], own_columns[j], own)
            i, j = i[wanted], j[wanted]
            part = np.cumsum(size_b[own_columns[j]]) // entries_at_once
            for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(part)) + 1):
                at = at[_open(a, b, own_rows[i[at]], own_columns[j[at]], own)]
                if not len(at):
                    continue
                x, y = own_rows[i[at]], own_columns[j[at]]
                cosine = _dots(dense, i[at] * width, b, y)
                sure = cosine > threshold + _SLACK
                a.known[x[sure]] = True
                b.known[y[sure]] = True
                unsure = np.abs(cosine - threshold) <= _SLACK
                x, y = x[unsure], y[unsure]
                wanted = _open(a, b, x, y, own)
                if wanted.any():
                    yield pa.record_batch({"left": pa.array(a.bag[x[wanted]]), "right": pa.array(b.bag[y[wanted]])})
        if filled is not None:
            dense[filled] = 0


def _open(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, own: bool) -> np.ndarray:
    """Which of the pairs have one vector that is not known yet; in one block each pair once."""
    wanted = ~(a.known[i] & b.known[j])
    return wanted & (i < j) if own else wanted
