r"""Repair of conversation structure by dynamic programming over a shared grammar.

A turn becomes one of 16 symbols: its role initial (``s``, ``u``, ``a`` or another) with its fault (none, blank,
duplicate, truncated). A conversation is the string of its symbols. The cheapest edits that give role initials
``(s?(ua)+)?`` come from an automaton of four states (nothing yet, after s, after u, after a): a symbol is a 4 x 4
matrix over (min, +) whose entries hold the least cost from state to state and, as a rope, the edits of it. Of
equal costs the ASCII-least edits stay. Edits of equal cost over the same turns are never one the beginning of the
other (further inserts would cost more), so comparing them before they are joined is right, and the matrices form
a monoid: a product may be taken in any grouping.

Re-Pair over the distinct strings of all conversations replaces the most frequent pairs of neighbours by new
symbols. The matrix of a rule is the product of its two sides, worked out once, bottom-up, on the driver and
shared by all conversations; a conversation multiplies the matrices of the few symbols that are left. Counting
pairs and replacing them is Spark's work; only the most frequent pairs of a round come to the driver.

Rows of a conversation pass through a task in order, one batch at a time; what is held is the string of symbols,
a character per row, and the edits, as many. Its hash is sequential, so the rows of one conversation are one task's
work, however many they are; texts are never held together.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.names import unused
from reviewlens.sources.scratch import materialise

# Costs of edits; keeping is free.
_REROLE, _DELETE, _INSERT, _TRUNCATED = 3, 4, 3, 3
_BLANKS = " \t\n\x0b\f\r"
_NONE, _IS_BLANK, _IS_DUPLICATE, _IS_TRUNCATED = range(4)
_ROLES = "sua"
# Terminals are the letters from a to p, rules the characters from here on.
_FIRST_RULE = 0x4E00
# Bounds of the grammar, not of the result: rules per round, and rounds.
_RULES, _ROUNDS = 16, 24
# Ropes up to this length are plain strings.
_LEAF = 64
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """An immutable text that shares its parts; equal texts have equal digests."""

    __slots__ = ("digest", "left", "length", "right", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.length = len(text)
            self.digest = reduce(lambda h, c: (h * _BASE + ord(c)) % _PRIME, text, 0)
        else:
            self.length = left.length + right.length
            self.digest = (left.digest * pow(_BASE, right.length, _PRIME) + right.digest) % _PRIME

    def __add__(self, other: Rope) -> Rope:
        if not other.length:
            return self
        if not self.length:
            return other
        if self.length + other.length <= _LEAF:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a is b or (a.length, a.digest) == (b.length, b.digest):
                continue
            if a.text is not None and b.text is not None:
                both = min(a.length, b.length)
                if a.text[:both] != b.text[:both]:
                    return a.text < b.text
                mine += [Rope(a.text[both:])] if a.length > both else []
                theirs += [Rope(b.text[both:])] if b.length > both else []
            elif b.text is not None or (a.text is None and a.length >= b.length):
                mine += [a.right, a.left]
                theirs.append(b)
            else:
                mine.append(a)
                theirs += [b.right, b.left]
        return bool(theirs)

    def __str__(self) -> str:
        parts, rest = [], [self]
        while rest:
            node = rest.pop()
            if node.text is None:
                rest += [node.right, node.left]
            else:
                parts.append(node.text)
        return "".join(parts)


# An entry is None or (cost, edits); a matrix is four rows of four entries.
Matrix = list[list[tuple[int, Rope] | None]]


def _better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def product(a: Matrix, b: Matrix) -> Matrix:
    """First ``a``, then ``b``: the best way over any state between."""
    made: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            for k in range(4):
                if a[i][k] and b[k][j]:
                    cost = a[i][k][0] + b[k][j][0]
                    if made[i][j] is None or cost <= made[i][j][0]:
                        made[i][j] = _better(made[i][j], (cost, a[i][k][1] + b[k][j][1]))
    return made


def _steps(role: str) -> list[tuple[int, int]]:
    """State changes when a turn of this role comes out."""
    return {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}.get(role, [])


def _inserts() -> Matrix:
    """The fewest inserts from state to state."""
    one: Matrix = [[(0, Rope("")) if i == j else None for j in range(4)] for i in range(4)]
    for role in "ua":
        for i, j in _steps(role):
            one[i][j] = (_INSERT, Rope("I"))
    return product(one, one)


def _turn(role: str, fault: int) -> Matrix:
    """One turn: any inserts before it, then its own edit."""
    own: Matrix = [[(_DELETE, Rope("D")) if i == j else None for j in range(4)] for i in range(4)]
    if fault in (_NONE, _IS_TRUNCATED):
        extra = _TRUNCATED if fault == _IS_TRUNCATED else 0
        for target in "ua":
            for i, j in _steps(target):
                own[i][j] = _better(own[i][j], (_REROLE + extra, Rope("R")))
        for i, j in _steps(role):
            own[i][j] = _better(own[i][j], (extra, Rope("K")))
    return product(_inserts(), own)


def symbol(initial: str, fault: int) -> str:
    """The terminal of a turn."""
    role = _ROLES.index(initial) if initial and initial in _ROLES else 3
    return chr(ord("a") + 4 * role + fault)


def transfer_matrices(rules: list[str]) -> dict[str, Matrix]:
    """One matrix per terminal and per rule; rule number i stands for the pair ``rules[i]``."""
    found = {symbol(role, fault): _turn(role, fault) for role in "sua?" for fault in range(4)}
    for i, (left, right) in enumerate(rules):
        found[chr(_FIRST_RULE + i)] = product(found[left], found[right])
    return found


def cheapest(symbols: str, rules: list[str], matrices: dict[str, Matrix]) -> tuple[int, str]:
    """Least cost and ASCII-least edits of a string of terminals. Nothing costs nothing."""
    if not symbols:
        return 0, ""
    for i, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(_FIRST_RULE + i))
    level = [matrices[c] for c in symbols]
    while len(level) > 1:  # pairwise, so that ropes stay flat
        level = [product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    whole = product(level[0], _inserts())
    cost, edits = _better(whole[0][0], whole[0][3])
    return cost, str(edits)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("symbols").to_pylist():
            counts.update(a + b for a, b in zip(text, text[1:], strict=False))
    yield pa.RecordBatch.from_pydict({"pair": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})


def shared_grammar(strings: DataFrame, rounds: int = _ROUNDS, per_round: int = _RULES) -> list[str]:
    """Re-Pair over the distinct values of ``symbols``: the pair of every rule, in order.

    A round takes the most frequent pairs that share no symbol, so that replacing one leaves the others as they
    were, and ends the work when no pair occurs twice. Ties go to the pair of lower code points.
    """
    strings = materialise(strings.select("symbols").where("length(symbols) > 1").distinct(), "strings")
    rules: list[str] = []
    for _ in range(rounds):
        counted = strings.mapInArrow(_pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * per_round).collect()
        taken: list[str] = []
        for row in best:
            if len(taken) < per_round and not set(row.pair) & set("".join(taken)):
                taken.append(row.pair)
        if not taken:
            break
        shorter = F.col("symbols")
        for pair in taken:
            shorter = F.replace(shorter, F.lit(pair), F.lit(chr(_FIRST_RULE + len(rules))))
            rules.append(pair)
        strings = materialise(strings.select(shorter.alias("symbols")).where("length(symbols) > 1"), "strings")
    return rules


def _turns(turns: DataFrame) -> DataFrame:
    """Nulls as one space, the digest of role and text, and whether a turn is blank or truncated."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # The length tells where the role ends.
    named = F.concat_ws(":", F.length("role").cast("string"), "role", "text")
    last = F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1))
    fault = F.when(last == "", _IS_BLANK).when(last.isin(".", "!", "?"), _NONE).otherwise(_IS_TRUNCATED)
    return rows.withColumns({"digest": F.unhex(F.sha2(named, 256)), "fault": fault})


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its marker row and its turns, in order."""
    now: dict | None = None
    letters: list[str] = []
    before: str | None = None
    low = high = None
    turns = 0

    def closed() -> dict:
        return now | {"gaps": high - low + 1 - turns if turns else 0, "symbols": "".join(letters)}

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if not row["is_turn"]:
                done += [closed()] if now else []
                now = {"conv_id": row["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                letters, before, low, high, turns = [], None, None, None, 0
                continue
            if (turn := row["turn"]) is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            fault, initial = row["fault"], row["initial"]
            if row["repeated"] and fault != _IS_BLANK:
                fault = _IS_DUPLICATE
            if fault:
                now[("blank", "duplicate", "truncated")[fault - 1]] += 1
            now["illegal"] += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            letters.append(symbol(initial, fault))
        if done:
            yield pa.RecordBatch.from_pylist(done, _string_schema(batch))
        last = batch
    if now:
        yield pa.RecordBatch.from_pylist([closed()], _string_schema(last))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _string_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([("conv_id", batch.schema.field("conv_id").type), *((name, pa.int64()) for name in _COUNTS), ("symbols", pa.string())])


def _key_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def fault_strings(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, symbols)``, one row per conversation.

    Conversations are those of ``turns`` and, where given, of ``ids``; one without turns has zeros and no symbols.
    Turns are taken by ``turn``, nulls first, those of one turn by role and digest; equal rows stand together.
    """
    rows = _turns(turns)
    narrow = rows.select("conv_id", F.lit(True).alias("is_turn"), "turn", "role", "digest", "fault")
    known = turns.select("conv_id") if ids is None else ids.select("conv_id").unionByName(turns.select("conv_id"))
    marks = known.distinct().selectExpr("conv_id", "false as is_turn", "null as turn", "null as role", "null as digest", "null as fault")
    # One exchange by conversation serves the window and the order.
    dealt = narrow.unionByName(marks).repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "is_turn", "digest").orderBy(F.asc_nulls_first("turn"))
    marked = dealt.withColumn("repeated", F.row_number().over(earlier) > 1)
    ordered = marked.sortWithinPartitions("conv_id", "is_turn", F.asc_nulls_first("turn"), "role", "digest", "repeated")
    passed = ordered.select("conv_id", "is_turn", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "repeated")
    counts = ", ".join(f"{name} long" for name in _COUNTS)
    return passed.mapInArrow(_strings, f"conv_id {_key_type(turns)}, {counts}, symbols string")


def _audited(rules: list[str], matrices: dict[str, Matrix]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = lru_cache(1 << 14)(lambda symbols: cheapest(symbols, rules, matrices))
        for batch in batches:
            solved = [solve(text) for text in batch.column("symbols").to_pylist()]
            made = batch.drop_columns(["symbols"]).append_column("cost", pa.array([cost for cost, _ in solved], pa.int64()))
            yield made.append_column("audit", pa.array([audit for _, audit in solved], pa.string()))

    return run


def audits(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)``, one row per conversation.

    ``audit`` has the initials of the cheapest edits in order: Keep, Rerole, Delete, Insert. Null roles and texts
    count as one space; a role is known by its first character. A null id is a conversation too. An empty table
    gives none. Columns besides ``conv_id``, ``turn``, ``role`` and ``text`` are not read.
    """
    strings = materialise(fault_strings(turns, ids), "strings")
    rules = shared_grammar(strings)
    schema = strings.drop("symbols").schema.add("cost", "long").add("audit", "string")
    return strings.mapInArrow(_audited(rules, transfer_matrices(rules)), schema)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, str | None, str | None]]:
    """``(conversation, None, None)`` for every conversation, followed by ``(None, role, text)`` for its turns."""
    audit, at, before = "", 0, ""

    def inserted() -> Iterator[tuple[None, str, str]]:
        nonlocal at, before
        while at < len(audit) and audit[at] == "I":
            role = "assistant" if before == "u" else "user"
            at, before = at + 1, role[0]
            yield None, role, ""

    for batch in batches:
        for row in batch.to_pylist():
            yield from inserted()
            if not row["is_turn"]:
                audit, at, before = row["audit"], 0, ""
                yield row, None, None
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                role = row["role"] if edit == "K" else "assistant" if before == "u" else "user"
                before = role[0]
                yield None, role, row["text"]
    yield from inserted()


def _with_audits(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """Every conversation's row of ``audited``, followed by its turns in the order of :func:`fault_strings`."""
    rows = _turns(turns).drop("fault")
    blank: dict[str, Column] = {name: F.lit(None).cast(audited.schema[name].dataType) for name in audited.columns if name != "conv_id"}
    rows = rows.withColumns(blank | {"is_turn": F.lit(True)})
    heads = audited.withColumns({name: F.lit(None).cast(rows.schema[name].dataType) for name in ("turn", "role", "text", "digest")} | {"is_turn": F.lit(False)})
    order = ["conv_id", "is_turn", F.asc_nulls_first("turn"), "role", "digest"]
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order)


def repaired_turns(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: the repaired conversations, positions from 0. ``audited`` is from :func:`audits`."""
    schema = f"conv_id {_key_type(turns)}, position long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [("conv_id", first.schema.field("conv_id").type), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())]

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        out: list[dict] = []
        conversation, position = None, 0
        for head, role, text in _edited(every()):
            if head:
                conversation, position = head["conv_id"], 0
                continue
            out.append({"conv_id": conversation, "position": position, "role": role, "text": text})
            position += 1
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, pa.schema(types))
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema(types))

    return _with_audits(turns, audited).mapInArrow(run, schema)


def repair_digests(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows of ``audited`` with ``repaired_sha256``, of the repaired ``role:text`` joined by newlines."""
    names = audited.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []
        head, digest, lines = None, None, 0

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([*(batch.schema.field(name) for name in names), ("repaired_sha256", pa.string())])
                yield batch

        def closed() -> dict:
            return {name: head[name] for name in names} | {"repaired_sha256": digest.hexdigest()}

        for row, role, text in _edited(typed()):
            if row:
                out += [closed()] if head else []
                head, digest, lines = row, hashlib.sha256(), 0
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
                continue
            digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
            lines += 1
        if head:
            yield pa.RecordBatch.from_pylist([*out, closed()], schema)

    return _with_audits(turns, audited).mapInArrow(run, audited.schema.add("repaired_sha256", "string"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by the checksum of ``conv_id:turn``, a null being one space.

    Of 20 remainders, 0 drops a turn, 1 empties its text, 2 removes its marks of sentence end, 3 repeats it and 4
    makes it the user's.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")))
    kind = unused(turns, "kind")
    rows = turns.select("conv_id", "turn", "role", "text", (F.crc32(F.encode(key, "UTF-8")) % 20).alias(kind)).where(F.col(kind) != 0)
    text = F.coalesce("text", F.lit(" "))
    changed = F.when(F.col(kind) == 1, "").when(F.col(kind) == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col(kind) == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    rows = rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), kind)
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col(kind) == 3, 2).otherwise(1)))
    return rows.withColumn(kind, times).drop(kind)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Damage every conversation, repair it and report: the columns of :func:`audits` and ``repaired_sha256``.

    Repeated rows are turns of their own and so duplicates. A conversation that lost all its turns has zeros, an
    empty audit and the hash of an empty text.
    """
    turns = damaged(conversations)
    audited = materialise(audits(turns, conversations), "audits")
    return repair_digests(turns, audited)
