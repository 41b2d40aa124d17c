"""Personal data: patterns, and information-theoretic sanitisation of terms that reveal it.

Patterns find the protected entities: mail addresses, IP addresses, card and phone numbers. The corpus then
tells which terms give them away. For an entity c and a term t near it, t discloses the share
``PMI(c; t) / IC(c)`` of c's information, with ``PMI = ln(p(c|t) / p(c))`` and ``IC = -ln p(c)``, from the
documents that hold t and the distinct contexts in which t stands near c. A term whose share reaches
``alpha`` is sanitised wherever it stands: generalised to its class where one is known, else removed.

Copies of a passage are one context, so a page copied thousands of times makes none of its words revealing.
Three passes read the texts: entities with contexts, document counts of candidate terms, places of
revealing terms. Between them only terms travel. What tasks need to know about terms is a bit table of fixed
size; its false positives end in an exact join.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from reviewlens.sources.scratch import materialise

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Bits of the term table: a megabyte, whatever the corpus.
_BITS = 1 << 23
# Words on either side of an entity that make its context.
_REACH = 8
# Partial counts a task holds before it hands them on.
_HELD = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match of digits always starts a run of digits; the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the longest run before an at sign that no earlier match holds."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def find_entities(text: str | None) -> list[Span]:
    """``(kind, start, end)`` of the pattern matches in a text, by kind, then start; none for null.

    Matches per kind are leftmost and do not overlap; those that fail their check are dropped, not retried.
    """
    if not text:
        return []
    found = [("email", *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _contexts(text: str, spans: list[Span]) -> Iterator[tuple[str, int, str]]:
    """``(entity, context, term)`` for the words around each entity; other entities are no terms."""
    covered = sorted((start, end) for _, start, end in spans)
    for kind, start, end in spans:
        around = [m[0].lower() for m in _WORD.finditer(text, max(0, start - 40 * _REACH), start)][-_REACH:]
        after: list[str] = []
        for m in _WORD.finditer(text, end, min(len(text), end + 40 * _REACH)):
            if len(after) == _REACH:
                break
            after.append(m[0].lower())
        words = around + after
        context = zlib.crc32(" ".join(words).encode("utf-8", "replace"))
        # Only entities near this one can hold its words; a text full of entities stays linear.
        first = bisect.bisect_left(covered, (start - 60 * _REACH, 0))
        last = bisect.bisect_right(covered, (start + 60 * _REACH, 0))
        hidden = {w.lower() for a, b in covered[first:last] for w in _WORD.findall(text[a:b])}
        for term in sorted(set(words) - hidden):
            yield f"{kind}:{text[start:end]}", context, term


def _bit(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % _BITS


def _entities_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its entity spans and the contexts around them."""
    for batch in batches:
        spans, contexts = [], []
        for text in batch.column("text").to_pylist():
            found = find_entities(text)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            contexts.append([{"entity": e, "context": c, "term": t} for e, c, t in _contexts(text or "", found)])
        made = {name: batch.column(name) for name in batch.schema.names if name != "text"}
        made["spans"] = pa.array(spans, pa.list_(_SPAN))
        made["contexts"] = pa.array(contexts, pa.list_(_CONTEXT))
        yield pa.RecordBatch.from_pydict(made)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CONTEXT = pa.struct([("entity", pa.string()), ("context", pa.int64()), ("term", pa.string())])
_PLACES_DDL = (
    "text_key struct<hash: bigint, crc: bigint, length: int>,"
    " places array<struct<term: string, start: bigint, end: bigint>>"
)
_SPAN_DDL = "array<struct<kind: string, start: bigint, end: bigint>>"


def _counts_pass(table: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _Bits(table)
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(t for t in {w.lower() for w in _WORD.findall(text or "")} if t in bits)
                if len(counts) > _HELD:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    return run


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


class _Bits:
    """Membership in a bit table, with the answers for recent terms at hand."""

    def __init__(self, table: bytes) -> None:
        self._table = np.frombuffer(zlib.decompress(table), dtype=np.uint8)
        self._known: dict[str, bool] = {}

    def __contains__(self, term: str) -> bool:
        answer = self._known.get(term)
        if answer is None:
            if len(self._known) > _HELD:
                self._known.clear()
            at = _bit(term)
            answer = self._known[term] = bool(self._table[at >> 3] >> (at & 7) & 1)
        return answer


def _places_pass(table: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _Bits(table)
        for batch in batches:
            places = []
            for text in batch.column("text").to_pylist():
                found = [(m[0].lower(), *m.span()) for m in _WORD.finditer(text or "") if m[0].lower() in bits]
                places.append([{"term": t, "start": s, "end": e} for t, s, e in found])
            made = {name: batch.column(name) for name in batch.schema.names if name != "text"}
            made["places"] = pa.array(places, pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_pydict(made)

    return run


def _bit_table(terms: DataFrame) -> bytes | None:
    """The terms' bits, compressed; None for no terms. At most ``_BITS`` numbers reach the driver."""
    at = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(_BITS))
    numbers = terms.select(at.alias("at")).distinct().toArrow().column("at").to_numpy()
    if not len(numbers):
        return None
    table = np.zeros(_BITS, dtype=np.uint8)
    table[numbers] = 1
    return zlib.compress(np.packbits(table, bitorder="little").tobytes())


def _text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("hash"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.length(text).alias("length"))


def entities(df: DataFrame, keys: list[Column], text: str) -> DataFrame:
    """The key columns, ``spans`` and ``contexts`` of every row."""
    narrow = df.select(*keys, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text")
    schema += f", spans {_SPAN_DDL}, contexts array<struct<entity: string, context: bigint, term: string>>"
    return narrow.mapInArrow(_entities_pass, schema)


def revealing_terms(df: DataFrame, found: DataFrame, text: str, alpha: float = 0.9, support: int = 4) -> DataFrame:
    """``(term, class)`` of the terms that disclose at least ``alpha`` of an entity's information.

    An entity counts only with ``support`` distinct contexts, a term only if it stands in so many of them.
    ``class`` is the kind of the entity most disclosed. Of the texts with a term or an
    entity copies count once.
    """
    contexts = found.select("text_key", F.explode("contexts").alias("c")).select("text_key", "c.*").distinct()
    texts = contexts.select("entity", "term", "text_key").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    places = contexts.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"))
    near = materialise(places.where(F.col("contexts") >= support).join(texts, ["entity", "term"]).drop("contexts"), "near")
    candidates = near.select("term").distinct()
    table = _bit_table(candidates)
    if table is None:
        return near.select("term", F.lit("").alias("class")).limit(0)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = df.select(_text_key(body).alias("text_key"), body.alias("text"))
    counted = keyed.dropDuplicates(["text_key"]).select("text").mapInArrow(_counts_pass(table), "term string, n bigint")
    holders = counted.groupBy("term").agg(F.sum("n").alias("n"))
    entity_sizes = contexts.select("entity", "text_key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("size"))
    documents = df.count()  # with copies: at most more terms count as revealing
    p_entity = F.least(F.col("size") / F.lit(float(documents)), F.lit(1.0))
    p_given = F.least(F.col("both") / F.col("n"), F.lit(1.0))
    share = F.log(p_given / p_entity) / -F.log(p_entity)
    scored = near.join(holders, "term").join(entity_sizes, "entity").where(p_entity < 1).withColumn("share", share)
    return (
        scored.where(F.col("share") >= alpha)
        .groupBy("term")
        .agg(F.max(F.struct("share", F.substring_index("entity", ":", 1).alias("class")))["class"].alias("class"))
    )


def _places(df: DataFrame, text: str, terms: DataFrame, table: bytes) -> DataFrame:
    """``(text_key, extra)``: the places of revealing terms per distinct text. Copies of a text count once."""
    body = F.coalesce(F.col(text), F.lit(""))
    places = df.select(_text_key(body).alias("text_key"), body.alias("text")).mapInArrow(_places_pass(table), _PLACES_DDL)
    single = places.select("text_key", F.explode("places").alias("p")).select("text_key", "p.*").distinct()
    kind = F.concat(F.lit(f"{TERM}-"), "class").alias("kind")
    sure = single.join(terms, "term").select("text_key", F.struct("start", "end", kind).alias("span"))
    in_order = F.transform(F.sort_array(F.collect_list("span")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return materialise(sure.groupBy("text_key").agg(in_order.alias("extra")), "extra")


def all_spans(df: DataFrame, keys: list[Column], text: str = "text", **options) -> DataFrame:
    """The key columns, ``base`` and ``extra`` spans of every row.

    ``extra`` are the places of revealing terms that no base span touches, in order.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = _text_key(body).alias("text_key")
    found = materialise(entities(df, [*keys, key], text), "entities")
    terms = materialise(revealing_terms(df, found, text, **options), "terms")
    table = _bit_table(terms)
    base = found.drop("contexts").withColumnRenamed("spans", "base")
    if table is None:
        return base.withColumn("extra", F.array().cast(_SPAN_DDL)).drop("text_key")
    grouped = _places(df, text, terms, table)
    clear = F.filter(
        F.coalesce("extra", F.array().cast(_SPAN_DDL)),
        lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    return base.join(grouped, "text_key", "left").withColumn("extra", clear).drop("text_key")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def pii_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row per row of ``df``.

    ``spans`` lists base spans by kind and start, then revealing terms as ``term-<kind>``, likewise; offsets are code
    points. A null text is empty and has none. Repeated rows stay; other columns are not read.
    """
    spans = all_spans(df, [F.col(doc_id).alias("doc_id")], text, **options)
    counts = [_count(kind).alias(f"n_{kind}") for kind in KINDS]
    listed = _listed(F.col("base"))
    kinds = F.array(*[F.lit(f"{TERM}-{kind}") for kind in KINDS])
    placed = F.transform("extra", lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    every = F.array_join(F.filter(F.array(listed, _listed(F.array_sort(placed))), lambda x: x != ""), ",")
    return spans.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), every.alias("spans"))


def _cleaned(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] < at:  # inside or across a span already replaced: that one grows
            at = max(at, span["end"])
            continue
        out += [text[at : span["start"]], f"[{span['kind'].upper()}]"]
        at = span["end"]
    return "".join([*out, text[at:]])


def _replace_pass(table: bytes | None) -> Callable:
    """Replaces entities and, if ``terms`` names any for the row, the places of revealing terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            extra = batch.column("extra").to_pylist() if table else [None] * len(texts)
            cleaned = []
            for text, terms in zip(texts, extra, strict=True):
                spans = [{"kind": k, "start": s, "end": e} for k, s, e in find_entities(text)]
                spans += [s for s in terms or [] if not any(b["start"] < s["end"] and s["start"] < b["end"] for b in spans)]
                cleaned.append(_cleaned(text, spans) if spans else text)
            made = {name: batch.column(name) for name in batch.schema.names if name != "extra"}
            made["text"] = pa.array(cleaned, pa.string())
            yield pa.RecordBatch.from_pydict(made)

    return run


def sanitised(df: DataFrame, text: str = "text", length: str | None = "n_chars", **options) -> DataFrame:
    """The rows of ``df`` with entities replaced by ``[KIND]`` and revealing terms by ``[TERM-KIND]``.

    All columns stay, whatever their names; ``length``, if it is among them, holds the new number of code points. Null
    texts and repeated rows stay; copies of a text are changed alike.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = materialise(entities(df, [_text_key(body).alias("text_key")], text).where(F.size("contexts") > 0), "entities")
    terms = materialise(revealing_terms(df, found, text, **options), "terms")
    table = _bit_table(terms)
    packed = df.select(F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row"), _text_key(body).alias("text_key"))
    if table is None:
        packed = packed.drop("text_key")
    else:
        grouped = _places(df, text, terms, table)
        packed = packed.join(grouped, "text_key", "left").drop("text_key")
    schema = packed.drop("extra").schema
    clean = packed.mapInArrow(_replace_pass(table), schema)
    columns = []
    for c in df.columns:
        if c == text:
            columns.append(F.col("text").alias(c))
        elif c == length:
            columns.append(F.coalesce(F.length("text").cast(df.schema[c].dataType), F.col("row")[c]).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return clean.select(*columns)
