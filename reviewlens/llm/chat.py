"""Conversations from event logs, and their training format.

``reconstruct`` folds the events of each message in order; ``render`` writes conversations in a template
with a loss mask; ``parse`` reads the template back. All of it is native expressions.

Template: ``### Label: text</turn>`` and a line break per turn. ``</turn>``, ``### `` (three number signs and
a blank) and, in labels, ``: `` cannot occur inside: after doubling every backslash, one backslash is put into
each of them. Runs of backslashes from the text are even, so a single one marks exactly these places, and
reading back is a plain replacement in the opposite order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "conv_id bigint, message_id bigint, seq bigint, kind string, role string, text string"
_HEAD, _END = "### ", "</turn>\n"
_CONTROLS = (("</turn>", "<\\/turn>"), ("### ", "###\\ "))
_IN_LABELS = ((": ", ":\\ "),)
_LABELS = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}


def _empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def escape(text: Column, more: tuple = ()) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, marked in (*_CONTROLS, *more):
        out = F.replace(out, F.lit(plain), F.lit(marked))
    return out


def unescape(text: Column, more: tuple = ()) -> Column:
    for plain, marked in reversed((*_CONTROLS, *more)):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def role_label(role: Column) -> Column:
    """Label of a role: a name for the usual ones, ``@`` and the escaped role for others, nothing for null."""
    label = F.when(role.isNull(), "")
    for name, shown in _LABELS.items():
        label = label.when(role == name, shown)
    return label.otherwise(F.concat(F.lit("@"), escape(role, _IN_LABELS)))


def label_role(label: Column) -> Column:
    role = F.when(label == "", F.lit(None).cast("string"))
    for name, shown in _LABELS.items():
        role = role.when(label == shown, name)
    return role.otherwise(unescape(F.substr(label, F.lit(2)), _IN_LABELS))


def reconstruct(events: DataFrame) -> DataFrame:
    """``(conv_id, message_id, seq, role, text)``: the final form of every message, ``seq`` its first event's.

    Events of a message apply in the order of ``seq`` (any orderable type; nulls first, ties by kind, role,
    text): ``message`` and ``edit`` replace the text, ``delta`` appends to it, ``regenerate`` empties it and
    appends its own text, later deltas follow. Other kinds change nothing. The last role that is not null
    counts; null texts are empty. Null conversation and message ids are ids like any other. A message is
    the unit of a task, so a conversation of any length folds in parallel.
    """
    event = F.struct("seq", "kind", "role", "text")
    folded = events.groupBy("conv_id", "message_id").agg(
        F.sort_array(F.collect_list(event)).alias("log"), F.min(F.struct(F.col("seq"))).alias("first")
    )
    replaces = ("message", "edit", "regenerate")

    def step(state: Column, e: Column) -> Column:
        text = F.when(e["kind"].isin(*replaces), _empty(e["text"])).when(
            e["kind"] == "delta", F.concat(state["text"], _empty(e["text"]))
        )
        return F.struct(
            F.coalesce(e["role"], state["role"]).alias("role"), F.coalesce(text, state["text"]).alias("text")
        )

    start = F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))
    final = F.aggregate("log", start, step)
    return folded.withColumn("final", final).select(
        "conv_id", "message_id", F.col("first.seq").alias("seq"), F.col("final.role").alias("role"), F.col("final.text").alias("text")
    )


def render(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans)`` from messages in the order of ``seq`` (ties by role and text).

    ``loss_spans`` holds code point ranges, end exclusive, of the escaped texts of the ``learned`` role, and
    the number of the turn each lies in.
    Escaping and lengths are worked out per message; where each message starts is a running sum, so no
    array is built element by element. The formatted string is one value by definition and has to fit in a row.
    """
    head = F.concat(F.lit(_HEAD), role_label(F.col("role")), F.lit(": "))
    pieces = messages.select("conv_id", "seq", "role", head.alias("head"), escape(_empty(F.col("text"))).alias("body"))
    pieces = pieces.withColumn("width", F.length("head") + F.length("body") + len(_END))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "body")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.select(
        "conv_id",
        F.row_number().over(order).alias("at"),
        F.concat("head", "body", F.lit(_END)).alias("piece"),
        F.when(F.col("role") == learned, F.sum("width").over(running) - len(_END)).alias("end"),
        F.length("body").alias("length"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", "piece", "end", "length")))
    whole = placed.groupBy("conv_id").agg(ordered.alias("pieces"))
    spans = F.transform(
        F.filter("pieces", lambda p: p["end"].isNotNull()),
        lambda p: F.struct((p["end"] - p["length"]).alias("start"), p["end"].alias("end"), (p["at"] - 1).alias("turn")),
    )
    return whole.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), spans.alias("loss_spans"))


def _parts(formatted: Column) -> Column:
    """The turns of a formatted conversation without their end marks."""
    parts = F.split(formatted, _END)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation, escapes undone."""

    def read(part: Column) -> Column:
        body = F.substr(part, F.lit(len(_HEAD) + 1))
        cut = F.instr(body, ": ")
        return F.struct(
            label_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 2)).alias("text")
        )

    return F.transform(_parts(formatted), read)


def learned_text(parts: Column, spans: Column) -> Column:
    """All text under the loss mask, escapes undone, in order, nothing between.

    ``parts`` are the formatted turns. A span ends where its turn ends, so it is cut from that turn alone and
    the work stays linear in the conversation.
    """

    def cut(span: Column) -> Column:
        part = F.get(parts, span["turn"])
        size = (span["end"] - span["start"]).cast("int")
        return unescape(F.substr(part, F.length(part) - size + 1, size))

    return F.array_join(F.transform(spans, cut), "")


def chat_digests(rendered: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read back from ``render``'s output."""
    read = rendered.select(
        "conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"), _parts(F.col("formatted")).alias("parts")
    ).withColumn("learned", learned_text(F.col("parts"), F.col("loss_spans")))
    lines = F.transform("turns", lambda t: F.concat(_empty(t["role"]), F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def turn_events(turns: DataFrame) -> DataFrame:
    """An event log of finished turns ``(conv_id, turn, role, text)``.

    A turn of the assistant becomes two deltas, as a model streams it, any other one message. Each row is a
    message of its own, even where rows are equal.
    """
    text = _empty(F.col("text"))
    half = F.floor(F.length(text) / 2).cast("int")

    def event(part: int, kind: str, words: Column) -> Column:
        seq = F.struct(F.col("turn").alias("turn"), F.lit(part).alias("part"))
        return F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), F.col("role").alias("role"), words.alias("text"))

    streamed = F.array(
        event(0, "delta", F.substr(text, F.lit(1), half)), event(1, "delta", F.substr(text, half + 1))
    )
    events = F.when(F.col("role") == "assistant", streamed).otherwise(F.array(event(0, "message", text)))
    # Numbered before the split, so that both halves carry the same number.
    numbered = turns.select("conv_id", F.monotonically_increasing_id().alias("message_id"), events.alias("events"))
    return numbered.select("conv_id", "message_id", F.explode("events").alias("event")).select("conv_id", "message_id", "event.*")
