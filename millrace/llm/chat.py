r"""Chat formatting from an event log: fold events into final messages, render them, read the format back.

Events: conv, msg, copy (optional, tells messages of one number apart), seq, op, role, text. `start` opens a message with its role, `delta` appends to it,
`edit` replaces its text, `regenerate` empties it so that the deltas after it count, `delete` drops
it. The log is partitioned by conversation, sorted by sequence and folded in one pass that holds the
conversation's open messages. A conversation of more than SHARD messages is dealt out in shards of
neighbouring messages, so it spreads over tasks and none holds more than a shard. Messages are rendered one by one into segments; a
conversation's formatted text is its segments in order. Only the reading back of digests walks a
conversation in order, as a stream that holds one segment.

Template: `<s>[INST] text [/INST]` for users, ` text </s>` for assistants (text under the loss mask),
`<<ROLE role>> text <</ROLE>>` for all others. Inside roles and texts every `\`, `<` and `[` gets a
`\` before it, so no control string can occur there and unescaping restores the text.

Defined cases: null texts are empty, a null role is the empty role; events of equal seq are taken by
op, role, text; events that repeat are each applied, messages of one number are told apart by `copy`; a message without
`start` has the empty role; a null conversation id is a conversation of its own; ids must be integers; messages
of any length are held one at a time; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, tidy

#: The template's control strings.
USER, ASSISTANT, OTHER = ("<s>[INST] ", " [/INST]"), (" ", " </s>"), ("<<ROLE ", ">> ", " <</ROLE>>")
SEGMENT = re.compile(  # each text takes the space before the mark that ends it along; nothing is ever tried twice
    r"<s>\[INST\] (?P<user>[^\\<\[]*+(?:\\.[^\\<\[]*+)*+)\[/INST\]"
    r"|<<ROLE (?P<role>[^\\<\[>]*+(?:\\.[^\\<\[>]*+)*+)>> (?P<other>[^\\<\[]*+(?:\\.[^\\<\[]*+)*+)<</ROLE>>"
    r"| (?P<assistant>[^\\<\[]*+(?:\\.[^\\<\[]*+)*+)</s>",
    re.DOTALL,
)
SHARD = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"\\$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\<\[>])", r"\\$1")


def unescape(text: str) -> str:
    """The other way round: no escaped character stands alone in `text`, so the backslashes, doubled, may come last."""
    for mark in "<[>\\":
        text = text.replace("\\" + mark, mark)
    return text


def fold(events: DataFrame) -> DataFrame:
    """(conv, msg, copy, role, text) of the messages that the log leaves, by a streamed fold over each conversation's events in sequence."""

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, {}
        for b in batches:
            out = []
            for conv, shard, msg, copy, op, who, text in zip(*(column(b, n).to_pylist() for n in ("conv", "shard", "msg", "copy", "op", "role", "text")), strict=True):
                if (conv, shard) != at:
                    out += closed(at, open_)
                    at, open_ = (conv, shard), {}
                message = open_.setdefault((msg, copy), ["", [], True])
                if op == "start":
                    message[0] = who or ""
                elif op == "delta":
                    message[1].append(text or "")
                elif op == "edit":
                    message[1] = [text or ""]
                elif op == "regenerate":
                    message[1] = []
                elif op == "delete":
                    message[2] = False
                else:
                    raise ValueError(f"unknown event: {op}")
            yield batch_of(out)
        yield batch_of(closed(at, open_))

    def closed(at: tuple | None, messages: dict) -> list[tuple]:
        return [(at[0], msg, copy, role, "".join(parts)) for (msg, copy), (role, parts, alive) in messages.items() if alive]

    def batch_of(rows: list) -> pa.RecordBatch:
        names = ["conv", "msg", "copy", "role", "text"]
        cols = list(zip(*rows, strict=True)) or [[] for _ in names]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    copy = (F.col("copy") if "copy" in events.columns else F.lit(0)).cast("int")
    shard = F.floor((F.coalesce("msg", F.lit(0)) + F.abs(F.coalesce(copy, F.lit(0)))) / SHARD)
    log = events.select("conv", shard.alias("shard"), "msg", copy.alias("copy"), "seq", "op", "role", "text")
    ordered = log.repartition("conv", "shard").sortWithinPartitions("conv", "shard", "seq", "msg", "copy", "op", "role", "text")
    return ordered.mapInArrow(run, "conv long, msg long, copy int, role string, text string")


def render(messages: DataFrame) -> DataFrame:
    """`messages` plus segment: the formatted text of each message."""
    text = escape(F.coalesce("text", F.lit("")))
    role = F.coalesce("role", F.lit(""))
    wrap = lambda marks, *inner: F.concat(*[x for m, t in zip(marks, (*inner, None), strict=True) for x in ([F.lit(m)] if t is None else [F.lit(m), t])])
    segment = (
        F.when(role == "user", wrap(USER, text))
        .when(role == "assistant", wrap(ASSISTANT, text))
        .otherwise(wrap(OTHER, escape_role(role), text))
    )
    return messages.withColumn("segment", segment)


def parse(segment: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in formatted text; raises if anything else is in it."""
    at = 0
    while at < len(segment):
        m = SEGMENT.match(segment, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        at = m.end()
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "other" else kind
        if m[kind][-1:] != " ":
            raise ValueError(f"no space ends the text of the turn before character {at}")
        yield role, unescape(m[kind][:-1])


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation what its formatted text holds: turns, their digest, the text under the loss mask, characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = (), None
        for b in batches:
            out = []
            for conv, segment in zip(column(b, "conv").to_pylist(), column(b, "segment").to_pylist(), strict=True):
                if (conv,) != at:
                    if state:
                        out.append(close(at[0], state))
                    at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(segment)
            yield batch_of(out)
        yield batch_of([close(at[0], state)] if state else [])

    def close(conv: int | None, s: list) -> tuple:
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch_of(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    ordered = segments.select("conv", "msg", "copy", "segment").repartition("conv").sortWithinPartitions("conv", "msg", "copy")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
