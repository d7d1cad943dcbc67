"""Chat formatting: conversations rebuilt from an event log, then rendered with a loss mask."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Strings with a meaning to chat templates. The rendered turn is OPEN role newline text CLOSE newline; inside roles and texts
#: a backslash is doubled and a control string gets a backslash after its first character.
OPEN, CLOSE = "<s>", "</s>"
CONTROL = (OPEN, CLOSE, "[INST]", "[/INST]")
LEARNED = "assistant"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_MARK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE) + "\n", re.DOTALL)

RENDERED = "conv_id long, turn long, role string, rendered string, loss_begin long, loss_end long"


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn and its loss mask as code points [begin, end): the text of the learned role."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    end = len(head) + len(body) if role == LEARNED else len(head)
    return f"{head}{body}{CLOSE}\n", len(head), end


def parse(rendered: str) -> tuple[str, str]:
    m = _TURN.fullmatch(rendered)
    return unescape(m[1]), unescape(m[2])


def fold(events):
    """Messages (conversation, role, text) from (conversation, message, sequence, kind, role, text), sorted by the first three.

    message: a new message, even under a used number. delta: appended to the message. edit: replaces its text.
    regenerate: replaces its text and voids all that was said before in later messages. Deltas and edits
    without a message start one. Holds one message at a time, whatever the length of a conversation.
    """
    conv, number, role, text = object(), None, None, None
    cut = own = None  # the last regeneration in messages before this one, and in this one
    for c, m, seq, kind, r, t in events:
        if c != conv or m != number:
            if text is not None:
                yield conv, role, "".join(text)
            cut = None if c != conv else own if cut is None else cut if own is None else max(cut, own)
            conv, number, role, text, own = c, m, None, None, None
        if cut is not None and (seq is None or seq < cut):
            continue
        if kind == "message" and text is not None:
            yield conv, role, "".join(text)
            text = None
        if text is None or kind in ("edit", "regenerate"):
            text = []
        if kind == "regenerate" and seq is not None:
            own = seq if own is None else max(own, seq)
        role = r if r is not None else role
        text.append(t or "")
    if text is not None:
        yield conv, role, "".join(text)


def format_conversations(events: DataFrame) -> DataFrame:
    """Render an event log: one row for each final message, ``conv_id, turn, role, rendered, loss_begin, loss_end``.

    ``events`` has conv_id, message_id, seq (long), kind, role, text. The log is partitioned by conversation and
    sorted by message and sequence; each task folds and renders its sorted rows as a stream, so a conversation with a third of all
    rows needs one task's time but no memory beyond a message and a batch. The rendered conversation is the
    concatenation of its rows in order of ``turn`` (from 0); loss bounds are code points of ``rendered``. A null role is an empty one, a
    null text is empty, a null conversation is one of its own, a null message or sequence comes first; equal
    keys are ordered by kind, role and text. Other columns are ignored. Rows of a partition stay sorted.
    """
    keys = ["conv_id", "message_id", "seq", "kind", "role", "text"]

    def rows(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches):
        conv, turn, out, size = object(), 0, [], 0
        for c, role, text in fold(rows(batches)):
            turn = turn + 1 if c == conv else 0
            conv = c
            rendered, begin, end = render(role or "", text)
            out.append((c, turn, role or "", rendered, begin, end))
            size += len(rendered)
            if size > 2_000_000 or len(out) >= 5_000:
                yield _batch(out, RENDERED)
                out, size = [], 0
        if out:
            yield _batch(out, RENDERED)

    return events.select(*keys).repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(run, RENDERED)


_KIND = {"long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KIND[k]) for i, k in enumerate(kinds)], names=names)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Read rendered turns back: for each conversation the turns and the text under the loss mask, as counts and SHA-256.

    Takes :func:`format_conversations`' result as it is (its partitions hold whole conversations, in order) and streams it.
    """

    def run(batches):
        conv, state, out = object(), None, []

        def close():
            n, turns, chars, loss, total = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for b in batches:
            for c, _, _, rendered, begin, end in zip(*(x.to_pylist() for x in b.columns)):
                if c != conv:
                    if state:
                        out.append(close())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(rendered)
                learned = unescape(rendered[begin:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(rendered)
            if out:
                yield _batch(out, _DIGEST)
                out = []
        if state:
            yield _batch([close()], _DIGEST)

    return formatted.mapInArrow(run, _DIGEST)


def message_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the event log of a session that streamed and corrected them.

    Turns are numbered in order of turn, role and text. By turns a message is sent whole; begun and continued by a delta; drafted, replaced by
    an edit and continued; or drafted, answered by a message that its regeneration then voids, regenerated and continued. The final messages
    are the turns; a null text is empty.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("message_id", (F.row_number().over(order) - 1).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substr("text", half + 1)
    kind, number = F.col("message_id") % 4, F.col("message_id")

    def event(when, k, name, text, message=number, role=F.lit(None).cast("string")):
        return F.when(when, F.struct(message.alias("message_id"), (8 * number + k).alias("seq"), F.lit(name).alias("kind"), role.alias("role"), text.alias("text")))

    begun, drafted = kind <= 1, kind >= 2
    role = F.coalesce("role", F.lit(""))
    events = F.array(
        event(begun, 0, "message", F.when(kind == 0, F.col("text")).otherwise(head), role=role),
        event(drafted, 0, "message", F.concat(F.lit("draft "), tail), role=role),
        event(kind == 3, 1, "message", F.lit("an answer to the draft"), message=number + 1, role=F.lit(LEARNED)),
        event(kind == 2, 2, "edit", head),
        event(kind == 3, 2, "regenerate", head),
        event(kind >= 1, 3, "delta", tail),
    )
    return rows.select("conv_id", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("conv_id", "e.*")
