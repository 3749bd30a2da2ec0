"""Chat formatting from event logs (operator 10).

A log row is an event of one message: ``message`` (or null, or any unknown kind)
sets role and text, ``delta`` adds to the text, ``edit`` replaces the text,
``regenerate`` drops it so that later deltas build it anew (its own text, if any,
comes first). Events are partitioned by message, sorted by sequence and folded
into the final message; messages are partitioned by conversation, sorted and
rendered turn by turn. Both passes stream through a sorted partition and hold one
message at a time, so a conversation of any number of turns needs no more memory.

Template: ``<|turn|>role<|text|>text<|end|>`` and a line feed. Inside roles and
texts every ``<|`` gets a backslash (``<\\|``), and ``<\\|`` one more, and so on, so
that no mark can be written by a text and the texts come back exactly.

Defined results: null roles and texts are empty; a null conversation id is a
conversation of its own; null turns come first; rows that tie in conversation,
turn and tie are one message and folded in the order of sequence, kind, role, text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import prepare_python

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED = "assistant"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_MESSAGE = "conv_id long, turn long, tie long, role string, text string"
_SEGMENT = "conv_id long, turn long, tie long, segment string, loss_from long, loss_to long"


def escape(s: str) -> str:
    return _MARK.sub(r"<\1\\|", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"<\1|", s)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where in it the loss mask begins and ends (equal: no loss)."""
    head, body = TURN + escape(role) + TEXT, escape(text)
    end = len(head) + len(body)
    return f"{head}{body}{END}\n", len(head) if role == LEARNED else end, end


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    if not segment.startswith(TURN) or not segment.endswith(END + "\n"):
        raise ValueError("not a rendered turn")
    role, _, text = segment[len(TURN):-len(END) - 1].partition(TEXT)
    return unescape(role), unescape(text)


def _sorted_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def final_messages(events: DataFrame) -> DataFrame:
    """Events (conv_id, turn, tie, seq, kind, role, text) folded into one row a message."""
    prepare_python(events.sparkSession)
    log = events.select(*(F.col(c).cast("long") for c in ("conv_id", "turn", "tie", "seq")), *(F.col(c).cast("string") for c in ("kind", "role", "text")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, role, text = None, "", []
        done: list[tuple] = []

        def rows() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [[]] * 5
            done.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["conv_id", "turn", "tie", "role", "text"])

        for b in batches:
            for conv, turn, tie, _, kind, r, t in zip(*(c.to_pylist() for c in b.columns)):
                if now != (conv, turn, tie):
                    if now:
                        done.append((*now, role, "".join(text)))
                    now, role, text = (conv, turn, tie), "", []
                if kind == "delta":
                    role = r or role
                    text.append(t or "")
                else:
                    role = (r or role) if kind in ("edit", "regenerate") else r or ""
                    text = [t or ""]
            if done:
                yield rows()
        if now:
            done.append((*now, role, "".join(text)))
        yield rows()

    return _sorted_by(log, ["conv_id", "turn", "tie"], "seq", "kind", "role", "text").mapInArrow(fold, _MESSAGE)


def format_conversations(events: DataFrame) -> DataFrame:
    """One rendered segment a turn (conv_id, turn, tie, segment, loss_from, loss_to): the
    formatted conversation is its segments in the order of turn and tie."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render(r, t) for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            seg, a, z = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(seg, pa.string()), pa.array(a, pa.int64()), pa.array(z, pa.int64())],
                                             ["conv_id", "turn", "tie", "segment", "loss_from", "loss_to"])

    return _sorted_by(final_messages(events), ["conv_id"], "turn", "tie").mapInArrow(draw, _SEGMENT)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from the rendered segments: number and digest of the turns, length
    and digest of the text under the loss mask, and the formatted length."""
    prepare_python(segments.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, now, n, turns, loss_n, loss, size = False, None, 0, None, 0, None, 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            rows = []
            for conv, _, _, segment, a, z in zip(*(c.to_pylist() for c in b.columns)):
                if not started or conv != now:
                    if started:
                        rows.append((now, n, turns.hexdigest(), loss_n, loss.hexdigest(), size))
                    started, now, n, turns, loss_n, loss, size = True, conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                role, text = parse(segment)
                turns.update(f"{role}\n{text}\n".encode())
                learned = unescape(segment[a:z])
                loss.update(learned.encode())
                n, loss_n, size = n + 1, loss_n + len(learned), size + len(segment)
            yield batch(rows)
        if started:
            yield batch([(now, n, turns.hexdigest(), loss_n, loss.hexdigest(), size)])

    ordered = _sorted_by(segments.select("conv_id", "turn", "tie", "segment", "loss_from", "loss_to"), ["conv_id"], "turn", "tie")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log: one ``message`` event a row; rows of one turn stay apart."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return (conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
            .withColumn("tie", F.row_number().over(same).cast("long"))
            .select("conv_id", "turn", "tie", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text"))
