"""Chat formatting with any template, observed from outside.

A template is a function from a list of turns ``(role, text)`` to a string and is
never looked into. Rendering the first one, two, three ... turns and comparing
consecutive outputs gives each turn's span: what the output gained. If an
output does not begin with the one before, the template rewrites history, and
the conversation is marked with the first turn at which it did. Where the text
lies within its turn is found by rendering the turn once more with a marker as
its text.

Rows are dealt out by conversation and sorted, and each task walks through its rows
holding one conversation at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# A private character stands for a turn's text when its place is looked for.
MARKER = "\ue000"
ESCAPED = re.compile(r"[\\#<:]")


def escape(text: str) -> str:
    """Puts a backslash before each character that a control string needs."""
    return ESCAPED.sub(r"\\\g<0>", text)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: a heading with the role, the text, and an end mark. The
    heading's ``### `` and the mark's ``</`` can't occur in an escaped text."""
    return "".join(f"### {escape(role)}: {escape(text)}</turn>\n" for role, text in turns)


# What reads a turn of the default template back, as Java regular expressions.
HEADING = r"(?s)^### ((?:[^\\:]|\\.)*): "
ESCAPE = r"(?s)\\(.)"


def render_incrementally(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """The output, for each turn its span and the span of its text in it, and the
    first turn at which the template changed what it had written before."""
    output, spans = "", []
    for k in range(1, len(turns) + 1):
        longer = template(turns[:k])
        if not longer.startswith(output):
            return template(turns), [], k - 1
        probe = template([*turns[: k - 1], (turns[k - 1][0], MARKER)])
        at = probe.rfind(MARKER, len(output))
        tail = len(probe) - at - len(MARKER)
        # A template may leave a turn's text out.
        text = (at, len(longer) - tail) if at >= 0 else (len(longer), len(longer))
        spans.append((len(output), len(longer), *text))
        output = longer
    return output, spans, None


def format_conversations(
    turns: DataFrame,
    template: Template = marked_turns,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """``(conv_id, n_turns, formatted, spans, loss, rewritten_from)``, one row per conversation.

    ``spans`` has each turn's ``role``, its place ``first`` to ``last`` in ``formatted`` and
    that of its text, ``text_first`` to ``text_last`` (ends excluded). ``loss`` holds the
    text places of the trained role, in order. ``rewritten_from`` is null, or the
    turn at which the template rewrote history; then there are no spans and no loss.

    Turns go by number, then role, then text, so ties and repeated rows have one
    order and each is a turn; a null number comes first. A null role or text is
    empty. Rows with a null conversation form one conversation with a null id.
    Other columns are ignored, and an empty table gives no rows.
    """
    kind = turns.schema[conv_col].dataType
    id_type = to_arrow_type(kind)
    chosen = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    span = pa.struct([("role", pa.string()), *[(c, pa.int64()) for c in ("first", "last", "text_first", "text_last")]])
    loss = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
        current, held, begun = None, [], False
        for batch in batches:
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if begun and conv != current:
                    yield current, held
                    held = []
                current, begun = conv, True
                held.append((role, text))
        if begun:
            yield current, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for conv, turns in conversations(batches):
            output, spans, rewritten = render_incrementally(turns, template)
            placed = [
                {"role": role, "first": a, "last": b, "text_first": c, "text_last": d}
                for (role, _), (a, b, c, d) in zip(turns, spans)
            ]
            trained = [{"first": s["text_first"], "last": s["text_last"]} for s in placed if s["role"] == trained_role]
            rows.append((conv, len(turns), output, placed, trained, rewritten))
            held += len(output)
            if held > 1 << 22:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.list_(span), pa.list_(loss), pa.int64()]
        names = ["conv_id", "n_turns", "formatted", "spans", "loss", "rewritten_from"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return ordered.select("conv_id", "role", "text").mapInArrow(
        run,
        f"conv_id {kind.simpleString()}, n_turns long, formatted string, spans array<struct<role: string, first: long, last: long, "
        "text_first: long, text_last: long>>, loss array<struct<first: long, last: long>>, rewritten_from long",
    )
