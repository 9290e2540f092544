"""Steps that add, rename, drop, split and combine columns."""

from __future__ import annotations

from dataclasses import replace
from typing import Any, Callable, Sequence

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import StepError
from tablewash.functions import cells
from tablewash.functions.cells import Cell
from tablewash.functions.text import split_text
from tablewash.operators.steps import Step
from tablewash.table import FILL, Row, Table

NewColumn = tuple[str, str]


def derive_column(column_id: str, name: str, expression: Callable[[Row], Any] | Any) -> Step:
    """Append one column. ``expression`` is a function of the row or a constant."""

    def run(table: Table) -> Table:
        clean = table.check_new(column_id, name)
        row = Row(table)
        value = cells.scalar("derive_column", expression(row) if callable(expression) else expression)
        return table.with_new({column_id: (clean, value)}, row.stage(table.df))

    return Step("deriveColumn", run)


def drop_columns(column_ids: Sequence[str]) -> Step:
    """Drop columns and their fills; at least one column must remain."""

    def run(table: Table) -> Table:
        table.check_targets(column_ids)
        if len(column_ids) >= len(table.columns):
            raise StepError("emptySchema", "at least one column must remain")
        kept = table.protect(column_ids)
        dropped = [c for c in column_ids] + [FILL + c for c in column_ids if c in kept.fills]
        return replace(
            kept,
            df=kept.df.drop(*dropped),
            columns=tuple(c for c in kept.columns if c.id not in column_ids),
            fills=kept.fills - set(column_ids),
        )

    return Step("dropColumns", run)


def rename_column(column_id: str, name: str) -> Step:
    """Change the display name; the column id stays."""

    def run(table: Table) -> Table:
        table.column(column_id)
        clean = table.check_name(name, ignoring=column_id)
        renamed = tuple(replace(c, name=clean) if c.id == column_id else c for c in table.columns)
        return replace(table, columns=renamed)

    return Step("renameColumn", run)


def _check_all_new(table: Table, outputs: Sequence[NewColumn]) -> list[NewColumn]:
    clean: list[NewColumn] = []
    for column_id, name in outputs:
        checked = table.check_new(column_id, name)
        if column_id in [i for i, _ in clean]:
            raise StepError("duplicateColumnId", f"column {column_id!r} is created twice")
        if checked.lower() in [n.lower() for _, n in clean]:
            raise StepError("nameConflict", f"display name {checked!r} is used twice")
        clean.append((column_id, checked))
    return clean


def split_column(column_id: str, delimiter: str, outputs: Sequence[NewColumn]) -> Step:
    """Split text on a literal delimiter into two or more new columns.

    Missing parts are null; the last column takes the unsplit remainder.
    """

    def run(table: Table) -> Table:
        source = table.column(column_id)
        if source.type not in ("string", "unknown"):
            raise StepError("incompatibleType", f"column {column_id!r} is {source.type} and cannot be split")
        if not delimiter:
            raise StepError("invalidDelimiter", "the delimiter must not be empty")
        if len(outputs) < 2:
            raise StepError("invalidExpression", "a split needs at least two output columns")
        clean = _check_all_new(table, outputs)
        parts = split_text(F.col(column_id), delimiter, len(clean))
        row = Row(table)
        bound = row.bind(Cell(parts, "string", T.ArrayType(T.StringType())))
        added = {
            new_id: (name, Cell(F.get(bound.col, F.lit(i)), source.type, T.StringType()))
            for i, (new_id, name) in enumerate(clean)
        }
        return table.with_new(added, row.stage(table.df))

    return Step("splitColumn", run)


def combine_columns(column_ids: Sequence[str], separator: str, column_id: str, name: str) -> Step:
    """Join columns as text, left to right, skipping null and empty values."""

    def run(table: Table) -> Table:
        table.check_targets(column_ids, at_least=2)
        clean = table.check_new(column_id, name)
        row = Row(table)
        parts = [F.nullif(cells.text(row[c]), F.lit("")) for c in column_ids]
        joined = Cell(F.concat_ws(separator, *parts), "string", T.StringType())
        return table.with_new({column_id: (clean, joined)})

    return Step("combineColumns", run)


def comment(text: str) -> Step:
    """A note inside a step list; changes nothing."""
    return Step("comment", lambda table: table)
