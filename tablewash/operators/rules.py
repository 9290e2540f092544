"""The scoped rule: conditional rewriting and colouring of cells."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any, Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.errors import StepError
from tablewash.functions import cells, colors
from tablewash.functions.cells import Cell
from tablewash.operators.steps import Step
from tablewash.table import FILL, ColumnInfo, Row, Table

KEEP = object()
# What is counted of a rule, in cells.
METRICS = ("matched_cell_count", "value_changed_cell_count", "format_changed_cell_count", "changed_cell_count")
Expression = Callable[[Row, Cell], Any]


@dataclass(frozen=True)
class Patch:
    """A new value, a fill colour, or both. ``value`` is a function of the row
    and the current cell, or a constant (None sets the cell to null)."""

    value: Expression | Any = KEEP
    fill: str | None = None


@dataclass(frozen=True)
class Case:
    when: Expression
    then: Patch


@dataclass(frozen=True)
class _Target:
    """One targeted column while its rule is being planned."""

    info: ColumnInfo
    kind: str
    spark: Any
    value: str
    matched: str
    fill: str


def _at(expression: Any, row: Row, value: Cell) -> Cell:
    return cells.scalar("scoped rule", expression(row, value) if callable(expression) else expression)


class ScopedRule(Step):
    """Cases run top to bottom and every matching case applies, each seeing the
    value left by the ones before it; the default applies when none matched.
    Other columns are read as they were before the step."""

    def __init__(
        self,
        column_ids: Sequence[str],
        cases: Sequence[Case] = (),
        default: Patch | None = None,
        where: Callable[[Row], Any] | None = None,
    ):
        super().__init__("scopedRule", self._apply)
        self.column_ids = list(column_ids)
        self.cases = list(cases)
        self.default = default
        self.where = where
        self.patches = [c.then for c in self.cases] + ([default] if default else [])

    # --- planning ------------------------------------------------------------

    def _result_type(self, row: Row, info: ColumnInfo):
        """The type shared by every value the rule may leave in the cell."""
        current = row[info.id]
        values = [_at(p.value, row, current) for p in self.patches if p.value is not KEEP]
        keeps = (
            self.where is not None
            or self.default is None
            or self.default.value is KEEP
            or any(c.then.value is KEEP for c in self.cases)
        )
        branches = values + ([current] if keeps else [])
        if not values:
            return current.type, current.spark
        kind = cells.merge_types([b.type for b in branches], f"rule on column {info.id!r}")
        return kind, cells.common_spark_type(branches, kind)

    def _check(self, table: Table) -> None:
        for patch in self.patches:
            if patch.value is KEEP and patch.fill is None:
                raise StepError("invalidExpression", "a patch needs a value or a fill")
            if patch.fill is not None:
                colors.normalize_fill(patch.fill)
        table.check_targets(self.column_ids)

    def _staged(self, table: Table) -> tuple[DataFrame, list[_Target]]:
        """The input with hidden columns for each target's running value, match
        flag and fill: one projection per case, which keeps the plan linear in
        the number of cases. The targets themselves are not touched yet."""
        self._check(table)
        targets = []
        for i, info in enumerate(table.check_targets(self.column_ids)):
            kind, spark_type = self._result_type(Row(table), info)
            targets.append(_Target(info, kind, spark_type, f"__value{i}", f"__matched{i}", f"__newfill{i}"))
        row = Row(table)
        eligible = None
        if self.where is not None:
            test = cells.truthy(cells.boolean_arg("scoped rule", self.where(row)))
            eligible = row.bind(test).col if self.cases else test.col
        df = row.stage(table.df)
        states = {t.info.id: (row[t.info.id], F.lit(False), table.fill(t.info.id)) for t in targets}
        for case in self.cases + ([None] if self.default is not None else []):
            row = row.next()
            if case is not None:
                stage = self._stage_case(row, case, eligible, targets, states)
            else:
                stage = self._stage_default(row, eligible, targets, states)
            df = row.stage(df).withColumns(stage)
        return df, targets

    def _patch(self, row: Row, target: _Target, patch: Patch, hit: Column, value: Cell, fill: Column):
        changes = {}
        if patch.value is not KEEP:
            new = cells.coerce(_at(patch.value, row, value), target.kind, target.spark)
            old = cells.coerce(value, target.kind, target.spark)
            changes[target.value] = F.when(hit, new).otherwise(old)
        if patch.fill is not None:
            changes[target.fill] = F.when(hit, F.lit(colors.normalize_fill(patch.fill))).otherwise(fill)
        return changes

    def _advance(self, target: _Target, changes: dict, states: dict) -> None:
        value, matched, fill = states[target.info.id]
        if target.value in changes:
            value = Cell(F.col(target.value), target.kind, target.spark)
        if target.fill in changes:
            fill = F.col(target.fill)
        if target.matched in changes:
            matched = F.col(target.matched)
        states[target.info.id] = (value, matched, fill)

    def _stage_case(self, row, case, eligible, targets, states) -> dict[str, Column]:
        stage: dict[str, Column] = {}
        for target in targets:
            value, matched, fill = states[target.info.id]
            hit = cells.truthy(cells.boolean_arg("scoped rule", _at(case.when, row, value))).col
            hit = hit if eligible is None else eligible & hit
            changes = self._patch(row, target, case.then, hit, value, fill)
            changes[target.matched] = matched | hit
            self._advance(target, changes, states)
            stage.update(changes)
        return stage

    def _stage_default(self, row, eligible, targets, states) -> dict[str, Column]:
        stage: dict[str, Column] = {}
        for target in targets:
            value, matched, fill = states[target.info.id]
            open_cell = ~matched if self.cases else F.lit(True)
            hit = open_cell if eligible is None else eligible & open_cell
            changes = self._patch(row, target, self.default, hit, value, fill)
            changes[target.matched] = F.lit(True) if eligible is None else eligible
            self._advance(target, changes, states)
            stage.update(changes)
        return stage

    # --- applying --------------------------------------------------------------

    def _apply(self, table: Table) -> Table:
        table = table.protect(self.column_ids)
        df, targets = self._staged(table)
        return self._finish(table, df, targets)

    def _finish(self, table: Table, df: DataFrame, targets: list[_Target], counters: dict[str, Column] | None = None) -> Table:
        valued = {t.info.id: t for t in targets if t.value in df.columns}
        filled = {t.info.id: t for t in targets if t.fill in df.columns}
        fills = table.fills | set(filled)
        hidden = [n for n in table.hidden_names() if not n.startswith(FILL)]
        selected = [F.col(valued[c].value).alias(c) if c in valued else F.col(c) for c in table.ids]
        selected += [F.col(n) for n in hidden]
        for c in sorted(fills):
            selected.append(F.col(filled[c].fill).alias(FILL + c) if c in filled else F.col(FILL + c))
        columns = tuple(
            replace(c, type=valued[c.id].kind, spark=valued[c.id].spark) if c.id in valued else c
            for c in table.columns
        )
        counters = counters or {}
        selected += [value.alias(n) for n, value in counters.items()]
        carried = table.carried + tuple(counters)
        return replace(table, df=df.select(*selected), columns=columns, fills=fills, carried=carried)

    # --- metrics -----------------------------------------------------------------

    def _counts(self, table: Table, df: DataFrame, targets: list[_Target]) -> list[Column]:
        """How many cells of a row are matched, get another value, another fill, or either."""
        matched, valued, filled, changed = [], [], [], []
        no, one = F.lit(False), lambda test: test.cast("bigint")
        for t in targets:
            old = cells.coerce(Row(table)[t.info.id], t.kind, t.spark)
            value = ~F.col(t.value).eqNullSafe(old) if t.value in df.columns else no
            fill = ~F.col(t.fill).eqNullSafe(table.fill(t.info.id)) if t.fill in df.columns else no
            matched.append(one(F.col(t.matched) if t.matched in df.columns else no))
            valued.append(one(value))
            filled.append(one(fill))
            changed.append(one(value | fill))
        return [sum(parts[1:], parts[0]) for parts in (matched, valued, filled, changed)]

    def counted(self, table: Table, names: Sequence[str], gone: str) -> Table:
        """The table after the rule, with its counts as carried columns ``names``: 0 in
        rows that the flag ``gone`` marks as removed."""
        table = table.protect(self.column_ids)
        df, targets = self._staged(table)
        counts = self._counts(table, df, targets)
        nothing = F.lit(0).cast("bigint")
        return self._finish(table, df, targets, {n: F.when(F.col(gone), nothing).otherwise(c) for n, c in zip(names, counts)})

    def metrics(self, table: Table) -> DataFrame:
        """One row with the number of cells this rule matches and changes."""
        df, targets = self._staged(table)
        totals = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")) for c in self._counts(table, df, targets)]
        return df.agg(*[t.alias(n) for t, n in zip(totals, METRICS)])


def scoped_rule(
    column_ids: Sequence[str],
    cases: Sequence[Case] = (),
    default: Patch | None = None,
    where: Callable[[Row], Any] | None = None,
) -> ScopedRule:
    return ScopedRule(column_ids, cases, default, where)
