"""Steps that filter, deduplicate and order rows."""

from __future__ import annotations

from dataclasses import replace
from typing import Any, Callable, Sequence

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewash.errors import StepError
from tablewash.functions import cells
from tablewash.operators.steps import Step
from tablewash.table import OrderKey, Row, Table


# Parts that the rows of a key are dealt into where none of them is cut.
DEALS = 64


class FilterRows(Step):
    """Keeps or drops the rows where a condition holds; null is false."""

    def __init__(self, mode: str, condition: Callable[[Row], Any]):
        super().__init__("filterRows", self._apply)
        self.mode = mode
        self.condition = condition

    def _tested(self, table: Table):
        if self.mode not in ("keep", "drop"):
            raise StepError("invalidExpression", f"mode {self.mode!r} is neither keep nor drop")
        row = Row(table)
        test = cells.truthy(cells.boolean_arg("filter_rows", self.condition(row)))
        return row.stage(table.df), test

    def _apply(self, table: Table) -> Table:
        staged, test = self._tested(table)
        # A filter reads null as false, so the form that Spark can push into
        # the scan serves for keeping; dropping needs the two-valued form.
        kept = (test.where if test.where is not None else test.col) if self.mode == "keep" else ~test.col
        return replace(table, df=staged.filter(kept).select(*table.ids, *table.hidden_names()))

    def marked(self, table: Table, flag: str) -> Table:
        """Set the carried column ``flag`` on the rows to remove, and keep them."""
        staged, test = self._tested(table)
        gone = F.col(flag) | (~test.col if self.mode == "keep" else test.col)
        marked = staged.withColumn(flag, gone)
        return replace(table, df=marked.select(*table.ids, *table.hidden_names()))


def filter_rows(mode: str, condition: Callable[[Row], Any]) -> Step:
    """``keep`` or ``drop`` the rows where the condition holds; null is false."""
    return FilterRows(mode, condition)


class DeduplicateRows(Step):
    """Keeps the first row, in current row order, of each combination of keys."""

    def __init__(self, column_ids: Sequence[str]):
        super().__init__("deduplicateRows", self._apply)
        self.column_ids = list(column_ids)

    def _apply(self, table: Table) -> Table:
        table.check_targets(self.column_ids)
        window = Window.partitionBy(*self.column_ids).orderBy(*table.order_columns())
        ranked = table.df.withColumn("__rank", F.row_number().over(window))
        return replace(table, df=ranked.filter(F.col("__rank") == 1).drop("__rank"), in_order=False)

    def marked(self, table: Table, flag: str) -> Table:
        """Set the carried column ``flag`` on the rows to remove, and keep them.

        As no row is cut, the rows of a key are dealt out by their ids first. Of each
        deal one row is left in the running; only these meet by key.
        """
        table.check_targets(self.column_ids)
        deal, rank = F.col("__deal"), F.row_number()
        dealt = table.df.withColumn("__deal", F.pmod(F.xxhash64(*table.row_id), F.lit(DEALS)))
        within = Window.partitionBy(flag, *self.column_ids, "__deal").orderBy(*table.order_columns())
        first = dealt.withColumn("__rank", rank.over(within))
        running = first.withColumn("__deal", F.when(~F.col(flag) & (F.col("__rank") == 1), F.lit(-1)).otherwise(deal))
        met = Window.partitionBy(*self.column_ids, "__deal").orderBy(*table.order_columns())
        last = running.withColumn("__rank", rank.over(met)).withColumn(flag, F.col(flag) | (deal >= 0) | (F.col("__rank") > 1))
        return replace(table, df=last.select(*table.ids, *table.hidden_names()), in_order=False)


def deduplicate_rows(column_ids: Sequence[str]) -> Step:
    """Keep the first row, in current row order, of each combination of keys.

    The rank filter is applied before the shuffle as well as after it, so each
    task sends at most one row per key: a key that holds a large share of all
    rows does not overload one task.
    """
    return DeduplicateRows(column_ids)


def sort_rows(sorts: Sequence[tuple[str, str]]) -> Step:
    """Order rows by ``(column, "asc" | "desc")`` keys, nulls last either way.

    Ties keep their previous order. Only the order spec changes here.
    """

    def run(table: Table) -> Table:
        if not sorts:
            raise StepError("emptySort", "a sort needs at least one key")
        keys = []
        for column_id, direction in sorts:
            info = table.column(column_id)
            if info.type in ("mixed", "opaque"):
                raise StepError("incompatibleType", f"column {column_id!r} is {info.type} and cannot be sorted")
            if direction not in ("asc", "desc"):
                raise StepError("invalidExpression", f"direction {direction!r} is neither asc nor desc")
            keys.append(OrderKey(f"{column_id}#{len(table.order)}", column_id, direction == "asc"))
        table.check_targets([c for c, _ in sorts])
        return replace(table, order=tuple(keys) + table.order, in_order=False)

    return Step("sortRows", run)
