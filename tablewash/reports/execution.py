"""A whole run and its result: the table, what changed, and what each step did."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Iterable

from pyspark.sql import functions as F

from tablewash.errors import StepError
from tablewash.operators.steps import Step
from tablewash.plans.runs import GONE, find_issues, marked_run, step_summaries, totals
from tablewash.reports.changes import carrying_originals, changed_cells
from tablewash.reports.positions import dense_positions
from tablewash.session import stored
from tablewash.table import Table


@dataclass(frozen=True)
class RunResult:
    """What a run gave. ``table`` is None, and nothing was changed, if any step can't run."""

    table: Table | None
    issues: tuple[StepError, ...] = ()
    changed_row_count: int = 0
    changed_cell_count: int = 0
    removed_row_count: int = 0
    row_order_changed: bool = False
    created_column_ids: tuple[str, ...] = ()
    sort_applied: bool = False
    steps: list[dict] = field(default_factory=list)


def execute(table: Table, steps: Iterable[Step]) -> RunResult:
    """Run the steps once and report on the run. All steps are checked before any job.

    The run is written once to the scratch folder: the result's columns of all rows that the
    table had, marked where they were removed, and beside them how many cells changed and
    what rules counted. The result's table reads it without the removed rows, and the
    report is an aggregation over its narrow columns, so both say the same whatever the
    steps are. If rows were removed and none sorted, one more reading finds the rows
    behind the first removed one; a sorted run numbers the rows before and after. The row
    id must be unique. ``clear_scratch`` deletes the written run with the table.
    """
    steps = tuple(steps)
    issues = find_issues(table, steps)
    if issues:
        return RunResult(None, tuple(issues))
    carrier, was, was_fill, place = carrying_originals(table)
    old_order = {k.column: f"__before{i}" for i, k in enumerate(table.order) if k.column not in table.row_id}
    carrier = replace(
        carrier,
        df=carrier.df.select("*", *[F.col(c).alias(n) for c, n in old_order.items()]),
        carried=carrier.carried + tuple(old_order.values()),
    )
    after = marked_run(carrier, steps)
    counters = [n for n in after.carried if n.startswith("__count")]
    dropped = {*was.values(), *was_fill.values()}
    hidden = [n for n in after.hidden_names() if n not in dropped]
    rows = stored(after.df.select(*after.ids, *hidden, changed_cells(table, after, was, was_fill).alias("__changed")), "run")
    gone = F.col(GONE)
    at = F.struct(*place)
    changed = gone | (F.col("__changed") > 0)
    found = rows.agg(
        F.count_if(changed).alias("rows"),
        F.coalesce(F.sum("__changed"), F.lit(0)).alias("cells"),
        F.count_if(gone).alias("removed"),
        F.min(F.when(gone, at)).alias("first"),
        *totals(after),
    ).first()
    kept = [n for n in hidden if n not in (*place, GONE, *old_order.values(), *counters)]
    result = replace(
        after, df=rows.filter(~gone).select(*after.ids, *kept), carried=table.carried, run_at=table.run_at, in_order=False
    )
    sorted_ = any(s.kind == "sortRows" for s in steps)
    changed_rows, order_changed = found["rows"], found["removed"] > 0
    if sorted_ or (found["removed"] and not _by_row_id(table)):
        names = dict(zip(table.row_id, place)) | old_order
        before = replace(
            table, df=rows, row_id=tuple(place), order=tuple(replace(k, column=names[k.column]) for k in table.order), in_order=False
        )
        after_ = replace(result, df=rows.filter(~gone), row_id=tuple(place))
        old, new = (dense_positions(t).withColumnRenamed("position", n) for t, n in ((before, "__old"), (after_, "__new")))
        moved = F.coalesce(F.col("__old") != F.col("__new"), F.lit(True))
        row = (
            rows.join(old, place)
            .join(new, place, "left")
            .agg(F.count_if(changed | moved).alias("rows"), F.count_if(moved).alias("moved"))
            .first()
        )
        changed_rows, order_changed = row["rows"], row["moved"] > 0
    elif found["removed"]:
        first = F.struct(*[F.lit(v).cast(rows.schema[n].dataType).alias(n) for n, v in zip(place, found["first"])])
        changed_rows = rows.filter(changed | (at > first)).count()
    return RunResult(
        result,
        (),
        changed_rows,
        int(found["cells"]),
        found["removed"],
        order_changed,
        tuple(c for c in after.ids if c not in table.ids),
        sorted_,
        step_summaries(steps, found.asDict()),
    )


def _by_row_id(table: Table) -> bool:
    return [(k.column, k.ascending) for k in table.order] == [(c, True) for c in table.row_id]
