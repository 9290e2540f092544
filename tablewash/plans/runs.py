"""Running step lists: one lazy plan, whatever the number of steps."""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass, field, replace
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.errors import StepError
from tablewash.operators.rows import DeduplicateRows, FilterRows
from tablewash.operators.rules import METRICS, ScopedRule
from tablewash.operators.steps import Step
from tablewash.table import Table, run_time

# Carried column that marks the rows a step has removed.
GONE = "__gone"


def apply_steps(table: Table, steps: Iterable[Step]) -> Table:
    """Apply the steps in order. A step that cannot run raises StepError here,
    before any job; ``now()`` is the same moment in all of them."""
    current = replace(table, run_at=table.run_at or run_time())
    for step in steps:
        current = step(current)
    return replace(current, run_at=table.run_at)


@dataclass(frozen=True)
class CountedRun:
    """A planned run and, in one row, the plan of its rules' counts."""

    table: Table
    steps: tuple[Step, ...]
    counts: DataFrame | None

    def summaries(self) -> list[dict]:
        """Per step: its id, its kind and its cell counts, from one job over all rules.

        The counts are sums over the rows a rule is given. They don't depend on how,
        or how often, the result is written or a task is run.
        """
        return step_summaries(self.steps, self.counts.first().asDict() if self.counts is not None else {})


def counter_names(i: int) -> list[str]:
    """The carried columns with the counts of step ``i``."""
    return [f"__count{i}_{m}" for m in range(len(METRICS))]


def step_summaries(steps: Iterable[Step], totals: dict[str, int]) -> list[dict]:
    """Per step: its id, its kind and its cell counts, from the sums of the carried columns."""
    return [
        {"step_id": step.step_id, "step_type": step.kind, **{m: int(totals.get(n) or 0) for m, n in zip(METRICS, counter_names(i))}}
        for i, step in enumerate(steps)
    ]


def marked_run(table: Table, steps: Iterable[Step]) -> Table:
    """The table after the steps with all rows that it had before: the carried column GONE marks
    those that a step removes, and rules leave their counts of each row in carried columns.

    ``table`` has GONE already. All steps are one plan over one scan.
    """
    for i, step in enumerate(steps):
        if isinstance(step, ScopedRule):
            table = step.counted(table, counter_names(i), GONE)
        elif isinstance(step, (FilterRows, DeduplicateRows)):
            table = step.marked(table, GONE)
        else:
            table = step(table)
    return table


def totals(table: Table) -> list[Column]:
    """Aggregates with the sums of the counts that rules left in ``marked_run``."""
    return [F.sum(n).alias(n) for n in table.carried if n.startswith("__count")]


def count_steps(table: Table, steps: Iterable[Step]) -> CountedRun:
    """Like ``apply_steps``, with the numbers of cells that each rule matches and changes.

    ``steps`` are planned once for the result and the counts, so both have one ``now()``.
    The counts are one aggregation over one scan, whatever the number of rules.
    """
    steps = tuple(steps)
    started = replace(table, run_at=table.run_at or run_time())
    result = apply_steps(started, steps)
    rows = replace(started, df=started.df.withColumn(GONE, F.lit(False)), carried=started.carried + (GONE,))
    marked = marked_run(rows, steps)
    sums = totals(marked)
    return CountedRun(replace(result, run_at=table.run_at), steps, marked.df.agg(*sums) if sums else None)


def find_issues(table: Table, steps: Iterable[Step]) -> list[StepError]:
    """Every step that cannot run, skipping it for the steps after it. No job runs."""
    issues = []
    for step in steps:
        try:
            table = step(table)
        except StepError as error:
            issues.append(error)
    return issues


@dataclass(frozen=True)
class Workflow:
    """A named step list."""

    id: str
    name: str
    steps: tuple[Step, ...]


@dataclass(frozen=True)
class Package:
    """Several step lists and the order in which they run."""

    workflows: tuple[Workflow, ...]
    run_order: tuple[str, ...] = field(default=())

    def sequence(self, up_to: str | None = None) -> list[Workflow]:
        """The step lists in run order, unknown ids skipped. With ``up_to``, only
        those up to and including that one; one outside the order runs alone."""
        known = {w.id: w for w in self.workflows}
        if up_to is None:
            return [known[i] for i in self.run_order if i in known]
        if up_to not in known:
            raise StepError("missingWorkflow", f"step list {up_to!r} does not exist")
        earlier = list(dict.fromkeys(self.run_order))
        if up_to not in earlier:
            return [known[up_to]]
        return [known[i] for i in earlier[: earlier.index(up_to) + 1] if i in known]

    def steps(self, up_to: str | None = None) -> list[Step]:
        """All steps in run order, their ids prefixed with the step list's id."""
        return [copy(step).named(f"{w.id}__{step.step_id}") for w in self.sequence(up_to) for step in w.steps]


def run_sequence(table: Table, package: Package, up_to: str | None = None) -> Table:
    """Run several step lists as one plan."""
    return apply_steps(table, package.steps(up_to))
