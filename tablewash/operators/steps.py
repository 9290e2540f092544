"""Steps: named functions from Table to Table."""

from __future__ import annotations

from typing import Callable

from tablewash.errors import StepError
from tablewash.table import Table


class Step:
    """One step of a step list. Calling it plans the change; no job runs."""

    def __init__(self, kind: str, run: Callable[[Table], Table], step_id: str | None = None):
        self.kind = kind
        self.step_id = step_id
        self._run = run

    def named(self, step_id: str) -> "Step":
        self.step_id = step_id
        return self

    def __call__(self, table: Table) -> Table:
        try:
            return self._run(table)
        except StepError as error:
            error.step_id = error.step_id or self.step_id
            raise

    def __repr__(self) -> str:
        return f"Step({self.kind!r}, id={self.step_id!r})"
