"""The one error type the operators raise, always before any job starts."""

from __future__ import annotations


class StepError(ValueError):
    """A step, expression or import setting that cannot run on this table.

    ``code`` is the stable machine-readable reason, for example
    ``missingColumn`` or ``incompatibleType``.
    """

    def __init__(self, code: str, message: str, step_id: str | None = None):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message
        self.step_id = step_id
