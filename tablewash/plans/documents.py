"""Step lists kept as JSON documents, turned into the steps of this package.

A document is data, not a language: each expression node names a function of
``tablewash.functions``, which is called with its arguments while planning.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from tablewash import functions as fx
from tablewash import operators as ops
from tablewash.errors import StepError
from tablewash.functions.cells import Cell
from tablewash.plans.runs import Package, Workflow
from tablewash.table import Row

ANY = None
# Function name in documents -> function, fewest and most arguments.
CALLS = {
    "datePart": (fx.date_part, 2, 2),
    "dateDiff": (fx.date_diff, 3, 3),
    "dateAdd": (fx.date_add, 3, 3),
    "round": (fx.round, 1, 1),
    "floor": (fx.floor, 1, 1),
    "ceil": (fx.ceil, 1, 1),
    "abs": (fx.abs, 1, 1),
    "add": (fx.add, 2, 2),
    "subtract": (fx.subtract, 2, 2),
    "multiply": (fx.multiply, 2, 2),
    "divide": (fx.divide, 2, 2),
    "modulo": (fx.modulo, 2, 2),
    "toNumber": (fx.to_number, 1, 1),
    "toString": (fx.to_string, 1, 1),
    "toBoolean": (fx.to_boolean, 1, 1),
    "trim": (fx.trim, 1, 1),
    "lower": (fx.lower, 1, 1),
    "upper": (fx.upper, 1, 1),
    "collapseWhitespace": (fx.collapse_whitespace, 1, 1),
    "substring": (fx.substring, 3, 3),
    "replace": (fx.replace, 3, 3),
    "extractRegex": (fx.extract_regex, 2, 2),
    "replaceRegex": (fx.replace_regex, 3, 3),
    "split": (fx.split, 2, 2),
    "concat": (fx.concat, 2, ANY),
    "length": (fx.length, 1, 1),
    "atIndex": (fx.at_index, 2, 2),
    "first": (fx.first, 1, 1),
    "last": (fx.last, 1, 1),
    "coalesce": (fx.coalesce, 2, 2),
    "isEmpty": (fx.is_empty, 1, 1),
    "equals": (fx.equals, 2, 2),
    "greaterThan": (fx.greater_than, 2, 2),
    "lessThan": (fx.less_than, 2, 2),
    "contains": (fx.contains, 2, 2),
    "startsWith": (fx.starts_with, 2, 2),
    "endsWith": (fx.ends_with, 2, 2),
    "matchesRegex": (fx.matches_regex, 2, 2),
    "and": (fx.and_, 2, ANY),
    "or": (fx.or_, 2, ANY),
    "not": (fx.not_, 1, 1),
}


def _need(node: dict, key: str) -> Any:
    if not isinstance(node, dict) or key not in node:
        raise StepError("invalidDocument", f"{key!r} is missing in {json.dumps(node)[:80]}")
    return node[key]


def _cell(node: dict, row: Row, value: Cell | None = None, case: Cell | None = None) -> Cell:
    kind = _need(node, "kind")
    if kind == "literal":
        return fx.literal(_need(node, "value"))
    if kind == "column":
        return row[_need(node, "columnId")]
    if kind in ("value", "caseValue"):
        found = value if kind == "value" else case
        if found is None:
            raise StepError("invalidExpression", f"{kind} cannot be used here")
        return found
    if kind == "match":
        return _match(node, row, value)
    if kind == "call":
        return _call(node, row, value, case)
    raise StepError("invalidExpression", f"unknown expression kind {kind!r}")


def _call(node: dict, row: Row, value: Cell | None, case: Cell | None) -> Cell:
    name, args = _need(node, "name"), _need(node, "args")
    if name == "now" and not args:
        return row.now()
    function, fewest, most = CALLS.get(name, (None, 0, -1))
    if function is None or len(args) < fewest or (most is not None and len(args) > most):
        raise StepError("invalidExpression", f"no function {name!r} with {len(args)} argument(s)")
    return function(*[_cell(a, row, value, case) for a in args])


def _match(node: dict, row: Row, value: Cell | None) -> Cell:
    cases = list(_need(node, "cases"))
    otherwise = None
    if cases and cases[-1].get("kind") == "otherwise":
        fallback = _need(cases.pop(), "then")
        otherwise = lambda cv: _cell(fallback, row, value, cv)
    if any(c.get("kind") != "when" for c in cases):
        raise StepError("invalidExpression", "otherwise must be the only one and the last case of a match")

    def branch(part: dict):
        return lambda cv: _cell(part, row, value, cv)

    subject = _cell(_need(node, "subject"), row)
    if not cases and otherwise is not None:
        return otherwise(subject)
    return row.match(subject, [(branch(_need(c, "when")), branch(_need(c, "then"))) for c in cases], otherwise)


def _row_expression(node: dict):
    return lambda row: _cell(node, row)


def _cell_expression(node: dict):
    return lambda row, value: _cell(node, row, value)


def _patch(node: dict) -> ops.Patch:
    settings = {}
    if "value" in node:
        settings["value"] = _cell_expression(node["value"])
    if "format" in node:
        settings["fill"] = _need(node["format"], "fillColor")
    return ops.Patch(**settings)


def _new(node: dict) -> tuple[str, str]:
    return _need(node, "columnId"), _need(node, "displayName")


def _rule(node: dict) -> ops.Step:
    cases = [ops.Case(_cell_expression(_need(c, "when")), _patch(_need(c, "then"))) for c in node.get("cases") or []]
    default = _patch(node["defaultPatch"]) if node.get("defaultPatch") else None
    where = _row_expression(node["rowCondition"]) if node.get("rowCondition") else None
    return ops.scoped_rule(_need(node, "columnIds"), cases, default, where)


STEPS = {
    "comment": lambda n: ops.comment(n.get("text", "")),
    "scopedRule": _rule,
    "dropColumns": lambda n: ops.drop_columns(_need(n, "columnIds")),
    "renameColumn": lambda n: ops.rename_column(_need(n, "columnId"), _need(n, "newDisplayName")),
    "deriveColumn": lambda n: ops.derive_column(*_new(_need(n, "newColumn")), _row_expression(_need(n, "expression"))),
    "filterRows": lambda n: ops.filter_rows(_need(n, "mode"), _row_expression(_need(n, "condition"))),
    "splitColumn": lambda n: ops.split_column(
        _need(n, "columnId"), _need(n, "delimiter"), [_new(o) for o in _need(n, "outputColumns")]
    ),
    "combineColumns": lambda n: ops.combine_columns(
        _need(n, "columnIds"), _need(n, "separator"), *_new(_need(n, "newColumn"))
    ),
    "deduplicateRows": lambda n: ops.deduplicate_rows(_need(n, "columnIds")),
    "sortRows": lambda n: ops.sort_rows([(_need(s, "columnId"), _need(s, "direction")) for s in _need(n, "sorts")]),
}


def workflow_from_document(document: dict) -> Workflow:
    """One step list."""
    steps, seen = [], set()
    for node in _need(document, "steps"):
        kind, step_id = _need(node, "type"), _need(node, "id")
        if kind not in STEPS:
            raise StepError("invalidDocument", f"unknown step type {kind!r}", step_id)
        if step_id in seen:
            raise StepError("duplicateStepId", f"step id {step_id!r} is used twice", step_id)
        seen.add(step_id)
        steps.append(STEPS[kind](node).named(step_id))
    return Workflow(_need(document, "workflowId"), document.get("name", ""), tuple(steps))


def package_from_document(document: dict | str | Path) -> Package:
    """A package of step lists, or a single step list, from a dict, JSON text or file."""
    if isinstance(document, Path):
        document = document.read_text(encoding="utf-8")
    if isinstance(document, str):
        document = json.loads(document)
    if "workflows" not in document:
        one = workflow_from_document(document)
        return Package((one,), (one.id,))
    workflows = tuple(workflow_from_document(w) for w in document["workflows"])
    return Package(workflows, tuple(document.get("runOrderWorkflowIds", [w.id for w in workflows])))
