"""Predicates. All are two-valued: a null operand gives true or false, never null."""

from __future__ import annotations

from functools import reduce
from operator import and_ as both
from operator import or_ as either
from typing import Any, Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import StepError
from tablewash.functions import cells as c
from tablewash.functions import regex
from tablewash.functions.cells import Cell, predicate, truthy

__all__ = ["truthy"]


def _null_is_false(test: Column) -> Cell:
    return predicate(F.coalesce(test, F.lit(False)), test)


def is_empty(x: Any) -> Cell:
    """Null, empty or whitespace-only text; numbers and booleans are never empty."""
    x = c.scalar("isEmpty", x)
    blank = lambda text: F.btrim(text, F.lit(c.WHITESPACE)) == ""
    if x.type == "mixed":
        return predicate(x.col.isNull() | F.coalesce(blank(x.col["s"]), F.lit(False)))
    if isinstance(x.spark, T.StringType):
        return predicate(x.col.isNull() | F.coalesce(blank(x.col), F.lit(False)), x.col.isNull() | blank(x.col))
    return predicate(x.col.isNull(), x.col.isNull())


def _integer_literal(column: Cell, other: Cell) -> Column | None:
    """A whole-number constant in the type of an integer column, so that the
    comparison is pushed into the scan instead of hiding behind a cast."""
    if isinstance(column.spark, T.IntegralType) and other.is_literal and other.type == "number":
        if float(other.literal).is_integer() and abs(other.literal) < 2**31:
            return F.lit(int(other.literal))
    return None


def _operands(a: Cell, b: Cell, what: str) -> tuple[Column, Column]:
    for left, right, swap in ((a, b, False), (b, a, True)):
        constant = _integer_literal(left, right)
        if constant is not None:
            return (constant, left.col) if swap else (left.col, constant)
    if a.type == b.type == "number":
        return c.double(a), c.double(b)
    columns, _, _ = c.unify([a, b], what)
    return columns[0], columns[1]


def equals(a: Any, b: Any) -> Cell:
    """Same type and same value; null equals null."""
    a, b = c.scalar("equals", a), c.scalar("equals", b)
    if "mixed" in (a.type, b.type):
        raise StepError("incompatibleType", "equals does not compare mixed columns")
    left, right = _operands(a, b, "equals")
    same = left.eqNullSafe(right)
    return predicate(same, same)


def _ordered(name: str, a: Any, b: Any) -> tuple[Cell, Column, Column]:
    a, b = c.scalar(name, a), c.scalar(name, b)
    for side in (a, b):
        if side.type not in ("number", "date", "datetime", "unknown"):
            raise StepError("incompatibleType", f"{name} does not order {side.type} values")
    left, right = _operands(a, b, name)
    return a, left, right


def greater_than(a: Any, b: Any) -> Cell:
    """False when either side is null."""
    _, left, right = _ordered("greaterThan", a, b)
    return _null_is_false(left > right)


def less_than(a: Any, b: Any) -> Cell:
    """A null left side is less than anything; otherwise a null right side gives false."""
    a, left, right = _ordered("lessThan", a, b)
    if a.is_literal and a.literal is not None:
        return _null_is_false(left < right)
    missing = left.isNull()
    return predicate(missing | F.coalesce(left < right, F.lit(False)), missing | (left < right))


def not_(x: Any) -> Cell:
    x = truthy(c.boolean_arg("not", x))
    return predicate(~x.col, ~x.col)


def _junction(name: str, join: Callable, values: tuple) -> Cell:
    if len(values) < 2:
        raise StepError("invalidExpression", f"{name} needs at least two conditions")
    parts = [truthy(c.boolean_arg(name, v)) for v in values]
    return predicate(
        reduce(join, [p.col for p in parts]),
        reduce(join, [p.where if p.where is not None else p.col for p in parts]),
    )


def and_(*values: Any) -> Cell:
    return _junction("and", both, values)


def or_(*values: Any) -> Cell:
    return _junction("or", either, values)


def _text_test(name: str, x: Any, other: Any, test: Callable[[Column, Any], Column]) -> Cell:
    x, other = c.literal_text(name, x), c.literal_text(name, other)
    # A plain Python constant lets Spark push prefix and suffix tests down.
    operand = other.literal if other.is_literal and other.literal is not None else other.col
    return _null_is_false(test(x.col, operand))


def contains(x: Any, search: Any) -> Cell:
    return _text_test("contains", x, search, lambda col, s: col.contains(s))


def starts_with(x: Any, search: Any) -> Cell:
    return _text_test("startsWith", x, search, lambda col, s: col.startswith(s))


def ends_with(x: Any, search: Any) -> Cell:
    return _text_test("endsWith", x, search, lambda col, s: col.endswith(s))


def matches_regex(x: Any, pattern: Any) -> Cell:
    """Whether the pattern occurs anywhere in the text; an invalid one from a column occurs nowhere."""
    x, p = c.literal_text("matchesRegex", x), c.literal_text("matchesRegex", pattern)
    if not p.is_literal:
        return _null_is_false(F.rlike(x.col, regex.translated(p.col)["pattern"]))
    if p.literal is None:
        return predicate(F.lit(False))
    return _null_is_false(x.col.rlike(regex.to_java(p.literal).pattern))


def coalesce(a: Any, b: Any, *more: Any) -> Cell:
    """The first value that is neither null nor empty text, else the last one."""
    values = [c.scalar("coalesce", v) for v in (a, b, *more)]
    if any(v.type == "mixed" for v in values):
        raise StepError("incompatibleType", "coalesce does not accept mixed columns")
    columns, kind, spark_type = c.unify(values, "coalesce")
    result = columns[-1]
    for value in reversed(columns[:-1]):
        empty = value.isNull()
        if isinstance(spark_type, T.StringType):
            empty = empty | (value == "")
        result = F.when(empty, result).otherwise(value)
    return Cell(result, kind, spark_type)


# Shorthands built from the predicates above.


def not_equals(a: Any, b: Any) -> Cell:
    return not_(equals(a, b))


def at_least(a: Any, b: Any) -> Cell:
    return or_(greater_than(a, b), equals(a, b))


def at_most(a: Any, b: Any) -> Cell:
    """Null is at most anything, as in ``less_than``."""
    return or_(less_than(a, b), equals(a, b))


def between(x: Any, low: Any, high: Any, include_low: bool = True, include_high: bool = True) -> Cell:
    lower = at_least(x, low) if include_low else greater_than(x, low)
    upper = at_most(x, high) if include_high else less_than(x, high)
    return and_(lower, upper)
