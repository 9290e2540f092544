"""Arithmetic on doubles: null in, null out; a zero divisor gives null."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from tablewash.functions import cells as c
from tablewash.functions.cells import Cell


def _pair(name: str, a: Any, b: Any):
    return c.double(c.number_arg(name, a)), c.double(c.number_arg(name, b))


def round(x: Any) -> Cell:
    """Nearest integer, halves towards positive infinity."""
    x = c.double(c.number_arg("round", x))
    down = F.floor(x).cast("double")
    nearest = F.when(x - down >= 0.5, down + 1.0).otherwise(down)
    return c.number(_whole(x, nearest))


def floor(x: Any) -> Cell:
    x = c.double(c.number_arg("floor", x))
    return c.number(_whole(x, F.floor(x).cast("double")))


def ceil(x: Any) -> Cell:
    x = c.double(c.number_arg("ceil", x))
    return c.number(_whole(x, F.ceil(x).cast("double")))


def _whole(x, result):
    # From 2^53 on every double is whole, and beyond 2^63 floor would saturate.
    return F.when(F.abs(x) < F.lit(2.0**53), result).otherwise(x)


def abs(x: Any) -> Cell:
    return c.number(F.abs(c.double(c.number_arg("abs", x))))


def add(a: Any, b: Any) -> Cell:
    left, right = _pair("add", a, b)
    return c.number(left + right)


def subtract(a: Any, b: Any) -> Cell:
    left, right = _pair("subtract", a, b)
    return c.number(left - right)


def multiply(a: Any, b: Any) -> Cell:
    left, right = _pair("multiply", a, b)
    return c.number(left * right)


def divide(a: Any, b: Any) -> Cell:
    left, right = _pair("divide", a, b)
    return c.number(F.try_divide(left, right))


def modulo(a: Any, b: Any) -> Cell:
    """Remainder with the sign of the dividend."""
    left, right = _pair("modulo", a, b)
    return c.number(F.try_mod(left, right))
