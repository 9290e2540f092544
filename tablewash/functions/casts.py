"""Casts that never fail: what cannot be read becomes null."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewash.functions import cells as c
from tablewash.functions.cells import Cell

DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
# Accepted radix prefixes with the digits allowed after them.
RADIX = {16: r"^0[xX][0-9a-fA-F]+\z", 8: r"^0[oO][0-7]+\z", 2: r"^0[bB][01]+\z"}
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _radix_value(text: Column, base: int) -> Column:
    digits = F.filter(F.split(F.substring(text, 3, 2**31 - 1), "", -1), lambda d: d != "")
    return F.aggregate(
        digits, F.lit(0.0), lambda total, d: total * base + F.conv(d, base, 10).cast("double")
    )


def text_to_number(text: Column) -> Column:
    t = F.btrim(text, F.lit(c.WHITESPACE))
    value = F.when(t.rlike(DECIMAL), _finite(t.try_cast("double")))
    for base, pattern in RADIX.items():
        value = value.when(t.rlike(pattern), _finite(_radix_value(t, base)))
    return value


def text_to_boolean(text: Column) -> Column:
    t = F.lower(F.btrim(text, F.lit(c.WHITESPACE)))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def _number_to_boolean(x: Column) -> Column:
    return F.when(x == 1, F.lit(True)).when(x == 0, F.lit(False))


def to_number(x: Any) -> Cell:
    """Finite numbers as they are, booleans as 1 and 0, readable text as its value."""
    x = c.scalar("toNumber", x)
    if x.type == "number":
        return c.number(_finite(c.double(x)))
    if x.type == "boolean":
        return c.number(x.col.cast("double"))
    if x.type == "mixed":
        return c.number(
            F.when(x.col["k"] == "s", text_to_number(x.col["s"]))
            .when(x.col["k"] == "n", _finite(x.col["n"]))
            .when(x.col["k"] == "b", x.col["b"].cast("double"))
        )
    if x.type in ("date", "datetime", "unknown"):
        return c.number(F.lit(None).cast("double"))
    return c.number(text_to_number(x.col))


def to_string(x: Any) -> Cell:
    """Text as it is, numbers in their shortest form, booleans as words."""
    return Cell(c.text(c.scalar("toString", x)), "string", c.STRING)


def to_boolean(x: Any) -> Cell:
    """Booleans as they are; 1, 0 and the words true, false, yes, no; else null."""
    x = c.scalar("toBoolean", x)
    if x.type == "boolean":
        value = x.col
    elif x.type == "number":
        value = _number_to_boolean(c.double(x))
    elif x.type == "mixed":
        value = (
            F.when(x.col["k"] == "s", text_to_boolean(x.col["s"]))
            .when(x.col["k"] == "n", _number_to_boolean(x.col["n"]))
            .when(x.col["k"] == "b", x.col["b"])
        )
    elif x.type in ("date", "datetime", "unknown"):
        value = F.lit(None).cast("boolean")
    else:
        value = text_to_boolean(x.col)
    return Cell(value, "boolean", c.BOOLEAN)
