"""Date functions, in UTC with millisecond precision."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewash.errors import StepError
from tablewash.functions import cells as c
from tablewash.functions.cells import Cell

PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "dayOfWeek": lambda moment: F.dayofweek(moment) - 1,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
}
# The length of each unit in milliseconds.
UNIT_MILLIS = {
    "years": 365 * 86_400_000,
    "months": 30 * 86_400_000,
    "days": 86_400_000,
    "hours": 3_600_000,
    "minutes": 60_000,
    "seconds": 1_000,
}


def _moment(name: str, x: Any) -> Column:
    return c.instant(c.typed(name, x, ("date", "datetime", "string")))


def _unit(name: str, unit: Any) -> str:
    unit = c.cell(unit).literal
    if not isinstance(unit, str) or unit not in UNIT_MILLIS:
        raise StepError("invalidExpression", f"{name} needs a unit out of {', '.join(UNIT_MILLIS)}")
    return unit


def date_part(x: Any, part: Any) -> Cell:
    """One calendar field as a number; Sunday is day 0 of the week."""
    moment = _moment("datePart", x)
    part = c.literal_text("datePart", part)
    if part.is_literal:
        if part.literal is None:
            return c.number(F.lit(None).cast("double"))
        if part.literal not in PARTS:
            raise StepError("invalidExpression", f"datePart does not know the part {part.literal!r}")
        return c.number(PARTS[part.literal](moment).cast("double"))
    value = F.lit(None).cast("double")
    for name, field in PARTS.items():
        value = F.when(part.col == name, field(moment).cast("double")).otherwise(value)
    return c.number(value)


def date_diff(a: Any, b: Any, unit: Any) -> Cell:
    """``a - b`` in units of fixed length: a year is 365 days, a month 30."""
    left, right = _moment("dateDiff", a), _moment("dateDiff", b)
    millis = (F.unix_millis(left) - F.unix_millis(right)).cast("double")
    return c.number(millis / F.lit(float(UNIT_MILLIS[_unit("dateDiff", unit)])))


# The largest distance from 1970 in milliseconds that a moment may have,
# and the first and last moments of the years whose text has four digits.
FURTHEST = 8_640_000_000_000_000
PLAIN_YEARS = (-62_167_219_200_000, 253_402_300_799_999)


def date_add(x: Any, amount: Any, unit: Any) -> Cell:
    """ISO datetime text. Months and years overflow into the next month: one
    month after 31 January is 3 March (2 March in a leap year). A result further
    than FURTHEST from 1970 is null, and years beyond four digits have a sign and six."""
    moment = _moment("dateAdd", x)
    amount = c.number_arg("dateAdd", amount)
    unit = _unit("dateAdd", unit)
    # An amount that leads out of range from any moment in it is dropped before
    # it is multiplied, so nothing overflows.
    n = c.double(amount)
    n = F.when(F.abs(n) * float(UNIT_MILLIS[unit]) <= 2.5 * FURTHEST, n)
    if unit in ("years", "months"):
        step = 12 if unit == "years" else 1
        field = F.year(moment) if unit == "years" else F.month(moment) - 1
        moved = _truncate(field.cast("double") + n) * step
        months = moved + (F.month(moment) - 1 if unit == "years" else F.year(moment) * 12)
        year = F.floor(months / 12).cast("int")
        # Dates of all these years exist; most of the margin is cut off below.
        year = F.when(year.between(-280_000, 280_000), year)
        first_day = F.make_date(year, (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
        day = F.unix_date(first_day).cast("bigint") + F.dayofmonth(moment) - 1
        into_day = F.unix_millis(moment) - F.unix_millis(F.date_trunc("day", moment))
        millis = day * UNIT_MILLIS["days"] + into_day
    else:
        whole = amount.is_literal and amount.literal is not None and float(amount.literal).is_integer()
        if whole:
            delta = n
        else:
            # A fraction is cut off after adding it to the calendar field.
            field = {"days": F.dayofmonth, "hours": F.hour, "minutes": F.minute, "seconds": F.second}[unit](moment)
            delta = _truncate(field.cast("double") + n) - field
        millis = F.unix_millis(moment) + delta.cast("bigint") * UNIT_MILLIS[unit]
    return Cell(_extended_iso(millis), "datetime", c.STRING)


def _extended_iso(millis: Column) -> Column:
    """Text of a moment up to FURTHEST from 1970, else null; plain years take no more than their format."""
    moment = F.timestamp_millis(millis)
    year = F.year(moment)
    digits = F.lpad(F.abs(year).cast("string"), 6, "0")
    signed = F.concat(F.when(year < 0, F.lit("-")).otherwise(F.lit("+")), digits)
    rest = F.date_format(moment, "-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(millis.between(*PLAIN_YEARS), c.iso_text(moment)).when(F.abs(millis) <= FURTHEST, F.concat(signed, rest))


def _truncate(x: Column) -> Column:
    return x.cast("bigint")
