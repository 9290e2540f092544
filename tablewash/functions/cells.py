"""Typed cells: a Spark Column together with its logical type.

Expressions are plain Python functions over cells. The logical type is known
while the plan is built, so type errors surface before any job starts and each
function picks its Spark expression without looking at the data.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import StepError

# Fixed value: the whitespace characters recognised by trimming and emptiness tests.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as the inside of a Java character class; \p{Z} is all the spaces
# and separators, which is tested much faster than a list of ranges.
WHITESPACE_CLASS = r"\s\p{Z}\ufeff"

ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"
ISO_LOCAL_DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\z"
ISO_ZONED_DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})\z"

# A column whose cells hold different kinds: k says which of s, n, b is set.
MIXED = T.StructType(
    [
        T.StructField("k", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("n", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
    ]
)

DOUBLE, STRING, BOOLEAN = T.DoubleType(), T.StringType(), T.BooleanType()
NOT_A_LITERAL = object()


@dataclass(frozen=True)
class Cell:
    """One value per row: its Column, logical type and Spark type.

    ``where`` is set on predicates: the same test with null standing for
    false. Filters use it because Spark can push it into the scan, while
    ``col`` itself is never null.
    """

    col: Column
    type: str
    spark: T.DataType
    literal: Any = NOT_A_LITERAL
    where: Column | None = None

    @property
    def is_list(self) -> bool:
        return isinstance(self.spark, T.ArrayType)

    @property
    def is_literal(self) -> bool:
        return self.literal is not NOT_A_LITERAL

    def bound_to(self, name: str) -> "Cell":
        return replace(self, col=F.col(name), where=None, literal=NOT_A_LITERAL)


def number(col: Column) -> Cell:
    return Cell(col, "number", DOUBLE)


def predicate(col: Column, where: Column | None = None) -> Cell:
    return Cell(col, "boolean", BOOLEAN, where=where)


def like(source: Cell, col: Column) -> Cell:
    """Text computed from ``source``: stays unknown when the source is."""
    return Cell(col, "string" if source.type == "string" else "unknown", STRING)


def literal_type(value: Any) -> str:
    if value is None:
        return "unknown"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        return "date" if _parses(value) else "string"
    if re.match(r"\d{4}-\d{2}-\d{2}T", value):
        return "datetime" if _parses(value) else "string"
    return "string"


def _parses(text: str) -> bool:
    return parse_iso(text) is not None


def parse_iso(text: str) -> datetime | None:
    """An ISO date or datetime literal as UTC, or None."""
    try:
        parsed = datetime.fromisoformat(text)
    except ValueError:
        return None
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def literal(value: Any) -> Cell:
    """A text, number, boolean or null constant."""
    if value is None:
        return Cell(F.lit(None).cast("string"), "unknown", STRING, literal=None)
    if isinstance(value, bool):
        return Cell(F.lit(value), "boolean", BOOLEAN, literal=value, where=F.lit(value))
    if isinstance(value, (int, float)):
        return Cell(F.lit(float(value)), "number", DOUBLE, literal=value)
    if isinstance(value, str):
        return Cell(F.lit(value), literal_type(value), STRING, literal=value)
    raise StepError("invalidExpression", f"{value!r} is not a text, number, boolean or null")


def cell(value: Any) -> Cell:
    return value if isinstance(value, Cell) else literal(value)


def logical_type(spark_type: T.DataType) -> str:
    if spark_type == MIXED:
        return "mixed"
    if isinstance(spark_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(spark_type, T.NumericType):
        return "number"
    if isinstance(spark_type, T.BooleanType):
        return "boolean"
    if isinstance(spark_type, T.DateType):
        return "date"
    if isinstance(spark_type, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(spark_type, T.NullType):
        return "unknown"
    return "opaque"


# --- argument checks -------------------------------------------------------


def scalar(name: str, value: Any) -> Cell:
    c = cell(value)
    if c.is_list:
        raise StepError("invalidExpression", f"{name} only accepts scalar inputs")
    return c


def typed(name: str, value: Any, allowed: tuple[str, ...]) -> Cell:
    c = cell(value)
    if c.is_list or c.type not in allowed + ("unknown",):
        kind = "list" if c.is_list else c.type
        raise StepError("incompatibleType", f"{name} does not accept a {kind} input")
    return c


def text_arg(name: str, value: Any) -> Cell:
    return typed(name, value, ("string",))


def literal_text(name: str, value: Any) -> Cell:
    """A text argument where date-shaped text is as good as any other."""
    c = cell(value)
    if c.is_literal and isinstance(c.literal, str):
        return replace(c, type="string")
    return text_arg(name, c)


def number_arg(name: str, value: Any) -> Cell:
    return typed(name, value, ("number",))


def boolean_arg(name: str, value: Any) -> Cell:
    return typed(name, value, ("boolean",))


def merge_types(types: list[str], what: str) -> str:
    """The one concrete type of several branches; unknown joins anything."""
    concrete = sorted({t for t in types if t != "unknown"})
    if len(concrete) > 1:
        raise StepError("incompatibleType", f"{what} mixes the types {', '.join(concrete)}")
    return concrete[0] if concrete else "unknown"


# --- representations -------------------------------------------------------


def double(c: Cell) -> Column:
    """The cell as a double; null when it is not a number."""
    if c.type == "unknown":
        return F.lit(None).cast("double")
    return c.col if isinstance(c.spark, T.DoubleType) else c.col.cast("double")


def truncated_int(c: Cell) -> Column:
    """Fraction cut off, clamped to the int range so that a cast cannot fail."""
    if c.is_literal and c.literal is not None:
        value = float(c.literal)
        return F.lit(0 if math.isnan(value) else int(max(-(2**31), min(value, 2**31 - 1))))
    bounded = F.least(F.greatest(F.nanvl(double(c), F.lit(-1.0)), F.lit(-(2.0**31))), F.lit(2.0**31 - 1))
    return bounded.cast("int")


def instant(c: Cell) -> Column:
    """The cell as a timestamp with millisecond precision; null if it is no date."""
    if isinstance(c.spark, (T.DateType, T.TimestampNTZType)):
        return c.col.cast("timestamp")
    if isinstance(c.spark, T.TimestampType):
        return c.col
    if c.is_literal:
        parsed = parse_iso(c.literal.strip(WHITESPACE)) if isinstance(c.literal, str) else None
        return F.lit(parsed) if parsed else F.lit(None).cast("timestamp")
    return iso_instant(F.btrim(c.col, F.lit(WHITESPACE)))


def iso_instant(text: Column) -> Column:
    """ISO text as a timestamp, UTC where no zone is given; null for anything else.

    The casts that follow the shape tests read no other zone, so the session's
    time zone does not matter. Spark wants seconds before a zone.
    """
    seconds_given = F.substring(text, 17, 1) == ":"
    zone = F.substring(text, 17, 6)
    full = (
        F.when(text.rlike(ISO_DATE), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(ISO_LOCAL_DATETIME), F.concat(text, F.when(seconds_given, F.lit("Z")).otherwise(F.lit(":00Z"))))
        .when(
            text.rlike(ISO_ZONED_DATETIME),
            F.when(seconds_given, text).otherwise(F.concat(F.substring(text, 1, 16), F.lit(":00"), zone)),
        )
    )
    return full.try_cast("timestamp")


def _shortest_digits(x: Column) -> Column:
    """The double in decimal, with as few digits as still identify it.

    Java may print a digit too many. Where it printed more than 15, the
    roundings to 15 and 16 digits are tried and taken if they read back equal.
    """
    java = x.cast("string")
    digits = F.length(F.translate(F.substring_index(java, "E", 1), ".-", ""))
    fifteen, sixteen = F.format_string("%.14e", x), F.format_string("%.15e", x)
    return (
        F.when(digits <= 15, java)
        .when(fifteen.try_cast("double") == x, fifteen)
        .when(sixteen.try_cast("double") == x, sixteen)
        .otherwise(java)
    )


def _any_number_text(x: Column) -> Column:
    size, zero = F.abs(x), F.lit("0")
    shortest = _shortest_digits(x)
    large = shortest.try_cast(T.DecimalType(38, 0)).cast("string")
    fraction = F.rtrim(shortest.try_cast(T.DecimalType(38, 22)).cast("string"), zero)
    scientific = F.lower(shortest)
    mantissa = F.rtrim(F.rtrim(F.substring_index(scientific, "e", 1), zero), F.lit("."))
    power = F.substring_index(scientific, "e", -1).try_cast("int").cast("string")
    sign = F.when(size >= 1, F.lit("e+")).otherwise(F.lit("e"))
    return (
        F.when(F.isnan(x) | (size == F.lit(float("inf"))), x.cast("string"))
        .when((size >= F.lit(1e21)) | (size < F.lit(1e-6)), F.concat(mantissa, sign, power))
        .when(size >= F.lit(2.0**53), large)
        .otherwise(fraction)
    )


def number_text(x: Column) -> Column:
    """A double as text: no trailing ``.0``, exponents only below 1e-6 and from 1e21."""
    size, java = F.abs(x), x.cast("string")
    exact_integer = (x == F.floor(x)) & (size < F.lit(2.0**53))
    # Java writes this range without an exponent, and 15 digits cannot be too many.
    plain = (size >= F.lit(1e-3)) & (size < F.lit(1e7)) & (F.length(java) <= 16)
    # The long expression for other numbers is kept out of the generated method,
    # which would otherwise grow past the size the JVM compiles.
    other = F.get(F.transform(F.array(x), _any_number_text), F.lit(0))
    return F.when(exact_integer, x.try_cast("bigint").cast("string")).when(plain, java).when(x.isNotNull(), other)


def text(c: Cell) -> Column:
    """The cell as text, null staying null."""
    if c.is_literal and not isinstance(c.literal, (int, float)):
        return c.col
    if c.type == "mixed":
        return (
            F.when(c.col["k"] == "s", c.col["s"])
            .when(c.col["k"] == "n", number_text(c.col["n"]))
            .when(c.col["k"] == "b", c.col["b"].cast("string"))
        )
    if isinstance(c.spark, (T.BooleanType, T.IntegralType, T.DateType)):
        return c.col.cast("string")
    if isinstance(c.spark, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(c.col.cast("timestamp"))
    if c.type == "number":
        return number_text(double(c))
    return c.col if isinstance(c.spark, T.StringType) else c.col.cast("string")


def iso_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def coerce(c: Cell, kind: str, spark_type: T.DataType) -> Column:
    """The cell in the representation shared by several branches."""
    if c.spark == spark_type and c.type != "unknown":
        return c.col
    if c.type == "unknown":
        return c.col if c.spark == spark_type else F.lit(None).cast(spark_type)
    if kind == "number":
        return double(c)
    if kind in ("date", "datetime") and not isinstance(spark_type, T.StringType):
        return instant(c).cast(spark_type)
    if kind in ("date", "datetime"):
        return text(c)
    return c.col.cast(spark_type)


def common_spark_type(cells: list[Cell], kind: str) -> T.DataType:
    """Keep the branches' own Spark type when they agree, else the usual one."""
    own = {c.spark.json(): c.spark for c in cells if c.type != "unknown"}
    if len(own) == 1:
        return next(iter(own.values()))
    if kind == "number":
        return DOUBLE
    if kind == "boolean":
        return BOOLEAN
    if kind in ("date", "datetime"):
        # A literal follows the column it is compared with, so that the
        # comparison can reach the scan; otherwise text is the shared form.
        columns = [c.spark for c in cells if not c.is_literal and c.type != "unknown"]
        if len({s.json() for s in columns}) == 1:
            return columns[0]
        if all(not isinstance(s, T.StringType) for s in columns) and columns:
            return T.TimestampType()
    return STRING


def unify(cells: list[Cell], what: str) -> tuple[list[Column], str, T.DataType]:
    kind = merge_types([c.type for c in cells], what)
    spark_type = common_spark_type(cells, kind)
    return [coerce(c, kind, spark_type) for c in cells], kind, spark_type


def truthy(value: Any) -> Cell:
    """Two-valued truth: null, empty text, zero and NaN are false."""
    c = cell(value)
    if c.is_list:
        return predicate(F.lit(True))
    if c.where is not None:
        return c
    if isinstance(c.spark, T.BooleanType):
        return predicate(F.coalesce(c.col, F.lit(False)), c.col)
    if c.type == "number":
        test = (double(c) != 0) & ~F.isnan(double(c))
    elif c.type == "mixed":
        test = (
            F.when(c.col["k"] == "s", c.col["s"] != "")
            .when(c.col["k"] == "n", (c.col["n"] != 0) & ~F.isnan(c.col["n"]))
            .otherwise(c.col["b"])
        )
    elif isinstance(c.spark, T.StringType):
        test = c.col != ""
    else:
        test = c.col.isNotNull()
    return predicate(F.coalesce(test, F.lit(False)), test)
