"""Text and list functions."""

from __future__ import annotations

import re
from dataclasses import replace as with_fields
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import StepError
from tablewash.functions import cells as c
from tablewash.functions import regex
from tablewash.functions.cells import Cell

LIST = T.ArrayType(T.StringType())
# More than any text has, and twice as much is still an int.
MOST_UNITS = 2**30 - 1


def trim(x: Any) -> Cell:
    """Whitespace removed from both ends, Unicode spaces included."""
    x = c.text_arg("trim", x)
    return c.like(x, F.btrim(x.col, F.lit(c.WHITESPACE)))


def lower(x: Any) -> Cell:
    x = c.text_arg("lower", x)
    return c.like(x, F.lower(x.col))


def upper(x: Any) -> Cell:
    x = c.text_arg("upper", x)
    return c.like(x, F.upper(x.col))


def collapse_whitespace(x: Any) -> Cell:
    """Each run of whitespace becomes one space; the ends are not trimmed."""
    x = c.text_arg("collapseWhitespace", x)
    return c.like(x, F.regexp_replace(x.col, f"[{c.WHITESPACE_CLASS}]+", " "))


def _units(x: Column) -> Column:
    """Number of UTF-16 units of a text."""
    # Only text with characters of four UTF-8 bytes has more units than characters.
    octets, points = F.octet_length(x), F.length(x)
    return F.when(octets == points, points).otherwise((F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int"))


def unit_slice(x: Column, first: Column, count: Column) -> Column:
    """``count`` UTF-16 units from the zero-based unit ``first`` on, both at most MOST_UNITS.

    The slice is cut from the two-byte form. A half of a surrogate pair at its beginning
    or end that belongs to a character cut in two is no text in UTF-8 and becomes U+FFFD.
    Text of ASCII characters alone takes a shorter way.
    """
    cut = F.substr(F.encode(x, "UTF-16BE"), first * 2 + 1, count * 2)
    size = F.octet_length(cut)
    head = F.hex(F.substring(cut, 1, 1)).between("DC", "DF")
    tail = (size > 1) & F.hex(F.substr(cut, size - 1, F.lit(1))).between("D8", "DB")
    lone, none = F.lit("\ufffd"), F.lit("")
    whole = F.substr(cut, F.when(head, 3).otherwise(1), size - F.when(head, 2).otherwise(0) - F.when(tail, 2).otherwise(0))
    pieces = F.concat(F.when(head, lone).otherwise(none), F.decode(whole, "UTF-16BE"), F.when(tail, lone).otherwise(none))
    return F.when(F.octet_length(x) == F.length(x), F.substr(x, first + 1, count)).otherwise(pieces)


def substring(x: Any, start: Any, length: Any) -> Cell:
    """Zero-based slice by UTF-16 units; a null start or length leaves the text unchanged. A
    half of a character that the slice leaves alone becomes U+FFFD."""
    x = c.text_arg("substring", x)
    start = c.number_arg("substring", start)
    length = c.number_arg("substring", length)
    if (start.is_literal and start.literal is None) or (length.is_literal and length.literal is None):
        return x
    zero = F.lit(0)
    most = F.lit(MOST_UNITS)
    first = F.least(F.greatest(c.truncated_int(start), zero), most)
    piece = unit_slice(x.col, first, F.least(F.greatest(c.truncated_int(length), zero), most))
    known = [a.col.isNotNull() for a in (start, length) if not a.is_literal]
    if known:
        both = known[0] if len(known) == 1 else known[0] & known[1]
        piece = F.when(both, piece).otherwise(x.col)
    return c.like(x, piece)


def replace(x: Any, search: Any, replacement: Any) -> Cell:
    """Every exact match replaced; empty or null arguments leave the text unchanged."""
    x = c.text_arg("replace", x)
    search = c.literal_text("replace", search)
    replacement = c.literal_text("replace", replacement)
    if any(a.is_literal and a.literal is None for a in (search, replacement)):
        return x
    return c.like(x, F.coalesce(F.replace(x.col, search.col, replacement.col), x.col))


def _java(x: Cell, pattern: Any, name: str) -> tuple[Column | None, Column]:
    """The pattern in Java's spelling, null where it is none; and the texts that it is sought in.
    A constant is translated now and raises if it is invalid; None where it is null."""
    p = c.literal_text(name, pattern)
    if not p.is_literal:
        return regex.translated(p.col)["pattern"], x.col
    return (None if p.literal is None else F.lit(regex.to_java(p.literal).pattern)), x.col


def extract_regex(x: Any, pattern: Any) -> Cell:
    """The first match of the pattern, or null, also if a column's pattern is invalid."""
    x = c.text_arg("extractRegex", x)
    java, text = _java(x, pattern, "extractRegex")
    if java is None:
        return Cell(F.lit(None).cast("string"), "string", c.STRING)
    found = F.when(F.rlike(text, java), F.call_function("regexp_extract", text, java, F.lit(0)))
    return Cell(found, "string", c.STRING)


def replace_regex(x: Any, pattern: Any, replacement: Any) -> Cell:
    """Every match of the pattern replaced; ``$1``, ``$<name>``, ``$&``, `` $` ``, ``$'`` and ``$$`` are
    understood. A null argument, or an invalid pattern from a column, leaves the text unchanged."""
    x = c.text_arg("replaceRegex", x)
    p, r = c.literal_text("replaceRegex", pattern), c.literal_text("replaceRegex", replacement)
    if any(a.is_literal and a.literal is None for a in (p, r)):
        return with_fields(x, type="string", literal=c.NOT_A_LITERAL)
    if p.is_literal and r.is_literal:
        java = regex.to_java(p.literal)
        parts = regex.replacement_to_java(r.literal, java)
        if not parts.around:
            found = F.regexp_replace(x.col, F.lit(java.pattern), F.lit(parts.segments[0]))
        else:
            texts = [F.array(*map(F.lit, part)) for part in (parts.segments, parts.around)]
            found = regex.woven(x.col, F.lit(java.pattern), *texts)
        return Cell(found, "string", c.STRING)
    if p.is_literal:
        regex.to_java(p.literal)
    parts = regex.translated(p.col, r.col)
    plain = F.regexp_replace(x.col, parts["pattern"], F.get(parts["segments"], F.lit(0)))
    found = F.when(F.size(parts["around"]) > 0, regex.woven(x.col, parts["pattern"], parts["segments"], parts["around"])).otherwise(plain)
    return Cell(F.when(parts["pattern"].isNotNull(), found).otherwise(x.col), "string", c.STRING)


def split_text(x: Column, delimiter: str, limit: int = -1) -> Column:
    """Split on literal text. Escaped one by one, a single character keeps
    Java's non-regex fast path."""
    return F.split(x, re.sub(r"([^\w\s])", r"\\\1", delimiter, flags=re.ASCII), limit)


def split(x: Any, delimiter: Any) -> Cell:
    """A list of parts, empty parts kept; null gives an empty list."""
    x = c.text_arg("split", x)
    d = c.literal_text("split", delimiter)
    if not d.is_literal:
        quoted = F.concat(F.lit(r"\Q"), F.replace(d.col, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        parts = F.when(d.col == "", _characters(x.col)).otherwise(F.split(x.col, quoted, -1))
    elif d.literal is None:
        parts = F.lit(None).cast(LIST)
    elif d.literal == "":
        parts = _characters(x.col)
    else:
        parts = split_text(x.col, d.literal)
    return Cell(F.coalesce(parts, F.array().cast(LIST)), x.type, LIST)


def _characters(x: Column) -> Column:
    return F.filter(F.split(x, "", -1), lambda part: part != "")


def concat(*values: Any) -> Cell:
    """Every value as text, joined without a separator; null counts as empty."""
    if len(values) < 2:
        raise StepError("invalidExpression", "concat needs at least two values")
    parts = [c.scalar("concat", v) for v in values]
    return Cell(F.concat_ws("", *[c.text(p) for p in parts]), "string", c.STRING)


def _text_or_list(name: str, x: Any) -> Cell:
    x = c.cell(x)
    return x if x.is_list else c.text_arg(name, x)


def length(x: Any) -> Cell:
    """Number of UTF-16 units of a text, or of items of a list."""
    x = _text_or_list("length", x)
    if x.is_list:
        return c.number(F.size(x.col).cast("double"))
    return c.number(_units(x.col).cast("double"))


def at_index(x: Any, index: Any) -> Cell:
    """The zero-based item or UTF-16 unit; null when out of range. Half a character is U+FFFD."""
    x = _text_or_list("atIndex", x)
    index = c.number_arg("atIndex", index)
    kind = "string" if x.is_list or x.type == "string" else "unknown"
    if index.is_literal and index.literal is None:
        return Cell(F.lit(None).cast("string"), kind, c.STRING)
    i = c.truncated_int(index)
    if x.is_list:
        return Cell(F.get(x.col, i), kind, c.STRING)
    # Behind the last unit the slice is empty.
    unit = F.nullif(unit_slice(x.col, F.greatest(F.least(i, F.lit(MOST_UNITS)), F.lit(0)), F.lit(1)), F.lit(""))
    return Cell(F.when(i >= 0, unit), kind, c.STRING)


def first(x: Any) -> Cell:
    """The first UTF-16 unit or item; null when there is none."""
    x = _text_or_list("first", x)
    if x.is_list:
        return Cell(F.get(x.col, F.lit(0)), "string", c.STRING)
    return c.like(x, F.nullif(unit_slice(x.col, F.lit(0), F.lit(1)), F.lit("")))


def last(x: Any) -> Cell:
    """The last UTF-16 unit or item; null when there is none."""
    x = _text_or_list("last", x)
    if x.is_list:
        return Cell(F.try_element_at(x.col, F.lit(-1)), "string", c.STRING)
    return c.like(x, F.nullif(unit_slice(x.col, F.greatest(_units(x.col) - 1, F.lit(0)), F.lit(1)), F.lit("")))
