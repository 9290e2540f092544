"""Functions over cells, for use inside step expressions.

>>> from tablewash import functions as fx
>>> lambda row: fx.lower(fx.trim(row["email"]))
"""

from tablewash.functions.casts import to_boolean, to_number, to_string
from tablewash.functions.cells import Cell, literal, truthy
from tablewash.functions.dates import date_add, date_diff, date_part
from tablewash.functions.logic import (
    and_,
    at_least,
    at_most,
    between,
    coalesce,
    contains,
    ends_with,
    equals,
    greater_than,
    is_empty,
    less_than,
    matches_regex,
    not_,
    not_equals,
    or_,
    starts_with,
)
from tablewash.functions.numbers import abs, add, ceil, divide, floor, modulo, multiply, round, subtract
from tablewash.functions.text import (
    at_index,
    collapse_whitespace,
    concat,
    extract_regex,
    first,
    last,
    length,
    lower,
    replace,
    replace_regex,
    split,
    substring,
    trim,
    upper,
)
