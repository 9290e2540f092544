"""A plain-Python statement of what each function returns, for tests only."""

import math
import re
from datetime import datetime, timedelta, timezone
from decimal import Decimal

WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(chr(c) for c in range(0x2000, 0x200B))
UNIT = {"years": 365 * 86400, "months": 30 * 86400, "days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}


def trim(x):
    return None if x is None else x.strip(WS)


def collapse(x):
    return None if x is None else re.sub(f"[{WS}]+", " ", x)


def is_empty(x):
    return x is None or x.strip(WS) == ""


def to_number(x):
    t = (x or "").strip(WS)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t, re.ASCII):
        value = float(t)
        return value if math.isfinite(value) else None
    for base, mark in ((16, "x"), (8, "o"), (2, "b")):
        if t[:2].lower() == "0" + mark:
            try:
                return float(int(t[2:], base)) if "_" not in t and not re.search(r"[+\-\s]", t) else None
            except ValueError:
                return None
    return None


def to_boolean(x):
    t = (x or "").strip(WS).lower()
    return True if t in ("true", "1", "yes") else False if t in ("false", "0", "no") else None


def to_string(x):
    if x is None:
        return None
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    digits = "".join(map(str, digits))
    point = len(digits) + exponent
    if 0 < point <= 21:
        body = digits.ljust(point, "0") if exponent >= 0 else digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        e = point - 1
        mantissa = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
        body = f"{mantissa}e{'+' if e > 0 else '-'}{abs(e)}"
    return ("-" if sign else "") + body


def round_half_up(x):
    return None if x is None else float(math.floor(Decimal(x) + Decimal("0.5")))


def modulo(a, b):
    return None if a is None or b is None or b == 0 else math.fmod(a, b)


def divide(a, b):
    return None if a is None or b is None or b == 0 else a / b


def less_than(a, b):
    return True if a is None else b is not None and a < b


def greater_than(a, b):
    return a is not None and b is not None and a > b


def units(x, start, stop):
    """A slice by UTF-16 units; lone halves of characters become U+FFFD."""
    cut = x.encode("utf-16-be")[2 * start : 2 * stop].decode("utf-16-be", "surrogatepass")
    return "".join("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c for c in cut)


def substring(x, start, length):
    if x is None or start is None or length is None:
        return x
    s, n = max(0, math.trunc(start)), max(0, math.trunc(length))
    return units(x, s, s + n)


def at_index(x, i):
    if x is None or i is None:
        return None
    i = math.trunc(i)
    if isinstance(x, list):
        return x[i] if 0 <= i < len(x) else None
    return (units(x, i, i + 1) or None) if i >= 0 else None


def length(x):
    return None if x is None else float(len(x.encode("utf-16-be")) // 2)


def coalesce(a, b):
    return b if a is None or a == "" else a


def moment(x):
    t = (x or "").strip(WS)
    if re.fullmatch(r"\d{4}-\d\d-\d\d", t) or re.fullmatch(
        r"\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?", t
    ):
        try:
            parsed = datetime.fromisoformat(t)
        except ValueError:
            return None
        return (parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    return None


def iso(at):
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def date_add(x, n, unit):
    at = moment(x)
    if at is None or n is None:
        return None
    if unit in ("years", "months"):
        months = math.trunc(at.year + n) * 12 + at.month - 1 if unit == "years" else at.year * 12 + math.trunc(at.month - 1 + n)
        start = datetime(months // 12, months % 12 + 1, 1, tzinfo=timezone.utc)
        return iso(start + timedelta(days=at.day - 1, hours=at.hour, minutes=at.minute, seconds=at.second, microseconds=at.microsecond))
    field = {"days": at.day, "hours": at.hour, "minutes": at.minute, "seconds": at.second}[unit]
    return iso(at + timedelta(seconds=(math.trunc(field + n) - field) * UNIT[unit]))


def date_diff(a, b, unit):
    left, right = moment(a), moment(b)
    if left is None or right is None:
        return None
    return ((left - right) // timedelta(milliseconds=1)) / (UNIT[unit] * 1000)


def date_part(x, part):
    at = moment(x)
    if at is None:
        return None
    if part == "dayOfWeek":
        return float((at.weekday() + 1) % 7)
    return float(getattr(at, part))
