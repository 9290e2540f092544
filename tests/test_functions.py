"""Every function against the plain-Python model, on random messy values."""

import math
import random

import pytest
from pyspark.sql import functions as F

import model
from tablewash import Row, StepError, Table
from tablewash import functions as fx

PIECES = [" ", "\u00a0", "\t", "\n", "a", "B", "\u00df", "\u00e9", "\U0001f600", "1", "7", ".", "-", "x", "0x", "e", "\ufeff", "$", "\\E", ",", "|"]
TEXTS = [
    None, "", "   ", "\u00a0", " Alice  Ng ", "42", " 42 ", "-3.5", ".5", "5.", "+1", "007", "1e5", "1E-3", "1e999", "Infinity",
    "NaN", "1d", "0x1F", "0X1f", "0o17", "0b101", "0b102", "-0x10", "0xffffffffffffffffff", "1_000", "true", " YES ", "No", "0", "1", "t", "y",
    "a.b.c", "a|b", "$1", "a\\Eb", "x\ny", "\U0001f600a", "123456789.123456789", "1e21", "9007199254740993", "12,5",
]
NUMBERS = [
    None, 0.0, -0.0, 1.0, -1.0, 2.5, -2.5, 0.5, -0.5, 0.49999999999999994, 1e15, 1e16, 1e20, 1e21, 1.5e300, 1e-6, 1e-7, 123456.789,
    120.5, 0.1 + 0.2, 100.0, 1e7, 12345678901234.5, 2.0**53, 2.0**60, 4503599627370497.5, -7.5, 2.0**-44, 1.7976931348623157e308, 1 / 3, 1234567.891e-9,
]
DATES = [
    None, "", "bad", "2026-01-02", " 2026-01-31 ", "2024-02-29", "2026-1-2", "2026-13-01", "2025-02-30", "1969-12-31",
    "2026-01-31T23:59:59.999Z", "2026-03-31T10:00", "2026-03-31T10:00:05", "2026-01-31T10:00:00+02:00", "2026-06-15T01:30:00-05:30", "20260101",
]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        text = rng.choice(TEXTS) if i % 2 else "".join(rng.choices(PIECES, k=rng.randint(0, 8)))
        other = rng.choice(TEXTS) if rng.random() < 0.7 else "".join(rng.choices(PIECES, k=2))
        number = rng.choice(NUMBERS) if i % 3 else round(rng.uniform(-1000, 1000), rng.randint(0, 9))
        small = rng.choice([None, 0.0, 1.0, -1.0, 2.0, 3.7, -0.5, 100.0])
        rows.append((i, text, other, number, small, rng.choice(DATES), rng.choice(DATES), rng.choice([None, True, False])))
    schema = "id int, t string, u string, n double, m double, d string, e string, b boolean"
    return Table.of(spark.createDataFrame(rows, schema).repartition(4), "id"), rows


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


CASES = {
    "trim": (lambda r: fx.trim(r["t"]), lambda t, u, n, m, d, e, b: model.trim(t)),
    "lower": (lambda r: fx.lower(r["t"]), lambda t, u, n, m, d, e, b: t and t.lower() if t else t),
    "upper": (lambda r: fx.upper(r["t"]), lambda t, u, n, m, d, e, b: t.upper() if t else t),
    "collapse": (lambda r: fx.collapse_whitespace(r["t"]), lambda t, u, n, m, d, e, b: model.collapse(t)),
    "substring": (lambda r: fx.substring(r["t"], r["m"], r["n"]), lambda t, u, n, m, d, e, b: model.substring(t, m, n)),
    "substring_literal": (lambda r: fx.substring(r["t"], 1, 2.9), lambda t, u, n, m, d, e, b: model.substring(t, 1, 2)),
    "substring_negative": (lambda r: fx.substring(r["t"], -3, 2), lambda t, u, n, m, d, e, b: model.substring(t, -3, 2)),
    "substring_null": (lambda r: fx.substring(r["t"], None, 2), lambda t, u, n, m, d, e, b: t),
    "replace": (
        lambda r: fx.replace(r["t"], r["u"], "<>"),
        lambda t, u, n, m, d, e, b: t if t is None or not u else t.replace(u, "<>"),
    ),
    "split_length": (
        lambda r: fx.length(fx.split(r["t"], r["u"])),
        lambda t, u, n, m, d, e, b: 0.0 if t is None or u is None else float(len(t.split(u) if u else list(t))),
    ),
    "split_last": (
        lambda r: fx.last(fx.split(r["t"], ".")),
        lambda t, u, n, m, d, e, b: None if t is None else t.split(".")[-1],
    ),
    "split_at": (
        lambda r: fx.at_index(fx.split(r["t"], "|"), r["m"]),
        lambda t, u, n, m, d, e, b: None if t is None else model.at_index(t.split("|"), m),
    ),
    "split_chars": (lambda r: fx.length(fx.split(r["t"], "")), lambda t, u, n, m, d, e, b: float(len(t or ""))),
    "concat": (
        lambda r: fx.concat(r["t"], r["n"], r["b"], "!"),
        lambda t, u, n, m, d, e, b: (t or "") + (model.to_string(n) or "") + ("" if b is None else str(b).lower()) + "!",
    ),
    "length": (lambda r: fx.length(r["t"]), lambda t, u, n, m, d, e, b: model.length(t)),
    "at_index": (lambda r: fx.at_index(r["t"], r["m"]), lambda t, u, n, m, d, e, b: model.at_index(t, m)),
    "first": (lambda r: fx.first(r["t"]), lambda t, u, n, m, d, e, b: model.units(t, 0, 1) if t else None),
    "last": (
        lambda r: fx.last(r["t"]),
        lambda t, u, n, m, d, e, b: model.units(t, int(model.length(t)) - 1, int(model.length(t))) if t else None,
    ),
    "coalesce": (lambda r: fx.coalesce(r["t"], r["u"]), lambda t, u, n, m, d, e, b: model.coalesce(t, u)),
    "coalesce_numbers": (lambda r: fx.coalesce(r["n"], 9), lambda t, u, n, m, d, e, b: 9.0 if n is None else n),
    "coalesce_many": (
        lambda r: fx.coalesce(r["t"], r["u"], "z"),
        lambda t, u, n, m, d, e, b: model.coalesce(model.coalesce(t, u), "z"),
    ),
    "to_number": (lambda r: fx.to_number(r["t"]), lambda t, u, n, m, d, e, b: model.to_number(t)),
    "to_number_bool": (lambda r: fx.to_number(r["b"]), lambda t, u, n, m, d, e, b: None if b is None else float(b)),
    "to_string": (lambda r: fx.to_string(r["n"]), lambda t, u, n, m, d, e, b: model.to_string(n)),
    "to_boolean": (lambda r: fx.to_boolean(r["t"]), lambda t, u, n, m, d, e, b: model.to_boolean(t)),
    "to_boolean_number": (lambda r: fx.to_boolean(r["m"]), lambda t, u, n, m, d, e, b: {1.0: True, 0.0: False}.get(m)),
    "round": (lambda r: fx.round(r["n"]), lambda t, u, n, m, d, e, b: model.round_half_up(n)),
    "floor": (lambda r: fx.floor(r["n"]), lambda t, u, n, m, d, e, b: None if n is None else float(math.floor(n))),
    "ceil": (lambda r: fx.ceil(r["n"]), lambda t, u, n, m, d, e, b: None if n is None else float(math.ceil(n))),
    "abs": (lambda r: fx.abs(r["n"]), lambda t, u, n, m, d, e, b: None if n is None else abs(n)),
    "add": (lambda r: fx.add(r["n"], r["m"]), lambda t, u, n, m, d, e, b: None if None in (n, m) else n + m),
    "subtract": (lambda r: fx.subtract(r["n"], r["m"]), lambda t, u, n, m, d, e, b: None if None in (n, m) else n - m),
    "multiply": (lambda r: fx.multiply(r["n"], r["m"]), lambda t, u, n, m, d, e, b: None if None in (n, m) else n * m),
    "divide": (lambda r: fx.divide(r["n"], r["m"]), lambda t, u, n, m, d, e, b: model.divide(n, m)),
    "modulo": (lambda r: fx.modulo(r["n"], r["m"]), lambda t, u, n, m, d, e, b: model.modulo(n, m)),
    "is_empty": (lambda r: fx.is_empty(r["t"]), lambda t, u, n, m, d, e, b: model.is_empty(t)),
    "is_empty_number": (lambda r: fx.is_empty(r["n"]), lambda t, u, n, m, d, e, b: n is None),
    "equals": (lambda r: fx.equals(r["t"], r["u"]), lambda t, u, n, m, d, e, b: t == u),
    "equals_null": (lambda r: fx.equals(r["t"], None), lambda t, u, n, m, d, e, b: t is None),
    "not_equals": (lambda r: fx.not_equals(r["m"], 1), lambda t, u, n, m, d, e, b: m != 1),
    "greater_than": (lambda r: fx.greater_than(r["n"], r["m"]), lambda t, u, n, m, d, e, b: model.greater_than(n, m)),
    "less_than": (lambda r: fx.less_than(r["n"], r["m"]), lambda t, u, n, m, d, e, b: model.less_than(n, m)),
    "less_than_literal": (lambda r: fx.less_than(0, r["m"]), lambda t, u, n, m, d, e, b: model.less_than(0, m)),
    "at_least": (lambda r: fx.at_least(r["n"], r["m"]), lambda t, u, n, m, d, e, b: model.greater_than(n, m) or n == m),
    "at_most": (lambda r: fx.at_most(r["n"], r["m"]), lambda t, u, n, m, d, e, b: model.less_than(n, m) or n == m),
    "between": (
        lambda r: fx.between(r["n"], 0, 100, include_high=False),
        lambda t, u, n, m, d, e, b: n is not None and 0 <= n < 100,
    ),
    "contains": (lambda r: fx.contains(r["t"], r["u"]), lambda t, u, n, m, d, e, b: None not in (t, u) and u in t),
    "contains_null": (lambda r: fx.contains(r["t"], None), lambda t, u, n, m, d, e, b: False),
    "starts_with": (lambda r: fx.starts_with(r["t"], "a"), lambda t, u, n, m, d, e, b: (t or "").startswith("a")),
    "ends_with": (lambda r: fx.ends_with(r["t"], r["u"]), lambda t, u, n, m, d, e, b: None not in (t, u) and t.endswith(u)),
    "and": (
        lambda r: fx.and_(r["b"], fx.is_empty(r["t"])),
        lambda t, u, n, m, d, e, b: bool(b) and model.is_empty(t),
    ),
    "or": (lambda r: fx.or_(r["b"], fx.is_empty(r["t"])), lambda t, u, n, m, d, e, b: bool(b) or model.is_empty(t)),
    "not": (lambda r: fx.not_(r["b"]), lambda t, u, n, m, d, e, b: not b),
    "truthy_text": (lambda r: fx.truthy(r["t"]), lambda t, u, n, m, d, e, b: bool(t)),
    "truthy_number": (lambda r: fx.truthy(r["n"]), lambda t, u, n, m, d, e, b: bool(n)),
    "date_diff": (lambda r: fx.date_diff(r["d"], r["e"], "months"), lambda t, u, n, m, d, e, b: model.date_diff(d, e, "months")),
    "date_diff_seconds": (
        lambda r: fx.date_diff(r["d"], "2026-01-01", "seconds"),
        lambda t, u, n, m, d, e, b: model.date_diff(d, "2026-01-01", "seconds"),
    ),
}
for _part in ("year", "month", "day", "dayOfWeek", "hour", "minute", "second"):
    CASES[f"date_part_{_part}"] = (
        lambda r, p=_part: fx.date_part(r["d"], p),
        lambda t, u, n, m, d, e, b, p=_part: model.date_part(d, p),
    )
for _unit in ("years", "months", "days", "hours", "minutes", "seconds"):
    for _label, _amount in (("one", 1), ("back", -13), ("fraction", 1.5)):
        CASES[f"date_add_{_unit}_{_label}"] = (
            lambda r, x=_unit, a=_amount: fx.date_add(r["d"], a, x),
            lambda t, u, n, m, d, e, b, x=_unit, a=_amount: model.date_add(d, a, x),
        )
    CASES[f"date_add_{_unit}_column"] = (
        lambda r, x=_unit: fx.date_add(r["d"], r["m"], x),
        lambda t, u, n, m, d, e, b, x=_unit: model.date_add(d, m, x),
    )


@pytest.fixture(scope="module")
def results(data):
    table, _ = data
    row = Row(table)
    # A few columns per job, so that generated code stays compiled.
    names, found = list(CASES), {}
    for start in range(0, len(names), 12):
        part = names[start : start + 12]
        df = row.stage(table.df).select("id", *[CASES[n][0](row).col.alias(n) for n in part])
        for r in df.collect():
            for n in part:
                found.setdefault(n, {})[r["id"]] = r[n]
    return found


@pytest.mark.parametrize("name", list(CASES))
def test_matches_model(name, data, results):
    wrong = []
    for i, *values in data[1]:
        expected, actual = CASES[name][1](*values), results[name][i]
        if not same(actual, expected):
            wrong.append((values, actual, expected))
    assert not wrong, wrong[:5]


def test_filters_agree_with_columns(data):
    """The form of a predicate used for filtering selects the same rows."""
    table, _ = data
    row = Row(table)
    for name, (build, _) in CASES.items():
        test = build(row)
        if test.where is None:
            continue
        kept = table.df.filter(test.where).count()
        assert kept == table.df.filter(test.col).count(), name


@pytest.mark.parametrize(
    "build, code",
    [
        (lambda r: fx.lower(r["n"]), "incompatibleType"),
        (lambda r: fx.add(r["t"], 1), "incompatibleType"),
        (lambda r: fx.greater_than(r["t"], r["u"]), "incompatibleType"),
        (lambda r: fx.greater_than(r["t"], 100), "incompatibleType"),
        (lambda r: fx.equals(r["t"], 1), "incompatibleType"),
        (lambda r: fx.coalesce(r["t"], 1), "incompatibleType"),
        (lambda r: fx.and_(r["t"], True), "incompatibleType"),
        (lambda r: fx.date_part(r["n"], "year"), "incompatibleType"),
        (lambda r: fx.date_part(r["d"], "week"), "invalidExpression"),
        (lambda r: fx.date_diff(r["d"], r["e"], "weeks"), "invalidExpression"),
        (lambda r: fx.date_add(r["d"], 1, r["t"]), "invalidExpression"),
        (lambda r: fx.concat(r["t"]), "invalidExpression"),
        (lambda r: fx.or_(True), "invalidExpression"),
        (lambda r: fx.concat(fx.split(r["t"], ","), "a"), "invalidExpression"),
        (lambda r: fx.matches_regex(r["t"], "[a-z"), "invalidRegex"),
        (lambda r: fx.matches_regex(r["n"], "a"), "incompatibleType"),
        (lambda r: r["nope"], "missingColumn"),
    ],
)
def test_errors_before_any_job(data, build, code):
    with pytest.raises(StepError) as caught:
        build(Row(data[0]))
    assert caught.value.code == code


def test_native_dates_and_literals(spark):
    df = spark.sql(
        "select 1 id, date'2026-01-31' d, timestamp'2026-01-31 10:00:00.5' t, timestamp_ntz'2026-01-31 10:00:00.5' z"
    )
    row = Row(Table.of(df, "id"))
    got = df.select(
        fx.date_add(row["d"], 1, "months").col.alias("a"),
        fx.date_add(row["t"], 1, "months").col.alias("b"),
        fx.date_part(row["z"], "hour").col.alias("c"),
        fx.date_diff(row["z"], row["t"], "seconds").col.alias("e"),
        fx.to_string(row["t"]).col.alias("f"),
        fx.to_string(row["d"]).col.alias("g"),
        fx.equals(row["d"], "2026-01-31").col.alias("h"),
        fx.less_than(row["t"], "2026-02-01T00:00:00Z").col.alias("i"),
        fx.is_empty(row["d"]).col.alias("j"),
    ).first()
    assert tuple(got) == (
        "2026-03-03T00:00:00.000Z", "2026-03-03T10:00:00.500Z", 10.0, 0.0,
        "2026-01-31T10:00:00.500Z", "2026-01-31", True, True, False,
    )


REGEX = [
    (r"ORD-\d+", "Order: ORD-1234 (urgent)", "ORD-1234"),
    (r"a$", "a\n", None),
    (r"^a.c$", "a\u0085c", "a\u0085c"),
    (r"\s+", "x\u00a0\u3000y", "\u00a0\u3000"),
    (r"[^\s]+", "\u00a0yz\u00a0", "yz"),
    (r"[\S]+", "\u00a0yz\u00a0", "yz"),
    (r"\bcaf", "un caf\u00e9", "caf"),
    (r"\w+", "\u00e9abc", "abc"),
    (r"[[&&]+", "x[&&y", "[&&"),
    (r"[\b]", "a\bc", "\b"),
    (r"a{,2}", "a{,2}", "a{,2}"),
    (r"x*", "abc", ""),
    (r"[^]", "\n", "\n"),
    (r"a|[]", "ba", "a"),
    (r"\z\A\h", "zAh", "zAh"),
    (r"(?<y>\d{4})-\k<y>", "2020-2020", "2020-2020"),
    (r"[$.]+", "a$.b", "$."),
    (r"[^a-z]+", "ab12c", "12"),
]


@pytest.mark.parametrize("pattern, text, expected", REGEX)
def test_regex_dialect(spark, pattern, text, expected):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    row = Row(Table.of(df, "id"))
    found = df.select(fx.extract_regex(row["t"], pattern).col, fx.matches_regex(row["t"], pattern).col).first()
    assert tuple(found) == (expected, expected is not None)


@pytest.mark.parametrize(
    "pattern, replacement, text, expected",
    [
        (r"\s+", "_", "Order: ORD-1 (x)", "Order:_ORD-1_(x)"),
        (r"(\d)(\d)", "$2$1", "12 34", "21 43"),
        (r"\d", "<$&>", "a1", "a<1>"),
        (r"\d", "$$", "a1", "a$"),
        (r"(\d)", "$10", "a1", "a10"),
        (r"(\d)", "$2", "a1", "a$2"),
        (r"\d", r"\n", "a1", r"a\n"),
        (r"(?<d>\d)", "[$<d>]", "a1", "a[1]"),
        (r"\d", "$<d>", "a1", "a$<d>"),
        (r"[^0-9]", "", "202-555", "202555"),
        (r"(?<my_name>\d)x", "<$<my_name>>", "1x2", "<1>2"),
        (r"b", "[$`]", "abcb", "a[a]c[abc]"),
        (r"b", "[$']", "abcb", "a[cb]c[]"),
        (r"(b)(c)", "$2$`|$'$1", "abcd", "aca|dbd"),
        (r"x", "$`$'", "abc", "abc"),
        (r"", "-$`", "ab", "-a-ab-ab"),
        (r"\.", "$'\\$$", "a.b.", "ab.\\$b\\$"),
    ],
)
def test_regex_replacement(spark, pattern, replacement, text, expected):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    row = Row(Table.of(df, "id"))
    assert df.select(fx.replace_regex(row["t"], pattern, replacement).col).first()[0] == expected


def test_patterns_from_columns(spark):
    """Each row has a pattern of its own; constants give the same, and invalid ones find nothing."""
    cases = [(p, t, r) for p, t, _ in REGEX for r in ("<$&>", "$`|$'", "$1x")]
    cases += [(p, "aab [a-z (a *a", "x") for p in ("[a-z", "(a", "a)", "*a", "a++", "(?i)a", "a\\", "(?<=a*)b", "a{99999999999}", r"\k<y>(?<n>a)")]
    cases += [("a", None, "x"), (None, "abc", "x"), ("a", "abc", None), ("(?<=a{1,2})b", "aab", "x"), (r"(?<a_b>c)\k<a_b>", "cc", "[$<a_b>]")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, p string, t string, r string").repartition(3)
    row = Row(Table.of(df, "id"))
    found = df.select(
        "*",
        fx.extract_regex(row["t"], row["p"]).col.alias("e"),
        fx.matches_regex(row["t"], row["p"]).col.alias("m"),
        fx.replace_regex(row["t"], row["p"], row["r"]).col.alias("s"),
        fx.replace_regex(row["t"], "a", row["r"]).col.alias("q"),
        fx.replace_regex(row["t"], row["p"], "-").col.alias("u"),
    ).collect()
    assert len(found) == len(cases)
    for r in found:
        one = spark.createDataFrame([(1, r.t)], "id int, t string")
        t = Row(Table.of(one, "id"))["t"]
        try:
            want = one.select(
                fx.extract_regex(t, r.p).col, fx.matches_regex(t, r.p).col, fx.replace_regex(t, r.p, r.r).col,
                fx.replace_regex(t, "a", r.r).col, fx.replace_regex(t, r.p, "-").col,
            ).first()
        except StepError:
            want = (None, False, r.t, None if r.t is None else r.t.replace("a", r.r), r.t)
        assert (r.e, r.m, r.s, r.q, r.u) == tuple(want), r


@pytest.mark.parametrize("pattern", ["[a-z", "(a", "a)", "*a", "a++", "(?>a)", "(?i)a", "[z-a]", "a\\"])
def test_bad_patterns(pattern):
    from tablewash.functions import regex

    with pytest.raises(StepError) as caught:
        regex.to_java(pattern)
    assert caught.value.code == "invalidRegex"


def test_expressions_stay_native(data):
    table, _ = data
    row = Row(table)
    plan = table.df.select(*[b(row).col.alias(n) for n, (b, _) in list(CASES.items())[:40]])._jdf.queryExecution().toString()
    assert "Python" not in plan and "ScalaUDF" not in plan
    assert F is not None
