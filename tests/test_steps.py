"""Steps on a generated table, against plain loops over its rows."""

import random

import pytest

import model
from support import cells, fills
from tablewash import StepError, Table
from tablewash import functions as fx
from tablewash.operators import (
    Case,
    Patch,
    combine_columns,
    comment,
    deduplicate_rows,
    derive_column,
    drop_columns,
    filter_rows,
    rename_column,
    scoped_rule,
    sort_rows,
    split_column,
)
from tablewash.plans import apply_steps, count_steps, find_issues
from tablewash.reports import change_summary, execute, run_summary
from tablewash.sinks import write_csv, write_parquet

DEPOTS = ["Kiel", "Turku", " Gdynia ", "", None, "\t"]
NOTES = ["fragile; upright", "cold;;keep", "", None, " heavy ", "A;b;C;d"]


def parcels(rows=60, seed=3):
    """Parcels with gaps, blanks, equal weights and awkward amounts."""
    rng = random.Random(seed)
    return [
        (
            n,
            rng.choice(DEPOTS),
            rng.choice(DEPOTS),
            rng.choice([None, 0.0, -2.5, 0.5, 1.5, 2.5, 40.0, 40.0, 1e21]),
            rng.choice(NOTES),
            rng.choice([None, "12", " 7.5", "0x1F", "n/a", ""]),
            rng.choice([True, False, None]),
        )
        for n in range(1, rows + 1)
    ]


FIELDS = ["no", "depot", "fallback", "kg", "note", "fee", "paid"]


@pytest.fixture(scope="module")
def rows():
    return [dict(zip(FIELDS, r)) for r in parcels()]


@pytest.fixture(scope="module")
def table(spark):
    schema = "no int, depot string, fallback string, kg double, note string, fee string, paid boolean"
    return Table.of(spark.createDataFrame(parcels(), schema), "no")


def summary(before, after):
    return change_summary(before, after).first().asDict()


def numbers(table):
    """Parcel numbers in row order."""
    return cells(table, "no")


def test_rule_under_a_condition(table, rows):
    rule = scoped_rule(
        ["depot", "note"], default=Patch(lambda r, v: fx.coalesce(v, "none")), where=lambda r: fx.equals(r["paid"], True)
    )
    out = apply_steps(table, [rule])
    changed = 0
    for name in ("depot", "note"):
        want = ["none" if r["paid"] and r[name] in (None, "") else r[name] for r in rows]
        changed += sum(a != r[name] for a, r in zip(want, rows))
        assert cells(out, name) == want
    assert summary(table, out)["changed_cell_count"] == changed
    paid = sum(r["paid"] is True for r in rows)
    assert tuple(rule.metrics(table).first()) == (2 * paid, changed, 0, changed)


def test_each_case_sees_what_the_last_one_left(table, rows):
    rule = scoped_rule(
        ["depot"],
        cases=[
            Case(lambda r, v: fx.is_empty(v), Patch(lambda r, v: r["fallback"])),
            Case(lambda r, v: fx.is_empty(v), Patch(fill="#ABCDEF")),
        ],
    )
    out = apply_steps(table, [rule])
    want = [r["fallback"] if model.is_empty(r["depot"]) else r["depot"] for r in rows]
    assert cells(out, "depot") == want
    assert fills(out, "depot") == ["#abcdef" if model.is_empty(v) else None for v in want]


def test_rule_reads_other_targets_as_they_were(spark):
    t = Table.of(spark.createDataFrame([(1, "a", "b")], "id int, x string, y string"), "id")
    swap = scoped_rule(["x", "y"], default=Patch(lambda r, v: fx.concat(r["y"], r["x"])))
    out = swap(t)
    assert out.to_df().first()[1:] == ("ba", "ba")
    assert scoped_rule(["x"], default=Patch(None))(t).to_df().first()[1] is None


def test_default_applies_only_without_a_match_and_later_fill_wins(spark):
    t = Table.of(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, x string"), "id")
    first = scoped_rule(
        ["x"],
        cases=[
            Case(lambda r, v: fx.equals(v, "a"), Patch(fill="#111111")),
            Case(lambda r, v: fx.equals(v, "a"), Patch("c", "#222222")),
            Case(lambda r, v: fx.equals(v, "c"), Patch(lambda r, v: fx.concat(v, "!"))),
        ],
        default=Patch("rest", "#333333"),
    )
    second = scoped_rule(["x"], cases=[Case(lambda r, v: fx.equals(v, "c!"), Patch(fill="#444444"))])
    out = apply_steps(t, [first])
    assert cells(out, "x") == ["c!", "rest", "rest"]
    assert fills(out, "x") == ["#222222", "#333333", "#333333"]
    assert fills(apply_steps(t, [first, second]), "x") == ["#444444", "#333333", "#333333"]


def test_many_cases_keep_the_plan_small(spark):
    t = Table.of(spark.createDataFrame([(1, "a")], "id int, x string"), "id")
    rule = scoped_rule(
        ["x"], cases=[Case(lambda r, v: fx.starts_with(v, "a"), Patch(lambda r, v: fx.concat(v, "b"))) for _ in range(14)]
    )
    out = rule(t).to_df()
    assert out.first()[1] == "a" + "b" * 14
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_match_inside_a_rule(table, rows):
    size = scoped_rule(
        ["note"],
        default=Patch(
            lambda r, v: r.match(
                r["kg"],
                [
                    (lambda kg: fx.is_empty(kg), fx.concat("unweighed ", fx.coalesce(v, "-"))),
                    (lambda kg: fx.greater_than(kg, 30), "pallet"),
                ],
                otherwise=v,
            )
        ),
    )
    want = [
        f"unweighed {r['note'] or '-'}" if r["kg"] is None else "pallet" if r["kg"] > 30 else r["note"] for r in rows
    ]
    assert cells(size(table), "note") == want


def test_nested_text_functions(table, rows):
    out = apply_steps(
        table,
        [
            derive_column("label", "Label", lambda r: fx.upper(fx.concat(fx.first(fx.trim(r["depot"])), "-", fx.to_string(r["no"])))),
            derive_column("tail", "Tail", lambda r: fx.last(fx.split(fx.coalesce(r["note"], ""), ";"))),
        ],
    )
    trimmed = [model.trim(r["depot"]) for r in rows]
    assert cells(out, "label") == [((t[:1] if t else "") + f"-{r['no']}").upper() if t is not None else f"-{r['no']}" for t, r in zip(trimmed, rows)]
    assert cells(out, "tail") == [(r["note"] or "").split(";")[-1] for r in rows]


def test_parts_of_lists_and_arithmetic(table, rows):
    out = apply_steps(
        table,
        [
            derive_column("parts", "Parts", lambda r: fx.length(fx.split(r["note"], ";"))),
            derive_column("second", "Second", lambda r: fx.at_index(fx.split(r["note"], ";"), 1)),
            derive_column("grams", "Grams", lambda r: fx.multiply(r["kg"], 1000)),
            derive_column("share", "Share", lambda r: fx.divide(r["no"], r["kg"])),
        ],
    )
    split = [None if r["note"] is None else r["note"].split(";") for r in rows]
    assert cells(out, "parts") == [0 if s is None else len(s) for s in split]
    assert cells(out, "second") == [s[1] if s and len(s) > 1 else None for s in split]
    assert cells(out, "grams") == [None if r["kg"] is None else r["kg"] * 1000 for r in rows]
    assert cells(out, "share") == [r["no"] / r["kg"] if r["kg"] else None for r in rows]


def test_now_is_one_moment_and_dates_reach_far(spark):
    t = Table.of(spark.createDataFrame([(1, "2024-02-29"), (2, "1999-12-31T23:59:59Z"), (3, "soon")], "no int, due string"), "no")
    moves = {"a": (-9000, "years"), "b": (1e9, "years"), "c": (13, "months"), "d": (1e300, "seconds"), "e": (float("nan"), "days"), "f": (5e7, "days")}
    steps = [derive_column(k, k, lambda r, n=n, u=u: fx.date_add(r["due"], n, u)) for k, (n, u) in moves.items()]
    steps += [derive_column(k, k, lambda r: r.now()) for k in ("n1", "n2")]
    out = apply_steps(t, steps)
    assert cells(out, "a") == ["-006976-02-29T00:00:00.000Z", "-007001-12-31T23:59:59.000Z", None]
    assert cells(out, "b") == cells(out, "d") == cells(out, "e") == [None] * 3
    assert cells(out, "c") == ["2025-03-29T00:00:00.000Z", "2001-01-31T23:59:59.000Z", None]
    assert cells(out, "f")[0].startswith("+138919-")
    assert len({*cells(out, "n1"), *cells(out, "n2")}) == 1


def test_casts_and_a_sort_by_them(table, rows):
    out = apply_steps(
        table,
        [derive_column("amount", "Amount", lambda r: fx.to_number(r["fee"])), sort_rows([("amount", "desc"), ("depot", "asc")])],
    )
    amount = [model.to_number(r["fee"]) for r in rows]
    order = sorted(rows, key=lambda r: r["no"])
    order.sort(key=lambda r: (r["depot"] is None, r["depot"] or ""))
    order.sort(key=lambda r: (amount[r["no"] - 1] is None, -(amount[r["no"] - 1] or 0)))
    assert numbers(out) == [r["no"] for r in order]


def test_filters_keep_and_drop(table, rows):
    heavy = lambda r: fx.greater_than(r["kg"], 1)
    known = [r["no"] for r in rows if r["kg"] is not None and r["kg"] > 1]
    assert numbers(filter_rows("keep", heavy)(table)) == known
    assert numbers(filter_rows("drop", heavy)(table)) == [r["no"] for r in rows if r["no"] not in known]
    empty = filter_rows("keep", lambda r: fx.is_empty(r["depot"]))(table)
    assert numbers(empty) == [r["no"] for r in rows if model.is_empty(r["depot"])]


def test_split_keeps_the_rest_and_combine_skips_gaps(table, rows):
    out = split_column("note", ";", [("head", "Head"), ("rest", "Rest")])(table)
    cut = [(None, None) if r["note"] is None else (*r["note"].split(";", 1), None)[:2] for r in rows]
    assert cells(out, "head") == [a for a, _ in cut]
    assert cells(out, "rest") == [b for _, b in cut]
    joined = combine_columns(["depot", "fallback", "fee"], " > ", "route", "Route")(table)
    want = [" > ".join(v for v in (r["depot"], r["fallback"], r["fee"]) if v not in (None, "")) for r in rows]
    assert cells(joined, "route") == want


def test_dedupe_after_a_sort_keeps_the_first_in_row_order(table, rows):
    order = sorted(rows, key=lambda r: (r["kg"] is None, -(r["kg"] or 0), r["no"]))
    seen, want = set(), []
    for r in order:
        if r["depot"] not in seen:
            seen.add(r["depot"])
            want.append(r["no"])
    out = apply_steps(table, [sort_rows([("kg", "desc")]), deduplicate_rows(["depot"])])
    assert numbers(out) == want
    # A later edit or drop of the key does not disturb the order.
    edited = apply_steps(table, [sort_rows([("kg", "desc")]), scoped_rule(["kg"], default=Patch(1)), drop_columns(["kg"])])
    assert numbers(edited) == [r["no"] for r in order]


def test_dedupe_is_type_and_null_exact(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, None, 1.0), (4, "A", 1.0), (5, "a", 1.0), (6, "", 1.0)]
    t = Table.of(spark.createDataFrame(rows, "id int, k string, v double"), "id")
    assert cells(deduplicate_rows(["k", "v"])(t), "id") == [1, 2, 4, 5]


def test_dedupe_limits_each_task_before_the_shuffle(spark):
    t = Table.of(spark.range(1000).selectExpr("id", "id % 3 as k").repartition(4), "id")
    plan = deduplicate_rows(["k"])(t).to_df()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as double) x", "cast(id as string) s", "id % 2 = 0 as b").write.parquet(str(tmp_path / "p"))
    for t in (Table.read_parquet(spark, str(tmp_path / "p")), Table.read_parquet(spark, str(tmp_path / "p"), "id")):
        keep = filter_rows(
            "keep",
            lambda r: fx.and_(fx.greater_than(r["id"], 5), fx.less_than(r["x"], 50), fx.starts_with(r["s"], "1"), fx.equals(r["s"], "17")),
        )
        df = keep(t).to_df().select("id")
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = [line for line in plan.splitlines() if "PushedFilters" in line][0]
        for expected in ("GreaterThan(id,5)", "StringStartsWith(s,1)", "EqualNullSafe(s,17)", "LessThan(x,50.0)"):
            assert expected in pushed, (expected, pushed)
        assert "struct<id:bigint,x:double,s:string" in plan and df.collect()[0][0] == 17


def test_generated_ids_keep_file_order(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "q"))
    t = Table.read_parquet(spark, str(tmp_path / "q"))
    assert cells(t, "id") == list(range(50))
    out = apply_steps(t, [filter_rows("drop", lambda r: fx.equals(fx.modulo(r["id"], 10), 0))])
    found = summary(t, out)
    assert (found["removed_row_count"], found["changed_row_count"], found["row_order_changed"]) == (5, 50, True)


def test_rename_drop_comment(load_csv):
    t = load_csv("a,b\r\n1,2\r\n").table
    out = apply_steps(t, [comment("note"), rename_column("col_a", "  New \t name "), drop_columns(["col_b"])])
    assert [(c.id, c.name) for c in out.columns] == [("col_a", "New name")]
    assert out.to_df().schema["col_a"].metadata["displayName"] == "New name"


@pytest.mark.parametrize(
    "step, code",
    [
        (drop_columns(["nope"]), "missingColumn"),
        (drop_columns([]), "emptyTarget"),
        (drop_columns(["col_a", "col_a"]), "duplicateColumnReference"),
        (drop_columns(["col_a", "col_b", "col_n"]), "emptySchema"),
        (rename_column("nope", "x"), "missingColumn"),
        (rename_column("col_a", "  "), "invalidDisplayName"),
        (rename_column("col_a", " B "), "nameConflict"),
        (derive_column("col_a", "x", "y"), "duplicateColumnId"),
        (derive_column("x", "A", "y"), "nameConflict"),
        (derive_column("__x", "x", "y"), "invalidColumnId"),
        (derive_column("a.b", "x", "y"), "invalidColumnId"),
        (derive_column("x", "x", lambda r: r["nope"]), "missingColumn"),
        (derive_column("x", "x", lambda r: fx.split(r["col_a"], ",")), "invalidExpression"),
        (filter_rows("keep", lambda r: r["col_a"]), "incompatibleType"),
        (filter_rows("keep", lambda r: fx.greater_than(r["col_a"], 100)), "incompatibleType"),
        (split_column("col_n", ",", [("x", "x"), ("y", "y")]), "incompatibleType"),
        (split_column("col_a", "", [("x", "x"), ("y", "y")]), "invalidDelimiter"),
        (split_column("col_a", ",", [("x", "x")]), "invalidExpression"),
        (split_column("col_a", ",", [("x", "x"), ("x", "y")]), "duplicateColumnId"),
        (split_column("col_a", ",", [("x", "x"), ("y", "X")]), "nameConflict"),
        (combine_columns(["col_a"], ",", "x", "x"), "emptyTarget"),
        (combine_columns(["col_a", "col_a"], ",", "x", "x"), "duplicateColumnReference"),
        (deduplicate_rows([]), "emptyTarget"),
        (sort_rows([]), "emptySort"),
        (sort_rows([("col_a", "asc"), ("col_a", "desc")]), "duplicateColumnReference"),
        (scoped_rule([], default=Patch("x")), "emptyTarget"),
        (scoped_rule(["col_a"], default=Patch(fill="red")), "invalidColor"),
        (scoped_rule(["col_a"], default=Patch()), "invalidExpression"),
        (scoped_rule(["col_a", "col_n"], default=Patch("x"), where=lambda r: fx.equals(r["col_a"], "x")), "incompatibleType"),
        (scoped_rule(["col_n"], default=Patch(lambda r, v: fx.lower(v))), "incompatibleType"),
        (scoped_rule(["col_a"], cases=[Case(lambda r, v: v, Patch("x"))]), "incompatibleType"),
        (derive_column("x", "x", lambda r: r.match(r["col_a"], [])), "invalidExpression"),
        (derive_column("x", "x", lambda r: r.match(r["col_a"], [("a", "b")])), "incompatibleType"),
        (derive_column("x", "x", lambda r: r.match(r["col_a"], [(True, 3)], "other")), "incompatibleType"),
    ],
)
def test_step_errors(load_csv, step, code):
    t = load_csv("a,b,n\r\nx,y,1\r\n").table
    with pytest.raises(StepError) as caught:
        step.named("s1")(t)
    assert (caught.value.code, caught.value.step_id) == (code, "s1")


def test_issues_are_collected_without_running(load_csv):
    t = load_csv("depot,note\r\nKiel,cold\r\n").table
    found = find_issues(
        t, [derive_column("full", "depot", "x").named("a"), rename_column("full", "y").named("b"), comment("c")]
    )
    assert [(e.code, e.step_id) for e in found] == [("nameConflict", "a"), ("missingColumn", "b")]


METERED = [
    scoped_rule(["depot"], cases=[Case(lambda r, v: fx.is_empty(v), Patch("Kiel", "#00ff00"))]).named("gaps"),
    filter_rows("drop", lambda r: r["paid"]).named("paid"),
    sort_rows([("kg", "asc")]).named("sort"),
    scoped_rule(["kg", "fee"], default=Patch(None), where=lambda r: fx.less_than(r["no"], 20)).named("clear"),
]


@pytest.mark.parametrize("sink", ["none", "noop", "csv", "parquet", "ordered"])
def test_metrics_do_not_depend_on_the_sink(table, rows, tmp_path, sink):
    run = count_steps(table, METERED)
    path = str(tmp_path / sink)
    if sink == "csv":
        write_csv(run.table, path)
    elif sink == "noop":
        run.table.sorted_df().write.format("noop").mode("overwrite").save()
    elif sink != "none":
        write_parquet(run.table, path, ordered=sink == "ordered")
    gaps = sum(model.is_empty(r["depot"]) for r in rows)
    left = [r for r in rows if r["paid"] is not True and r["no"] < 20]
    cleared = sum((r["kg"] is not None) + (r["fee"] is not None) for r in left)
    assert [tuple(s.values()) for s in run.summaries()] == [
        ("gaps", "scopedRule", gaps, gaps, gaps, gaps),
        ("paid", "filterRows", 0, 0, 0, 0),
        ("sort", "sortRows", 0, 0, 0, 0),
        ("clear", "scopedRule", 2 * len(left), cleared, 0, cleared),
    ]


def one_by_one(table, steps):
    """Metrics of each rule over the table that the steps before it give."""
    found = []
    for i, step in enumerate(steps):
        if step.kind == "scopedRule":
            found.append(tuple(step.metrics(apply_steps(table, steps[:i])).first()))
        else:
            found.append((0, 0, 0, 0))
    return found


def six_rules():
    def mark(name, column, test, **patch):
        return scoped_rule([column], cases=[Case(test, Patch(**patch))]).named(name)

    return [
        mark("a", "depot", lambda r, v: fx.is_empty(v), value="Kiel"),
        deduplicate_rows(["depot", "fee"]).named("d"),
        mark("b", "kg", lambda r, v: fx.greater_than(v, 1), value=lambda r, v: fx.subtract(v, 1), fill="#aaaaaa"),
        filter_rows("drop", lambda r: r["paid"]).named("f"),
        mark("c", "fee", lambda r, v: fx.is_empty(v), value="0", fill="#bbbbbb"),
        sort_rows([("kg", "desc")]).named("s"),
        deduplicate_rows(["depot"]).named("e"),
        mark("d2", "depot", lambda r, v: fx.contains(v, "i"), value=lambda r, v: fx.upper(v)),
        scoped_rule(["fee", "kg"], default=Patch(None), where=lambda r: fx.less_than(r["no"], 9)).named("g"),
        mark("h", "fee", lambda r, v: fx.is_empty(v), fill="#cccccc"),
    ]


def test_metrics_of_six_rules_are_one_pass(table, spark, tmp_path):
    steps = six_rules()
    run = count_steps(table, steps)
    assert [tuple(s.values())[2:] for s in run.summaries()] == one_by_one(table, steps)
    path = str(tmp_path / "t")
    table.df.write.parquet(path)
    read = Table.of(spark.read.parquet(path), table.row_id)
    plan = count_steps(read, six_rules()).counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_marked_duplicates_are_those_removed(spark):
    """Most rows share a key; whichever way rows are dealt out, the first in row order stays."""
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", (i * 7919) % 1000) for i in range(4000)]
    t = Table.of(spark.createDataFrame(rows, "no int, k string, n int").repartition(9), "no")
    for steps in ([deduplicate_rows(["k"])], [sort_rows([("n", "desc")]), filter_rows("drop", lambda r: fx.greater_than(r["n"], 990)), deduplicate_rows(["k"])]):
        want = {r.no for r in apply_steps(t, steps).df.collect()}
        assert {r.no for r in execute(t, steps).table.df.collect()} == want


def test_run_results_agree_with_separate_reports(spark, table):
    rows = [(i % 5, i, "x" if i % 3 else None, i / 2) for i in range(60)]
    t = Table.of(spark.createDataFrame(rows, "a int, b int, s string, n double").repartition(3), ["a", "b"])
    mark = scoped_rule(["s"], cases=[Case(lambda r, v: fx.is_empty(v), Patch("y", "#ffffff"))])
    keep = filter_rows("keep", lambda r: fx.less_than(r["n"], 25))
    by_n = sort_rows([("n", "desc")])
    sorted_before = by_n(t)
    for start, steps in [
        (t, []), (t, [mark, keep]), (t, [by_n]), (t, [by_n, deduplicate_rows(["s"]), mark]), (t, [deduplicate_rows(["a", "s"]), drop_columns(["b"])]),
        (mark(t), [keep, scoped_rule(["s"], default=Patch(fill="#000000")), derive_column("c", "c", 1)]),
        (sorted_before, [keep]), (sorted_before, [sort_rows([("b", "asc")]), mark]), (table, six_rules()),
    ]:
        result, want = execute(start, steps), apply_steps(start, steps)
        assert result.table.sorted_df().select(*want.ids).collect() == want.sorted_df().select(*want.ids).collect()
        assert result.table.fills == want.fills and result.table.columns == want.columns
        found = {
            "changed_row_count": result.changed_row_count, "changed_cell_count": result.changed_cell_count,
            "removed_row_count": result.removed_row_count, "row_order_changed": result.row_order_changed,
            "created_column_ids": list(result.created_column_ids),
        }
        assert found == summary(start, want), steps
        assert [tuple(s.values())[2:] for s in result.steps] == one_by_one(start, steps)
        assert result.sort_applied == any(s.kind == "sortRows" for s in steps)


def test_run_with_issues_changes_nothing(table):
    result = execute(table, [rename_column("nowhere", "x").named("r"), scoped_rule(["fee"], default=Patch(1))])
    assert result.table is None and [(e.code, e.step_id) for e in result.issues] == [("missingColumn", "r")]
    assert result.changed_row_count == result.changed_cell_count == 0 and not result.steps


def test_change_summary_of_a_sorted_run(table, rows):
    steps = [
        scoped_rule(["depot"], default=Patch(lambda r, v: fx.trim(v))),
        filter_rows("drop", lambda r: fx.is_empty(r["fee"])),
        sort_rows([("no", "desc")]),
        derive_column("extra", "Extra", lambda r: 1),
    ]
    found = summary(table, apply_steps(table, steps))
    left = [r for r in rows if not model.is_empty(r["fee"])]
    places = {r["no"]: k for k, r in enumerate(reversed(left))}
    trimmed = sum(model.trim(r["depot"]) != r["depot"] for r in left)
    moved = sum(r["no"] - 1 != places[r["no"]] for r in left)
    # Every surviving row has the new column's cell, so all rows have changed.
    assert found["removed_row_count"] == len(rows) - len(left) and found["changed_row_count"] == len(rows)
    assert found["changed_cell_count"] == trimmed + len(left)
    assert found["row_order_changed"] == (moved > 0 or len(left) < len(rows)) and found["created_column_ids"] == ["extra"]


def test_repeated_row_ids_are_refused(spark):
    t = Table.of(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "no int, x string"), "no")
    with pytest.raises(Exception, match="duplicateRowId"):
        change_summary(t, t).collect()


def test_run_summary_agrees_with_the_comparison(spark):
    rows = [(i % 5, i, "x" if i % 3 else None, i / 2) for i in range(40)]
    t = Table.of(spark.createDataFrame(rows, "a int, b int, s string, n double").repartition(3), ["a", "b"])
    mark = scoped_rule(["s"], cases=[Case(lambda r, v: fx.is_empty(v), Patch("y", "#ffffff"))])
    keep = filter_rows("keep", lambda r: fx.less_than(r["n"], 15))
    rewrite_key = scoped_rule(["a"], default=Patch(lambda r, v: fx.add(v, 1)))
    retype = scoped_rule(["n"], default=Patch(lambda r, v: fx.to_string(v)))
    new = derive_column("c", "c", lambda r: fx.concat(r["s"], r["n"]))
    for steps in (
        [], [mark], [keep], [mark, keep, new], [rewrite_key, keep, drop_columns(["b"])], [retype, new, rename_column("s", "S")],
        [keep, filter_rows("drop", lambda r: fx.equals(r["s"], "x"))], [sort_rows([("n", "desc")]), keep], [deduplicate_rows(["s"]), mark],
    ):
        expected = summary(t, apply_steps(t, steps))
        assert run_summary(t, steps).first().asDict() == expected, steps
    marked = mark(t)
    assert run_summary(marked, [keep, mark]).first().asDict() == summary(marked, apply_steps(marked, [keep, mark]))


def test_removal_moves_only_later_rows(spark):
    t = Table.of(spark.range(10).selectExpr("id", "id * 2 as x"), "id")
    out = filter_rows("drop", lambda r: fx.equals(r["id"], 6))(t)
    assert summary(t, out)["changed_row_count"] == 4
    resorted = apply_steps(t, [filter_rows("drop", lambda r: fx.equals(r["id"], 6)), sort_rows([("x", "asc")])])
    assert summary(t, resorted)["changed_row_count"] == 4
    assert summary(t, drop_columns(["x"])(t))["changed_cell_count"] == 10


def test_stateless_steps_run_on_a_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, " A "), (2, ""), (3, "b")], "id bigint, x string").write.parquet(source)
    stream = spark.readStream.schema("id bigint, x string").parquet(source)
    out = apply_steps(
        Table.of(stream, "id"),
        [
            scoped_rule(["x"], default=Patch(lambda r, v: fx.lower(fx.trim(v)))),
            filter_rows("drop", lambda r: fx.is_empty(r["x"])),
        ],
    )
    query = (
        out.to_df().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(target)
    )
    query.awaitTermination(60)
    assert sorted(r["x"] for r in spark.read.parquet(target).collect()) == ["a", "b"]
