"""CSV and workbook import, and what the sinks write."""

import random
import re

import pytest

from support import cells
from registry.xlsx_bytes import DATETIME_STYLE, Formula, Serial, workbook_bytes
from samples import LOANS
from tablewash import StepError, Table
from tablewash import functions as fx
from tablewash.operators import Case, Patch, filter_rows, scoped_rule, sort_rows
from tablewash.plans import apply_steps
from tablewash.reports import dense_positions, infer_types, profile
from tablewash.sinks import cell_formats, write_csv, write_formats, write_parquet
from tablewash.sources import (
    choose_header_rows,
    csv_warnings,
    normalize_headers,
    read_csv,
    read_file,
    read_workbook,
    body_rows,
    sheet_columns,
    sheet_table,
    sheet_types,
    workbook_rows,
    workbook_warnings,
)


@pytest.fixture
def loans_file(tmp_path):
    (tmp_path / "loans.csv").write_text(LOANS)
    return str(tmp_path / "loans.csv")


def ids(table):
    return [c.id for c in table.columns]


def names(table):
    return [c.name for c in table.columns]


def kinds(table):
    return [c.type for c in table.columns]


def test_missing_values(spark, loans_file):
    missing = {r["column_id"]: (r["nullable"], r["missing_count"]) for r in profile(read_csv(spark, loans_file)).collect()}
    assert missing["col_loan"] == (True, 1) and missing["col_borrower"] == (True, 2) and missing["col_column_2"] == (True, 5)


def test_headers(load_csv):
    assert names(load_csv('"Wind\n(max)",x\r\n3,1\r\n').table) == ["Wind (max)", "x"]
    many = load_csv("Buoy, buoy ,,BUOY,bu-oy,Bu/oy,\r\n1,2,3,4,5,6,7\r\n")
    assert names(many.table) == ["Buoy", "Buoy (2)", "Column", "Buoy (3)", "bu-oy", "Bu/oy", "Column (2)"]
    assert ids(many.table) == ["col_buoy", "col_buoy_2", "col_column", "col_buoy_3", "col_bu_oy", "col_bu_oy_2", "col_column_2"]
    codes = [r["code"] for r in csv_warnings(many.table.df.sparkSession, many).collect()]
    assert sorted(codes) == ["blankHeaderGenerated"] * 2 + ["duplicateHeaderNormalized"] * 3
    assert [h.id for h in normalize_headers(["\u00c4", "--", None])] == ["col_column", "col_column_2", "col_column_3"]


def test_cell_typing(load_csv):
    got = load_csv('a,b,c,d,e\r\nTRUE,007,"5",,""\r\nfalse,1e5,-0.5,,x\r\n,+1,10,,\r\n').table
    assert kinds(got) == ["boolean", "string", "number", "unknown", "string"]
    assert cells(got, "col_a") == [True, False, None]
    assert cells(got, "col_c") == [5.0, -0.5, 10.0]
    assert cells(got, "col_e") == ["", "x", None]
    mixed = load_csv("v\r\n1\r\nhello\r\nTrue\r\n").table
    assert kinds(mixed) == ["mixed"]
    assert [tuple(v) for v in cells(mixed, "col_v")] == [("n", None, 1.0, None), ("s", "hello", None, None), ("b", None, None, True)]
    assert {r[1] for r in infer_types(mixed).collect()} == {"mixed"}
    assert [w["code"] for w in csv_warnings(mixed.df.sparkSession, load_csv("v\r\n1\r\nx\r\n")).collect()] == ["mixedTypeColumn"]


def parsed(text):
    """Records of CSV text, read one character at a time."""
    records, record, value, inside, quoted, k = [], [], "", False, False, 0
    while k <= len(text):
        c = text[k] if k < len(text) else None
        if inside and c is not None:
            if c == '"' and text[k + 1 : k + 2] == '"':
                value, k = value + '"', k + 1
            elif c == '"':
                inside = False
            else:
                value += c
        elif c is None or c in ",\r\n":
            record.append(value if value or quoted else None)
            value, quoted = "", False
            if c is None or c != ",":
                if c is not None or record != [None]:
                    records.append(record)
                record = []
                k += c == "\r" and text[k + 1 : k + 2] == "\n"
        elif c == '"' and not value:
            inside = quoted = True
        else:
            value += c
        k += 1
    return records


@pytest.mark.parametrize("seed", range(6))
def test_any_csv_text_in_small_splits(spark, tmp_path, seed):
    """Line breaks in quotes, stray quotes, text after quotes, blank lines, any line end."""
    rng = random.Random(seed)

    def field():
        inner = "".join(rng.choice(["a", ",", "\n", "\r\n", '""', " ", "\ue000"]) for _ in range(rng.randrange(7)))
        return rng.choice(["", "a b", '""', '5" x', 'a"b"', f'"{inner}"', f'"{inner}"z'])

    end = rng.choice(["\n", "\r\n", "\r"])
    lines = ["" if rng.random() < 0.1 else ",".join(field() for _ in range(rng.choice([1, 3, 4]))) for _ in range(300)]
    text = "a,b,c,d" + end + end.join(lines) + rng.choice([end, ""])
    (tmp_path / "any.csv").write_text(text, newline="")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        t = read_csv(spark, str(tmp_path / "any.csv"), types={f"col_{c}": "string" for c in "abcd"})
        assert spark.read.text(str(tmp_path / "any.csv")).rdd.getNumPartitions() > 1
        got = [list(r) for r in t.sorted_df().select(*t.ids).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == [r + [None] * (4 - len(r)) for r in parsed(text)[1:]]


def test_wide_rows_make_columns(load_csv):
    t = load_csv('a\r\n"x,1",,"q""q"\r\ny\r\n,,,last\r\n').table
    assert names(t) == ["a", "Column", "Column (2)", "Column (3)"]
    assert cells(t, "col_column_2") == ['q"q', None, None] and cells(t, "col_column_3") == [None, None, "last"]


def test_nothing_is_lost_silently(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,2\n3,4,5\n")
    path = str(tmp_path / "f.csv")
    with pytest.raises(Exception, match="given width is 2"):
        read_csv(spark, path, width=2, types={"col_a": "string", "col_b": "string"}).df.collect()
    with pytest.raises(Exception, match="x is no number"):
        (tmp_path / "g.csv").write_text("a\nx\n")
        read_csv(spark, str(tmp_path / "g.csv"), types={"col_a": "number"}).df.collect()
    (tmp_path / "e.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "e.csv")).columns == ()
    with pytest.raises(StepError, match="invalidColumnId"):
        Table.of(spark.range(2).selectExpr("id", "id as __mine"), "id")


def test_files_with_other_columns_are_refused(spark, tmp_path):
    for name, text in {"a": "k,v\n1,2\n", "b": "k, V \n3,4\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    assert sorted(cells(read_csv(spark, str(tmp_path)), "col_k")) == [1, 3]
    (tmp_path / "c.csv").write_text("k,w\n5,6\n")
    with pytest.raises(StepError, match="headerMismatch"):
        read_csv(spark, str(tmp_path))


def test_files_with_columns_in_other_orders(spark, tmp_path):
    for name, text in {"a": "k,v,w\n1,x,true\n2\n", "b": "w,k,v\nfalse,3,y,extra\n\ntrue,4\n", "c": 'v,w,"k"\n"z, z",,5\n', "d": "k,v,w\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    t = read_csv(spark, str(tmp_path))
    assert ids(t) == ["col_k", "col_v", "col_w", "col_column"] and kinds(t) == ["number", "string", "boolean", "string"]
    rows = [tuple(r) for r in t.sorted_df().select(*t.ids).collect()]
    assert rows == [
        (1.0, "x", True, None), (2.0, None, None, None), (3.0, "y", False, "extra"), (None, None, None, None), (4.0, None, True, None),
        (5.0, "z, z", None, None),
    ]


def test_a_stray_quote_fails_past_the_limit(spark, tmp_path):
    path = tmp_path / "stray.csv"
    path.write_text('a,b\n1,"open\n' + "2,x\n" * 500)
    assert cells(read_csv(spark, str(path)), "col_a") == [1.0]
    with pytest.raises(Exception, match="recordTooLong"):
        read_csv(spark, str(path), max_record_lines=100)


def test_data_of_a_plain_file_are_one_scan(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("a,b\n" + 'x,"y, z"\n' * 1000)
    t = read_csv(spark, str(path))
    plan = t.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan
    assert t.in_order and t.df.count() == 1000


def test_several_files_share_a_header_and_keep_file_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(4):
        lines = ["k,v"] + [f"r{n}{i},x" for i in range(3 + n * 40)] + (["k,v"] if n == 2 else [])
        (folder / f"f{n}.csv").write_text("\n".join(lines) + "\n")
    expected = [f"r{n}{i}" for n in range(4) for i in range(3 + n * 40)]
    t = read_csv(spark, str(folder))
    assert t.df.count() == len(expected) + 1  # a later line equal to the header is data
    assert [r for r in cells(t, "col_k") if r != "k"] == expected


def test_csv_roundtrip(spark, tmp_path, loans_file):
    t = read_csv(spark, loans_file)
    write_csv(t, str(tmp_path / "out"), keep_nulls=True)
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("Loan,Instrument [kind],Borrower") and '"  Bo "' in text and '"cello\n3/4"' in text
    back = read_csv(spark, str(tmp_path / "out"))
    assert names(back) == names(t)
    assert [list(r) for r in back.sorted_df().select(*back.ids).collect()] == [list(r) for r in t.sorted_df().select(*t.ids).collect()]
    write_csv(t, str(tmp_path / "filled"))
    filled = read_csv(spark, str(tmp_path / "filled"))
    assert "" in cells(filled, "col_borrower_2") and None not in cells(filled, "col_borrower_2")
    none = apply_steps(t, [filter_rows("keep", lambda r: False)])
    write_csv(none, str(tmp_path / "none"))
    assert names(read_csv(spark, str(tmp_path / "none"))) == names(t)


def test_csv_number_and_boolean_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 120.5, True, 'a "b", c'), (2, 1e21, None, "")], "id bigint, n double, b boolean, s string")
    write_csv(sort_rows([("id", "desc")])(Table.of(df, "id")), str(tmp_path / "out"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    lines = [line for line in text.split("\r\n") if line and line != "id,n,b,s"]
    assert lines == ['2,1e+21,"",""', '1,120.5,true,"a ""b"", c"']


def test_parquet_sink_keeps_names_types_and_order(spark, tmp_path, loans_file):
    t = sort_rows([("col_loan", "desc")])(read_csv(spark, loans_file))
    write_parquet(t, str(tmp_path / "p"), ordered=True)
    back = Table.read_parquet(spark, str(tmp_path / "p"))
    assert names(back) == names(t) and kinds(back) == kinds(t)
    assert cells(back, "col_loan") == [11, 10, 9, 8, 7, None]


def test_cell_formats(spark, tmp_path):
    t = Table.of(spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string"), "id")
    out = apply_steps(
        t,
        [
            scoped_rule(["x", "y"], default=Patch(fill="#FFEB9C"), where=lambda r: fx.equals(r["id"], 1)),
            scoped_rule(["y"], cases=[Case(lambda r, v: fx.equals(v, "d"), Patch(fill="#000080"))]),
        ],
    )
    write_formats(out, str(tmp_path / "f"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "f")).collect()))
    assert got == [(1, "x", "#ffeb9c", "#1c1a17"), (1, "y", "#ffeb9c", "#1c1a17"), (2, "y", "#000080", "#fffdf9")]
    assert cell_formats(t).count() == 0


def test_dense_positions_match_a_global_order(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as k").repartition(5)
    out = sort_rows([("k", "desc")])(Table.of(df, "id"))
    got = [r[0] for r in dense_positions(out).orderBy("position").collect()]
    assert got == sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [r[1] for r in dense_positions(out).orderBy("position").collect()] == list(range(1000))


# --- workbooks ------------------------------------------------------------------


def files(spark, **books):
    return spark.createDataFrame([(f"/in/{n}.xlsx", bytearray(workbook_bytes(s))) for n, s in books.items()], "path string, content binary")


HEADER_BOOK = {
    "Probes": [
        ['{"UniqueId":"probe"}', '{"DisplayName":"Depth"}', '{"Name":"Lost"}'],
        ["Probe\nid", "Depth\nmetres", "Lost"],
        ["p-4", 12.5, True],
        ["p-5", 3, False],
    ]
}


def test_sheets_become_tables(spark):
    found = workbook_rows(files(spark, multi={"Masts": [["mast", "height"], ["m1", 9]], "Sails": [["sail", "area"], ["jib", 14.25], ["main", 30]]}))
    t = sheet_table(found, "Sails")
    assert ids(t) == ["col_sail", "col_area"] and kinds(t) == ["string", "number"]
    assert cells(t, "col_area") == [14.25, 30.0]


def test_header_row_is_detected_or_chosen(spark):
    found = workbook_rows(files(spark, a=HEADER_BOOK)).persist()
    t = sheet_table(found, "Probes")
    assert names(t) == ["Probe", "Depth", "Lost"] and cells(t, "col_depth") == [12.5, 3.0]
    chosen = sheet_table(found, "Probes", {"Probes": 0})
    assert "UniqueId" in chosen.columns[0].name and cells(chosen, ids(chosen)[0])[0] == "Probe\nid"
    with pytest.raises(Exception, match="out of range"):
        choose_header_rows(found, {"Probes": 9}).collect()
    found.unpersist()


def test_workbook_values_and_warnings(spark):
    book = {
        "Formulas": [
            ["left", "right", "total", "missing_total", "when", "at", "ok"],
            [1, 2, Formula("A2+B2", 3), Formula("A2+B2"), Serial(46023), Serial(46023.5, DATETIME_STYLE), True],
            [],
            ["x", None, None, None, None, None, False],
        ]
    }
    found = workbook_rows(files(spark, f=book, g=HEADER_BOOK)).persist()
    t = sheet_table(found, "Formulas")
    first = t.sorted_df().first()
    assert (first["col_total"], first["col_missing_total"]) == (3.0, None)
    assert (first["col_when"], first["col_at"], first["col_ok"]) == ("2026-01-01", "2026-01-01T12:00:00", True)
    assert kinds(t) == ["mixed", "number", "number", "unknown", "date", "datetime", "boolean"]
    assert [tuple(v)[0] if v else None for v in cells(t, "col_left")] == ["n", None, "s"]
    sheets = choose_header_rows(found)
    columns = sheet_columns(sheets)
    body = body_rows(found, sheets)
    warned = {(w["code"], w["sheet"], w["cell_count"]) for w in workbook_warnings(sheets, columns, body, sheet_types(body, columns)).collect()}
    assert warned == {
        ("xlsxValueOnlyImport", None, None),
        ("mixedTypeColumn", "Formulas", None),
        ("formulaImportedAsValue", "Formulas", 2),
        ("formulaValueUnavailable", "Formulas", 1),
        ("xlsxHeaderRowAutoDetected", "Probes", None),
    }
    found.unpersist()


def test_multiline_blank_and_repeated_sheet_headers(spark):
    rows = [["Status\nstring", "\nStatus\nnumber", "\n  \r\n", "\r\n"], ["Open", "Closed", "A", "B"]]
    found = workbook_rows(files(spark, h={"Headers": rows}))
    t = sheet_table(found, "Headers", {"Headers": 0})
    assert names(t) == ["Status", "Status (2)", "Column", "Column (2)"]
    assert ids(t) == ["col_status", "col_status_2", "col_column", "col_column_2"]


def test_fleet_of_workbooks_is_one_table(spark):
    books = {f"b{n}": {"Data": [["id", "v"], *[[n * 10 + i, f"v{i}"] for i in range(n + 1)]]} for n in range(5)}
    t = sheet_table(workbook_rows(files(spark, **books)), "Data")
    assert t.df.count() == 15 and kinds(t) == ["number", "string"]
    assert cells(t, "col_id")[:3] == [0.0, 10.0, 11.0]


def test_read_file_chooses_by_suffix(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes({"One": [["h"], ["x"]], "Two": [["g"], ["y"]]}))
    (tmp_path / "B.XLSX").write_bytes(workbook_bytes({"One": [["k"], ["z"]]}))
    (tmp_path / "a.CSV").write_text("h\nx\n")
    assert cells(read_file(spark, str(tmp_path / "B.XLSX")), "col_k") == ["z"]
    assert ids(read_file(spark, str(tmp_path / "a.xlsx"))) == ["col_h"]
    assert ids(read_file(spark, str(tmp_path / "a.xlsx"), "Two")) == ["col_g"]
    assert cells(read_file(spark, str(tmp_path / "a.CSV")), "col_h") == ["x"]
    assert cells(read_file(spark, str(tmp_path / "a.xlsx"), "Two", {"Two": 1}), "col_y") == []
    with pytest.raises(StepError, match="unsupportedFormat"):
        read_file(spark, "a.txt")


def test_all_sheets_from_one_parse(spark, tmp_path):
    for name, day in (("a", 1), ("b", 2)):
        one = [["meta", None], ["id", "v"], [day, "x"], [], [day + 10, None]]
        (tmp_path / f"{name}.xlsx").write_bytes(workbook_bytes({"2024": one, "Two words/x": [["g"], [True]]}))
    path = str(tmp_path / "*.xlsx")
    found = read_workbook(spark, path, {"2024": 1})
    assert list(found) == ["2024", "Two words/x"]
    assert cells(found["2024"], "col_id") == [1.0, None, 11.0, 2.0, None, 12.0] and kinds(found["Two words/x"]) == ["boolean"]
    plan = found["2024"].df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "row" not in "".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan))
    (tmp_path / "c.xlsx").write_bytes(workbook_bytes({"Other": [["g"], ["y"]]}))
    for read in (read_file, read_workbook):
        with pytest.raises(StepError, match="sheetMismatch"):
            read(spark, path)
    assert cells(read_file(spark, path, "Other"), "col_g") == ["y"]
    assert list(read_workbook(spark, str(tmp_path / "c.xlsx"))) == ["Other"]


@pytest.mark.parametrize("probe, readings", [(2_000, 1), (1, 2)])
def test_open_quotes_among_first_lines_save_a_survey(load_csv, monkeypatch, probe, readings):
    """Lines known not to be records are not surveyed as such, and a quote beyond the probe is still found."""
    from tablewash.sources import csv

    surveys, survey = [], csv._survey
    monkeypatch.setattr(csv, "_survey", lambda *args: surveys.append(args) or survey(*args))
    monkeypatch.setattr(csv, "PROBE_LINES", probe, raising=False)
    table = load_csv('id,text\n1,"a\nb ""c"""\n2,plain\n3,"x,\r\ny"\n').table
    assert [tuple(r) for r in table.sorted_df().select("col_id", "col_text").collect()] == [(1.0, 'a\nb "c"'), (2.0, "plain"), (3.0, "x,\r\ny")]
    assert len(surveys) == readings
