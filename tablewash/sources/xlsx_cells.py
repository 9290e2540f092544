"""Reading the cells of one workbook file: the helper that runs inside tasks."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from itertools import groupby
from typing import Iterator
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates or times, and error codes.
DATE_FORMATS = set(range(14, 23)) | set(range(27, 37)) | set(range(45, 48)) | set(range(50, 59))
ERROR_CODES = {
    "#NULL!": 0,
    "#DIV/0!": 7,
    "#VALUE!": 15,
    "#REF!": 23,
    "#NAME?": 29,
    "#NUM!": 36,
    "#N/A": 42,
    "#GETTING_DATA": 43,
}


def sheet_rows(content: bytes) -> Iterator[tuple]:
    """``(sheet_index, sheet, row, cells)`` for each row of a sheet's used range up to the last
    that holds a cell, rows counting from zero. ``cells`` go from the range's first
    column to the row's last cell; a blank one is None, any other ``(k, s, n, b,
    had_formula, missing_value)``."""
    for sheet, found in groupby(sheet_cells(content), key=lambda c: c[:2]):
        next_row = 0
        for row, cells in groupby(found, key=lambda c: c[2]):
            for blank in range(next_row, row):
                yield (*sheet, blank, [])
            line: list[tuple | None] = []
            for _, _, _, col, *value in cells:
                line += [None] * (col + 1 - len(line))
                line[col] = tuple(value)
            yield (*sheet, row, line)
            next_row = row + 1


def sheet_cells(content: bytes) -> Iterator[tuple]:
    """``(sheet_index, sheet, row, col, k, s, n, b, had_formula, missing_value)``
    for each cell that holds a value or a formula; rows and columns count from
    zero at the top left of the sheet's used range."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        strings = _shared_strings(book) if "xl/sharedStrings.xml" in names else []
        dated = _date_styles(book) if "xl/styles.xml" in names else []
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        settings = root.find(f"{MAIN}workbookPr")
        since_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        targets = _targets(book)
        for index, sheet in enumerate(root.iter(f"{MAIN}sheet")):
            part = targets[sheet.get(RELATION)]
            for cell in _cells(book, part, strings, dated, since_1904):
                yield (index, sheet.get("name"), *cell)


def _targets(book: zipfile.ZipFile) -> dict[str, str]:
    root = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    paths = {r.get("Id"): r.get("Target") for r in root}
    return {i: p.lstrip("/") if p.startswith("/") else f"xl/{p}" for i, p in paths.items()}


def _plain(element: ElementTree.Element) -> str:
    """The text of a string item: its own or its rich runs', not its reading aids."""
    runs = [element.find(f"{MAIN}t")] + [r.find(f"{MAIN}t") for r in element.findall(f"{MAIN}r")]
    text = "".join(t.text or "" for t in runs if t is not None)
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m.group(1), 16)), text)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    strings = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, element in ElementTree.iterparse(stream):
            if element.tag == f"{MAIN}si":
                strings.append(_plain(element))
                element.clear()
    return strings


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}

    def shows_date(number_format: int) -> bool:
        if number_format not in custom:
            return number_format in DATE_FORMATS
        code = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", custom[number_format].lower())
        return code != "general" and re.search(r"[ymdhs]", code) is not None

    formats = root.find(f"{MAIN}cellXfs")
    return [shows_date(int(x.get("numFmtId", "0"))) for x in formats] if formats is not None else []


def _position(reference: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", reference).groups()
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - 64
    return int(digits) - 1, column - 1


def _cells(book, part: str, strings: list[str], dated: list[bool], since_1904: bool) -> Iterator[tuple]:
    top = left = None
    row_number = -1
    with book.open(part) as stream:
        for event, element in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                if element.tag == f"{MAIN}row":
                    row_number = int(element.get("r")) - 1 if element.get("r") else row_number + 1
                    next_column = 0
                continue
            if element.tag == f"{MAIN}dimension" and element.get("ref"):
                top, left = _position(element.get("ref").split(":")[0])
            elif element.tag == f"{MAIN}c":
                at = _position(element.get("r")) if element.get("r") else (row_number, next_column)
                next_column = at[1] + 1
                if top is None:
                    top, left = at
                found = _value(element, strings, dated, since_1904)
                if found is not None:
                    yield (at[0] - top, at[1] - left, *found)
            elif element.tag == f"{MAIN}row":
                element.clear()


def _value(c: ElementTree.Element, strings, dated, since_1904):
    """``(k, s, n, b, had_formula, missing_value)``, or None for a blank cell."""
    formula = c.find(f"{MAIN}f") is not None
    v, kind = c.find(f"{MAIN}v"), c.get("t", "n")
    if kind == "inlineStr":
        return ("s", _plain(c.find(f"{MAIN}is")), None, None, formula, False)
    if v is None or (v.text is None and kind not in ("str", "s")):
        return (None, None, None, None, True, True) if formula else None
    raw = v.text or ""
    if kind == "s":
        return ("s", strings[int(raw)], None, None, formula, False)
    if kind == "str":
        return ("s", raw, None, None, formula, False)
    if kind == "b":
        return ("b", None, None, raw.strip() in ("1", "true"), formula, False)
    if kind == "e":
        return ("n", None, float(ERROR_CODES.get(raw, 42)), None, formula, False)
    if kind == "d":
        return ("s", _iso(datetime.fromisoformat(raw.rstrip("Z"))), None, None, formula, False)
    number = float(raw)
    style = int(c.get("s", "0"))
    if style < len(dated) and dated[style]:
        return ("s", _serial_date(number, since_1904), None, None, formula, False)
    return ("n", None, number, None, formula, False)


def _iso(moment: datetime) -> str:
    day_only = (moment.hour, moment.minute, moment.second) == (0, 0, 0)
    return moment.strftime("%Y-%m-%d") if day_only else moment.strftime("%Y-%m-%dT%H:%M:%S")


def _serial_date(serial: float, since_1904: bool) -> str:
    # Serial 60 is a day that never existed, so earlier serials are one day off.
    epoch = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30 if serial >= 60 else 31)
    return _iso(epoch + timedelta(milliseconds=round(serial * 86_400_000)))
