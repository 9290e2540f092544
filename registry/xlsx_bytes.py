"""Minimal workbook files from rows of plain values, to feed the workbook source."""

from __future__ import annotations

import io
import zipfile
from typing import Any
from xml.sax.saxutils import escape

TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
DATE_STYLE, DATETIME_STYLE = 1, 2


class Formula:
    """A formula cell, with or without a cached value."""

    def __init__(self, text: str, cached: Any = None):
        self.text, self.cached = text, cached


class Serial:
    """A number shown as a date (style 1) or a date and time (style 2)."""

    def __init__(self, serial: float, style: int = DATE_STYLE):
        self.serial, self.style = serial, style


def _name(row: int, col: int) -> str:
    letters, col = "", col + 1
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


def _cell(row: int, col: int, value: Any) -> str:
    at = f'<c r="{_name(row, col)}"'
    if value is None:
        return ""
    if isinstance(value, Formula):
        cached = "" if value.cached is None else f"<v>{value.cached!r}</v>"
        return f"{at}><f>{escape(value.text)}</f>{cached}</c>"
    if isinstance(value, Serial):
        return f'{at} s="{value.style}"><v>{value.serial!r}</v></c>'
    if isinstance(value, bool):
        return f'{at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"{at}><v>{value!r}</v></c>"
    return f'{at} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def _sheet(rows: list[list[Any]]) -> str:
    width = max((len(r) for r in rows), default=1) or 1
    body = "".join(
        f'<row r="{i + 1}">' + "".join(_cell(i, j, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows)
    )
    extent = f"A1:{_name(max(len(rows), 1) - 1, width - 1)}"
    return f'<worksheet xmlns="{MAIN}"><dimension ref="{extent}"/><sheetData>{body}</sheetData></worksheet>'


def workbook_bytes(sheets: dict[str, list[list[Any]]]) -> bytes:
    """An XLSX file with one sheet per entry."""
    numbers = range(1, len(sheets) + 1)
    listed = "".join(
        f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, sheets)
    )
    links = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
    styles = '<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{TYPES}"><Default Extension="xml" ContentType="application/xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><cellXfs count="3">{styles}</cellXfs></styleSheet>',
    }
    parts |= {f"xl/worksheets/sheet{i}.xml": _sheet(rows) for i, rows in zip(numbers, sheets.values())}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for path, text in parts.items():
            book.writestr(path, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return buffer.getvalue()
