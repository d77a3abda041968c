"""Workbooks for people: a few sheets of a bounded number of rows, and formulas over them, as an .xlsx file.

A workbook is read by one person in one program, so its rows are collected; `MOST` bounds them.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows of a sheet at most.
MOST = 50_000
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def _letters(i: int) -> str:
    out = ""
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(at: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, str) and value.startswith("="):
        return f'<c r="{at}"><f>{escape(value[1:])}</f></c>'
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value}</v></c>'
    text = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(rows: list) -> str:
    body = "".join(f'<row r="{i}">{"".join(_cell(f"{_letters(j)}{i}", v) for j, v in enumerate(r, 1))}</row>' for i, r in enumerate(rows, 1))
    return f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'


def workbook(sheets: dict[str, DataFrame | list]) -> bytes:
    """The bytes of a workbook. A sheet is a frame (its columns are the first row) or a list of rows; "=..." is a formula.

    Text that only looks like a formula would be run as one, so a frame's cells that begin with = get an apostrophe before.
    """
    held = {}
    for name, sheet in sheets.items():
        if isinstance(sheet, DataFrame):
            rows = sheet.limit(MOST + 1).collect()
            if len(rows) > MOST:
                raise ValueError(f"sheet {name} has more than {MOST} rows")
            safe = [[f"'{v}" if isinstance(v, str) and v.startswith("=") else v for v in r] for r in rows]
            sheet = [list(sheet.columns), *safe]
        held[name] = sheet
    numbers, out = range(1, len(held) + 1), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, held))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{links}</Relationships>')
        for i, rows in zip(numbers, held.values()):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(rows))
    return out.getvalue()


def share_formula(sheet: str, column: str, value: str) -> str:
    """A formula: the share of a column's filled cells that hold a value; empty where none is filled."""
    cells = f"'{sheet}'!{column}2:{column}{MOST + 1}"
    return f'=IF(COUNTA({cells})=0,"",COUNTIF({cells},"{value}")/COUNTA({cells}))'
