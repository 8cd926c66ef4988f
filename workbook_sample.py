"""A minimal .xlsx writer, for sample files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(ref: str, value, shared: list[str]) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if isinstance(value, tuple):  # (serial number, style)
        return f'<c r="{ref}" s="{value[1]}"><v>{value[0]}</v></c>'
    shared.append(str(value))
    return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'


def make_workbook(headers: list[str], rows: list[list]) -> bytes:
    """One sheet; text, number, boolean and (serial, style) date cells; style 1 is a date format."""
    shared: list[str] = []
    lines = []
    for r, row in enumerate([headers, *rows], start=1):
        cells = "".join(_cell(f"{_letters(c)}{r}", v, shared) for c, v in enumerate(row))
        if cells:
            lines.append(f'<row r="{r}">{cells}</row>')
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="a" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PKG}"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}">{"".join(f"<si><t>{escape(s)}</t></si>" for s in shared)}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()
