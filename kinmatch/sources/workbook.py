"""First sheet of an .xlsx file as text cells, from the open spreadsheet format (zip of XML parts)."""

from __future__ import annotations

import datetime as dt
import io
import math
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show a date or a time.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _first_sheet_path(book: zipfile.ZipFile) -> tuple[str, bool]:
    root = ET.fromstring(book.read("xl/workbook.xml"))
    sheet = root.find(f"{_NS}sheets/{_NS}sheet")
    if sheet is None:
        raise ValueError("workbook has no sheet")
    links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.get("Target") for e in links if e.get("Id") == sheet.get(_REL))
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    props = root.find(f"{_NS}workbookPr")
    return path, props is not None and props.get("date1904") in ("1", "true")


def _text(node: ET.Element) -> str:
    """Text of a string item: its own t and those of its runs, without phonetic notes."""
    own = [t.text or "" for t in node.findall(f"{_NS}t")]
    return "".join(own + [t.text or "" for t in node.findall(f"{_NS}r/{_NS}t")])


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_text(e) for e in ET.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_NS}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Style numbers whose number format is a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for fmt in root.iter(f"{_NS}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search("[dmyhs]", code, re.IGNORECASE):
            dates.add(int(fmt.get("numFmtId")))
    styles = root.find(f"{_NS}cellXfs")
    return {i for i, xf in enumerate(styles if styles is not None else []) if int(xf.get("numFmtId", 0)) in dates}


def _moment(serial: float, from_1904: bool) -> str:
    if not from_1904 and serial < 1:  # a time of day
        seconds = dt.datetime.min + dt.timedelta(seconds=round(serial * 86400, 3))
        return str(seconds.time())
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30) + dt.timedelta(days=serial < 60)
    return str(start + dt.timedelta(milliseconds=round(serial * 86400000)))


def _number(raw: str, numeric: str) -> str:
    value = float(raw)
    if math.isinf(value) or math.isnan(value):
        raise OverflowError(f"number {raw} has no integer form")
    if value.is_integer() or numeric == "truncate":
        return str(int(raw)) if re.fullmatch(r"[+-]?\d+", raw) else str(int(value))
    return repr(value)


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def read_first_sheet(content: bytes, numeric: str = "truncate") -> Iterator[tuple[dict[str, str] | None, str | None]]:
    """(cells keyed by the header row, error) per data row; a row with a cell that cannot be read has an
    error instead of cells. Blank cells are ''; booleans 1 or 0; dates their text; numbers lose their
    fraction unless `numeric="exact"`."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path, from_1904 = _first_sheet_path(book)
        strings, dates = _shared_strings(book), _date_styles(book)

        def value(cell: ET.Element) -> str:
            kind, raw = cell.get("t", "n"), cell.findtext(f"{_NS}v")
            if kind == "inlineStr":
                node = cell.find(f"{_NS}is")
                return _text(node) if node is not None else ""
            if raw is None or raw == "":
                return ""
            if kind == "s":
                return strings[int(raw)]
            if kind == "e":
                return "nan"
            if kind == "d":
                return str(dt.datetime.fromisoformat(raw.rstrip("Z")))
            if kind == "n":
                return _moment(float(raw), from_1904) if int(cell.get("s", 0)) in dates else _number(raw, numeric)
            return raw

        headers: list[str] | None = None
        gap, expected = 0, 1
        with book.open(path) as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != f"{_NS}row":
                    continue
                cells: dict[int, str] = {}
                error = None
                for position, cell in enumerate(row.findall(f"{_NS}c")):
                    at = _column(cell.get("r", ""))
                    try:
                        cells[at if at >= 0 else position] = value(cell)
                    except (ValueError, OverflowError, IndexError) as e:
                        error = f"{cell.get('r')}: {e}"
                number = int(row.get("r", expected))
                row.clear()
                if headers is None:
                    expected = number + 1
                    if cells:
                        headers = _headers(cells)
                    continue
                gap += max(number - expected, 0)
                expected = number + 1
                if not cells and not error:
                    gap += 1
                    continue
                for _ in range(gap):  # empty rows between data rows count as rows; trailing ones do not
                    yield dict.fromkeys(headers, ""), None
                gap = 0
                if error:
                    yield None, error
                else:
                    yield {h: cells.get(i, "") for i, h in enumerate(headers)}, None


def _headers(cells: dict[int, str]) -> list[str]:
    """Header texts; blank ones are numbered, repeated ones get a counter."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i in range(max(cells) + 1):
        name = cells.get(i, "") or f"Unnamed: {i}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(f"{name}.{count}" if count else name)
    return out
