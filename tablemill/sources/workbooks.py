"""Workbook (.xlsx) decoding with the standard library, one sheet at a time."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

# XML namespaces, and the built-in number formats that show dates or times.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMAT_IDS = frozenset([*range(14, 23), *range(45, 48)])


class Workbook:
    """Sheets of an opened workbook, streamed row by row."""

    def __init__(self, stream) -> None:
        self._zip = zipfile.ZipFile(stream)
        targets = {
            r.get("Id"): r.get("Target", "").lstrip("/") for r in self._tree("xl/_rels/workbook.xml.rels")
        }
        book = self._tree("xl/workbook.xml")
        properties = book.find(f"{MAIN}workbookPr")
        self._epoch = dt.datetime(1904, 1, 1) if _truthy(properties, "date1904") else dt.datetime(1899, 12, 30)
        self._parts = {}
        for sheet in book.iter(f"{MAIN}sheet"):
            target = targets[sheet.get(f"{RELATION}id")]
            self._parts[sheet.get("name")] = target if target.startswith("xl/") else f"xl/{target}"
        self._strings: list[str] | None = None
        self._dates = self._date_styles()

    @property
    def sheets(self) -> list[str]:
        return list(self._parts)

    def rows(self, sheet: str) -> Iterator[list[str | None]]:
        """Cells of a sheet as text; rows left out of the file come back empty."""
        if self._strings is None:
            self._strings = self._shared_strings()
        due = 1
        with self._zip.open(self._parts[sheet]) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r", due))
                yield from ([] for _ in range(due, number))
                cells: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(self._text(cell))
                yield cells
                due = number + 1
                row.clear()

    def _tree(self, name: str) -> ElementTree.Element:
        with self._zip.open(name) as part:
            return ElementTree.parse(part).getroot()

    def _shared_strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self._zip.namelist():
            return []
        items = self._tree("xl/sharedStrings.xml").iter(f"{MAIN}si")
        return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in items]

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self._zip.namelist():
            return set()
        root = self._tree("xl/styles.xml")
        custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
        formats = root.find(f"{MAIN}cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
        return {i for i, code in enumerate(ids) if code in DATE_FORMAT_IDS or _shows_date(custom.get(code, ""))}

    def _text(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
        raw = cell.findtext(f"{MAIN}v")
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self._strings[int(raw)]
        if kind == "b":
            return "True" if raw == "1" else "False"
        if kind != "n":
            return raw
        number = float(raw)
        if int(cell.get("s", 0)) in self._dates:
            return str(self._epoch + dt.timedelta(milliseconds=round(number * 86_400_000)))
        return str(int(number)) if number.is_integer() else repr(number)


def _truthy(element: ElementTree.Element | None, name: str) -> bool:
    return element is not None and element.get(name) in ("1", "true")


def _shows_date(code: str) -> bool:
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference.rstrip("0123456789"):
        index = index * 26 + ord(letter.upper()) - 64
    return index - 1
