"""Workbooks as files: a small writer of the open spreadsheet format, and exporting only what changed.

A sheet is a list of rows, a cell None, a number or text. Workbooks hold a day or a month, so they are made one by one
where their rows have been gathered.
"""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import escape

from ..operators.export import sheet_names

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def column_name(n: int) -> str:
    """A, B, ... Z, AA for 0, 1, ..."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(value, at: str) -> str:
    if value is None:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = escape("".join(c for c in str(value) if c >= " " or c in "\t\n"))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _sheet(rows: list[list]) -> str:
    body = "".join(f'<row r="{r}">' + "".join(_cell(v, f"{column_name(c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    return f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'


def write_workbook(path: str, sheets: dict[str, list[list]]) -> None:
    """Write a workbook beside the path and put it there in one step, so a reader sees the old or the new one."""
    names = sheet_names(list(sheets))
    n = range(1, len(names) + 1)
    files = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        + "</Types>",
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, x in zip(n, names, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>",
    } | {f"xl/worksheets/sheet{i}.xml": _sheet(rows) for i, rows in zip(n, sheets.values(), strict=True)}
    part = f"{path}.part"
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)  # the same rows give the same bytes
    os.replace(part, path)


def model_hash(sheets: dict[str, list[list]]) -> str:
    return hashlib.sha256(json.dumps(sheets, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def export_workbooks(folder: str, site: str, books: dict[str, Callable[[], dict[str, list[list]]]], store_is_empty: bool = False) -> dict[str, list[str]]:
    """Write the books (name: function that makes its sheets) whose content changed since the record in the folder says,
    and delete recorded ones that are gone. Files that the record doesn't know are never deleted, an empty store deletes
    nothing, and another site's folder is refused."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    at = root / "record.json"
    record = json.loads(at.read_text()) if at.exists() else {"site": site, "files": {}}
    if record["site"] != site:
        raise ValueError("the folder is another site's")
    done: dict[str, list[str]] = {"written": [], "kept": [], "deleted": []}
    for name, make in sorted(books.items()):
        if Path(name).name != name:
            raise ValueError(f"not a file's name: {name!r}")
        sheets = make()
        h = model_hash(sheets)
        if record["files"].get(name) == h and (root / name).exists():
            done["kept"].append(name)
            continue
        write_workbook(str(root / name), sheets)
        record["files"][name] = h
        done["written"].append(name)
    for name in [] if store_is_empty else sorted(set(record["files"]) - set(books)):
        (root / name).unlink(missing_ok=True)
        del record["files"][name]
        done["deleted"].append(name)
    part = root / "record.json.part"
    part.write_text(json.dumps(record, ensure_ascii=False, sort_keys=True, indent=1))
    os.replace(part, at)
    return done
