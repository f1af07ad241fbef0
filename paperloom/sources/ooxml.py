"""Workbooks and slides from their OOXML archives, without office software.

Each file is read by one task from its own bytes; files are many, each is bounded by its format.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"

CELL_SCHEMA = "path string, sheet string, tab_no int, visible boolean, row int, col int, coordinate string, kind string, text string, formula string, number_format string, merged_range string"
SLIDE_SCHEMA = "path string, slide_no int, title string, markdown string, notes string"
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _read(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    rels = _read(z, f"{folder}/_rels/{name}.rels")
    out = {}
    for r in rels if rels is not None else ():
        target = r.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
        while "/../" in path:
            path = re.sub(r"[^/]+/\.\./", "", path, count=1)
        out[r.get("Id", "")] = path
    return out


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t"))


def workbook_cells(data: bytes) -> Iterator[dict]:
    """Every cell of an .xlsx file that has a value or a formula."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = _read(z, "xl/workbook.xml")
        if book is None:
            return
        shared_part, styles = _read(z, "xl/sharedStrings.xml"), _read(z, "xl/styles.xml")
        shared = [_text(si) for si in shared_part.findall(f"{_M}si")] if shared_part is not None else []
        codes, formats = {}, []
        if styles is not None:
            codes = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in styles.iter(f"{_M}numFmt")}
            xfs = styles.find(f"{_M}cellXfs")
            formats = [int(x.get("numFmtId", 0)) for x in xfs] if xfs is not None else []
        epoch = datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_M}workbookPr")) else datetime(1899, 12, 30)
        targets = _targets(z, "xl/workbook.xml")
        for tab, s in enumerate(book.iter(f"{_M}sheet"), 1):
            sheet = _read(z, targets.get(s.get(f"{_R}id", ""), ""))
            if sheet is None:
                continue
            merged = [m.get("ref", "") for m in sheet.iter(f"{_M}mergeCell")]
            anchors = {m.split(":")[0]: m for m in merged}
            for c in sheet.iter(f"{_M}c"):
                ref, t = c.get("r", ""), c.get("t", "n")
                m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
                if not m:
                    continue
                v, f, inline = c.find(f"{_M}v"), c.find(f"{_M}f"), c.find(f"{_M}is")
                raw = v.text if v is not None else None
                style = int(c.get("s", 0))
                fmt = formats[style] if style < len(formats) else 0
                code = codes.get(fmt, "")
                dated = fmt in _DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))
                kind, text = "n", raw
                if t == "s":
                    kind, text = "s", shared[int(raw)] if raw and int(raw) < len(shared) else None
                elif t in ("str", "e"):
                    kind = "s"
                elif t == "inlineStr":
                    kind, text = "s", _text(inline) if inline is not None else None
                elif t == "b":
                    kind, text = "b", {"1": "true", "0": "false"}.get(raw or "")
                elif raw is not None and dated:
                    kind, text = "d", (epoch + timedelta(days=float(raw))).isoformat(timespec="seconds")
                formula = f"={f.text}" if f is not None and f.text else None
                if text is None and formula is None:
                    continue
                yield {
                    "sheet": s.get("name", ""), "tab_no": tab, "visible": s.get("state", "visible") == "visible", "row": int(m[2]), "col": _column(m[1]), "coordinate": ref,
                    "kind": kind, "text": text, "formula": formula, "number_format": code or (str(fmt) if fmt else None), "merged_range": anchors.get(ref),
                }


def _paragraphs(node) -> list[str]:
    return ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in node.iter(f"{_A}p")]


def slides(data: bytes) -> Iterator[dict]:
    """Title, paragraphs, tables and notes of every slide of a .pptx file as Markdown."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        deck = _read(z, "ppt/presentation.xml")
        if deck is None:
            return
        targets = _targets(z, "ppt/presentation.xml")
        for n, s in enumerate(deck.iter(f"{_P}sldId"), 1):
            part = targets.get(s.get(f"{_R}id", ""), "")
            slide = _read(z, part)
            if slide is None:
                continue
            title, blocks = "", []
            for shape in slide.iter():
                if shape.tag == f"{_P}sp":
                    place = shape.find(f".//{_P}ph")
                    texts = [t.strip() for t in _paragraphs(shape) if t.strip()]
                    if place is not None and place.get("type") in ("title", "ctrTitle") and texts and not title:
                        title = " ".join(texts)
                    elif texts:
                        blocks.append("\n".join(f"- {t}" for t in texts))
                elif shape.tag == f"{_A}tbl":
                    rows = [[" ".join(_paragraphs(c)).strip().replace("|", "&#124;") for c in r.findall(f"{_A}tc")] for r in shape.findall(f"{_A}tr")]
                    if rows:
                        width = max(map(len, rows))
                        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                        blocks.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
            notes = next((_read(z, t) for t in _targets(z, part).values() if "notesSlide" in t), None)
            note = "\n".join(t for t in _paragraphs(notes) if t.strip()) if notes is not None else ""
            head = [f"## {title}"] if title else []
            yield {"slide_no": n, "title": title or None, "markdown": "\n\n".join([*head, *blocks]), "notes": note or None}


def _read_all(spark: SparkSession, folder: str, pattern: str, reader, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [{"path": path, **r} for r in reader(bytes(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    rows = []
                yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(run, schema)


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of all .xlsx files under a folder. A file that is no workbook gives none."""
    return _read_all(spark, folder, "*.xls[xm]", workbook_cells, CELL_SCHEMA)


def read_presentations(spark: SparkSession, folder: str) -> DataFrame:
    """The slides of all .pptx files under a folder."""
    return _read_all(spark, folder, "*.pptx", slides, SLIDE_SCHEMA)
