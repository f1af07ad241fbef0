"""The text layer of PDF files, without a PDF library.

What the format's public specification says of objects, streams, page trees and text operators is
read as far as text needs it: plain and compressed objects, Flate streams, fonts with a ToUnicode
map or a Latin encoding. Encrypted files and other filters give no text. A file is one unit, its
pages become rows; rendering is no part of this.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Name(str):
    """A PDF name, such as a key of a dictionary."""


class Ref(int):
    """The number of an object that stands elsewhere in the file."""


class Word(str):
    """A keyword or an operator."""


_SPACE, _DELIMITERS = b" \t\r\n\f\0", b"()<>[]{}/% \t\r\n\f\0"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Strings further apart than this part of their size are parted by a blank.
GAP = 0.2


class Reader:
    """Reads values one after the other from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        d, n = self.data, len(self.data)
        while self.at < n:
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at] == 37:  # a comment runs to the end of its line
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self):
        """The next value; None at the end, a Word for what is no value."""
        self._skip()
        d = self.data
        if self.at >= len(d):
            return None
        c = d[self.at : self.at + 1]
        if c == b"/":
            start = self.at = self.at + 1
            while self.at < len(d) and d[self.at] not in _DELIMITERS:
                self.at += 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), d[start : self.at]).decode("latin-1"))
        if c == b"(":
            return self._string()
        if d.startswith(b"<<", self.at):
            self.at += 2
            items = self._until(">>")
            return {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}
        if c == b"<":
            end = d.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at : end])
            self.at = end + 1 if end >= 0 else len(d)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until("]")
        if c in b"]>{})":
            self.at += 2 if d.startswith(b">>", self.at) else 1
            return Word(">>" if d.startswith(b">>", self.at - 2) and c == b">" else c.decode())
        start = self.at
        while self.at < len(d) and d[self.at] not in _DELIMITERS:
            self.at += 1
        text = d[start : self.at].decode("latin-1")
        if re.fullmatch(r"[+-]?\d+", text):
            m = re.compile(rb"[ \t\r\n]+\d+[ \t\r\n]+R(?![A-Za-z])").match(d, self.at)
            if m and text.isdigit():
                self.at = m.end()
                return Ref(text)
            return int(text)
        if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+)", text):
            return float(text)
        return {"true": True, "false": False}.get(text, Word(text))

    def _until(self, close: str) -> list:
        out = []
        while (v := self.value()) is not None and not (isinstance(v, Word) and v == close):
            out.append(v)
        return out

    def _string(self) -> bytes:
        d, out, depth = self.data, bytearray(), 1
        self.at += 1
        while self.at < len(d):
            c = d[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                m = re.compile(rb"[0-7]{1,3}|\r\n|[\s\S]").match(d, self.at)
                if not m:
                    break
                self.at, e = m.end(), m[0]
                out += bytes([int(e, 8) & 255]) if e.isdigit() else b"" if e in (b"\r\n", b"\n", b"\r") else _ESCAPES.get(e, e)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)


class Document:
    """The objects of a file, found by looking for them, so that a broken table of contents does no harm."""

    def __init__(self, data: bytes):
        self.objects: dict[int, tuple] = {}
        self.root = None
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            r = Reader(data, m.end())
            value, stream = r.value(), None
            if isinstance(value, dict):
                s = re.compile(rb"\s*stream\r?\n").match(data, r.at)
                if s:
                    size = value.get("Length")
                    end = s.end() + size if isinstance(size, int) and not isinstance(size, Ref) else data.find(b"endstream", s.end())
                    stream = data[s.end() : end if end >= 0 else len(data)]
            self.objects[int(m[1])] = (value, stream)
        for value, stream in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(value, self._plain(value, stream))
        trailers = [Reader(data, m.end()).value() for m in re.finditer(rb"\btrailer\b", data)] + [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "XRef"]
        for t in trailers:
            if isinstance(t, dict):
                self.root = t.get("Root", self.root)
        self.closed = any(isinstance(t, dict) and "Encrypt" in t for t in trailers)

    def _unpack(self, head: dict, body: bytes) -> None:
        r = Reader(body)
        pairs = [(r.value(), r.value()) for _ in range(int(self.of(head.get("N")) or 0))]
        first = int(self.of(head.get("First")) or 0)
        for number, place in pairs:
            if isinstance(number, int) and isinstance(place, int):
                self.objects.setdefault(number, (Reader(body, first + place).value(), None))

    def of(self, value):
        """A value, or what it refers to."""
        seen = 0
        while isinstance(value, Ref) and seen < 32:
            value, seen = self.objects.get(int(value), (None, None))[0], seen + 1
        return value

    def _plain(self, head: dict, stream: bytes | None) -> bytes:
        filters = self.of(head.get("Filter"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        out = stream or b""
        for f in filters:
            if f != "FlateDecode":
                return b""
            try:
                out = zlib.decompressobj().decompress(out)
            except zlib.error:
                return b""
        return out

    def stream(self, ref) -> bytes:
        value, stream = self.objects.get(int(ref), (None, None)) if isinstance(ref, Ref) else (None, None)
        return self._plain(value, stream) if isinstance(value, dict) else b""

    def pages(self) -> list[dict]:
        """The pages in order, each with the resources it inherits."""
        out: list[dict] = []
        root = self.of(self.root)
        stack, seen = [(root.get("Pages"), {})] if isinstance(root, dict) else [], set()
        while stack:
            ref, above = stack.pop()
            node = self.of(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            seen.add(int(ref) if isinstance(ref, Ref) else None)
            own = above | {k: node[k] for k in ("Resources",) if k in node}
            kids = self.of(node.get("Kids"))
            if isinstance(kids, list):
                stack.extend((k, own) for k in reversed(kids))
            else:
                out.append(own | node)
        return out


def _decoder(doc: Document, font) -> tuple[int, dict[int, str]]:
    """How many bytes a code has, and what codes mean; an empty map stands for Latin text."""
    font = doc.of(font)
    font = font if isinstance(font, dict) else {}
    wide = 2 if font.get("Subtype") == "Type0" else 1
    meaning: dict[int, str] = {}
    r = Reader(doc.stream(font.get("ToUnicode")))
    text = lambda b: b.decode("utf-16-be", "replace") if isinstance(b, bytes) else ""
    code = lambda b: int.from_bytes(b, "big") if isinstance(b, bytes) else 0
    held: list = []
    while (v := r.value()) is not None:
        if not isinstance(v, Word):
            held.append(v)
            continue
        if v == "endcodespacerange" and held and isinstance(held[-1], bytes):
            wide = max(1, len(held[-1]))
        elif v == "endbfchar":
            meaning.update((code(a), text(b)) for a, b in zip(held[::2], held[1::2]))
        elif v == "endbfrange":
            for a, z, b in zip(held[::3], held[1::3], held[2::3]):
                for k in range(min(code(z) - code(a) + 1, 65_536)):
                    meaning[code(a) + k] = text(b[k]) if isinstance(b, list) and k < len(b) else text(b)[:-1] + chr(ord(text(b)[-1]) + k) if isinstance(b, bytes) and text(b) else ""
        held = []
    return wide, meaning


def _shown(data: bytes, decoder: tuple[int, dict[int, str]]) -> str:
    wide, meaning = decoder
    if not meaning:
        return data.decode("utf-16-be" if wide == 2 else "cp1252", "replace")
    return "".join(meaning.get(int.from_bytes(data[k : k + wide], "big"), "") for k in range(0, len(data), wide))


def _page_text(doc: Document, page: dict) -> str:
    """The words of a page from top to bottom and left to right."""
    resources = doc.of(page.get("Resources")) or {}
    fonts = doc.of(resources.get("Font")) or {} if isinstance(resources, dict) else {}
    contents = page.get("Contents")
    parts = doc.of(contents) if isinstance(doc.of(contents), list) else [contents]
    r = Reader(b"\n".join(doc.stream(p) for p in parts))
    decoders: dict[str, tuple] = {}
    font, size, leading, x, y, line_x, line_y, held = "", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, []
    found: list[tuple[float, float, float, str]] = []

    def number(k: int) -> float:
        return float(held[k]) if len(held) >= -k and isinstance(held[k], (int, float)) else 0.0

    def move(dx: float, dy: float) -> None:
        nonlocal x, y, line_x, line_y
        line_x, line_y = line_x + dx, line_y + dy
        x, y = line_x, line_y

    def show(parts: list) -> None:
        """Strings and the distances between them, in thousandths of the size."""
        nonlocal x
        if font not in decoders:
            decoders[font] = _decoder(doc, fonts.get(font) if isinstance(fonts, dict) else None)
        t = "".join(_shown(p, decoders[font]) if isinstance(p, bytes) else " " if isinstance(p, (int, float)) and p < -1000 * GAP else "" for p in parts)
        found.append((y, x, size, t))
        x += 0.5 * size * len(t)

    while (v := r.value()) is not None:
        if not isinstance(v, Word):
            held.append(v)
            continue
        if v == "Tf" and len(held) >= 2:
            font, size = str(held[-2]), abs(number(-1)) or 1.0
        elif v == "TL":
            leading = number(-1)
        elif v == "BT":
            x = y = line_x = line_y = 0.0
        elif v in ("Td", "TD"):
            leading = -number(-1) if v == "TD" else leading
            move(number(-2), number(-1))
        elif v == "Tm":
            x, y = line_x, line_y = number(-2), number(-1)
        elif v == "T*":
            move(0.0, -leading)
        elif v == "Tj" and held:
            show(held[-1:])
        elif v in ("'", '"') and held:
            move(0.0, -leading)
            show(held[-1:])
        elif v == "TJ" and held and isinstance(held[-1], list):
            show(held[-1])
        held = []
    lines: list[list[tuple[float, float, float, str]]] = []
    for piece in sorted(found, key=lambda p: (-p[0], p[1])):
        if lines and abs(lines[-1][0][0] - piece[0]) < 0.5 * piece[2]:
            lines[-1].append(piece)
        else:
            lines.append([piece])
    return "\n".join(" ".join(t for p in sorted(line, key=lambda p: p[1]) if (t := p[3].strip())) for line in lines).strip()


def page_texts(data: bytes) -> list[str]:
    """The text of each page of a PDF file; none for what is no PDF or is encrypted."""
    if b"%PDF-" not in data[:1024]:
        return []
    doc = Document(data)
    return [] if doc.closed else [_page_text(doc, p) for p in doc.pages()]


def read_pdf_text(spark: SparkSession, folder: str) -> DataFrame:
    """path, page_number, text of every page of the .pdf files under a folder. A file that cannot be read gives no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, data = (batch.column(c)[k].as_py() for c in (0, 1))
                try:
                    texts = page_texts(data)
                except (ValueError, IndexError, RecursionError, OverflowError):
                    texts = []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string())], names=["path", "page_number", "text"])

    return files.select("path", F.col("content")).mapInArrow(run, "path string, page_number int, text string")


def page_counts(pages: DataFrame) -> DataFrame:
    """path, n_pages of every file."""
    return pages.groupBy("path").agg(F.max("page_number").alias("n_pages"))
