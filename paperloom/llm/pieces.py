"""Cutting oversized items into pieces at natural boundaries, range by range.

A content (or a file) is read as byte ranges with halos, by as many tasks as it has ranges. Where
the pieces of a range begin depends on where the last piece before it ended, so every range first
makes a table: for each place at which a piece may enter it, where the chain of pieces leaves it
and how many pieces that makes. The tables, which are small because chains soon meet, are stitched
along the ranges of an item; characters and pieces are prefix-summed, and then each range emits its
pieces by offset. The pieces are those of the whole text read at once, whatever its length; nobody
reads a whole giant.

Pieces are at most ``size`` characters (Unicode code points); consecutive pieces share exactly
``overlap`` characters. Of the boundaries in reach the latest of the strongest kind in the second
half of the piece wins: paragraph, line, sentence, clause, word; then any boundary; where there is
none the cut is hard but not before a combining mark, a joiner or a variation selector if that
can be helped. A null size is 1000, a null overlap 150; an overlap is at most size - 1. Null and
empty contents give no piece. Whole contents are cut, whatever their length.
"""

from __future__ import annotations

import bisect
import functools
import operator
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperloom.session import cut

DEFAULT_SIZE, DEFAULT_OVERLAP = 1000, 150
#: Bytes of a range of an item and of a file; ranges have at least 16 bytes for each character of the piece size.
RANGE_BYTES, FILE_RANGE_BYTES = 1 << 18, 8 << 20
#: Characters before a range that tell which kind of boundary its first ones are.
LOOK_BACK = 256
#: The entry of ranges after the one in which the last piece begins.
DONE = 1 << 60

# Boundary kinds, strongest first; a boundary is where the next piece begins.
_KINDS = (
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…。]+[)\]\"'”’]*\s+"),
    re.compile(r"[,;:]\s+"),
    re.compile(r"\s+"),
)
_JOINERS = {"\u200d", "\ufe0f", "\ufe0e", "\u20e3"}


def _glued(ch: str) -> bool:
    """Whether a character belongs to the one before it."""
    return ch in _JOINERS or unicodedata.combining(ch) > 0 or "\U0001f3fb" <= ch <= "\U0001f3ff"


class Cutter:
    """The boundaries of a text (or of a range with its halos), and where a piece that begins somewhere ends."""

    def __init__(self, text: str, size: int, overlap: int):
        self.text, self.size, self.overlap = text, size, overlap
        self.marks = [[m.end() for m in kind.finditer(text)] for kind in _KINDS]

    def end_of(self, start: int) -> int:
        """The end of the piece that begins at ``start``, if more than ``size`` characters follow."""
        limit, least = start + self.size, start + self.overlap + 1
        for floor in (max(least, start + self.size // 2), least):
            for marks in self.marks:
                k = bisect.bisect_right(marks, limit) - 1
                if k >= 0 and marks[k] >= floor:
                    return marks[k]
        found = limit
        while found > least and _glued(self.text[found]):
            found -= 1
        return limit if _glued(self.text[found]) else found


def cut_positions(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text."""
    if len(text) <= size:
        return [(0, len(text))]
    cutter, out, start = Cutter(text, size, overlap), [], 0
    while len(text) - start > size:
        end = cutter.end_of(start)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


def _limits(size, overlap) -> tuple[int, int]:
    size = DEFAULT_SIZE if size is None or size != size else max(1, int(size))
    overlap = DEFAULT_OVERLAP if overlap is None or overlap != overlap else max(0, int(overlap))
    return size, min(overlap, size - 1)


# ---- ranges ------------------------------------------------------------------------------------


def _halos(size) -> tuple:
    """Bytes before and after a range that its pieces may need; of a number or a column."""
    return 4 * LOOK_BACK, 4 * (size + LOOK_BACK)


def _lead_byte(data: bytes, at: int) -> int:
    """The first position from ``at`` on where a UTF-8 character begins."""
    while at < len(data) and 0x80 <= data[at] < 0xC0:
        at += 1
    return at


class Range:
    """The characters of a byte range from ``a`` to ``z`` of ``total`` bytes; ``data`` begins at byte ``lo``. Bytes that are no UTF-8 are replacement characters."""

    def __init__(self, data: bytes, lo: int, a: int, z: int, total: int, size: int, overlap: int):
        first, begin, end = (_lead_byte(data, x) for x in (0, a - lo, z - lo))
        before = data[first:begin].decode("utf-8", "replace")
        body = data[begin:end].decode("utf-8", "replace")
        after = data[end:].decode("utf-8", "replace" if lo + len(data) == total else "ignore")
        self.left, self.n_chars = len(before), len(body)
        #: How many characters follow from the range's beginning to the end of the whole, if that is in sight.
        self.to_end = len(body) + len(after) if lo + len(data) == total else None
        self.size, self.overlap = size, overlap
        self.cutter = Cutter(before + body + after, size, overlap)

    def _ends(self, start: int) -> bool:
        return self.to_end is not None and self.to_end - start <= self.size

    def chain(self, entry: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that begin in the range, the first at ``entry``; places count from the range's beginning."""
        out, start = [], entry
        while start < self.n_chars:
            if self._ends(start):
                return [*out, (start, self.to_end)]
            end = self.cutter.end_of(start + self.left) - self.left
            out.append((start, end))
            start = end - self.overlap
        return out

    def table(self) -> list[tuple[int, int, int, int]]:
        """(entry, exit, count, slope) of stretches of entries: the exit is the same for all of them (slope 0) or moves with the entry (slope 1).

        An exit counts from the next range's beginning; it is DONE where the last piece begins in this range.
        """
        known: dict[int, tuple[int, int]] = {}
        exits = np.zeros((self.size, 2), dtype=np.int64)
        for entry in range(self.size):
            path, at = [], entry
            while at < self.n_chars and at not in known:
                path.append(at)
                if self._ends(at):
                    known[at] = (DONE, 1)
                    path.pop()
                else:
                    at = self.cutter.end_of(at + self.left) - self.left - self.overlap
            out, count = known.get(at, (at - self.n_chars, 0))
            for k, place in enumerate(reversed(path)):
                known[place] = (out, count + k + 1)
            exits[entry] = known[entry] if entry in known else (entry - self.n_chars, 0)
        step, more = np.diff(exits[:, 0]), np.diff(exits[:, 1])
        usual = (more == 0) & ((step == 0) | (step == 1))
        # A stretch goes on while its slope stays what its first step was.
        stretches, k = [], 0
        while k < self.size:
            e, n = k, int(exits[k, 0])
            slope = int(step[e]) if e < self.size - 1 and usual[e] else 0
            k += 1
            while k < self.size and usual[k - 1] and step[k - 1] == slope:
                k += 1
            stretches.append((e, n, int(exits[e, 1]), slope))
        return stretches


_TABLE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("entry", "exit", "count", "slope")]))


def _stitch(keys: list[str]):
    """One item's tables, range after range: where each range is entered, and the pieces and characters before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range_no")
        entry, pieces, chars, rows = 0, 0, 0, []
        for n_chars, table in zip(pdf["n_chars"], pdf["stretches"]):
            rows.append((entry, pieces, chars))
            chars += int(n_chars)
            if entry >= DONE:
                continue
            k = bisect.bisect_right([t["entry"] for t in table], entry) - 1
            t = table[k]
            pieces, entry = pieces + int(t["count"]), int(t["exit"]) + int(t["slope"]) * (entry - int(t["entry"]))
        out = pdf[[*keys, "range_no"]].copy()
        out["entry"], out["pieces_before"], out["chars_before"] = zip(*rows)
        out["n_pieces"] = pieces
        return out

    return run


def _pieces_of_ranges(ranges: DataFrame, keys: list[str], read, with_text: bool) -> DataFrame:
    """The pieces of ranges; ``read`` gives the Range of a row."""
    kinds = [T.StructField(k, ranges.schema[k].dataType) for k in (*keys, "range_no")]
    number = lambda *names: [T.StructField(n, T.LongType()) for n in names]

    table_kind = T.StructType([*kinds, *number("n_chars"), T.StructField("stretches", _TABLE)])
    piece_kind = _schema(ranges, keys, with_text)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                r = read(row)
                made = {c: row[c] for c in (*keys, "range_no")} | {"n_chars": r.n_chars, "stretches": [dict(zip(("entry", "exit", "count", "slope"), t)) for t in r.table()]}
                yield pa.RecordBatch.from_pylist([made], schema=to_arrow_schema(table_kind))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                r, out = read(row), []
                for n, (s, e) in enumerate(r.chain(row["entry"])):
                    piece = {c: row[c] for c in keys} | {"piece_no": row["pieces_before"] + n + 1, "n_pieces": row["n_pieces"], "start_char": row["chars_before"] + s, "end_char": row["chars_before"] + e}
                    out.append(piece | {"piece": r.cutter.text[r.left + s : r.left + e]} if with_text else piece)
                yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(piece_kind))

    made = ranges.mapInArrow(tables, table_kind)
    entries = cut(made.groupBy(*keys).applyInPandas(_stitch(keys), T.StructType([*kinds, *number("entry", "pieces_before", "chars_before", "n_pieces")])))
    named = entries.withColumnsRenamed({c: f"_e_{c}" for c in (*keys, "range_no")})
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in (*keys, "range_no")])
    return ranges.join(named, same).drop(*[f"_e_{c}" for c in (*keys, "range_no")]).mapInArrow(emit, piece_kind)


def _schema(typed: DataFrame, keys: list[str], with_text: bool) -> T.StructType:
    fields = [T.StructField(k, typed.schema[k].dataType) for k in keys]
    fields += [T.StructField(c, T.LongType()) for c in ("piece_no", "n_pieces", "start_char", "end_char")]
    return T.StructType(fields + ([T.StructField("piece", T.StringType())] if with_text else []))


# ---- items -------------------------------------------------------------------------------------


def _cut_whole(keys: list[str], kind: T.StructType, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                row_of, numbers, sizes, starts, ends, texts = [], [], [], [], [], []
                for k, (text, size, overlap) in enumerate(zip(*(batch.column(n + c).to_pylist() for c in range(3)))):
                    pieces = cut_positions(text, *_limits(size, overlap))
                    row_of.extend([k] * len(pieces))
                    numbers.extend(range(1, len(pieces) + 1))
                    sizes.extend([len(pieces)] * len(pieces))
                    starts.extend(s for s, _ in pieces)
                    ends.extend(e for _, e in pieces)
                    if with_text:
                        texts.extend(text[s:e] for s, e in pieces)
                columns = [batch.column(c).take(pa.array(row_of, pa.int64())) for c in range(n)] + [pa.array(x, pa.int64()) for x in (numbers, sizes, starts, ends)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if with_text else []), names=kind.names)

    return run


def split_items(
    items: DataFrame, keys: list[str], content: str, size: str, overlap: str, with_text: bool = True, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """keys, piece_no (from 1), n_pieces, start_char, end_char and, if asked for, the piece.

    ``keys`` are columns that name an item; a null in one of them is a name like any other. An item
    delivered twice unchanged gives its pieces once. Items of one range are cut where they lie;
    longer ones are sliced by bytes in the JVM and their ranges spread over the tasks.
    """
    n_bytes = F.octet_length(content)
    at_least = F.greatest(F.lit(range_bytes), 16 * F.greatest(F.coalesce(F.col(size), F.lit(DEFAULT_SIZE)), F.lit(1))).cast("long")
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    slim = items.where(n_bytes > 0).select(*[F.col(k).alias(v) for k, v in names.items()], F.col(content).alias("_c"), F.col(size).cast("int").alias("_size"), F.col(overlap).cast("int").alias("_overlap"), n_bytes.alias("_n"), at_least.alias("_step"))
    own = list(names.values())
    whole = slim.where("_n <= _step").select(*own, "_c", "_size", "_overlap")
    pieces = whole.mapInArrow(_cut_whole(own, _schema(slim, own, with_text), with_text), _schema(slim, own, with_text))
    ranges = _item_ranges(slim.where("_n > _step"), own)
    giants = _pieces_of_ranges(ranges, own, _item_range, with_text) if not ranges.isEmpty() else None
    every = pieces if giants is None else pieces.unionByName(giants)
    once = every.dropDuplicates([*own, "piece_no"])
    return once.withColumnsRenamed({v: k for k, v in names.items()})


def _item_ranges(giants: DataFrame, keys: list[str]) -> DataFrame:
    """The byte ranges of giants with their halos, once each, spread over the tasks by item and range."""
    before, after = _halos(F.greatest(F.coalesce(F.col("_size"), F.lit(DEFAULT_SIZE)), F.lit(1)))
    n_ranges = F.ceil(F.col("_n") / F.col("_step")).cast("int")
    cells = giants.select(*keys, "_size", "_overlap", "_n", "_step", F.col("_c").cast("binary").alias("_b"), F.explode(F.sequence(F.lit(0), n_ranges - 1)).alias("range_no"))
    a = F.col("range_no") * F.col("_step")
    z = F.least("_n", a + F.col("_step"))
    lo, hi = F.greatest(F.lit(0), a - before), F.least("_n", z + after)
    sliced: Column = F.substring("_b", (lo + 1).cast("int"), (hi - lo).cast("int"))
    rows = cells.select(*keys, "range_no", "_size", "_overlap", "_n", a.alias("_a"), z.alias("_z"), lo.alias("_lo"), sliced.alias("_data"))
    # One shuffle spreads the ranges and brings second deliveries together; with a stated number it is not coalesced to few tasks.
    spread = rows.repartition(int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "range_no")
    return cut(spread.dropDuplicates([*keys, "range_no"]))


def _item_range(row: dict) -> Range:
    return Range(bytes(row["_data"]), int(row["_lo"]), int(row["_a"]), int(row["_z"]), int(row["_n"]), *_limits(row["_size"], row["_overlap"]))


# ---- files -------------------------------------------------------------------------------------


def file_ranges(spark: SparkSession, folder: str, pattern: str = "*", range_bytes: int = FILE_RANGE_BYTES) -> DataFrame:
    """path, file_bytes, range_no, from_byte, to_byte of every file; only sizes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    step = F.lit(range_bytes)
    return (
        files.where("length > 0").select("path", F.col("length").alias("file_bytes"))
        .withColumn("range_no", F.explode(F.sequence(F.lit(0), F.ceil(F.col("file_bytes") / step).cast("int") - 1)))
        .select("path", "file_bytes", "range_no", (F.col("range_no") * step).alias("from_byte"), F.least("file_bytes", (F.col("range_no") + 1) * step).alias("to_byte"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "range_no")  # a stated number is not coalesced
    )


def _file_range(size: int, overlap: int):
    def read(row: dict) -> Range:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(row["path"])
        a, z, total = int(row["from_byte"]), int(row["to_byte"]), int(row["file_bytes"])
        before, after = _halos(size)
        lo, hi = max(0, a - before), min(total, z + after)
        with system.open_input_file(path) as f:
            return Range(f.read_at(hi - lo, lo), lo, a, z, total, size, overlap)

    return read


def split_files(spark: SparkSession, folder: str, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, pattern: str = "*", range_bytes: int = FILE_RANGE_BYTES) -> DataFrame:
    """path, piece_no, n_pieces, start_char, end_char, piece of every text file under a folder.

    Workers open the file and read their byte range with a halo, once for the table and once for the
    pieces; nobody reads a whole file. Bytes that are no UTF-8 count as replacement characters.
    """
    size, overlap = _limits(size, overlap)
    ranges = file_ranges(spark, folder, pattern, max(range_bytes, 16 * size))
    return _pieces_of_ranges(ranges, ["path"], _file_range(size, overlap), True)
