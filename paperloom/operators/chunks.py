"""Preview of how a Markdown text falls into chunks: by headings first, then by ever finer separators.

Contract: a section begins at each heading of level one to three. A section longer than the size
is parted at blank lines, parts still too long at line ends, then at blanks, then anywhere; parts
are packed greedily up to the size, and a new chunk repeats whole trailing parts of the one
before up to the overlap. Chunks are trimmed; blank ones are left out. Null texts have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", " ", "")


def sections(text: str) -> list[str]:
    out: list[list[str]] = [[]]
    fenced = False
    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        if not fenced and re.match(r"#{1,3} ", line) and any(x.strip() for x in out[-1]):
            out.append([])
        out[-1].append(line)
    return ["\n".join(x) for x in out]


def _pack(parts: list[str], glue: str, size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    length = 0
    for p in parts:
        extra = len(p) + (len(glue) if held else 0)
        if held and length + extra > size:
            out.append(glue.join(held))
            while held and (length > overlap or length + len(p) + len(glue) > size):
                length -= len(held.pop(0)) + (len(glue) if held else 0)
            extra = len(p) + (len(glue) if held else 0)
        held.append(p)
        length += extra
    if held:
        out.append(glue.join(held))
    return out


def split(text: str, size: int, overlap: int, level: int = 0) -> list[str]:
    if len(text) <= size:
        return [text]
    glue = SEPARATORS[level]
    if not glue:
        step = max(1, size - overlap)
        return [text[k : k + size] for k in range(0, max(1, len(text) - overlap), step)]
    out: list[str] = []
    small: list[str] = []
    for part in text.split(glue):
        if len(part) <= size:
            small.append(part)
            continue
        out.extend(_pack(small, glue, size, overlap))
        small = []
        out.extend(split(part, size, overlap, level + 1))
    return out + _pack(small, glue, size, overlap)


def preview_chunks(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """key, chunk_id, char_count, token_estimate, preview, content of every chunk of each text."""
    overlap = min(max(0, overlap), size - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["_k"], pdf["_t"]):
                chunks = [c.strip() for s in sections(t) for c in split(s, size, overlap)]
                rows.extend((k, n, len(c), max(1, len(c) // 4), c[:120].replace("\n", " "), c) for n, c in enumerate(filter(None, chunks), 1))
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "char_count", "token_estimate", "preview", "content"])

    fields = [T.StructField(key, docs.schema[key].dataType)] + T.StructType.fromDDL("chunk_id int, char_count int, token_estimate int, preview string, content string").fields
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(run, T.StructType(fields))


def chunk_stats(chunks: DataFrame, key: str) -> DataFrame:
    """key, total_chunks, total_characters, avg_chunk_size."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("total_chunks"), F.sum("char_count").alias("total_characters"), F.round(F.avg("char_count"), 4).alias("avg_chunk_size"))
