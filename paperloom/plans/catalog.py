"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from paperloom.plans import cells, data_quality, documents, pages, records, stored, streams, workbooks

_PARTS = (data_quality, cells, stored, documents, streams, workbooks, pages, records)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
