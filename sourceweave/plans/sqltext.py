"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from sourceweave.sources.corpus import corpus_sql
from sourceweave.sources.tables import DOC_PATH_SQL

CORPUS = f"corpus as materialized ({corpus_sql()})"
DOCS = f"docs as (select source as project_id, {DOC_PATH_SQL} as path, text as content from documents)"
LINES = (
    "lines as materialized (select project_id, path, unnest(string_split(content, chr(10))) as line, "
    "generate_subscripts(string_split(content, chr(10)), 1) as line_no from {src})"
)
SUFFIX = r"regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.].*\.([^.]+)$', 1)"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return ", ".join(q(v) for v in values)


def parts_overlap(parts: str, values: list[str]) -> str:
    return f"list_has_any({parts}, [{in_list(values)}])"
