"""Schemas of the engine's tables, and the interfaces of what can be plugged in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame

#: Spark DDL of each table of a written index.
TABLES = {
    "files": "path string, language string, content_hash string, mtime long, indexed_at long",
    "symbols": "id long, name string, kind string, file_path string, module string, language string, visibility string, start_line int, end_line int, signature string, doc string, class_name string",
    "imports": "file_path string, path string, alias string, is_glob boolean, is_type_only boolean",
    "relationships": "from_id long, to_id long, kind string, weight double, line int, context string",
    "chunks": "chunk_id long, symbol_id long, file_path string, language string, chunk_type string, parent_scope string, line_start long, line_end long, signature string, doc string, snippet string, embedding_text string",
    "vectors": "id long, language string, embedding array<float>",
    "documents": "chunk_id long, collection string, source_path string, byte_start long, byte_end long, headings array<string>, content string",
    "clusters": "cluster int, centroid array<double>",
}
#: Version of the written form; an index of a newer one is not read.
VERSION = 2


class Embedder(Protocol):
    """Texts to vectors; the same text gives the same vector."""

    def __call__(self, text: Column) -> Column: ...


class Chunker(Protocol):
    """Documents (id, text) to chunks (id, chunk_no, start, end, headings, content)."""

    def __call__(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame: ...


class LanguageParser(Protocol):
    """A source text to rows (what, name, kind, line, end_line, other)."""

    def __call__(self, language: str, source: str) -> list[tuple]: ...


class Reranker(Protocol):
    """A query and texts to one score for each text."""

    def __call__(self, query: str, texts: list[str]) -> list[float]: ...


class ChangeHandler(Protocol):
    """A micro-batch of changes, applied once."""

    def __call__(self, changes: DataFrame, batch: int) -> None: ...


class Resolver(Protocol):
    """Import paths as a project's configuration changes them: (file_path, path) to (file_path, path, candidate)."""

    def __call__(self, imports: DataFrame, configs: DataFrame) -> DataFrame: ...


class Rows(Protocol):
    def __iter__(self) -> Iterator[tuple]: ...
