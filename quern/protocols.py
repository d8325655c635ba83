"""What parts can be exchanged for one's own."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import Column, DataFrame


class Fetcher(Protocol):
    """URLs to results (url, status, status_code, html)."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


class Extractor(Protocol):
    """Results to results with text, metadata and hash."""

    def __call__(self, results: DataFrame) -> DataFrame: ...


class Chunker(Protocol):
    """Documents to chunks, a row each."""

    def __call__(self, docs: DataFrame, key: str, text: str, **options: Any) -> DataFrame: ...


class Exporter(Protocol):
    """Rows to files at a path."""

    def __call__(self, rows: DataFrame, path: str) -> None: ...


class Publisher(Protocol):
    """Documents to files (path, action, content)."""

    def __call__(self, docs: DataFrame, deletion: str = "tombstone") -> DataFrame: ...


class ChangeDetector(Protocol):
    """Whether a content differs from the one before, by their hashes."""

    def __call__(self, old: Column, new: Column) -> Column: ...


class Store(Protocol):
    """Keyed tables of sites, runs, pages, versions and frontier items."""

    def read(self, table: str) -> DataFrame: ...

    def save(self, table: str, rows: Any, order: list[str] | None = None) -> None: ...

    def get(self, table: str, **key: Any) -> dict | None: ...

    def delete_site(self, site_id: str) -> None: ...
