"""Iterate over a result partition by partition; the next one is fetched meanwhile."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

CHUNK_ROWS = 10_000


def iter_rows(df: DataFrame) -> Iterator[dict[str, Any]]:
    """Rows as dicts; the driver holds two partitions at most."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield row.asDict()


def iter_chunks(df: DataFrame, rows: int = CHUNK_ROWS) -> Iterator[list[dict[str, Any]]]:
    """Lists of up to ``rows`` rows, in order."""
    if rows < 1:
        raise ValueError("a chunk has at least one row")
    held: list[dict[str, Any]] = []
    for row in iter_rows(df):
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held
