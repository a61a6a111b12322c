"""Disjoint segments of a table, read one by one: scan, independent count, drift, and resume of an unfinished run.

A row's segment is the CRC-32 of its key modulo the number of segments, so it does not depend on files, order or run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segment_of(keys: list[str], of: int) -> Column:
    """Segment of a row from 0; a null in a key counts as empty text."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.crc32(text.cast("binary")), F.lit(of)).cast("int")


def token_ranges(of: int) -> list[tuple[int, int]]:
    """``of`` neighbouring ranges (after, up to and with) over the signed 64-bit ring, none empty, all of it covered."""
    if of < 1:
        raise ValueError("at least one range")
    edges = [-(1 << 63) + (k << 64) // of for k in range(of)] + [(1 << 63) - 1]
    return list(zip(edges[:-1], edges[1:], strict=True))


@dataclass
class TableSource:
    """Tables of a mapping as a source: a table that is not there is unavailable, not empty. ``fault`` may raise before a
    segment is read, which tests use."""

    label: str
    tables: dict[str, tuple[DataFrame, list[str]]]
    fault: Callable[[str, int], None] = field(default=lambda table, segment: None)

    def available(self, table: str) -> bool:
        return table in self.tables

    def scan(self, table: str, columns: list[str], segment: int, of: int, where: Column | None = None) -> DataFrame:
        self.fault(table, segment)
        rows, keys = self.tables[table]
        rows = rows.where(segment_of(keys, of) == segment)
        return (rows if where is None else rows.where(where)).select(*columns)

    def counts(self, table: str, of: int, where: Column | None = None) -> DataFrame:
        """(segment, rows) by a count of its own, one pass for all segments."""
        rows, keys = self.tables[table]
        return (rows if where is None else rows.where(where)).groupBy(segment_of(keys, of).alias("segment")).agg(F.count(F.lit(1)).alias("rows"))


def drift(scanned: DataFrame, recounted: DataFrame, of: int) -> DataFrame:
    """(segment, scanned, recounted, delta) of every segment; a table that changed between both has a delta."""
    every = scanned.sparkSession.range(of).select(F.col("id").cast("int").alias("segment"))
    rows = every.join(scanned.select("segment", F.col("rows").alias("scanned")), "segment", "left").join(recounted.select("segment", F.col("rows").alias("recounted")), "segment", "left").na.fill(0, ["scanned", "recounted"])
    return rows.withColumn("delta", F.col("recounted") - F.col("scanned"))


def unfinished(done: DataFrame, of: int) -> DataFrame:
    """Segments still to be read, given those done (segment, attempts, ok)."""
    every = done.sparkSession.range(of).select(F.col("id").cast("int").alias("segment"))
    return every.join(done.where("ok").select("segment").distinct(), "segment", "left_anti")


def read_with_retry(source: TableSource, table: str, columns: list[str], segment: int, of: int, attempts: int, wait: Callable[[int], None]) -> DataFrame:
    """A segment, tried again after ``wait(attempt)``; the last failure is raised."""
    for attempt in range(1, attempts + 1):
        try:
            return source.scan(table, columns, segment, of)
        except OSError:
            if attempt == attempts:
                raise
            wait(attempt)
    raise ValueError("at least one attempt")
