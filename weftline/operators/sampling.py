"""Deterministic samples and bounded choices that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_fraction(column: Column, parts: int) -> Column:
    """A number from 0 to parts - 1 from the first 32 bits of SHA-256 of the text."""
    return F.pmod(F.conv(F.substring(F.sha2(column.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(parts))


def hash_sample(rows: DataFrame, column: str, parts: int, keep: int) -> DataFrame:
    return rows.where(hash_fraction(F.col(column), parts) < keep)


def bounded_by_hash(rows: DataFrame, keys: list[str], column: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, those with the least SHA-256 of a column."""
    w = Window.partitionBy(*keys).orderBy(F.sha2(F.col(column).cast("string"), 256), column)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def stratified(rows: DataFrame, stratum: str, within: str, column: str, size: int, most_within: int) -> DataFrame:
    """Round robin over strata by hash: every stratum gives its first rows before any gives its next; inside one,
    at most ``most_within`` rows of each value of ``within``."""
    order = F.sha2(F.col(column).cast("string"), 256)
    capped = rows.withColumn("_k", F.row_number().over(Window.partitionBy(stratum, within).orderBy(order, column))).where(F.col("_k") <= most_within)
    turns = capped.withColumn("_turn", F.row_number().over(Window.partitionBy(stratum).orderBy("_k", order, column)))
    return turns.orderBy("_turn", stratum).limit(size).drop("_k", "_turn")


def allocate(counts: dict[str, int], size: int) -> dict[str, int]:
    """Shares of ``size`` in proportion to counts, whole by largest remainder; names break ties."""
    total = sum(counts.values())
    if not total:
        return dict.fromkeys(counts, 0)
    whole = {k: min(n, size * n // total) for k, n in counts.items()}
    rest = sorted(counts, key=lambda k: (-(size * counts[k] % total), k))
    for k in rest:
        if sum(whole.values()) >= min(size, total):
            break
        if whole[k] < counts[k]:
            whole[k] += 1
    return whole


def split_by_parity(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("part", F.when(hash_fraction(F.col(column), 2) == 0, "fit").otherwise("test"))
