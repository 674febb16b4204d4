"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n. Null ids are in no fold (null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bounded_sample(rows: DataFrame, key: str, most: int, by: str | None = None) -> DataFrame:
    """About ``most`` rows (of each value of ``by``), chosen by a hash of ``key``: the same rows at every run.

    The counts that set the rates are taken over all rows. Only a column-pruned count is shuffled, never a text.
    """
    by_col = F.col(by) if by else F.lit(0)
    counts = {r[0]: r[1] for r in rows.groupBy(by_col.alias("k")).count().collect()}  # a row for each class or language
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(by_col == F.lit(value), F.lit(min(1.0, most / n))).otherwise(rate)
    return rows.where((F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / F.lit(1 << 30)) < rate)
