"""First row wins, and the report of repeated keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is first by `order`; partial aggregation keeps one row for each key and task in the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def shown_key(key: Column, most: int = 64) -> Column:
    """A key for messages: at most `most` bytes, then how many more there are."""
    size = F.octet_length(key)
    cut = F.decode(F.substring(F.encode(key, "UTF-8"), 1, most), "UTF-8")
    return F.when(size <= most, key).otherwise(F.concat(cut, F.lit("...(+"), (size - most).cast("string"), F.lit("B)")))


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row, how many, and how they are shown."""
    found = df.filter(F.length(key) > 0).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    return found.withColumn("shown", shown_key(F.col(key)))
