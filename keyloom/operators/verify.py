"""Verification joins: expected against actual cells, sequences, metadata and whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import REQUIRED_META, TAG_META


def deep_verify(expected: DataFrame, actual: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """`expected` with status OK, MISSING or MISMATCH."""
    found = actual.select(*keys, F.col(value).alias("actual_value"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "MISSING").when(~F.col(value).eqNullSafe(F.col("actual_value")), "MISMATCH").otherwise("OK")
    return expected.join(found, keys, "left").withColumn("status", status).drop("_there")


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(actual.select(*keys), keys, "left_anti")


def verdict(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def sampled(df: DataFrame, key: str, percent: int) -> DataFrame:
    """A stable sample by key hash, so that both sides of a check draw the same rows."""
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return df.filter(draw % 100 < percent)


def row_count_check(actual: DataFrame, row: str, at_least: int) -> DataFrame:
    return actual.agg(F.countDistinct(row).alias("n_rows")).withColumn("passed", F.col("n_rows") >= at_least)


def sequence_check(expected: DataFrame, actual: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """Positions at which two sequences differ, missing and surplus ones too."""
    a = expected.select(position, F.struct(*columns).alias("expected"))
    b = actual.select(position, F.struct(*columns).alias("actual"))
    return a.join(b, position, "full").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def required_meta(entries: DataFrame, by: list[str], name: str = "name", required=REQUIRED_META) -> DataFrame:
    """Required metadata that a file lacks."""
    always = entries.select(*by).distinct().withColumn(name, F.explode(F.array(*[F.lit(r) for r in required])))
    wanted = always.unionByName(entries.filter(F.col(name) == TAG_META[0]).select(*by).distinct().withColumn(name, F.lit(TAG_META[1])))
    return wanted.join(entries.select(*by, name), [*by, name], "left_anti")


def metadata_check(stats: DataFrame, **expected) -> DataFrame:
    """Of each expected column value, whether the row has it."""
    return stats.select("*", *[F.col(k).eqNullSafe(v if isinstance(v, Column) else F.lit(v)).alias(f"{k}_ok") for k, v in expected.items()])


def table_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side alone, repeats counted; empty for equal tables."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def first_cells(cells: DataFrame, order: list, n: int) -> DataFrame:
    """The first `n` cells in order: the limit of a report."""
    return cells.orderBy(*order).limit(n)
