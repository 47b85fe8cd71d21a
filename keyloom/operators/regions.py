"""Half-open key ranges: a key that equals a split point belongs to the right."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument

#: Up to so many split points are a literal array in the plan; more are searched by bisection.
LITERAL = 4096
#: Up to so many are a tree of comparisons.
TREE = 128


def check_splits(splits: list[str]) -> None:
    if any(a.encode() >= b.encode() for a, b in zip(splits, splits[1:])):
        raise InvalidArgument("split points must rise strictly")


def bisected(value: Column, borders: list, low: int = 0) -> Column:
    """The number of borders at or below `value`, by bisection: a tree of comparisons."""
    if not borders:
        return F.lit(low)
    mid = len(borders) // 2
    return F.when(value >= F.lit(borders[mid]), bisected(value, borders[mid + 1 :], low + mid + 1)).otherwise(bisected(value, borders[:mid], low))


def region_of(key: Column, splits: list[str]) -> Column:
    """The number of split points at or below `key`."""
    check_splits(splits)
    if len(splits) <= TREE:
        return bisected(key, splits)
    return F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s <= key))


def assign(df: DataFrame, key: str, splits: list[str]) -> DataFrame:
    """`df` with `region`. Many split points are searched by bisection, batch by batch; the list is the caller's and so fits a driver."""
    check_splits(splits)
    if len(splits) <= LITERAL:
        return df.withColumn("region", region_of(F.col(key), splits))
    edges = [s.encode() for s in splits]

    @F.pandas_udf(T.IntegerType())
    def search(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else bisect.bisect_right(edges, k.encode()), na_action="ignore").astype("Int32")

    return df.withColumn("region", search(key))


def ranked(df: DataFrame, key: str, name: str = "rank", ranges: int = 128) -> DataFrame:
    """`df` with its rank (from 1) in the order of `key`, whose values differ. The borders of `ranges` ranges are keys with the smallest
    hashes, an even draw of bounded size; a row's range follows from its key alone, so no task has to see a whole order."""
    drawn = df.select(F.col(key).alias("k")).filter("k is not null").orderBy(F.xxhash64("k"), "k").limit(ranges - 1).collect()
    placed = assign(df, key, sorted({r["k"] for r in drawn}, key=str.encode))
    before = Window.orderBy("region").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    first = placed.groupBy("region").agg(F.count(F.lit(1)).alias("_n")).select("region", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("region").orderBy(key))
    return placed.withColumn("_at", within).join(F.broadcast(first), "region").withColumn(name, F.col("_before") + F.col("_at")).drop("region", "_at", "_before")
