"""Counters, histograms and benchmark reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, sum, extremes and nearest-rank percentiles."""
    ranks = [F.expr(f"percentile_disc({p / 100}) within group (order by {value})").alias(f"p{p}") for p in (50, 95, 99)]
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), *ranks)


def counters(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.groupBy(name).agg(F.sum(value).alias("total"))


def gauges(df: DataFrame, name: str, value: str, order: str) -> DataFrame:
    return df.groupBy(name).agg(F.max_by(value, order).alias("last_value"))


def batch_totals(files: DataFrame) -> DataFrame:
    """From one row per file (path, error_code, cells, bytes)."""
    good = F.col("error_code") == 0
    return files.agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col("cells"))), F.lit(0)).alias("cells"), F.coalesce(F.sum(F.when(good, F.col("bytes"))), F.lit(0)).alias("bytes"))


def perf_summary(runs: DataFrame) -> DataFrame:
    """Each scenario's implementations over their iterations; `iteration` orders them and the first one speaks for all."""
    first = lambda c: F.min_by(c, "iteration").alias(c)
    same = lambda c: F.min(c) == F.max(c)
    layout = F.when(F.col("strategy") == "merge-then-convert", "merged").otherwise("one-to-one")
    return runs.withColumn("layout", layout).groupBy("scenario", "implementation").agg(
        F.avg("elapsed_ms").alias("average_ms"),
        (F.bool_and("success") & same("strategy") & same("worker_parallelism") & same("file_count") & same("cell_count")).alias("consistent"),
        F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"),
        F.array_join(F.array_sort(F.collect_set("layout")), ",").alias("layouts"),
        first("worker_parallelism"), first("file_count"), first("cell_count"),
    )


def fair_speedup(runs: DataFrame, base: str = "native", other: str = "java") -> DataFrame:
    """other / base where the two did the same work; else null and the first reason."""
    per = perf_summary(runs)
    a = per.filter(F.col("implementation") == base).select("scenario", F.struct("*").alias("a"))
    b = per.filter(F.col("implementation") == other).select("scenario", F.struct("*").alias("b"))
    both = per.select("scenario").distinct().join(a, "scenario", "left").join(b, "scenario", "left")
    differ = lambda c: F.col(f"a.{c}") != F.col(f"b.{c}")
    note = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "an implementation is missing")
        .when(~F.col("a.consistent") | ~F.col("b.consistent"), "iterations differ")
        .when(differ("strategies") | differ("worker_parallelism"), "strategies differ")
        .when(differ("layouts"), "layouts differ")
        .when(differ("file_count"), "file counts differ")
        .when(differ("cell_count"), "cell counts differ")
        .when(F.col("a.average_ms") <= 0, "no time was taken")
        .otherwise("comparable")
    )
    return both.select("scenario", note.alias("note"), F.when(note == "comparable", F.col("b.average_ms") / F.col("a.average_ms")).alias("speedup"))
