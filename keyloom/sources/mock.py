"""Deterministic example tables of telecom records: equal in shape and distribution, not digit for digit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the two tables.
SIGNAL_RULE, SESSION_RULE = "REFID,0,false,15", "STARTTIME,0,false,10#IMSI,1,true,15"
FIRST_REFID, FIRST_SECOND, FIRST_MILLISECOND, FIRST_IMSI = 183971587293920, 1775537735, 1700000000000, 460001234560000
RATS = ("LTE", "NR", "UMTS")


def _draw(i: Column, name: str, seed: int, n: int) -> Column:
    """0 to n - 1, from the row number alone: the same in every attempt and partitioning."""
    return F.pmod(F.xxhash64(F.lit(name), F.lit(seed), i), F.lit(n))


def signals(spark: SparkSession, rows: int, seed: int = 42, payload_bytes: int = 0, start: int = 0) -> DataFrame:
    i = F.col("id")
    time = F.lit(FIRST_SECOND) + F.floor(i / 3)

    def record(r: int) -> Column:
        d = lambda name, n: _draw(i * 8 + r, name, seed, n)
        odd = i % 5 == 0
        return F.concat_ws(
            ",", F.lit("cs"), F.lit(12111), F.when(odd, 120).otherwise(100), F.when(odd, 121).otherwise(100), F.lit(FIRST_IMSI) + d("imsi", 1_000_000), F.lit(0), d("rat", 10), F.lit(""), F.lit(""), time, time, F.lit(""),
            d("cell", 10) + 34, d("rsrp", 120), F.lit(""), F.lit(""), F.lit(10), d("snr", 40), d("bytes", 500) + 11, F.lit(""),
        )

    if payload_bytes:
        text = F.rpad(F.repeat(record(0), max(1, payload_bytes // 60)), payload_bytes, "0")
    else:
        text = F.concat(record(0), F.when(i % 3 >= 1, record(1)).otherwise(""), F.when(i % 3 >= 2, record(2)).otherwise(""))
    return spark.range(start, start + rows).select(
        (F.lit(FIRST_REFID) + i * 255 + _draw(i, "gap", seed, 245)).alias("REFID"), time.alias("TIME"), F.concat(text, F.lit("; ")).alias("SIGSTORE"),
        F.when(i % 20 == 0, _draw(i, "map", seed, 64)).otherwise(F.lit(12).cast("long")).alias("BIT_MAP"), (i % 10).cast("string").alias("no"),
    )


def sessions(spark: SparkSession, rows: int, seed: int = 42, start: int = 0) -> DataFrame:
    i = F.col("id")
    d = lambda name, n: _draw(i, name, seed, n)
    return spark.range(start, start + rows).select(
        (F.lit(FIRST_MILLISECOND) + i * 5 + d("start", 5)).alias("STARTTIME"), F.lpad((F.lit(FIRST_IMSI) + i).cast("string"), 15, "0").alias("IMSI"), F.concat(F.lit("138"), F.lpad(d("msisdn", 10**8).cast("string"), 8, "0")).alias("MSISDN"),
        (d("duration", 3600) + 1).alias("DURATION"), d("up", 10**8).alias("BYTES_UP"), d("down", 5 * 10**8).alias("BYTES_DW"), F.lpad(F.hex(d("cell", 0xFFFFFF)), 6, "0").alias("CELL_ID"), F.element_at(F.array(*[F.lit(r) for r in RATS]), (i % 3 + 1).cast("int")).alias("RAT_TYPE"),
    )


def shuffled(df: DataFrame, order: str, batch_rows: int = 1000, seed: int = 42) -> DataFrame:
    """Rows in a random order within batches of `batch_rows` neighbours by `order` (a number without gaps)."""
    return df.withColumn("_batch", F.floor(F.col(order) / batch_rows)).repartitionByRange("_batch").sortWithinPartitions("_batch", F.xxhash64(F.lit(seed), order)).drop("_batch")


def rows_for(target_bytes: int, row_bytes: int, batch_rows: int = 1000) -> int:
    """Rows that batches add up to until an estimate of 95 % of the target is reached."""
    rows = 0
    while rows * row_bytes < 0.95 * target_bytes:
        rows += min(batch_rows, max(1, (target_bytes - rows * row_bytes) // row_bytes))
    return rows


def folder(spark: SparkSession, files: int, rows_per_file: int, seed: int = 42) -> DataFrame:
    """The signals of `files` files with keys that never repeat, and the file of each row."""
    made = signals(spark, files * rows_per_file, seed)
    return made.withColumn("file", F.floor((F.col("REFID") - FIRST_REFID) / 255 / rows_per_file).cast("int"))
