"""Cell tables on disk, their names, and text files of expected cells."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cells(cells: DataFrame, path: str, compression: str = "gzip", mode: str = "errorifexists") -> None:
    """Range-partitioned and sorted by row, so that files hold disjoint key ranges and row groups prune by key. The committer makes
    the result appear as a whole."""
    cells.repartitionByRange("row").sortWithinPartitions("row").write.mode(mode).option("compression", compression).option("parquet.bloom.filter.enabled#row", "true").parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for an example's output: in `spark.checkpoint.dir`, or where that is unset on a local master, in its own folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or f'file://{tempfile.gettempdir()}').rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def output_name(source: Column) -> Column:
    """`a.arrow` as `a.cells`."""
    return F.concat(F.regexp_replace(source, r"\.arrow$", ""), F.lit(".cells"))


def merged_name(table: Column, number: Column) -> Column:
    """The table's name with anything but letters, digits, - and _ replaced, and three digits."""
    return F.format_string("%s_%03d.cells", F.regexp_replace(table, "[^a-zA-Z0-9_-]", "_"), number)


def not_yet_written(inputs: DataFrame, outputs: DataFrame, name: str = "output") -> DataFrame:
    return inputs.join(outputs.select(name), name, "left_anti")


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    return parse_expected(spark.read.text(path))


def parse_expected(lines: DataFrame, line: str = "value") -> DataFrame:
    """Five fields by tabs: row in hex, family, qualifier, timestamp, value in hex; shorter lines are left out."""
    f = F.split(line, "\t", 5)
    return lines.select(f.alias("f")).filter(F.size("f") == 5).select(
        F.unhex(F.col("f")[0]).alias("row"), F.col("f")[1].alias("family"), F.col("f")[2].alias("qualifier"), F.col("f")[3].cast("long").alias("ts"), F.unhex(F.col("f")[4]).alias("value")
    )
