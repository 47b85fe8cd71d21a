"""Merging inputs, and batches of files."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaMismatch, code_of


def check_schemas(frames: list[DataFrame]) -> None:
    """Same names, types and order; whether columns may be null doesn't matter."""
    first = [(f.name, f.dataType) for f in frames[0].schema]
    for k, df in enumerate(frames[1:], 1):
        if [(f.name, f.dataType) for f in df.schema] != first:
            raise SchemaMismatch(f"input {k} has another schema")


def merge(frames: list[DataFrame], ordinal: str = "source_ordinal") -> DataFrame:
    """One after the other, with the place of the input as a column: rows have no other order."""
    check_schemas(frames)
    return functools.reduce(DataFrame.union, [df.withColumn(ordinal, F.lit(k)) for k, df in enumerate(frames)])


@dataclass(frozen=True)
class Policy:
    """Below the threshold files are merged; a batch is closed by size, count or age."""

    merge_threshold: int = 100 << 20
    size: int = 512 << 20
    count: int = 500
    interval_ms: int = 180_000


def strategy(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Total and mean size, and what they lead to; no files: nothing to merge."""
    mean = F.expr("coalesce(sum(bytes) div count(1), 0)")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), mean.alias("mean_bytes"), F.when(mean < policy.merge_threshold, "merge-then-convert").otherwise("parallel-convert").alias("strategy"))


def batch_ids(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Greedy batches over files in name order (path, bytes, mtime_ms).

    The fold needs every file before it, so the listing, which is metadata, runs through one task in order; a handful of numbers is kept.
    """

    def run(batches):
        number, size, n, since = 0, 0, 0, None
        for batch in batches:
            out = []
            for path, held, mtime in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if n and (size + held >= policy.size or n >= policy.count or mtime - since >= policy.interval_ms):
                    number, size, n, since = number + 1, 0, 0, None
                size, n, since = size + held, n + 1, mtime if since is None else since
                out.append((path, number))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["path", "batch"])

    order = ["path", "bytes", "mtime_ms"]
    listed = files.select("path", F.col("bytes").cast("long").alias("bytes"), F.col("mtime_ms").cast("long").alias("mtime_ms"))
    return listed.coalesce(1).sortWithinPartitions(*order).mapInArrow(run, "path string, batch long")


#: One row per input of a batch.
OUTCOME = "path string, output string, error_code int, error string, cells long, bytes long"


def convert_each(spark: SparkSession, inputs: list[tuple[str, str]], convert_one: Callable[[str, str], tuple[int, int]], parallelism: int = 4, done: Callable[[dict], None] | None = None) -> DataFrame:
    """Convert (path, output) pairs, `parallelism` at a time, each by Spark jobs of its own; one row per pair as in OUTCOME.

    `convert_one` gives cells and bytes. An input that fails keeps its error and its code, and the others go on. `done` hears of each
    outcome as it is known. The driver holds a row per file, as a listing does.
    """

    def run(pair: tuple[str, str]) -> dict:
        path, output = pair
        try:
            cells, size = convert_one(path, output)
            found = {"path": path, "output": output, "error_code": 0, "error": None, "cells": cells, "bytes": size}
        except Exception as e:  # whatever it is, it is this input's outcome
            found = {"path": path, "output": output, "error_code": code_of(e), "error": f"{type(e).__name__}: {e}"[:500], "cells": 0, "bytes": 0}
        if done:
            done(found)
        return found

    if parallelism < 1:
        raise ValueError("parallelism must be 1 or more")
    with ThreadPoolExecutor(min(parallelism, max(1, len(inputs)))) as pool:
        outcomes = list(pool.map(run, inputs))
    return spark.createDataFrame([tuple(x.values()) for x in outcomes], OUTCOME)
