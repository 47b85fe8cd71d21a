"""Conversion of a folder of files: one output per file, or one per batch of merged files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument, SchemaMismatch
from ..operators import batches
from ..sources import arrow_stream, cell_file, cells_io
from .convert import convert
from .options import ConvertOptions

#: What may be asked for.
STRATEGIES = ("auto", "merge-then-convert", "parallel-convert")


@dataclass(frozen=True)
class DirectoryOptions:
    form: str = "arrow"
    sink: str = "parquet"
    strategy: str = "parallel-convert"
    parallelism: int = 4
    skip_existing: bool = False
    policy: batches.Policy = batches.Policy()

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise InvalidArgument(f"strategy must be one of {', '.join(STRATEGIES)}")
        if self.sink not in ("parquet", "cells"):
            raise InvalidArgument("sink must be parquet or cells")
        if self.parallelism < 1:
            raise InvalidArgument("parallelism must be 1 or more")


def read(spark: SparkSession, form: str, *paths: str) -> tuple[DataFrame, tuple[str, ...]]:
    """The rows of these files and the columns that order them; none: their place in their files."""
    if form == "arrow":
        schemas = [arrow_stream.peek_schema(p) for p in paths]
        if any(s.names != schemas[0].names for s in schemas):
            raise SchemaMismatch(f"files beside {paths[0]} have other columns")
        return arrow_stream.read(spark, None, files=list(paths), position=True), ("_file", "_batch", "_row")
    frames = [spark.read.format(form).load(p) for p in paths]
    batches.check_schemas(frames)
    return spark.read.format(form).load(list(paths)), ()


def write(df: DataFrame, order: tuple[str, ...], output: str, options: ConvertOptions, sink: str) -> tuple[int, int]:
    """Convert and write; cells and bytes (0 where the sink doesn't count them)."""
    hidden = tuple(c for c in order if c not in options.excluded_columns)
    outcome = convert(df, replace(options, order=order, excluded_columns=options.excluded_columns + hidden))
    if sink == "cells":
        compression = "none" if options.compression.lower() == "none" else "gz"
        files = cell_file.write(outcome.cells, output, compression, options.compression_level, options.block_size, options.bloom_type.lower(), options.fsync_policy.lower()).collect()  # a row per file
        return sum(f["entries"] for f in files), sum(f["file_bytes"] for f in files)
    cells_io.write_cells(outcome.cells, output, "none" if options.compression.lower() == "none" else "gzip")
    return df.sparkSession.read.parquet(output).count(), 0


def _exists(path: str) -> bool:
    system, name = arrow_stream._filesystem(path)
    return system.get_file_info(name).type.name != "NotFound"


def convert_directory(spark: SparkSession, files: list[tuple[str, int, int]], output: str, options: ConvertOptions, how: DirectoryOptions = DirectoryOptions(), done: Callable[[dict], None] | None = None) -> DataFrame:
    """One row per output as in `batches.OUTCOME`, from (path, bytes, mtime_ms) of the inputs. Merged outputs are named after the table
    and a number; `auto` merges where files are small on average. Outputs that are there already are left out if asked."""
    listed = spark.createDataFrame(files, "path string, bytes long, mtime_ms long")
    strategy = how.strategy if how.strategy != "auto" else batches.strategy(listed, how.policy).first()["strategy"]
    output = output.rstrip("/")
    if strategy == "merge-then-convert":
        groups: dict[int, list[str]] = {}
        for r in sorted(batches.batch_ids(listed, how.policy).collect(), key=lambda r: r["path"]):  # a row per file
            groups.setdefault(r["batch"], []).append(r["path"])
        names = spark.createDataFrame([(k,) for k in groups], "k int").select("k", cells_io.merged_name(F.lit(options.table_name or "merged"), F.col("k")).alias("name")) if groups else None
        named = {r["k"]: r["name"] for r in names.collect()} if groups else {}
        inputs = {named[k]: paths for k, paths in groups.items()}
    else:
        inputs = {path.rsplit("/", 1)[-1].removesuffix(".arrow") + ".cells": [path] for path, *_ in sorted(files)}
    pairs = [(",".join(paths), f"{output}/{name}") for name, paths in inputs.items() if not (how.skip_existing and _exists(f"{output}/{name}"))]

    def one(paths: str, target: str) -> tuple[int, int]:
        if _exists(target):
            raise InvalidArgument(f"{target} exists")
        return write(*read(spark, how.form, *paths.split(",")), target, options, how.sink)

    return batches.convert_each(spark, pairs, one, how.parallelism, done)


def list_inputs(folder: str, suffix: str = ".arrow") -> list[tuple[str, int, int]]:
    """(path, bytes, mtime_ms) of the files of a folder."""
    found = []
    for path in arrow_stream.list_files(folder, suffix=suffix):
        system, name = arrow_stream._filesystem(path)
        info = system.get_file_info(name)
        found.append((path, info.size, (info.mtime_ns or 0) // 1_000_000))
    return found

