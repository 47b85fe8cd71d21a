"""The conversion: project, derive keys, drop empty ones, keep the first row of each key, serialise, sort by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions.text import row_value
from ..operators.cells import validate
from ..operators.dedup import first_wins
from . import rules
from .options import ConvertOptions

PUT = 4


def visible(df: DataFrame, excluded=(), prefixes=()) -> list[tuple[str, T.DataType]]:
    """Columns that stay, with their types; names and prefixes are case-sensitive and an empty prefix excludes nothing."""
    prefixes = tuple(p for p in prefixes if p)
    return [(f.name, f.dataType) for f in df.schema if f.name not in excluded and not (prefixes and f.name.startswith(prefixes))]


@dataclass(frozen=True)
class Outcome:
    cells: DataFrame
    counters: DataFrame
    rejected: DataFrame

    def json(self) -> DataFrame:
        """The counters as one JSON text."""
        return self.counters.select(F.to_json(F.struct("*")).alias("result"))


def keyed(df: DataFrame, options: ConvertOptions) -> tuple[DataFrame, list[tuple[str, T.DataType]]]:
    """`df` with the columns `_key` and `_order`, and the visible columns. Without `order` columns, file and row position decide."""
    if not options.rule:
        raise InvalidArgument("the key rule is empty")
    columns = visible(df, options.excluded_columns, options.excluded_column_prefixes)
    if not columns:
        raise InvalidArgument("no column is left")
    segments = rules.parse(options.rule)
    order = F.struct(*options.order) if options.order else F.struct("_metadata.file_path", "_metadata.file_block_start", "_metadata.row_index")
    key = rules.expression(segments, columns, options.seed, options.null_keys)
    return df.select(key.alias("_key"), order.alias("_order"), *[F.col(f"`{n}`") for n, _ in columns]), columns


def fast_path_guard(df: DataFrame, options: ConvertOptions) -> Column:
    """With the numeric path demanded, a negative or too wide leading number is an error; true where it may be used."""
    columns = visible(df, options.excluded_columns, options.excluded_column_prefixes)
    s = rules.parse(options.rule)[0]
    numeric = s.reads_column and s.index < len(columns) and isinstance(columns[s.index][1], (T.IntegralType, T.BooleanType, T.TimestampType, T.TimestampNTZType))
    if not (numeric and s.kind == "column" and not s.reverse and not s.right and s.fill == "0" and s.length > 0):
        if options.numeric_sort_fast_path.lower() == "on":
            raise InvalidArgument("the rule does not begin with a zero-padded number")
        return F.lit(False)
    number = rules.text_of(F.col(f"`{columns[s.index][0]}`"), columns[s.index][1]).cast("decimal(38,0)")
    return number.isNull() | ((number >= 0) & (number < F.lit(10 ** min(s.length, 37)).cast("decimal(38,0)")))


def convert(df: DataFrame, options: ConvertOptions) -> Outcome:
    """Sorted cells (row, family, qualifier, ts, type, value) and one row of counters.

    One shuffle groups the keys, after a partial aggregation on the map side; the range sort moves only the rows that are left. Cells that
    are not valid go by `error_policy`: the batches of `skip_batch` are source files, or the values of the first order column.
    """
    if options.numeric_sort_fast_path.lower() == "on":
        ok = fast_path_guard(df, options)
        df = df.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("a leading number is negative or too wide")).cast("boolean")))
    rows, columns = keyed(df, options)
    value = row_value(columns)
    ts = F.lit(options.default_timestamp_ms).cast("long") if options.default_timestamp_ms > 0 else F.unix_millis(F.current_timestamp())
    policy = options.error_policy.lower()
    place = F.col("_order")[options.order[0] if options.order else "file_path"]
    batch = [place.alias("_batch")] if policy == "skip_batch" else []
    slim = rows.select("_key", "_order", value.alias("_value"), *batch)
    kept = first_wins(slim.filter(F.length("_key") > 0), ["_key"], "_order")
    cells = kept.select(
        F.col("_key").alias("row"), F.lit(options.column_family).alias("family"), F.lit("").alias("qualifier"), ts.alias("ts"), F.lit(PUT).cast("short").alias("type"), F.col("_value").alias("value"), *(["_batch"] if batch else [])
    )
    accepted, rejected = validate(cells, policy, options.max_errors, "_batch")
    return Outcome(accepted.drop("_batch").orderBy("row"), counters(slim), rejected.drop("_batch"))


def counters(rows: DataFrame) -> DataFrame:
    """rows_read = written + skipped; keys are counted by group, so no pass over collected keys is needed."""
    per_key = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    real = F.length("_key") > 0
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"),
        F.count_if(real).alias("written"),
        F.coalesce(F.sum(F.when(real, F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("skipped"),
        F.count_if(real & (F.col("n") > 1)).alias("duplicate_keys"),
    )
