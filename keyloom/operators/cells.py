"""Cells: order, validation and error policies, sanitising, sizes, binary form and file statistics.

A cell has row, family, qualifier, value, tags as text or binary, ts and memstore_ts as longs, type as a short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SortViolation
from ..functions.keycodes import big_endian
from .regions import bisected

#: Fixed values of the cell format.
TYPES = {"Put": 4, "Delete": 8, "DeleteColumn": 12, "DeleteFamily": 14, "Maximum": 255}
MAX_ROW, MAX_VALUE, MAX_ERRORS = 32 * 1024, 10 * 1024 * 1024, 1000


def cell_order() -> list[Column]:
    """Row, family and qualifier up, timestamp and type down."""
    return [F.col("row"), F.col("family"), F.col("qualifier"), F.col("ts").desc(), F.col("type").desc()]


def ordered_key() -> Column:
    """A struct that compares as cells are ordered."""
    return F.struct("row", "family", "qualifier", (-F.col("ts")).alias("ts"), (-F.col("type")).alias("type"))


def sort_violations(df: DataFrame, by: list[str], order: Column, key: Column | None = None, along: Column | None = None, ranges: int = 64) -> DataFrame:
    """Cells that are not above the one before them in `order`, within each group of `by` (a file).

    `along`, a number that never falls in `order` (its first part, say), splits large files: they are looked at in ranges of it, whose
    borders are an even draw of bounded size, and the first cell of a range is held against the last one before the range.
    """
    key = ordered_key() if key is None else key
    rows = df.withColumn("_key", key).withColumn("_order", order)
    part = F.lit(0)
    if along is not None:
        drawn = rows.select(along.alias("a")).filter("a is not null").distinct().orderBy(F.xxhash64("a"), "a").limit(ranges - 1).collect()
        part = F.when(along.isNull(), 0).otherwise(bisected(along, sorted(r["a"] for r in drawn)))
    rows = rows.withColumn("_part", part)
    within = Window.partitionBy(*by, "_part").orderBy("_order")
    seen = rows.withColumn("_before", F.lag("_key").over(within)).withColumn("_first", F.row_number().over(within) == 1).withColumn("_last", F.lead("_part").over(within).isNull())
    inner = seen.filter(~F.col("_first") & (F.col("_key") <= F.col("_before")))
    # of each range the first and the last cell: two rows, in the order of the file
    edges = seen.filter("_first or _last").withColumn("_before", F.lag("_key").over(Window.partitionBy(*by).orderBy("_order")))
    return inner.unionByName(edges.filter(F.col("_first") & (F.col("_key") <= F.col("_before")))).select(*df.columns)


def duplicate_cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """Full keys that occur more than once; an automatic sort refuses them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells")).filter("n_cells > 1")


def auto_sort(df: DataFrame) -> DataFrame:
    """Cells in order; refuses repeated full keys, which only the data can show, when the action runs."""
    n = F.count(F.lit(1)).over(Window.partitionBy("row", "family", "qualifier", "ts", "type"))
    ok = F.when(F.col("_same") == 1, True).otherwise(F.raise_error(F.lit(f"{SortViolation.__name__}: a cell key occurs twice")).cast("boolean"))
    return df.withColumn("_same", n).filter(ok).drop("_same").orderBy(*cell_order())


def _size(name: str) -> Column:
    return F.coalesce(F.octet_length(name), F.lit(0))


def error_reason(family: str | None = None, max_row: int = MAX_ROW, max_value: int = MAX_VALUE) -> Column:
    """The first reason that a cell is refused for, or null."""
    reason = (
        F.when(_size("row") == 0, "ROW_EMPTY").when(_size("row") > max_row, "ROW_TOO_LONG").when(_size("value") > max_value, "VALUE_TOO_LONG").when(F.col("ts") < 0, "NEGATIVE_TIMESTAMP")
    )
    return reason if family is None else reason.when(~F.col("family").eqNullSafe(F.lit(family)), "WRONG_FAMILY")


def validate(df: DataFrame, policy: str = "skip_row", max_errors: int = MAX_ERRORS, batch: str | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). `strict`: the first error ends the action; `skip_row`: errors are left out, more than `max_errors`
    (0: any number) end the action; `skip_batch`: batches with an error are left out whole."""
    judged = df.withColumn("error_reason", error_reason(**limits))
    rejected = judged.filter("error_reason is not null")
    fail = lambda text: F.raise_error(text).cast("boolean")
    if policy == "strict":
        return judged.filter(F.when(F.col("error_reason").isNull(), True).otherwise(fail(F.col("error_reason")))).drop("error_reason"), rejected
    if policy == "skip_batch":
        bad = rejected.select(batch).distinct()
        return judged.join(bad, batch, "left_anti").drop("error_reason"), rejected
    accepted = judged.filter("error_reason is null").drop("error_reason")
    if max_errors:
        count = rejected.agg(F.count(F.lit(1)).alias("_errors"))  # one row, and so broadcast
        accepted = accepted.crossJoin(F.broadcast(count)).filter(F.when(F.col("_errors") <= max_errors, True).otherwise(fail(F.lit(f"more than {max_errors} errors")))).drop("_errors")
    return accepted, rejected


def sanitise(df: DataFrame, include_tags: bool = True, include_mvcc: bool = False) -> DataFrame:
    """Without tags or versions where they aren't wanted; a version counts as there only above 0."""
    ts = F.col("memstore_ts") if include_mvcc else F.lit(0).cast("long")
    tags = F.col("tags") if include_tags else F.lit(b"").cast("binary")
    return df.withColumns({"tags": tags, "memstore_ts": ts}).withColumn("has_memstore_ts", F.col("memstore_ts") > 0)


def key_length() -> Column:
    return F.lit(12) + _size("row") + _size("family") + _size("qualifier")


def vint_size(x: Column) -> Column:
    """Bytes of the variable-length integer of Hadoop's writables."""
    x = F.when(x < 0, -(x + 1)).otherwise(x)
    more = F.greatest(F.lit(1), F.ceil(F.length(F.regexp_replace(F.hex(x), "^0+", "")) / 2))
    return more.cast("int") + 1


def writable_vint_size(x: Column) -> Column:
    return F.when(x.between(-112, 127), 1).otherwise(vint_size(x))


def varint_size(x: Column) -> Column:
    """Bytes of the base-128 integer of a number of 0 or more."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.regexp_replace(F.bin(x), "^0+", "")) / 7)).cast("int")


def encoded_size(tags: bool = False, mvcc: bool = False) -> Column:
    size = F.lit(8) + key_length() + _size("value") + 2
    size = size + _size("tags") if tags else size
    return size + F.when(F.col("memstore_ts") > 0, writable_vint_size(F.col("memstore_ts"))).otherwise(0) if mvcc else size


def _bytes(name: str) -> Column:
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def key_bytes() -> Column:
    return F.concat(
        big_endian(_size("row").cast("long"), 2), _bytes("row"), big_endian(_size("family").cast("long"), 1), _bytes("family"), _bytes("qualifier"), big_endian(F.col("ts"), 8), big_endian(F.col("type").cast("long"), 1)
    )


def cell_bytes() -> Column:
    """The cell without tags and version."""
    return F.concat(big_endian(key_length().cast("long"), 4), big_endian(_size("value").cast("long"), 4), key_bytes(), _bytes("value"), big_endian(F.lit(0).cast("long"), 2))


def biggest_cell_length() -> Column:
    return F.lit(12) + key_length() + _size("value")


def file_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Entries, mean key and value length, the biggest cell (the first by row among equals), first and last row."""
    big = F.struct(biggest_cell_length().alias("n"), F.col("row"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"),
        F.expr("sum(12 + octet_length(row) + octet_length(family) + octet_length(qualifier)) div count(1)").alias("avg_key_len"),
        F.expr("sum(octet_length(value)) div count(1)").alias("avg_value_len"),
        F.max(biggest_cell_length()).alias("biggest_len"),
        F.min_by("row", F.struct((-big["n"]).alias("n"), "row")).alias("biggest_row"),
        F.min("row").alias("first_row"),
        F.max("row").alias("last_row"),
    )
