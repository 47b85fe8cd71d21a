"""Text forms of typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From here on a double's last bit is worth 2^-23 or more, so its fraction is a whole number of them.
_LARGE = float(2**29)


def float_text(x: Column) -> Column:
    """Six decimals, rounded half to even on the exact binary value, as C's %.6f; `nan` and `inf` in lower case.

    Exact below 2^63; beyond, the digits of the shortest decimal that reads back as the value.
    """
    x = x.cast("double")
    size = F.abs(x)
    whole = F.floor(size).cast("long")
    parts = F.round((size - F.floor(size)) * F.lit(float(2**23))).cast("long") * 1_000_000
    low, rest = F.shiftright(parts, 23), parts.bitwiseAND(F.lit(2**23 - 1))
    half = F.lit(2**22)
    up = (rest > half) | ((rest == half) & (low % 2 == 1))
    micro = low + up.cast("long")
    digits = F.concat((whole + F.when(micro == 1_000_000, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((micro % 1_000_000).cast("string"), 6, "0"))
    sign = F.when(x < 0, "-").otherwise("")
    return (
        F.when(F.isnan(x), "nan")
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(size < _LARGE, F.call_function("format_number", x, F.lit("0.000000")))
        .when(size < float(2**63), F.concat(sign, digits))
        .otherwise(F.call_function("format_number", x, F.lit("0.000000")))
    )


def _epoch_micros(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x)
    return F.unix_micros(x)


def millis_text(x: Column, kind: T.DataType) -> Column:
    """Milliseconds since 1970, cut toward zero."""
    micros = _epoch_micros(x, kind)
    return F.when(micros >= 0, F.floor(micros / 1000)).otherwise(F.ceil(micros / 1000)).cast("long").cast("string")


def bool_text(x: Column) -> Column:
    return F.when(x, "1").when(~x, "0")


def base64_text(x: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(x), "\r\n", "")


#: Types whose text may be part of a key.
KEY_TYPES = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.TimestampType, T.TimestampNTZType)


def may_be_key(kind: T.DataType) -> bool:
    return isinstance(kind, KEY_TYPES) or isinstance(kind, T.DecimalType) and kind.scale == 0  # unsigned 64-bit integers


def text_of(x: Column, kind: T.DataType) -> Column:
    """The text of a value; null stays null."""
    if isinstance(kind, T.StringType):
        return x
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float_text(x)
    if isinstance(kind, T.BooleanType):
        return bool_text(x)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return millis_text(x, kind)
    if isinstance(kind, T.BinaryType):
        return base64_text(x)
    if isinstance(kind, T.DateType):
        return F.date_format(x, "yyyy-MM-dd")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(x)  # best effort: nested types have no fixed text
    return x.cast("string")


def row_value(columns: list[tuple[str, T.DataType]], delimiter: str = "|") -> Column:
    """All columns in order, joined; null is empty and nothing is escaped."""
    return F.concat_ws(delimiter, *[F.coalesce(text_of(F.col(f"`{name}`"), kind), F.lit("")) for name, kind in columns])


def split_row_value(value: Column, limit: int = -1) -> Column:
    """The fields of a row value; empty ones stay, and the last of `limit` has the rest."""
    return F.split(value, r"\|", limit)
