"""Padding, reversal and number encodings of row keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import base64_text

_INTEGER = "^-?[0-9]+$"


def pad(x: Column, length: int, fill: str = "0", right: bool = False) -> Column:
    """Fill up to `length` bytes; longer values stay whole."""
    more = F.repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.octet_length(x)))
    return F.concat(x, more) if right else F.concat(more, x)


@F.pandas_udf(T.BinaryType())
def _reverse_bytes(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else v.encode("utf-8")[::-1])


def reverse(x: Column) -> Column:
    """Reverse by characters; keys that hold other than ASCII are refused, as their bytes reversed are no text."""
    ascii_only = F.octet_length(x) == F.length(x)
    return F.when(ascii_only, F.reverse(x)).otherwise(F.raise_error(F.lit("only ASCII text can be reversed; reverse_bytes gives binary")).cast("string"))


def reverse_bytes(x: Column) -> Column:
    """Any text's bytes in reverse order, as binary."""
    return _reverse_bytes(x)


def parsed(x: Column, what: str) -> Column:
    """A 64-bit integer from plain digits with an optional minus; anything else is an error."""
    return _checked(x.rlike(_INTEGER), x.try_cast("long"), x, what)


def _checked(ok: Column, value: Column, x: Column, what: str) -> Column:
    return F.when(ok & value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: not a fitting number: "), F.coalesce(x, F.lit("null")))).cast("long"))


def hashed(x: Column) -> Column:
    """961 + 31 * high half + low 33 bits, its remainder by 65535 (sign of the dividend) as a 16-bit integer."""
    r = (F.lit(961) + F.shiftright(x, 32) * 31 + x.bitwiseAND(F.lit(8589934591))) % 65535
    return F.pmod(r + 32768, F.lit(65536)) - 32768


def big_endian(x: Column, size: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(2 * size)))


def long_code(x: Column) -> Column:
    return base64_text(big_endian(x, 8))


def short_code(x: Column, text: Column) -> Column:
    return base64_text(big_endian(_checked(x.between(-32768, 32767), x, text, "short()"), 2))


def random_digits(n: int, seed: int | None = None) -> Column:
    """n digits of 0 to 8. Write the result out before it is used twice: another attempt of a task draws others without a seed."""
    draws = [F.floor(F.rand(None if seed is None else seed + i) * 9).cast("string") for i in range(n)]
    return F.concat(*draws) if draws else F.lit("")
