"""Integer codes and checksums of the file format, as Arrow functions over batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reflected Castagnoli polynomial and the bytes that one checksum covers.
CASTAGNOLI, CHUNK = 0x82F63B78, 16 * 1024


def varint(v: int) -> bytes:
    """Base 128, low groups first, of a number of 0 or more."""
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def writable_vint(v: int) -> bytes:
    """Hadoop's variable-length integer: itself if small, else a length byte and the bytes, high first."""
    if -112 <= v <= 127:
        return bytes([v & 255])
    mark, size = (-120, ~v) if v < 0 else (-112, v)
    body = size.to_bytes((size.bit_length() + 7) // 8 or 1, "big")
    return bytes([mark - len(body) & 255]) + body


def read_writable_vint(data: bytes) -> tuple[int, int]:
    """The number and how many bytes it takes."""
    first = data[0] - 256 if data[0] > 127 else data[0]
    if first >= -112:
        return first, 1
    n = -first - (120 if first < -120 else 112)
    v = int.from_bytes(data[1 : 1 + n], "big")
    return (~v if first < -120 else v), n + 1


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1).astype(np.uint32)
    return t


_TABLE = _table()


#: A chunk is run in pieces of so many bytes side by side.
_PIECE = 64


def _run(state: np.ndarray, rows: np.ndarray) -> np.ndarray:
    for k in range(rows.shape[1]):
        state = _TABLE[(state ^ rows[:, k]) & 255] ^ (state >> 8)
    return state


def _skip_tables() -> list[list[int]]:
    """What _PIECE zero bytes make of each byte of a state; the step is linear, so these add up by xor."""
    zero = np.zeros((256, _PIECE), np.uint8)
    return [_run(np.arange(256, dtype=np.uint32) << np.uint32(8 * j), zero).tolist() for j in range(4)]


_SKIP = _skip_tables()


def crc32c(data: bytes, chunk: int = CHUNK) -> list[int]:
    """A checksum for each chunk."""
    out: list[int] = []
    for at in range(0, len(data), chunk):
        part = np.frombuffer(data[at : at + chunk], np.uint8)
        head = len(part) % _PIECE
        state = int(_run(np.full(1, 0xFFFFFFFF, np.uint32), part[None, :head])[0])
        if len(part) > head:
            a, b, c, d = _SKIP
            for piece in _run(np.zeros(len(part) // _PIECE, np.uint32), part[head:].reshape(-1, _PIECE)).tolist():
                state = a[state & 255] ^ b[state >> 8 & 255] ^ c[state >> 16 & 255] ^ d[state >> 24] ^ piece
        out.append(state ^ 0xFFFFFFFF)
    return out


def writable_vint_bytes(v: Column) -> Column:
    """`writable_vint` in built-in expressions."""
    v = v.cast("long")
    digits = F.hex(F.when(v < 0, F.bitwise_not(v)).otherwise(v))
    n = F.ceil(F.length(digits) / 2).cast("int")
    long = F.concat(F.hex((F.when(v < 0, F.lit(136)).otherwise(F.lit(144)) - n).cast("long")), F.lpad(digits, n * 2, F.lit("0")))
    return F.unhex(F.when(v.between(-112, 127), F.lpad(F.hex(v.bitwiseAND(F.lit(255).cast("long"))), 2, "0")).otherwise(long))


def varint_bytes(v: Column) -> Column:
    """`varint` of numbers of 0 or more in built-in expressions."""
    v = v.cast("long")
    n = F.greatest(F.lit(1), F.ceil(F.length(F.bin(v)) / 7)).cast("int")
    seven = lambda i: F.call_function("shiftright", v, (i * 7).cast("int")).bitwiseAND(F.lit(127).cast("long"))
    byte = lambda i: F.lpad(F.hex(seven(i) + F.when(i < n - 1, F.lit(128)).otherwise(F.lit(0)).cast("long")), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), ""))


@F.pandas_udf(T.ArrayType(T.LongType()))
def checksums(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else crc32c(bytes(v)))
