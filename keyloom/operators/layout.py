"""Blocks, index levels, Bloom filters and separators of sorted cell files."""

from __future__ import annotations

import bisect
import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the file format.
BLOCK_SIZE, LEAF_TARGET, LEAF_HEADER, LEAF_ENTRY = 64 * 1024, 128 * 1024, 8, 16
INDEX_FAN_OUT, MIDDLE_HEADER = 128, 33
CHUNK_BYTES, ERROR_RATE, MAX_FOLD = 128 * 1024, 0.01, 7
MURMUR_M, MURMUR_R = 0x5BD1E995, 24
REQUIRED_META = (
    "hfile.LASTKEY", "hfile.AVG_KEY_LEN", "hfile.AVG_VALUE_LEN", "hfile.CREATE_TIME_TS", "hfile.KEY_OF_BIGGEST_CELL", "hfile.LEN_OF_BIGGEST_CELL", "DELETE_FAMILY_COUNT", "HISTORICAL",
)
#: With the first, the second is required too.
TAG_META = ("hfile.MAX_TAGS_LEN", "hfile.TAGS_COMPRESSED")
COMPARATORS = {
    "org.apache.hadoop.hbase.CellComparatorImpl": "org.apache.hadoop.hbase.KeyValue$KVComparator",
    "org.apache.hadoop.hbase.InnerStoreCellComparator": "org.apache.hadoop.hbase.KeyValue$KVComparator",
    "org.apache.hadoop.hbase.MetaCellComparator": "org.apache.hadoop.hbase.KeyValue$MetaComparator",
}


def fold(df: DataFrame, by: list[str], order: list[str], size: str, target: int, name: str, header: int = 0, after: bool = False) -> DataFrame:
    """Number the groups that a greedy fold makes of rows in order: a new group starts once the one before has `target` bytes.

    The state runs through a file from row to row, so each file (`by`) is one sorted stream; files run in parallel, and only
    one number is kept. `header`: bytes a group has from the start.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        last, group, held = None, 0, header
        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in by))) if by else [()] * batch.num_rows
            groups = []
            for key, n in zip(keys, batch.column(batch.schema.get_field_index(size)).to_pylist()):
                if key != last:
                    last, group, held = key, 0, header
                elif held >= target:
                    group, held = group + 1, header
                held += n
                groups.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.int64())], [*batch.schema.names, name])

    spread = df.repartition(*by) if by else df.coalesce(1)
    return spread.sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def assign_blocks(cells: DataFrame, by: list[str], order: list[str], size: str, block_size: int = BLOCK_SIZE) -> DataFrame:
    return fold(cells, by, order, size, block_size, "block")


def block_stats(blocks: DataFrame, by: list[str], key: str, size: str) -> DataFrame:
    return blocks.groupBy(*by, "block").agg(F.count(F.lit(1)).alias("entries"), F.sum(size).alias("raw_bytes"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def leaf_index(stats: DataFrame, by: list[str], target: int = LEAF_TARGET) -> DataFrame:
    """Leaf blocks of the index, with their entries and first key; a file with one leaf has one level, else two."""
    entries = stats.withColumn("_bytes", F.octet_length("first_key") + LEAF_ENTRY)
    leaves = fold(entries, by, ["block"], "_bytes", target, "leaf", header=LEAF_HEADER)
    return leaves.groupBy(*by, "leaf").agg(F.count(F.lit(1)).alias("entries"), F.min("first_key").alias("first_key"))


def middle_index(stats: DataFrame, by: list[str], fan_out: int = INDEX_FAN_OUT) -> DataFrame:
    """Groups of `fan_out` blocks in order, with their first key."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy("block")) - 1
    return stats.withColumn("node", F.floor(at / fan_out).cast("long")).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("entries"), F.min("first_key").alias("first_key"))


def bloom_sizing(keys: Column, error: float = ERROR_RATE, chunk_bytes: int = CHUNK_BYTES) -> Column:
    """Hash count, most keys of a chunk, chunks and bytes of the last chunk after folding, for `keys` distinct keys."""
    byte_size = -(-chunk_bytes // (1 << MAX_FOLD)) * (1 << MAX_FOLD)
    bits = byte_size * 8
    ideal = int(bits * (math.log(2) ** 2 / -math.log(error)))
    hashes = max(1, math.ceil(math.log(2) * (bits // max(1, ideal))))
    most = int(-bits / hashes * math.log(1 - math.exp(math.log(error) / hashes)))
    chunks = F.ceil(keys / most).cast("long")
    last = keys - (chunks - 1) * most
    halves = F.lit(0)
    for k in range(1, byte_size.bit_length()):  # folding by half while twice the keys still fit
        if byte_size % (1 << k) == 0 and most >> k:
            halves = F.when(F.lit(most >> (k - 1)) > last * 2, k).otherwise(halves)
    return F.struct(F.lit(hashes).alias("hash_count"), F.lit(most).cast("long").alias("max_keys"), chunks.alias("chunks"), F.lit(byte_size).cast("long").alias("chunk_bytes"), F.call_function("shiftright", F.lit(byte_size).cast("long"), halves).alias("last_chunk_bytes"))


def murmur(data: bytes, seed: int = 0) -> int:
    """MurmurHash2 on 32 bits with sign-extended tail bytes, as a signed integer."""
    h, full = (seed ^ len(data)) & 0xFFFFFFFF, len(data) & ~3
    for k in np.frombuffer(data[:full], "<u4").tolist():
        k = k * MURMUR_M & 0xFFFFFFFF
        k = (k ^ k >> MURMUR_R) * MURMUR_M & 0xFFFFFFFF
        h = (h * MURMUR_M & 0xFFFFFFFF) ^ k
    if tail := np.frombuffer(data[full:], np.int8).tolist():
        for place, byte in enumerate(tail):
            h ^= byte << 8 * place & 0xFFFFFFFF
        h = h * MURMUR_M & 0xFFFFFFFF
    h = (h ^ h >> 13) * MURMUR_M & 0xFFFFFFFF
    h ^= h >> 15
    return h - (1 << 32) if h >> 31 else h


def murmur_all(keys: list[bytes], seeds: np.ndarray | int = 0) -> np.ndarray:
    """`murmur` of many keys (signed), those of one length at a time with array operations."""
    seeds = np.broadcast_to(np.asarray(seeds, np.int64) & 0xFFFFFFFF, len(keys)).astype(np.uint32)
    sizes, out, m = np.array([len(k) for k in keys], np.int64), np.zeros(len(keys), np.uint32), np.uint32(MURMUR_M)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        data = np.frombuffer(b"".join([keys[i] for i in at]), np.uint8).reshape(len(at), size)
        h, full = seeds[at] ^ np.uint32(size), int(size) & ~3
        for k in np.ascontiguousarray(data[:, :full]).view("<u4").T:
            k = k * m
            h = h * m ^ (k ^ k >> np.uint32(MURMUR_R)) * m
        if size > full:
            for place, byte in enumerate(data[:, full:].view(np.int8).T):
                h ^= byte.astype(np.int32).view(np.uint32) << np.uint32(8 * place)
            h *= m
        h = (h ^ h >> np.uint32(13)) * m
        out[at] = h ^ h >> np.uint32(15)
    return out.view(np.int32)


def _bytes(values: list) -> list[bytes]:
    return [b"" if v is None else bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else v.encode("utf-8", "surrogatepass") for v in values]


@F.pandas_udf(T.IntegerType())
def murmur_hash(x: pd.Series) -> pd.Series:
    return pd.Series(murmur_all(_bytes(x.tolist())), dtype="Int32").mask(x.isna().to_numpy())


def bloom_positions(keys: list[bytes], hashes: int, bits: int) -> np.ndarray:
    """(keys, hashes) places in a filter of `bits`."""
    first = murmur_all(keys)
    second = murmur_all(keys, first)
    mixed = first[:, None].view(np.uint32) + np.arange(hashes, dtype=np.uint32) * second[:, None].view(np.uint32)
    return np.abs(mixed.view(np.int32).astype(np.int64)) % bits


def bloom_bits(data: bytes, hashes: int, bits: int) -> list[int]:
    return bloom_positions([data], hashes, bits)[0].tolist()


def bloom_chunks(keys: DataFrame, by: list[str], key: str, most: int, hashes: int, byte_size: int) -> DataFrame:
    """Filters over distinct keys in order: chunk, keys, first key and bits of each; a chunk ends at `most` keys."""
    schema = T.StructType([*[f for f in keys.schema.fields if f.name in by], *T.StructType.fromDDL("chunk long, n_keys long, first_key binary, bits binary").fields])
    kinds = {}

    def run(batches):
        state = None

        def done():
            return (*state["by"], state["chunk"], state["n"], state["first"], state["bits"].tobytes())

        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(k)) for k in (*by, key)]
            kinds.update({k: v.type for k, v in zip(by, columns)})
            files, data = list(zip(*(c.to_pylist() for c in columns[:-1]))) if by else [()] * batch.num_rows, _bytes(columns[-1].to_pylist())
            places = bloom_positions(data, hashes, byte_size * 8)
            at = 0
            while at < len(data):
                if state is None or state["by"] != files[at] or state["n"] >= most:
                    if state:
                        out.append(done())
                    state = {"by": files[at], "chunk": state["chunk"] + 1 if state and state["by"] == files[at] else 0, "n": 0, "first": data[at], "bits": np.zeros(byte_size, np.uint8)}
                room = range(at, min(len(data), at + most - state["n"]))
                end = at + bisect.bisect_left(room, True, key=lambda i, file=files[at]: files[i] != file)  # files come one after another
                spots = places[at:end].ravel()
                np.bitwise_or.at(state["bits"], spots >> 3, (1 << (spots & 7)).astype(np.uint8))
                state["n"], at = state["n"] + end - at, end
            if out:
                yield _rows(out)
        if state:
            yield _rows([done()])

    def _rows(rows):
        types = [*[kinds[k] for k in by], pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], schema.names)

    distinct = keys.select(*by, key).distinct()
    return distinct.repartition(*by).sortWithinPartitions(*by, key).mapInArrow(run, schema)


@F.pandas_udf(T.StructType([T.StructField("n_bits", T.LongType()), T.StructField("sum_of_places", T.LongType())]))
def bloom_marks(bits: pd.Series) -> pd.DataFrame:
    """How many bits each filter has, and the sum of their places."""
    places = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) for b in bits]
    return pd.DataFrame({"n_bits": [len(p) for p in places], "sum_of_places": [int(p.sum()) for p in places]})


def might_contain(bits: bytes, data: bytes, hashes: int) -> bool:
    return all(bits[b >> 3] >> (b & 7) & 1 for b in bloom_bits(data, hashes, len(bits) * 8))


def filter_probe(wanted: DataFrame, chunks: DataFrame, key: str, hashes: int, name: str = "may_contain") -> DataFrame:
    """`wanted` with whether its file's filter may hold the key. `chunks` are `bloom_chunks` of the columns that both tables share; a key
    is asked of the chunk with the last first key that is not above it, and keys below every chunk are not there."""
    by = [c for c in chunks.columns if c in wanted.columns and c not in ("chunk", "n_keys", "first_key", "bits", key)]
    asked = wanted.withColumn("_key", F.col(key).cast("binary"))
    # chunk borders of a file are a sorted array of at most keys / `most` entries; the bits are joined by chunk afterwards
    borders = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("first_key", "chunk"))).alias("_borders"))
    at = F.expr("filter(_borders, b -> b.first_key <= _key)")
    asked = asked.join(borders, by, "left").withColumn("chunk", F.try_element_at(at, F.lit(-1))["chunk"]).drop("_borders")
    met = asked.join(chunks.select(*by, "chunk", "bits"), [*by, "chunk"], "left")

    @F.pandas_udf(T.BooleanType())
    def probe(data: pd.Series, bits: pd.Series) -> pd.Series:
        keys, out = _bytes(data.tolist()), np.zeros(len(data), bool)
        sizes = np.array([-1 if b is None else len(b) for b in bits])
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            places = bloom_positions([keys[i] for i in rows], hashes, int(size) * 8)
            filters = [np.frombuffer(bits.iloc[i], np.uint8) for i in rows]
            out[rows] = [bool((f[p >> 3] >> (p & 7) & 1).all()) for f, p in zip(filters, places)]
        return pd.Series(out)

    return met.select(*wanted.columns, probe("_key", "bits").alias(name))


#: What follows row and qualifier in the key of a filter over both: no family, the latest time and the highest type. Fixed values.
ROWCOL_END = b"\x7f" + b"\xff" * 8


def rowcol_key(row: bytes, qualifier: bytes) -> bytes:
    """The logical key by which a filter over rows and qualifiers is filled and asked: of the latest cell there, without a family."""
    return struct.pack(">H", len(row)) + row + b"\0" + qualifier + ROWCOL_END


def rowcol_column(row: Column, qualifier: Column) -> Column:
    """`rowcol_key` in built-in expressions."""
    size = F.octet_length(row)
    return F.concat(F.unhex(F.lpad(F.hex(size), 4, "0")), row.cast("binary"), F.unhex(F.lit("00")), qualifier.cast("binary"), F.unhex(F.lit(ROWCOL_END.hex())))


def bloom_keys(cells: DataFrame, kind: str) -> DataFrame:
    """What a filter gets: each row once, the logical key of every cell's row and qualifier, or nothing."""
    if kind == "row":
        return cells.select("row").distinct()
    if kind == "rowcol":
        return cells.select(rowcol_column(F.col("row"), F.col("qualifier")).alias("row"))
    return cells.select("row").limit(0)


def separator(left: bytes | None, right: bytes) -> bytes | None:
    """A short key above `left` and not above `right`; None where they are equal."""
    if left is None:
        return right
    if left > right:
        raise ValueError("keys are out of order")
    same = next((i for i, (a, b) in enumerate(zip(left, right)) if a != b), min(len(left), len(right)))
    if same < len(left):
        return left[:same] + bytes([left[same] + 1])
    return right[:same] + b"\x00" if same < len(right) else None


def text_separator(left: str | None, right: str) -> str:
    """`separator` of texts, whose characters are in the order of their bytes; equal keys and a first key give the right one."""
    if left is None or left == right:
        return right
    if left > right:
        raise ValueError("keys are out of order")
    same = next((i for i, (a, b) in enumerate(zip(left, right)) if a != b), min(len(left), len(right)))
    if same == len(left):
        return right[:same] + "\0"
    above = ord(left[same]) + 1
    return left[:same] + chr(0xE000 if above == 0xD800 else above)


@F.pandas_udf(T.StringType())
def separator_text(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([text_separator(a, b) for a, b in zip(left, right)], dtype=object)


def block_separators(stats: DataFrame, by: list[str]) -> DataFrame:
    """The index key of each block: a separator between the block before and its first key."""
    before = F.lag("last_key").over(Window.partitionBy(*by).orderBy("block"))
    return stats.withColumn("index_key", separator_text(before, F.col("first_key")))


def layout_summary(parts: DataFrame, by: list[str]) -> DataFrame:
    """Bytes and blocks by category, and whether they account for all of the file."""
    category = F.upper("category")
    known = ("DATA", "INDEX", "BLOOM", "META", "FILE_INFO", "TRAILER")
    other = ~category.isin(*known)
    sums = [F.coalesce(F.sum(F.when(category == c, F.col("bytes"))), F.lit(0)).alias(f"{c.lower()}_bytes") for c in known]
    counts = [F.count_if(category == c).alias(f"{c.lower()}_blocks") for c in known[:-1]]
    out = parts.groupBy(*by).agg(*sums, *counts, F.coalesce(F.sum(F.when(other, F.col("bytes"))), F.lit(0)).alias("other_bytes"), F.sum("bytes").alias("accounted_bytes"), F.max("file_bytes").alias("file_bytes"))
    return out.withColumn("complete", (F.col("accounted_bytes") == F.col("file_bytes")) & (F.col("file_info_blocks") == 1) & (F.col("other_bytes") == 0))


def meta_map(entries: DataFrame, by: list[str]) -> DataFrame:
    """A file's metadata as a map in key order."""
    return entries.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("meta"))


def comparator(name: Column) -> Column:
    """The older name of a comparator."""
    out = name
    for new, old in COMPARATORS.items():
        out = F.when(name == new, old).otherwise(out)
    return out
