"""Rendezvous hashing of stable record keys over weighted shards, with built-in expressions only.

Every shard draws a number from the key and its own name; the smallest wins. Shard count + 1 adds one draw, so a row
stays where it is or goes to the new shard. Law: `key`.

Defined results: a null text has no bytes (size 1, crc 0); a null doc_id is a key of its own; rows that agree in
doc_id, size and crc are interchangeable and get neighbouring slots; extra columns are dropped by `place`; an empty table has no rows. Of
a very long text only its size and checksum go on. Equal draws of two shards go to the lower one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

#: A record that one input partition repeats more often than this is dealt to a range of its own.
CHUNK = 100_000


def _draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of MD5 over key and shard."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of `key`; ties go to the lower shard."""
    draws = [F.struct(_draw(key, s, w).alias("d"), F.lit(s).alias("s")) for s, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*draws))["s"]


def place(docs: DataFrame, n_shards: int = 8, weights: list[float] | None = None, grown_weight: float = 1.0, buckets: int = 4096) -> DataFrame:
    """Shard, slot in the shard (gapless from 0) and the shard under one more shard, for every row.

    Equal records of one input partition are counted before the shuffle, so no count passes a partition's rows. Slots: records
    are dealt to `buckets` ranges per shard, whose sums are at most shards x buckets rows and give each range its first slot.
    """
    weights = list(weights or [1.0] * n_shards)
    text = whole_text()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_p", F.spark_partition_id()).groupBy("doc_id", "size", "text_crc32", "_p").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.col("_n") > CHUNK, F.col("_p"))  # null, and so left out, but for such records
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", key, "size", "text_crc32", own).cast("binary")), 20, 8), 16, 10).cast("long") % buckets
    rows = rows.select("*", rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, grown_weight]).alias("grown_shard"), bucket.alias("_b"))

    by_shard = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("shard", "_b").agg(F.sum("_n").alias("_s"))
    firsts = sums.select("shard", "_b", F.coalesce(F.sum("_s").over(by_shard), F.lit(0)).alias("_first"))
    in_bucket = Window.partitionBy("shard", "_b").orderBy("doc_id", "size", "text_crc32", "_p").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum("_n").over(in_bucket), F.lit(0)))
    placed = placed.join(F.broadcast(firsts), ["shard", "_b"])  # shards x buckets rows

    placed = placed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_at") + F.col("_k")).alias("slot"), "grown_shard")


#: DuckDB SQL for `place` with eight equal shards, where no record is repeated more than CHUNK times. A checksum is folded over a text's
#: bytes with its table of 256 remainders; the least of -ln(u) is the largest draw.
ORACLE = """
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT doc_id, k, octet_length(b) + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda e: ('0x' || e)::BIGINT)), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) AS crc FROM d, t),
e AS (SELECT doc_id, size, crc, ('0x' || substr(md5(k || ':' || size || ':' || crc), 20, 8))::BIGINT % 4096 AS bucket, list_transform(range(9), lambda s: ('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT) AS u FROM c),
p AS (SELECT *, list_position(u[:8], list_max(u[:8])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown FROM e)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, crc) - 1 AS slot, grown::INT AS grown_shard
FROM p
"""
