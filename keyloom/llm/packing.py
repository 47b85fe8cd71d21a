"""Power-of-two packing: every document is cut into pieces of 2^k tokens (at most the sequence length), and pieces of one
length form a bucket of ready sequences. No sequence crosses documents and none is padded, as each length is a power of two.

Pieces are dealt out by ranges of (bucket, doc_id, start): the sequences of one length are numbered one after another and lie together,
and `write` puts each bucket in a folder of its own. A sequence's number is its rank in that order, so it does not depend on how the
documents were partitioned; pieces that agree in all columns share their ranks in any order.

Defined results: a null or empty text is its end id alone (one piece of length 1); repeated rows are each packed; a null
doc_id is carried along, in front; extra columns are dropped; an empty table has no sequences. A very long text is encoded whole, in one
task, and gives as many pieces as it needs. Strings of the vocabulary's special tokens get their ids, as its tokenizer does it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"
END_ID = 1
#: Bits of monotonically increasing ids that count within a partition, a fixed value of Spark's.
WITHIN = 33


def cuts(n: int, most: int) -> list[int]:
    """Whole pieces of `most`, then the binary digits of the rest, largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, most: int = 2048, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """One row per piece, not numbered yet; `bucket` is log2 of the length. `with_ids` adds the ids themselves."""
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length must be a power of two")

    def run(batches):
        encode = encoder(vocabulary, special=True)
        for batch in batches:
            out = [[] for _ in range(6 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                at = 0
                for n in cuts(len(ids), most):
                    piece = ids[at : at + n]
                    for column, v in zip(out, (doc_id, at, n, zlib.crc32(piece.tobytes()), len(ids), n.bit_length() - 1)):
                        column.append(v)
                    if with_ids:
                        out[6].append(piece.astype("int32"))
                    at += n
            kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names[: len(out)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, most: int = 2048, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """One row per piece, each a sequence of its own (offset 0), numbered bucket by bucket."""
    found = materialise(pieces(docs, most, vocabulary, with_ids), "cut")  # drawing ranges reads it once more, which must not encode again
    found = found.withColumn("tie", F.monotonically_increasing_id())  # parts a piece that is repeated often
    order = ["bucket", "doc_id", "start", "ids_crc32", "doc_tokens", "tie"]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "pieces")  # the ranges are drawn once
    part = F.shiftright("at", WITHIN).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per partition
    first = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = ranged.withColumn("part", part).join(F.broadcast(first), "part")  # a row per partition
    names = [c for c in ranged.columns if c != "at"]
    return numbered.select(*names, (F.col("first") + F.col("at").bitwiseAND((1 << WITHIN) - 1)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write(docs: DataFrame, folder: str, **options) -> None:
    """Training files: a folder per bucket, whose sequences all have one length."""
    pack(docs, with_ids=True, **options).write.partitionBy("bucket").parquet(folder)
