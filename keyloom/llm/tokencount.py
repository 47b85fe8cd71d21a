"""Token counts by a separator scan over flat token files that have no index.

Token files hold ids back to back, with an end-of-document id after each document. Blocks of equal size are searched for that id
with array operations, in any order; a running maximum over the blocks' last separators (a prefix scan) then gives each block the
place where its first document began, however many blocks that document fills.

Defined results: a null or empty text has 0 tokens; repeated rows are each counted; a null doc_id is carried along; text that
spells a special token is ordinary text, so the separator stands only between documents; extra columns are dropped; an empty table
gives an empty result. A very long text fills several blocks and files' worth of ids; it is encoded whole, in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise
from .store import Reader, filesystem, own_name
from .tokens import encoder

END = 50256
#: Ids in a block, and bytes in a file before the next is begun.
BLOCK, FILE = 1 << 19, 1 << 28
KIND = np.dtype("<u2")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k", end: int = END) -> DataFrame:
    """Write flat token files; returns which document stands where: file, ordinal, doc_id. A row with ordinal -1 has the ids in a file."""

    def run(batches):
        encode = encoder(vocabulary)
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        out, name, n, ids = None, "", 0, 0

        def rows(files, ordinals, values):
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ordinals, pa.int64()), pa.array(values, pa.int64())], ["file", "ordinal", "value"])

        for batch in batches:
            files, ordinals, values = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    name, n, ids = own_name("tokens", ".bin"), 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = np.array([*encode(text or ""), end], KIND)
                out.write(data.tobytes())
                files.append(name), ordinals.append(n), values.append(doc_id)
                n, ids = n + 1, ids + len(data)
                if ids * KIND.itemsize >= FILE:
                    out.close()
                    out = None
                    files.append(name), ordinals.append(-1), values.append(ids)
            yield rows(files, ordinals, values)
        if out is not None:
            out.close()
            yield rows([name], [-1], [ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, ordinal long, value long")


def scan(folder: str, files: DataFrame, end: int = END) -> DataFrame:
    """file, ordinal, start, n_tokens of each document in `files` (file, n_ids)."""

    def run(batches):
        reader = Reader(folder)
        for batch in batches:
            for name, first, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = np.frombuffer(reader.read(name, first * KIND.itemsize, n * KIND.itemsize), KIND)
                ends = first + np.flatnonzero(data == end)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "first", "ends"])

    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ids") - 1, F.lit(BLOCK).cast("long")))
    blocks = files.filter("n_ids > 0").select("file", first.alias("first"), "n_ids").select("file", "first", F.least(F.lit(BLOCK).cast("long"), F.col("n_ids") - F.col("first")).alias("n"))
    found = blocks.repartition("file", "first").mapInArrow(run, "file string, first long, ends array<long>")
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "file", "ends",
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before) + 1, F.lit(0)).alias("begin"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("seen"),
    )
    begins = F.slice(F.concat(F.array("begin"), F.transform("ends", lambda e: e + 1)), F.lit(1), F.size("ends"))
    each = stitched.withColumn("begins", begins).select("file", "seen", F.posexplode(F.arrays_zip("begins", "ends")).alias("i", "x"))
    return each.select("file", (F.col("seen") + F.col("i")).alias("ordinal"), F.col("x.begins").alias("start"), (F.col("x.ends") - F.col("x.begins")).alias("n_tokens"))


def count(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the place in the token files for every document, read from the files alone."""
    folder = fresh_path(docs.sparkSession, "tokens")
    written = materialise(write_tokens(docs, folder), "documents-of-tokens")
    files = written.filter("ordinal = -1").select("file", F.col("value").alias("n_ids"))
    counts = scan(folder, files)
    # a row per document on both sides: merged, never broadcast
    return written.filter("ordinal >= 0").select("file", "ordinal", F.col("value").alias("doc_id")).join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "start")
