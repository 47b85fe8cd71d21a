"""Convert files as they arrive. Each micro-batch is a merged batch: keys are unique within it, as in a merge of its files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.batches import Policy
from ..plans.convert import convert
from ..plans.options import ConvertOptions
from ..sources import arrow_stream
from ..sources.cells_io import write_cells


def stream(spark: SparkSession, folder: str, schema: StructType, policy: Policy = Policy()) -> DataFrame:
    """Files of a folder as a stream, so many of them in a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", policy.count).parquet(folder)


def stream_arrow(spark: SparkSession, folder: str, schema: StructType, policy: Policy = Policy()) -> DataFrame:
    """Arrow stream files of a folder as a stream, with the columns that order their rows: `_file`, `_batch` and `_row`. A task holds the
    bytes of one file at a time."""
    out = StructType([*schema.fields, *arrow_stream.position_fields()])
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from arrow_stream.record_batches(pa.BufferReader(content.as_buffer()), path, names)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.arrow").option("maxFilesPerTrigger", policy.count).load(folder)
    return files.select("path", "content").mapInArrow(run, out)


def start(source: DataFrame, options: ConvertOptions, output: str, checkpoint: str, policy: Policy = Policy(), available_now: bool = False) -> StreamingQuery:
    """Start; the output of batch n is `output/batch=n`, replaced if the batch is run again, so each batch counts once."""

    def one(df: DataFrame, batch: int) -> None:
        write_cells(convert(df, options).cells, f"{output}/batch={batch}", mode="overwrite")

    writer = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{policy.interval_ms // 1000} seconds")
    return writer.start()
