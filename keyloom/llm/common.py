"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`. A local master has one machine only and may use its own folder."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/keyloom-shared"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{_mark(spark)}-{name}-{uuid.uuid4().hex[:12]}"


def _mark(spark: SparkSession) -> str:
    return f"keyloom-{spark.sparkContext.applicationId}"


def remove_intermediates(spark: SparkSession) -> None:
    """Delete what this application has left in the shared folder; results that aren't written yet can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_mark(spark)}-*")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path) or []:
        fs.delete(status.getPath(), True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bind(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a lambda variable.

    A plain column reference inside a higher-order function may be inlined and evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """These names, made longer until no column of `df` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def row_keys() -> tuple[Column, Column]:
    """(r1, r2): 63 bits of a hash of the text and a bit that is set without a doc_id; doc_id, or another hash of the text."""
    text, doc_id = whole_text(), F.col("doc_id").cast("long")
    return F.xxhash64(text).bitwiseAND(F.lit(-2)) + doc_id.isNull().cast("long"), F.coalesce(doc_id, F.xxhash64(F.lit("no id"), text))


def without_id(r1: str = "r1") -> Column:
    return F.col(r1).bitwiseAND(F.lit(1)) == 1


def shown_id(r1: str = "r1", r2: str = "r2") -> Column:
    return F.when(~without_id(r1), F.col(r2))


def row_keyed(docs: DataFrame) -> DataFrame:
    """(r1, r2, text): what tells rows apart, and the whole text."""
    r1, r2 = row_keys()
    return docs.select(r1.alias("r1"), r2.alias("r2"), whole_text().alias("text"))


def join_rows(docs: DataFrame, keys: DataFrame, how: str, once: bool = False) -> DataFrame:
    """`docs` joined by (r1, r2) with `keys`, whose columns must have spare names but for these; the columns of both, without the
    keys. `once`: rows that agree in both keys and in one more hash of their text are left once."""
    a, b, c = spare(docs, "_row_hash", "_row_id", "_row_text")
    keyed = docs.withColumns(dict(zip((a, b), row_keys())))
    keyed = keyed.withColumn(c, F.xxhash64(F.lit("text"), whole_text())) if once else keyed
    out = keyed.join(keys.withColumnsRenamed({"r1": a, "r2": b}), [a, b], how)
    return (out.dropDuplicates([a, b, c]) if once else out).drop(a, b, c)


@contextlib.contextmanager
def bloom_joins(spark):
    """Joins drop rows by a Bloom filter of the smaller side before the shuffle; the filter's size is fixed by Spark's settings, and
    if it fills up, it only drops less."""
    name = "spark.sql.optimizer.runtime.bloomFilter."
    put = {f"{name}applicationSideScanSizeThreshold": "0", f"{name}creationSideThreshold": str(1 << 40), f"{name}expectedNumItems": "4000000", f"{name}numBits": str(1 << 25)}
    before = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
