"""Arrow IPC stream files as a Spark data source: `spark.read.format("arrow_stream").load(folder)`.

Each file is a partition and its record batches go to Spark as they are read. `_file`, `_batch` and `_row` give every row its place
where the option `position` is true. Files are found in one folder (no deeper), by the option `files` (comma-separated), or
both, in the order of their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import SchemaMismatch, SourceError


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def list_files(folder: str | None, files: str = "", suffix: str = ".arrow") -> list[str]:
    """File URIs or paths in the order of their names."""
    found = [f for f in files.split(",") if f]
    if folder:
        from pyarrow import fs

        system, path = _filesystem(folder)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise SourceError(f"{folder} does not exist")
        if info.type == fs.FileType.File:
            found.append(folder)
        else:
            base = folder.rstrip("/")
            found += [f"{base}/{x.base_name}" for x in system.get_file_info(fs.FileSelector(path)) if x.is_file and x.base_name.endswith(suffix)]
    return sorted(dict.fromkeys(found), key=lambda f: (f.rsplit("/", 1)[-1], f))


def open_stream(path: str):
    system, name = _filesystem(path)
    try:
        return pa.ipc.open_stream(system.open_input_stream(name, compression=None))
    except (OSError, pa.ArrowInvalid) as e:
        raise SourceError(f"{path}: {e}") from e


def peek_schema(path: str) -> pa.Schema:
    return open_stream(path).schema


def _plain(kind: pa.DataType) -> pa.DataType:
    """The type that Spark has for it: unsigned integers widen, the largest to a decimal."""
    widened = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    return widened.get(kind, kind)


def _column(column: pa.Array, kind: pa.DataType) -> pa.Array:
    if column.type == kind:
        return column
    if pa.types.is_uint64(column.type):  # Arrow has no such cast for large values
        import decimal

        return pa.array([None if v is None else decimal.Decimal(v) for v in column.to_pylist()], kind)
    return column.cast(kind, safe=False)


POSITION = (("_file", pa.string()), ("_batch", pa.int64()), ("_row", pa.int64()))


def position_fields() -> list:
    """The columns of a row's place, as Spark's fields."""
    from pyspark.sql.pandas.types import from_arrow_schema

    return list(from_arrow_schema(pa.schema([pa.field(n, t) for n, t in POSITION])))


def record_batches(source, path: str, names: list[str], position: bool = True):
    """The batches of one stream, in the types that Spark has, with the rows' places."""
    try:
        stream = pa.ipc.open_stream(source)
        if stream.schema.names != names:
            raise SchemaMismatch(f"{path} has other columns than the first file")
        kinds = [_plain(f.type) for f in stream.schema]
        for k, batch in enumerate(stream):
            columns = [_column(c, t) for c, t in zip(batch.columns, kinds)]
            if position:
                n = batch.num_rows
                columns += [pa.array([path] * n, pa.string()), pa.array([k] * n, pa.int64()), pa.array(range(n), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *[n for n, _ in POSITION] * position])
    except (OSError, pa.ArrowInvalid) as e:
        raise SourceError(f"{path}: {e}") from e


class ArrowFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArrowStreamReader(DataSourceReader):
    def __init__(self, files: list[str], names: list[str], position: bool):
        self.files, self.names, self.position = files, names, position

    def partitions(self):
        return [ArrowFile(f) for f in self.files] or [ArrowFile("")]

    def read(self, partition):
        if partition.path:
            system, name = _filesystem(partition.path)
            yield from record_batches(system.open_input_stream(name, compression=None), partition.path, self.names, self.position)


class ArrowStreamSource(DataSource):
    @classmethod
    def name(cls):
        return "arrow_stream"

    def _files(self):
        return list_files(self.options.get("path"), self.options.get("files", ""), self.options.get("suffix", ".arrow"))

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        files = self._files()
        if not files:
            raise SourceError("no Arrow file was found")
        fields = [pa.field(f.name, _plain(f.type)) for f in peek_schema(files[0])]
        if self.options.get("position", "false").lower() == "true":
            fields += [pa.field(n, t) for n, t in POSITION]
        return from_arrow_schema(pa.schema(fields))

    def reader(self, schema: StructType) -> DataSourceReader:
        position = self.options.get("position", "false").lower() == "true"
        names = [f.name for f in schema if not (position and f.name in dict(POSITION))]
        return ArrowStreamReader(self._files(), names, position)


def read(spark: SparkSession, path: str | None = None, files: list[str] = (), position: bool = False) -> DataFrame:
    if not list_files(path, ",".join(files)):
        raise SourceError("no Arrow file was found")
    spark.dataSource.register(ArrowStreamSource)
    reader = spark.read.format("arrow_stream").option("position", str(position).lower()).option("files", ",".join(files))
    return reader.load(path) if path else reader.load()


def write(df: DataFrame, folder: str, compression: str | None = None) -> DataFrame:
    """One Arrow stream file per partition; returns path and rows of each, when an action runs."""
    import uuid

    def run(batches):
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        name, rows, writer = f"part-{uuid.uuid4().hex}.arrow", 0, None
        for batch in batches:
            if writer is None:
                sink = system.open_output_stream(f"{path}/{name}", compression=None)
                writer = pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression))
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "n_rows": pa.array([rows], pa.int64())})

    return df.mapInArrow(run, "path string, n_rows long")
