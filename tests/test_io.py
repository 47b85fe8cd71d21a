import json

import pyarrow as pa
import pytest

from keyloom.cli import Session
from keyloom.errors import InvalidArgument, SchemaMismatch, SourceError
from keyloom.plans import directory
from keyloom.plans.options import ConvertOptions
from keyloom.sources import arrow_stream, cell_file, cells_io, mock
from keyloom.streaming import microbatch


def put(path, batches):
    with pa.OSFile(str(path), "wb") as sink, pa.ipc.new_stream(sink, batches[0].schema) as writer:
        for b in batches:
            writer.write_batch(b)


def batch(**columns):
    return pa.RecordBatch.from_pydict(columns)


def test_arrow_files(spark, tmp_path):
    wide = {"id": pa.array(["x", "y"], pa.large_string()), "u": pa.array([2**64 - 1, 1], pa.uint64()), "n": pa.array([1, None], pa.uint32())}
    put(tmp_path / "b.arrow", [batch(**wide), batch(**wide)])
    put(tmp_path / "a.arrow", [batch(**wide)])
    (tmp_path / "other.txt").write_text("x")
    df = arrow_stream.read(spark, str(tmp_path), position=True)
    rows = df.orderBy("_file", "_batch", "_row").collect()
    assert len(rows) == 6 and rows[0]["_file"].endswith("a.arrow") and str(rows[0]["u"]) == str(2**64 - 1)
    assert [r["_batch"] for r in rows] == [0, 0, 0, 0, 1, 1]


def test_arrow_errors(spark, tmp_path):
    with pytest.raises(SourceError):
        arrow_stream.list_files(str(tmp_path / "none"))
    with pytest.raises(SourceError):
        arrow_stream.read(spark, str(tmp_path))
    (tmp_path / "x.arrow").write_bytes(b"damaged")
    with pytest.raises(SourceError):
        arrow_stream.peek_schema(str(tmp_path / "x.arrow"))
    put(tmp_path / "a.arrow", [batch(a=[1])])
    put(tmp_path / "x.arrow", [batch(b=[1])])
    with pytest.raises(Exception, match="other columns"):
        arrow_stream.read(spark, str(tmp_path)).count()
    assert SchemaMismatch.code == 3


def test_arrow_round_trip(spark, tmp_path):
    written = arrow_stream.write(mock.sessions(spark, 100), str(tmp_path / "out"), "zstd").collect()
    assert sum(r["n_rows"] for r in written) == 100
    assert arrow_stream.read(spark, str(tmp_path / "out")).exceptAll(mock.sessions(spark, 100)).count() == 0


def test_session(spark, tmp_path):
    put(tmp_path / "in.arrow", [batch(id=["b", "a", "a"], v=[1, 2, 3])])
    s = Session(spark)
    s.configure('{"column_family": "v", "default_timestamp_ms": 5}')
    assert s.convert(str(tmp_path / "in.arrow"), str(tmp_path / "out"), "t", "ID,0,false,0") == 0
    assert json.loads(s.last_result()) == {"rows_read": 3, "written": 2, "skipped": 1, "duplicate_keys": 1}
    assert [(r["row"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("row").collect()] == [("a", "a|2"), ("b", "b|1")]
    assert s.convert(str(tmp_path / "in.arrow"), str(tmp_path / "out2"), "t", "bad") == 4
    assert s.convert("", "x", "t", "A,0,false,0") == 1
    assert s.convert(str(tmp_path / "none"), "x", "t", "A,0,false,0") == 2
    s.close()
    with pytest.raises(InvalidArgument):
        s.configure("{}")


def test_mock_is_deterministic(spark):
    assert mock.signals(spark, 200).exceptAll(mock.signals(spark, 200).repartition(3)).count() == 0
    assert mock.folder(spark, 3, 50).groupBy("file").count().count() == 3
    assert mock.rows_for(1000, 10, 30) * 10 >= 950
    assert mock.shuffled(mock.sessions(spark, 100).withColumnRenamed("STARTTIME", "t"), "t", 10).count() == 100
    assert {len(r["SIGSTORE"]) for r in mock.signals(spark, 5, payload_bytes=300).collect()} == {302}


def test_expected_lines(spark):
    lines = spark.createDataFrame([("41\tcf\tq\t7\t4242",), ("short\tline",)], "value string")
    assert [tuple(r) for r in cells_io.parse_expected(lines).collect()] == [(bytearray(b"A"), "cf", "q", 7, bytearray(b"BB"))]


def test_stream_of_files(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "_o int, id string")
    df.write.parquet(str(tmp_path / "in"))
    options = ConvertOptions(rule="ID,0,false,0", default_timestamp_ms=1, order=("_o",), excluded_columns=("_o",))
    query = microbatch.start(microbatch.stream(spark, str(tmp_path / "in"), df.schema), options, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
    query.awaitTermination(120)
    assert [r["row"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("row").collect()] == ["a", "b"]


def folder_of_three(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "in").mkdir()
    for name, ids in (("one", ["b", "a"]), ("two", ["a", "c", "c"])):
        with pa.ipc.new_stream(str(tmp_path / "in" / f"{name}.arrow"), pa.schema([("id", pa.string()), ("v", pa.int64())])) as w:
            w.write_batch(pa.record_batch([pa.array(ids), pa.array(range(len(ids)), pa.int64())], ["id", "v"]))
    (tmp_path / "in" / "bad.arrow").write_bytes(b"no such stream")
    return str(tmp_path / "in")


@pytest.mark.parametrize("sink", ["parquet", "cells"])
def test_directory_conversion(spark, tmp_path, sink):
    source, heard = folder_of_three(spark, tmp_path), []
    s = Session(spark)
    how = directory.DirectoryOptions(sink=sink, parallelism=2)
    got = {r["output"].rsplit("/", 1)[-1]: r for r in s.convert_directory(source, str(tmp_path / "out"), "t", "ID,0,false,0", how, heard.append).collect()}
    assert {k: (r["error_code"], r["cells"]) for k, r in got.items()} == {"bad.cells": (2, 0), "one.cells": (0, 2), "two.cells": (0, 2)}
    assert "bad.arrow" in got["bad.cells"]["error"] and len(heard) == 3
    totals = json.loads(s.last_result())
    assert (totals["succeeded"], totals["failed"], totals["cells"]) == (2, 1, 4) and (totals["bytes"] > 0) == (sink == "cells")
    again = s.convert_directory(source, str(tmp_path / "out"), "t", "ID,0,false,0", directory.DirectoryOptions(sink=sink, skip_existing=True)).collect()
    assert [r["output"].rsplit("/", 1)[-1] for r in again] == ["bad.cells"]
    assert all(r["error_code"] for r in s.convert_directory(source, str(tmp_path / "out"), "t", "ID,0,false,0", how).collect())


def test_merged_directory_conversion(spark, tmp_path):
    source = folder_of_three(spark, tmp_path)
    (tmp_path / "in" / "bad.arrow").unlink()
    s = Session(spark)
    for strategy in ("merge-then-convert", "auto"):
        got = s.convert_directory(source, str(tmp_path / strategy), "my table", "ID,0,false,0", directory.DirectoryOptions(strategy=strategy)).collect()
        assert [(r["output"].rsplit("/", 1)[-1], r["cells"]) for r in got] == [("my_table_000.cells", 3)]
    with pytest.raises(InvalidArgument):
        directory.DirectoryOptions(strategy="other")


def test_command_line(spark, tmp_path, capsys):
    from keyloom import cli

    source = folder_of_three(spark, tmp_path)
    given = ["--input", f"{source}/one.arrow", "--rule", "ID,0,false,0", "--sink", "cells", "--compression", "none", "--block-size", "512", "--bloom-type", "rowcol", "--fsync-policy", "paranoid", "--default-timestamp-ms", "7", "--column-family", "x"]
    assert cli.main([*given, "--output", str(tmp_path / "a")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["written"] == 2
    read = [c for f in sorted((tmp_path / "a").glob("*.cells")) for c in cell_file.File(f.read_bytes()).cells()]
    assert sorted(c[:5] for c in read) == [(b"a", b"x", b"", 7, 4), (b"b", b"x", b"", 7, 4)]
    files = [cell_file.File(f.read_bytes()) for f in (tmp_path / "a").glob("*.cells")]
    assert {f.info["BLOOM_FILTER_TYPE"] for f in files} == {b"ROWCOL"} and {f.codec for f in files} == {2}
    assert cli.main([*given, "--output", str(tmp_path / "b"), "--max-memory-bytes", "5"]) == 1
    assert cli.main(["--batch", "--input", source, "--output", str(tmp_path / "c"), "--rule", "ID,0,false,0", "--progress"]) == 20
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["failed"] == 1


def test_error_policies_of_a_conversion(spark):
    from pyspark.errors import PySparkException

    from keyloom.plans.convert import convert

    df = spark.createDataFrame([(0, "f", "k" * 40_000), (1, "f", "good"), (2, "g", "fine")], "_o int, file string, id string")
    base = {"rule": "ID,1,false,0", "default_timestamp_ms": 1, "excluded_columns": ("_o",)}
    out = convert(df, ConvertOptions(**base, order=("_o",)))
    assert {r["row"] for r in out.cells.collect()} == {"good", "fine"} and [r["error_reason"] for r in out.rejected.collect()] == ["ROW_TOO_LONG"]
    assert {r["row"] for r in convert(df, ConvertOptions(**base, order=("file", "_o"), error_policy="skip_batch")).cells.collect()} == {"fine"}
    with pytest.raises(PySparkException):
        convert(df, ConvertOptions(**base, order=("_o",), error_policy="strict")).cells.collect()


@pytest.mark.parametrize("name", ["max_memory_bytes", "compression_threads", "compression_queue_depth"])
def test_options_that_spark_decides_are_refused(name):
    assert getattr(ConvertOptions.from_json(json.dumps({name: 0})), name) == 0
    with pytest.raises(InvalidArgument):
        ConvertOptions.from_json(json.dumps({name: 3}))


def test_stream_of_arrow_files(spark, tmp_path):
    source = folder_of_three(spark, tmp_path)
    (tmp_path / "in" / "bad.arrow").unlink()
    schema = spark.createDataFrame([], "id string, v long").schema
    place = ("_file", "_batch", "_row")
    options = ConvertOptions(rule="ID,0,false,0", default_timestamp_ms=1, order=place, excluded_columns=place)
    query = microbatch.start(microbatch.stream_arrow(spark, source, schema), options, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
    query.awaitTermination(120)
    got = [(r["row"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("row").collect()]
    assert got == [("a", "a|1"), ("b", "b|0"), ("c", "c|1")]
