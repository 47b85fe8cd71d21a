import pytest
from pyspark.errors import PySparkException

from keyloom.errors import CODES, InvalidArgument, SchemaMismatch, code_of
from keyloom.plans.convert import convert, visible
from keyloom.plans.options import ConvertOptions

BASE = {"default_timestamp_ms": 1715678900123, "order": ("_o",), "excluded_columns": ("_o",)}


def run(df, **options):
    out = convert(df, ConvertOptions(**(BASE | options)))
    counts = out.counters.first()
    assert counts["rows_read"] == counts["written"] + counts["skipped"]
    return [tuple(r) for r in out.cells.collect()], counts


def test_value_cell(spark):
    df = spark.createDataFrame([(0, 4, 87580202874, "dfx", 1783451782), (1, 5, 87580202875, "sig2", None)], "_o int, BIT_MAP long, REFID long, SIGSTORE string, TIME long")
    cells, counts = run(df, rule="REFID,1,false,0", column_family="value")
    assert cells == [("87580202874", "value", "", 1715678900123, 4, "4|87580202874|dfx|1783451782"), ("87580202875", "value", "", 1715678900123, 4, "5|87580202875|sig2|")]
    assert counts["written"] == 2


@pytest.mark.parametrize("parts", [1, 5])
def test_first_row_wins_in_any_partitioning(spark, parts):
    df = spark.createDataFrame([(0, 12, "a"), (1, 2, "first-two"), (2, 2, "second-two"), (3, 7, "c")], "_o int, ID long, v string").repartition(parts)
    cells, counts = run(df, rule="ID,0,false,5")
    assert [c[0] for c in cells] == ["00002", "00007", "00012"] and cells[0][-1] == "2|first-two"
    assert (counts["duplicate_keys"], counts["skipped"]) == (1, 1)


def test_empty_keys_are_skipped(spark):
    df = spark.createDataFrame([(0, None, "a"), (1, "", "b"), (2, "row-ok", "c")], "_o int, ID string, p string")
    cells, counts = run(df, rule="ID,0,false,0")
    assert len(cells) == 1 and (counts["rows_read"], counts["skipped"]) == (3, 2)


def test_empty_table(spark):
    cells, counts = run(spark.createDataFrame([], "_o int, ID string"), rule="ID,0,false,0")
    assert cells == [] and counts["rows_read"] == 0


def test_exclusion_is_case_sensitive_and_comes_first(spark):
    df = spark.createDataFrame([(0, "k", "x", "y")], "_o int, Key string, key_a string, keep string")
    assert [n for n, _ in visible(df, ("KEY", "_o"), ("key_", ""))] == ["Key", "keep"]
    cells, _ = run(df, rule="K,1,false,0", excluded_column_prefixes=("key_",))
    assert cells[0][0] == "y"
    with pytest.raises(SchemaMismatch):
        run(df, rule="K,2,false,0", excluded_column_prefixes=("key_",))


def test_options():
    assert ConvertOptions.from_json('{"column_family": "v", "excluded_columns": ["a"], "block_size": 100}').excluded_columns == ("a",)
    for text in ('{"x": 1}', '{"block_size": 1, "block_size": 2}', "[1]", '{"block_size": "1"}', '{"compression": "lz4"}', "{"):
        with pytest.raises(InvalidArgument):
            ConvertOptions.from_json(text)
    assert code_of(SchemaMismatch("x")) == CODES["SCHEMA_MISMATCH"] and code_of(ValueError()) == CODES["INTERNAL_ERROR"]


def test_numeric_path_on_demand(spark):
    df = spark.createDataFrame([(0, -1)], "_o int, ID long")
    with pytest.raises(PySparkException):
        run(df, rule="ID,0,false,5", numeric_sort_fast_path="on")
    with pytest.raises(InvalidArgument):
        run(df, rule="ID,0,true,5", numeric_sort_fast_path="on")
    with pytest.raises(InvalidArgument):
        convert(df, ConvertOptions())


def test_json_result(spark):
    df = spark.createDataFrame([(0, "k")], "_o int, ID string")
    assert convert(df, ConvertOptions(rule="ID,0,false,0", **BASE)).json().first()["result"] == '{"rows_read":1,"written":1,"skipped":0,"duplicate_keys":0}'
