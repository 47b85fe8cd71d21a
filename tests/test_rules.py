import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import InvalidRule, SchemaMismatch
from keyloom.plans import rules
from keyloom.plans.convert import visible


def key(spark, rule, *values, **options):
    fields = [T.StructField(f"c{i}", T.LongType() if isinstance(v, int) else T.StringType()) for i, v in enumerate(values)]
    df = spark.createDataFrame([tuple(values)], T.StructType(fields))
    return df.select(rules.expression(rules.parse(rule), visible(df), **options).alias("k")).first()["k"]


@pytest.mark.parametrize("rule,values,expected", [
    ("F,0,false,8", ["123"], "00000123"),
    ("F,0,false,8,RIGHT", ["123"], "12300000"),
    ("F,0,false,5,LEFT, ", ["ab"], "   ab"),
    ("F,0,false,5", ["1234567890"], "1234567890"),
    ("F,0,true,6", ["abc"], "cba000"),
    ("F,0,true,3", ["xyz"], "zyx"),
    ("F,1,false,5", ["a", "", "c"], "00000"),
    ("FILL,9,false,4", ["x"], "0000"),
    ("FILL_COL,9,true,4", ["x"], "0000"),
    ("short(hash),0,false,0", ["123456789"], "2DE="),
    ("long(),0,false,0", ["123456789"], "AAAAAAdbzRU="),
    ("long(hash),0,false,0", ["123456789"], "////////2DE="),
    ("LONG(hash()),0,false,0", ["123456789"], "////////2DE="),
    ("A,0,false,0#B,0,false,0", ["hello"], "hellohello"),
    ("A,0,false,0#", ["hello"], "hello"),
    ("F,0,false,4", ["é"], "00é"),
])
def test_goldens(spark, rule, values, expected):
    assert key(spark, rule, *values) == expected


def test_composite_with_random(spark):
    rule = "STARTTIME,0,false,10#IMSI,1,true,15#MSISDN,2,false,0#$RND$,0,false,4"
    got = key(spark, rule, "20240301123000", "460001234567890", "13800138000", seed=3)
    assert got[:-4] == "20240301123000" + "098765432100064" + "13800138000"
    assert set(got[-4:]) <= set("012345678")


@pytest.mark.parametrize("rule", ["", "A,0,false", "A,x,false,0", "A,0,false,x", "#", "long(hash,0,false,0", "bytes(hash),0,false,0", "short(md5),0,false,0", "A,-1,false,0", "A,0,false,-1", "A,0,maybe,0", "A,0,false,0,CENTER", "A,0,false,0,,x"])
def test_bad_rules(rule):
    with pytest.raises(InvalidRule):
        rules.parse(rule)


@pytest.mark.parametrize("rule,value", [("long(),0,false,0", "abc"), ("short(),0,false,0", "40000"), ("long(),0,false,0", "+12"), ("long(),0,false,0", " 12"), ("long(),0,false,0", "")])
def test_bad_numbers(spark, rule, value):
    with pytest.raises(PySparkException):
        key(spark, rule, value)


def test_missing_and_unfit_columns(spark):
    df = spark.createDataFrame([(b"x",)], "b binary")
    for rule in ("A,9,false,0", "A,0,false,0"):
        with pytest.raises(SchemaMismatch):
            rules.expression(rules.parse(rule), visible(df))


def test_negative_numbers_sort_as_bytes(spark):
    df = spark.createDataFrame([(-2,), (2,), (-10,)], "id long")
    got = df.select(rules.expression(rules.parse("ID,0,false,5"), visible(df)).alias("k")).orderBy("k").collect()
    assert [r["k"] for r in got] == ["00-10", "000-2", "00002"]


def test_null_keys(spark):
    df = spark.createDataFrame([(None, "a"), (3, "b")], "id long, city string")
    segments = rules.parse("ID,0,false,5#CITY,1,false,0")
    skip = [r[0] for r in df.select(rules.expression(segments, visible(df))).collect()]
    padded = [r[0] for r in df.select(rules.expression(segments, visible(df), null_keys="pad")).collect()]
    assert skip == ["", "00003b"] and padded == ["00000a", "00003b"]


def test_hash_of_hash(spark):
    from keyloom.functions.keycodes import hashed

    def plain(x):
        r = 961 + 31 * (x >> 32) + (x & (2**33 - 1))
        r = r % 65535 if r >= 0 else -(-r % 65535)
        return (r + 32768) % 65536 - 32768

    values = [0, 1, -1, 123456789, 2**40 + 7, -(2**50), 2**62, -(2**62)]
    df = spark.createDataFrame([(v,) for v in values], "x long").select(hashed(F.col("x")).alias("h"))
    assert [r["h"] for r in df.collect()] == [plain(v) for v in values]
