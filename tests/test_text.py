import datetime
import math
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import keycodes
from keyloom.functions.text import base64_text, float_text, row_value, text_of
from keyloom.plans.convert import visible


def test_floats_as_c_prints_them(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1.25, -2.5, 5e-7, -1e-9, 1e15, 2.0**62, math.nan, math.inf, -math.inf]
    values += [(2 * i + 1) * 5e-7 for i in range(300)] + [rng.uniform(-1, 1) * 10**e for e in range(19) for _ in range(80)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", float_text(F.col("x")).alias("t")).orderBy("i").collect()
    for row, v in zip(got, values):
        if abs(v) < 2.0**63 or math.isnan(v) or math.isinf(v):
            assert row["t"] == "%.6f" % v, v


def test_row_value_of_every_type(spark):
    schema = "id string, signed long, unsigned decimal(20,0), flag boolean, f float, d double, ts timestamp_ntz, b binary"
    import decimal

    df = spark.createDataFrame([("row", -42, decimal.Decimal(2**64 - 1), True, 1.25, -2.5, datetime.datetime(1970, 1, 1, 0, 0, 1, 234567), b"bin")], schema)
    assert df.select(row_value(visible(df))).first()[0] == "row|-42|18446744073709551615|1|1.250000|-2.500000|1234|Ymlu"


def test_nulls_keep_their_place(spark):
    df = spark.createDataFrame([(5, 87580202875, "sig2", None)], "a long, b long, c string, d long")
    assert df.select(row_value(visible(df))).first()[0] == "5|87580202875|sig2|"


def test_times_are_cut_toward_zero(spark):
    df = spark.createDataFrame([(-1,), (-1500,), (1999,)], "u long").select(F.timestamp_micros("u").alias("t"))
    assert [r[0] for r in df.select(text_of(F.col("t"), T.TimestampType())).collect()] == ["0", "-1", "1"]


def test_base64_has_no_line_breaks(spark):
    text = spark.createDataFrame([(b"x" * 100,)], "b binary").select(base64_text(F.col("b"))).first()[0]
    assert "\r" not in text and len(text) == 136


def test_reversed_bytes(spark):
    df = spark.createDataFrame([("é1",)], "s string")
    assert bytes(df.select(keycodes.reverse_bytes(F.col("s"))).first()[0]) == "é1".encode()[::-1]
