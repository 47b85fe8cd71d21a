import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyloom.errors import InvalidArgument, SchemaMismatch
from keyloom.operators import batches, cells, encoding, layout, regions, verify

CELL = "row string, family string, qualifier string, ts long, type short, value string"


@pytest.mark.parametrize("many", [False, True])
def test_regions(spark, many, monkeypatch):
    if many:
        monkeypatch.setattr(regions, "LITERAL", 0)
    df = spark.createDataFrame([("",), ("a",), ("b",), ("bb",), ("z",)], "k string")
    got = {r["k"]: r["region"] for r in regions.assign(df, "k", ["b", "c"]).collect()}
    assert got == {"": 0, "a": 0, "b": 1, "bb": 1, "z": 2}
    assert {r["region"] for r in regions.assign(df, "k", []).collect()} == {0}
    with pytest.raises(InvalidArgument):
        regions.assign(df, "k", ["c", "b"])


def test_cell_order(spark):
    df = spark.createDataFrame([("b", "f", "", 1, 4, ""), ("a", "f", "q", 1, 4, ""), ("a", "f", "", 1, 4, ""), ("a", "f", "", 2, 4, ""), ("a", "f", "", 2, 8, "")], CELL)
    assert [(r["row"], r["qualifier"], r["ts"], r["type"]) for r in cells.auto_sort(df).collect()] == [("a", "", 2, 8), ("a", "", 2, 4), ("a", "", 1, 4), ("a", "q", 1, 4), ("b", "", 1, 4)]
    with pytest.raises(PySparkException):
        cells.auto_sort(df.union(df.limit(1))).collect()


def test_policies(spark):
    df = spark.createDataFrame([("1", "", "f", "", 1, 4, ""), ("1", "r", "f", "", 1, 4, ""), ("2", "r", "f", "", -1, 4, ""), ("3", "r", "f", "", 1, 4, "")], "batch string, " + CELL)
    good, bad = cells.validate(df, "skip_row", max_errors=2)
    assert good.count() == 2 and {r["error_reason"] for r in bad.collect()} == {"ROW_EMPTY", "NEGATIVE_TIMESTAMP"}
    with pytest.raises(PySparkException):
        cells.validate(df, "skip_row", max_errors=1)[0].collect()
    with pytest.raises(PySparkException):
        cells.validate(df, "strict")[0].collect()
    assert [r["batch"] for r in cells.validate(df, "skip_batch", batch="batch")[0].collect()] == ["3"]


def test_variable_length_sizes(spark):
    values = {0: 1, 127: 1, 128: 2, -112: 1, -113: 2, 255: 2, 256: 3, 65535: 3, 2**31: 5, -(2**63): 9}
    df = spark.createDataFrame([(v,) for v in values], "x long").select("x", cells.writable_vint_size(F.col("x")).alias("n"))
    assert {r["x"]: r["n"] for r in df.collect()} == values
    df = spark.createDataFrame([(v,) for v in (0, 127, 128, 16383, 16384)], "x long").select(cells.varint_size(F.col("x")).alias("n"))
    assert [r["n"] for r in df.collect()] == [1, 1, 2, 2, 3]


def test_separators():
    assert layout.separator(None, b"b") == b"b"
    assert layout.separator(b"abc", b"abz") == b"abd"
    assert layout.separator(b"ab", b"abc") == b"ab\x00"
    assert layout.separator(b"ab", b"ab") is None
    with pytest.raises(ValueError):
        layout.separator(b"b", b"a")


def test_filters_hold_their_keys(spark):
    keys = [f"k{i}" for i in range(50)]
    df = spark.createDataFrame([("f", k) for k in keys], "file string, row string")
    chunks = layout.bloom_chunks(df, ["file"], "row", 20, 3, 64).collect()
    assert sorted(c["n_keys"] for c in chunks) == [10, 20, 20]
    for k in keys:
        assert any(layout.might_contain(c["bits"], k.encode(), 3) for c in chunks)
    assert layout.murmur(b"") == 0 and layout.murmur(b"\xff\x80a") != layout.murmur(b"\x7f\x80a")


def test_sizing_folds_the_last_chunk(spark):
    rows = spark.createDataFrame([(100,), (109306,), (200000,)], "n long").select(layout.bloom_sizing(F.col("n")).alias("b")).select("b.*").collect()
    assert rows[0]["hash_count"] == 7 and [r["chunks"] for r in rows] == [1, 1, 2]
    assert rows[0]["last_chunk_bytes"] < rows[1]["last_chunk_bytes"] == rows[0]["chunk_bytes"] == 131072


def test_merge_refuses_other_schemas(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,)], "y int")
    assert batches.merge([a, a]).count() == 2
    with pytest.raises(SchemaMismatch):
        batches.merge([a, b])


def test_batches_close_by_size_count_and_age(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, bytes long, mtime_ms long")
    policy = batches.Policy(size=10, count=2, interval_ms=100)
    ids = lambda rows: {r["path"]: r["batch"] for r in batches.batch_ids(files(rows), policy).collect()}
    assert ids([("a", 6, 0), ("b", 4, 0), ("c", 1, 0)]) == {"a": 0, "b": 1, "c": 1}
    assert ids([("a", 1, 0), ("b", 1, 0), ("c", 1, 0)]) == {"a": 0, "b": 0, "c": 1}
    assert ids([("a", 1, 0), ("b", 1, 100)]) == {"a": 0, "b": 1}
    assert ids([]) == {}


def test_diff(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert [tuple(r) for r in verify.table_diff(a, b).collect()] == [(1, "left")]


def test_blocks_restart_with_every_file(spark):
    df = spark.createDataFrame([(f, i, 5) for f in "ab" for i in range(5)], "f string, i int, size long")
    got = {(r["f"], r["i"]): r["block"] for r in layout.assign_blocks(df, ["f"], ["i"], "size", 10).collect()}
    assert got == {(f, i): i // 2 for f in "ab" for i in range(5)}


def test_integer_codes():
    for v in (0, 1, 127, 128, 300, 2**31, 2**63 - 1, -1, -112, -113, -129, -(2**63)):
        code = encoding.writable_vint(v)
        assert encoding.read_writable_vint(code) == (v, len(code))
    assert encoding.varint(0) == b"\0" and encoding.varint(300) == b"\xac\x02"


def test_checksums_per_chunk():
    assert encoding.crc32c(b"123456789") == [0xE3069283]
    data, plain = bytes(range(256)) * 3, 0xFFFFFFFF
    for b in data:
        plain = plain >> 8 ^ int(encoding._TABLE[(plain ^ b) & 255])
    assert encoding.crc32c(data) == [plain ^ 0xFFFFFFFF]
    assert encoding.crc32c(b"") == [] and encoding.crc32c(b"123456789" * 2, 9) == [0xE3069283] * 2
    assert len(encoding.crc32c(b"x" * 40_000)) == 3


#: Hashes (unsigned) of bytes by seed, as the format demands them.
HASHES = [
    (b"\x01\x02\x03", 0, 0x3AA63325), (b"row_0", 0, 0xB06BB73A), (b"row_0", -123456789, 0x3AD85E04), (b"\x80", 0, 0xFDAB6E14), (b"\x80", 0xFDAB6E14, 0x97CFE73A),
    (b"\xc3\xa9", 0, 0x20A5A987), (b"\xc3\xa9", 0x20A5A987, 0x47B788B2),
]


def test_hash_vectors(spark):
    for data, seed, want in HASHES:
        assert layout.murmur(data, seed) & 0xFFFFFFFF == want
        assert int(layout.murmur_all([data, b"xyz", data], seed)[2]) & 0xFFFFFFFF == want
    assert layout.rowcol_key(b"row", b"q") == b"\x00\x03row\x00q\x7f" + b"\xff" * 8
    first = layout.murmur(layout.rowcol_key(b"row", b"q"))
    assert (first & 0xFFFFFFFF, layout.murmur(layout.rowcol_key(b"row", b"q"), first) & 0xFFFFFFFF) == (0x9350B067, 0xF1A34EC0)
    df = spark.createDataFrame([("row", "q"), ("r\u00e9", "")], "row string, qualifier string")
    got = layout.bloom_keys(df, "rowcol").collect()
    assert [bytes(r["row"]) for r in got] == [layout.rowcol_key(b"row", b"q"), layout.rowcol_key("r\u00e9".encode(), b"")]


def test_hashes_of_many_keys():
    import random

    rng = random.Random(4)
    keys = [rng.randbytes(rng.randrange(0, 23)) for _ in range(500)]
    assert layout.murmur_all(keys).tolist() == [layout.murmur(k) for k in keys]
    seeds = [rng.randrange(-(2**31), 2**31) for _ in keys]
    import numpy as np

    assert layout.murmur_all(keys, np.array(seeds)).tolist() == [layout.murmur(k, s) for k, s in zip(keys, seeds)]
    assert layout.murmur_all([]).tolist() == []


def test_filters_of_several_files_and_chunks(spark):
    df = spark.createDataFrame([(f, f"{f}{i:04}") for f in "ab" for i in range(250)] + [("c", "c1")], "file string, row string")
    chunks = layout.bloom_chunks(df, ["file"], "row", 100, 5, 256)
    got = sorted((r["file"], r["chunk"], r["n_keys"], bytes(r["first_key"]), bytes(r["bits"])) for r in chunks.collect())
    assert [(f, c, n, k.decode()) for f, c, n, k, _ in got] == [(f, c, n, f"{f}{c * 100:04}") for f in "ab" for c, n in enumerate((100, 100, 50))] + [("c", 0, 1, "c1")]
    for f, c, n, _, bits in got[:-1]:
        want = {p for i in range(100 * c, 100 * c + n) for p in layout.bloom_bits(f"{f}{i:04}".encode(), 5, 2048)}
        assert {8 * i + j for i, b in enumerate(bits) for j in range(8) if b >> j & 1} == want
    asked = spark.createDataFrame([("a", "a0000"), ("a", "a0249"), ("b", "b0100"), ("a", "0"), ("d", "x"), ("a", None)], "file string, row string")
    assert {(r["file"], r["row"]): r["may_contain"] for r in layout.filter_probe(asked, chunks, "row", 5).collect()} == {("a", "a0000"): True, ("a", "a0249"): True, ("b", "b0100"): True, ("a", "0"): False, ("d", "x"): False, ("a", None): False}


def test_separators_of_any_script(spark):
    df = spark.createDataFrame([("f", k, a, z) for k, (a, z) in enumerate([("\u043a\u043b\u044e\u0447", "\u043b"), ("\u6771", "\u6771\u4eac"), ("\u6771\u4eac", "\U0001f600"), ("\U0001f601", "\U0001f602")])], "f string, block int, first_key string, last_key string")
    keys = [r["index_key"] for r in layout.block_separators(df, ["f"]).orderBy("block").collect()]
    rows = df.orderBy("block").collect()
    assert all(a["last_key"].encode() < k.encode() <= b["first_key"].encode() for a, k, b in zip(rows, keys[1:], rows[1:]) if a["last_key"] < b["first_key"])
    assert layout.text_separator("ab\ud7ff", "b") == "b" or layout.text_separator("ab\ud7ff", "ab\ue001") == "ab\ue000"


def test_integer_codes_in_expressions(spark):
    values = [0, 1, 127, 128, 300, 2**31, 2**63 - 1, -1, -112, -113, -129, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert [bytes(r[0]) for r in df.select(encoding.writable_vint_bytes(F.col("x"))).collect()] == [encoding.writable_vint(v) for v in values]
    plain = [v for v in values if v >= 0]
    df = spark.createDataFrame([(v,) for v in plain], "x long")
    assert [bytes(r[0]) for r in df.select(encoding.varint_bytes(F.col("x"))).collect()] == [encoding.varint(v) for v in plain]


def test_ranks_over_drawn_borders(spark):
    df = spark.range(500).selectExpr("concat('k', id) k").repartition(7)
    want = {k: i + 1 for i, k in enumerate(sorted(f"k{i}" for i in range(500)))}
    for ranges in (1, 2, 50):
        assert {r["k"]: r["rank"] for r in regions.ranked(df, "k", ranges=ranges).collect()} == want


def test_batches_of_many_files(spark):
    files = spark.range(3000).selectExpr("concat('f', lpad(id, 6, '0')) path", "1L bytes", "0L mtime_ms").repartition(5)
    got = batches.batch_ids(files, batches.Policy(size=10**9, count=7)).collect()
    assert {r["path"]: r["batch"] for r in got} == {f"f{i:06}": i // 7 for i in range(3000)}


@pytest.mark.parametrize("ranges", [1, 2, 9])
def test_sort_violations_across_ranges(spark, ranges):
    import random

    rng = random.Random(ranges)
    rows = [(f, k, f"r{rng.randint(0, 30):02}") for f in "ab" for k in range(120)]
    df = spark.createDataFrame(rows, "f string, k long, row string").repartition(5)
    want = {(f, k) for (g, j, a), (f, k, b) in zip(rows, rows[1:]) if f == g and b <= a}
    got = cells.sort_violations(df, ["f"], F.col("k"), F.col("row"), along=F.col("k"), ranges=ranges)
    assert {(r["f"], r["k"]) for r in got.collect()} == want and got.columns == df.columns
    assert {(r["f"], r["k"]) for r in cells.sort_violations(df, ["f"], F.col("k"), F.col("row")).collect()} == want
