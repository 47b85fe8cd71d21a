"""The registered queries over the example tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import InvalidArgument
from .functions import text as X
from .operators import batches, cells, dedup, encoding, layout, metrics, regions, verify
from .plans import directory, rules
from .plans.convert import convert, counters, keyed, visible
from .plans.options import ConvertOptions
from .sources import cells_io, mock

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _keys(df: DataFrame, rule: str, keep: str, **options) -> DataFrame:
    return df.select(keep, rules.expression(rules.parse(rule), visible(df), **options).alias("rk"))


# ---- row keys


@query("SELECT c_custkey, c_name AS rk FROM customer")
def rk_passthrough(spark, sf):
    return _keys(_read(spark, sf, "customer"), "NAME,1,false,0", "c_custkey")


@query("SELECT c_custkey, repeat('0', greatest(0, 10 - strlen(c_custkey::VARCHAR))) || c_custkey::VARCHAR AS rk FROM customer")
def rk_pad_left(spark, sf):
    return _keys(_read(spark, sf, "customer"), "ID,0,false,10", "c_custkey")


@query("SELECT p_partkey, p_brand || repeat('*', greatest(0, 12 - strlen(p_brand))) AS rk FROM part")
def rk_pad_right(spark, sf):
    return _keys(_read(spark, sf, "part"), "BRAND,2,false,12,RIGHT,*", "p_partkey")


@query("SELECT p_partkey, reverse(repeat('0', greatest(0, 8 - strlen(p_partkey::VARCHAR))) || p_partkey::VARCHAR) AS rk FROM part")
def rk_reverse(spark, sf):
    return _keys(_read(spark, sf, "part"), "ID,0,true,8", "p_partkey")


@query("SELECT c_custkey, 'xxxx' || c_mktsegment AS rk FROM customer")
def rk_fill(spark, sf):
    return _keys(_read(spark, sf, "customer"), "FILL,99,false,4,LEFT,x#SEG,4,false,0", "c_custkey")


@query("SELECT o_orderkey, to_base64(unhex(lpad(to_hex(o_orderkey), 16, '0'))) AS rk FROM orders")
def rk_long_b64(spark, sf):
    return _keys(_read(spark, sf, "orders"), "long(),0,false,0", "o_orderkey")


@query("SELECT c_custkey, to_base64(unhex(right(lpad(to_hex(c_custkey % 30000), 16, '0'), 4))) AS rk FROM customer")
def rk_short_b64(spark, sf):
    df = _read(spark, sf, "customer").select((F.col("c_custkey") % 30000).alias("n"), "c_custkey")
    return _keys(df, "short(),0,false,0", "c_custkey")


@query(
    "SELECT o_orderkey, to_base64(unhex(right(lpad(to_hex((CASE WHEN r >= 0 THEN (r + 32768) % 65536 ELSE (r + 98304) % 65536 END) - 32768), 16, '0'), 4))) AS rk "
    "FROM (SELECT o_orderkey, (961 + 31 * (x >> 32) + (x & 8589934591)) % 65535 AS r FROM (SELECT o_orderkey, o_orderkey * 123456789 AS x FROM orders))"
)
def rk_hash(spark, sf):
    df = _read(spark, sf, "orders").select((F.col("o_orderkey") * 123456789).alias("n"), "o_orderkey")
    return _keys(df, "short(hash),0,false,0", "o_orderkey")


@query(
    "SELECT event_id, repeat('0', greatest(0, 6 - strlen(user_id::VARCHAR))) || user_id::VARCHAR || event_type || repeat('_', greatest(0, 10 - strlen(event_type))) || (epoch_us(ts) // 1000)::VARCHAR AS rk FROM events"
)
def rk_composite(spark, sf):
    return _keys(_read(spark, sf, "events"), "USER,2,false,6#TYPE,3,false,10,RIGHT,_#TS,1,false,0", "event_id")


@query("SELECT 5::BIGINT AS n_rows, 5::BIGINT AS n_valid")
def rk_random_shape(spark, sf):
    keys = _keys(_read(spark, sf, "region"), "$RND$,0,false,10", "r_regionkey", seed=7)
    return keys.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("rk").rlike("^[0-8]{10}$")).alias("n_valid"))


@query("SELECT c_custkey, list_extract(string_split(v, '|'), 2) AS second, len(string_split(v, '|'))::BIGINT AS n_fields FROM (SELECT c_custkey, c_custkey::VARCHAR || '|' || c_name || '||' || c_mktsegment AS v FROM customer)")
def split_row_value(spark, sf):
    value = F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.lit(""), "c_mktsegment")
    f = X.split_row_value(value)
    return _read(spark, sf, "customer").select("c_custkey", f[1].alias("second"), F.size(f).cast("long").alias("n_fields"))


# ---- values


def _values(df: DataFrame, keep: str, **excluded) -> DataFrame:
    return df.select(keep, X.row_value(visible(df, **excluded)).alias("v"))


@query("SELECT c_custkey, c_custkey::VARCHAR || '|' || c_name || '|' || c_nationkey::VARCHAR || '|' || printf('%.6f', c_acctbal) || '|' || c_mktsegment AS v FROM customer")
def value_join_all(spark, sf):
    return _values(_read(spark, sf, "customer"), "c_custkey")


@query("SELECT p_partkey, p_partkey::VARCHAR || '|' || p_name || '|' || p_type || '|' || p_size::VARCHAR AS v FROM part")
def value_join_excluded(spark, sf):
    return _values(_read(spark, sf, "part"), "p_partkey", excluded=("p_brand", "p_retailprice", "P_NAME"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR || '|' || coalesce(nullif(o_orderstatus, 'F'), '') || '|' || printf('%.6f', o_totalprice) AS v FROM orders")
def value_join_prefix(spark, sf):
    df = _read(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    return _values(df, "o_orderkey", excluded=("o_custkey",), prefixes=("o_orderd", "o_orderp", ""))


@query("SELECT event_id, (epoch_us(ts) // 1000)::VARCHAR AS v FROM events")
def value_timestamp_ms(spark, sf):
    df = _read(spark, sf, "events")
    return df.select("event_id", X.text_of(F.col("ts"), df.schema["ts"].dataType).alias("v"))


@query("SELECT event_id, printf('%.6f', value) AS small, printf('%.6f', value * 123456789) AS large, printf('%.6f', -value * 987654321012) AS larger FROM events")
def value_floats(spark, sf):
    v = F.col("value")
    return _read(spark, sf, "events").select("event_id", X.float_text(v).alias("small"), X.float_text(v * 123456789).alias("large"), X.float_text(-v * 987654321012).alias("larger"))


@query("SELECT doc_id, to_base64(encode(text)) AS v FROM documents")
def value_base64(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", X.base64_text(F.encode("text", "UTF-8")).alias("v"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS v, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def value_bool(spark, sf):
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.bool_text(F.col("l_returnflag") == "R").alias("v")).groupBy("l_orderkey", "l_linenumber", "v").agg(F.count(F.lit(1)).alias("n"))


# ---- conversion

_ORDERS = ConvertOptions(rule="CUST,1,false,10", default_timestamp_ms=1715678900123, order=("o_orderkey",))
_ORDER_VALUE = "o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR || '|' || o_orderstatus || '|' || printf('%.6f', o_totalprice) || '|' || (epoch_us(o_orderdate) // 1000)::VARCHAR || '|' || o_orderpriority"
_FIRST_ORDERS = f"""
SELECT lpad(o_custkey::VARCHAR, 10, '0') AS row, 'cf' AS family, '' AS qualifier, 1715678900123::BIGINT AS ts, 4::SMALLINT AS type, {_ORDER_VALUE} AS value
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1"""


@query(_FIRST_ORDERS)
def convert_orders(spark, sf):
    return convert(_read(spark, sf, "orders"), _ORDERS).cells


@query(
    "SELECT sum(n)::BIGINT AS rows_read, count(*)::BIGINT AS written, sum(n - 1)::BIGINT AS skipped, count(*) FILTER (n > 1)::BIGINT AS duplicate_keys FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)"
)
def convert_counters(spark, sf):
    return convert(_read(spark, sf, "orders"), _ORDERS).counters


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def dedup_first(spark, sf):
    return dedup.first_wins(_read(spark, sf, "orders").withColumn("_o", F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice", "_o"), ["o_custkey"], "_o")


@query(
    "SELECT k AS rk, count(*)::BIGINT AS n_rows, CASE WHEN strlen(k) <= 64 THEN k ELSE left(k, 64) || '...(+' || (strlen(k) - 64)::VARCHAR || 'B)' END AS shown FROM (SELECT repeat(lpad(o_custkey::VARCHAR, 10, '0'), 7) AS k FROM orders) GROUP BY k HAVING count(*) > 1"
)
def dup_report(spark, sf):
    keys = _keys(_read(spark, sf, "orders"), "#".join(["CUST,1,false,10"] * 7), "o_orderkey")
    return dedup.duplicate_report(keys, "rk")


@query(
    "SELECT sum(n)::BIGINT AS rows_read, count(*) FILTER (k <> '')::BIGINT AS written, sum(CASE WHEN k <> '' THEN n - 1 ELSE n END)::BIGINT AS skipped, count(*) FILTER (k <> '' AND n > 1)::BIGINT AS duplicate_keys "
    "FROM (SELECT CASE WHEN user_id % 7 = 0 THEN '' ELSE lpad(user_id::VARCHAR, 8, '0') || event_type END AS k, count(*) AS n FROM events GROUP BY 1)"
)
def skip_empty_keys(spark, sf):
    df = _read(spark, sf, "events").withColumn("user_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    rows, _ = keyed(df, ConvertOptions(rule="USER,2,false,8#TYPE,3,false,0", order=("event_id",)))
    return counters(rows)


@query("SELECT lpad(o_custkey::VARCHAR, 10, '0') AS row, row_number() OVER (ORDER BY lpad(o_custkey::VARCHAR, 10, '0'))::BIGINT AS rank FROM (SELECT DISTINCT o_custkey FROM orders)")
def sorted_cells_rank(spark, sf):
    rows = _keys(_read(spark, sf, "orders"), "CUST,1,false,10", "o_orderkey").select(F.col("rk").alias("row")).distinct()
    return regions.ranked(rows, "row")


@query(
    "SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL) WHERE n > 1"
)
def autosort_conflicts(spark, sf):
    return cells.duplicate_cells(_read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumnRenamed("n_cells", "n")


def _lineitem_cells(spark, sf):
    df = _read(spark, sf, "lineitem")
    return df.select(
        "l_returnflag", F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("row"), F.lit("cf").alias("family"), F.col("l_linestatus").alias("qualifier"), F.col("l_suppkey").alias("ts"), F.lit(4).cast("short").alias("type"),
        F.struct("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("_o"),
    )


@query(
    "SELECT l_returnflag, count(*)::BIGINT AS n FROM (SELECT l_returnflag, struct_pack(r := lpad(l_orderkey::VARCHAR, 10, '0'), q := l_linestatus, t := -l_suppkey) AS k, "
    "lag(struct_pack(r := lpad(l_orderkey::VARCHAR, 10, '0'), q := l_linestatus, t := -l_suppkey)) OVER (PARTITION BY l_returnflag ORDER BY l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS b FROM lineitem) WHERE k <= b GROUP BY l_returnflag"
)
def sort_violations(spark, sf):
    return cells.sort_violations(_lineitem_cells(spark, sf), ["l_returnflag"], F.col("_o"), along=F.col("_o.l_partkey")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


# ---- cells


def _document_cells(spark, sf):
    return _read(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("batch"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.repeat(F.lit("k"), (F.col("doc_id") % 40).cast("int"))).alias("row"), F.lit("cf").alias("family"), F.lit("").alias("qualifier"),
        F.when(F.col("doc_id") % 13 == 0, -1).otherwise(F.col("doc_id")).cast("long").alias("ts"), F.lit(4).cast("short").alias("type"), F.col("text").alias("value"),
    )


_LIMITS = {"max_row": 35, "max_value": 5000}
_DOC_ROW = "CASE WHEN doc_id % 11 = 0 THEN '' ELSE repeat('k', (doc_id % 40)::INT) END"
_DOC_REASON = f"CASE WHEN strlen({_DOC_ROW}) = 0 THEN 'ROW_EMPTY' WHEN strlen({_DOC_ROW}) > 35 THEN 'ROW_TOO_LONG' WHEN coalesce(strlen(text), 0) > 5000 THEN 'VALUE_TOO_LONG' WHEN doc_id % 13 = 0 THEN 'NEGATIVE_TIMESTAMP' END"


@query(f"SELECT doc_id, {_DOC_REASON} AS error_reason FROM documents")
def cell_validation(spark, sf):
    return _document_cells(spark, sf).select("doc_id", cells.error_reason(**_LIMITS).alias("error_reason"))


@query(f"SELECT doc_id FROM documents WHERE ({_DOC_REASON}) IS NULL")
def error_policy_skiprow(spark, sf):
    return cells.validate(_document_cells(spark, sf), "skip_row", max_errors=0, **_LIMITS)[0].select("doc_id")


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 13 = 0 AND doc_id % 11 = 0)")
def error_policy_skipbatch(spark, sf):
    df = _document_cells(spark, sf).withColumns({"row": F.lit("r"), "value": F.lit(""), "ts": F.when((F.col("doc_id") % 13 == 0) & (F.col("doc_id") % 11 == 0), -1).otherwise(1).cast("long")})
    return cells.validate(df, "skip_batch", batch="batch")[0].select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def family_check(spark, sf):
    df = _document_cells(spark, sf).join(_read(spark, sf, "documents").select("doc_id", F.col("lang")), "doc_id").withColumns({"row": F.lit("r"), "ts": F.lit(1).cast("long"), "family": F.col("lang")})
    return cells.validate(df, "skip_row", max_errors=0, family="en")[0].select("doc_id")


@query(
    "SELECT event_id, (CASE WHEN user_id % 3 = 0 THEN user_id ELSE 0 END)::BIGINT AS memstore_ts, user_id % 3 = 0 AND user_id > 0 AS has_memstore_ts FROM events"
)
def sanitised_cells(spark, sf):
    df = _read(spark, sf, "events").select("event_id", F.encode("props", "UTF-8").alias("tags"), F.when(F.col("user_id") % 3 == 0, F.col("user_id")).otherwise(0).cast("long").alias("memstore_ts"))
    return cells.sanitise(df, include_tags=False, include_mvcc=True).filter(F.octet_length("tags") == 0).select("event_id", "memstore_ts", "has_memstore_ts")


_OC = f"WITH c AS ({_FIRST_ORDERS})"


@query(f"{_OC} SELECT row, (8 + 12 + strlen(row) + strlen(family) + strlen(qualifier) + strlen(value) + 2)::BIGINT AS bytes FROM c")
def encoded_sizes(spark, sf):
    return convert_orders(spark, sf).select("row", cells.encoded_size().cast("long").alias("bytes"))


@query(
    f"{_OC} SELECT row, to_hex(unhex(lpad(to_hex(12 + strlen(row) + 2), 8, '0')) || unhex(lpad(to_hex(strlen(value)), 8, '0')) || unhex(lpad(to_hex(strlen(row)), 4, '0')) || encode(row) || unhex('02') || encode('cf') || unhex(lpad(to_hex(ts), 16, '0')) || unhex('04') || encode(value) || unhex('0000')) AS cell FROM c"
)
def cell_binary(spark, sf):
    return convert_orders(spark, sf).select("row", F.hex(cells.cell_bytes()).alias("cell"))


@query(
    "SELECT o_orderkey, CASE WHEN v BETWEEN -112 AND 127 THEN 1 ELSE 1 + (strlen(ltrim(to_hex(CASE WHEN v < 0 THEN -(v + 1) ELSE v END), '0')) + 1) // 2 END::BIGINT AS size FROM (SELECT o_orderkey, (o_orderkey - 500) * 1000003 AS v FROM orders)"
)
def vint_sizes(spark, sf):
    return _read(spark, sf, "orders").select("o_orderkey", cells.writable_vint_size((F.col("o_orderkey") - 500) * 1000003).cast("long").alias("size"))


@query(
    f"""WITH c AS (SELECT o_orderpriority, lpad(o_orderkey::VARCHAR, 10, '0') AS row, 'cf' AS family, '' AS qualifier, {_ORDER_VALUE} AS value FROM orders),
s AS (SELECT *, 12 + 12 + strlen(row) + strlen(family) + strlen(qualifier) + strlen(value) AS big, row_number() OVER (PARTITION BY o_orderpriority ORDER BY 12 + 12 + strlen(row) + strlen(family) + strlen(value) DESC, row) AS n FROM c)
SELECT o_orderpriority, count(*)::BIGINT AS entries, (sum(12 + strlen(row) + strlen(family)) // count(*))::BIGINT AS avg_key_len, (sum(strlen(value)) // count(*))::BIGINT AS avg_value_len,
  max(big)::BIGINT AS biggest_len, max(row) FILTER (n = 1) AS biggest_row, min(row) AS first_row, max(row) AS last_row FROM s GROUP BY o_orderpriority"""
)
def file_stats(spark, sf):
    return cells.file_stats(_order_cells(spark, sf), ["o_orderpriority"]).withColumn("biggest_len", F.col("biggest_len").cast("long"))


def _order_cells(spark, sf):
    df = _read(spark, sf, "orders")
    return df.select("o_orderpriority", F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("row"), F.lit("cf").alias("family"), F.lit("").alias("qualifier"), F.lit(1).cast("long").alias("ts"), F.lit(4).cast("short").alias("type"), X.row_value(visible(df)).alias("value"))


@query("SELECT lang, max(strlen(text))::BIGINT AS bytes, arg_min(doc_id, struct_pack(a := -strlen(text), b := doc_id)) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY lang")
def biggest_cell(spark, sf):
    size = F.octet_length("text").cast("long")
    return _read(spark, sf, "documents").filter("text is not null").groupBy("lang").agg(F.max(size).alias("bytes"), F.max_by("doc_id", F.struct(size, -F.col("doc_id"))).alias("doc_id"))


@query(
    "SELECT o_orderkey, CASE WHEN v BETWEEN -112 AND 127 THEN right('0' || to_hex(v), 2) ELSE to_hex((CASE WHEN v < 0 THEN 136 ELSE 144 END) - n) || lpad(x, (2 * n)::INT, '0') END AS code "
    "FROM (SELECT *, (strlen(x) + 1) // 2 AS n FROM (SELECT o_orderkey, v, ltrim(to_hex(CASE WHEN v < 0 THEN -(v + 1) ELSE v END), '0') AS x FROM (SELECT o_orderkey, (o_orderkey - 500) * (o_orderkey % 3 * 1000002 + 1) AS v FROM orders)))"
)
def vint_bytes(spark, sf):
    v = (F.col("o_orderkey") - 500) * (F.col("o_orderkey") % 3 * 1000002 + 1)
    return _read(spark, sf, "orders").select("o_orderkey", F.hex(encoding.writable_vint_bytes(v)).alias("code"))


@query(
    """WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda e: ('0x' || e)::BIGINT) AS b FROM documents),
c AS (SELECT doc_id, chunk, b[(chunk * 16384 + 1):((chunk + 1) * 16384)] AS p FROM (SELECT doc_id, b, unnest(range((len(b) + 16383) // 16384)) AS chunk FROM b))
SELECT doc_id, chunk, xor(list_reduce(list_prepend(4294967295::BIGINT, p), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) AS checksum FROM c, t"""
)
def block_checksums(spark, sf):
    sums = encoding.checksums(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(sums).alias("chunk", "checksum")).withColumn("chunk", F.col("chunk").cast("long"))


@query(
    "SELECT n_regionkey AS f, count(*)::BIGINT AS n_entries, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1"
)
def meta_map(spark, sf):
    entries = _read(spark, sf, "nation").select(F.col("n_regionkey").alias("f"), F.col("n_name").alias("name"), F.encode("n_name", "UTF-8").alias("value"))
    return layout.meta_map(entries, ["f"]).select("f", F.size("meta").cast("long").alias("n_entries"), F.array_join(F.map_keys("meta"), ",").alias("names"))


@query(
    "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'org.apache.hadoop.hbase.KeyValue$KVComparator' WHEN 1 THEN 'org.apache.hadoop.hbase.KeyValue$MetaComparator' ELSE r_name END AS name FROM region"
)
def comparator_map(spark, sf):
    k = F.col("r_regionkey")
    name = F.when(k == 0, "org.apache.hadoop.hbase.CellComparatorImpl").when(k == 1, "org.apache.hadoop.hbase.MetaCellComparator").otherwise(F.col("r_name"))
    return _read(spark, sf, "region").select("r_regionkey", layout.comparator(name).alias("name"))


# ---- regions

_SPLITS = ["0000000200", "0000000500", "0000000501", "0000001200"]
_REGION = " + ".join(f"(rk >= '{s}')::INT" for s in _SPLITS)


@query(f"SELECT o_orderkey, {_REGION} AS region FROM (SELECT o_orderkey, lpad(o_custkey::VARCHAR, 10, '0') AS rk FROM orders)")
def region_assign(spark, sf):
    keys = _keys(_read(spark, sf, "orders"), "CUST,1,false,10", "o_orderkey")
    return regions.assign(keys, "rk", _SPLITS).select("o_orderkey", "region")


@query(f"SELECT {_REGION} AS region, count(*)::BIGINT AS n, min(rk) AS first_key, max(rk) AS last_key FROM (SELECT lpad(o_custkey::VARCHAR, 10, '0') AS rk FROM orders) GROUP BY 1")
def region_counts(spark, sf):
    keys = _keys(_read(spark, sf, "orders"), "CUST,1,false,10", "o_orderkey")
    return regions.assign(keys, "rk", _SPLITS).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("rk").alias("first_key"), F.max("rk").alias("last_key"))


# ---- blocks, index, Bloom filters

_BLOCKS = f"""WITH RECURSIVE c AS (SELECT o_orderpriority AS f, lpad(o_orderkey::VARCHAR, 10, '0') AS row, 8 + 12 + 10 + 2 + strlen({_ORDER_VALUE}) + 2 AS size,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i FROM orders),
b AS (SELECT f, row, size, i, 0::BIGINT AS block, size AS held FROM c WHERE i = 1
  UNION ALL SELECT c.f, c.row, c.size, c.i, b.block + (b.held >= 4096)::BIGINT, CASE WHEN b.held >= 4096 THEN c.size ELSE b.held + c.size END FROM b JOIN c ON c.f = b.f AND c.i = b.i + 1)"""
_STATS = f"{_BLOCKS}, s AS (SELECT f AS o_orderpriority, block, count(*)::BIGINT AS entries, sum(size)::BIGINT AS raw_bytes, min(row) AS first_key, max(row) AS last_key FROM b GROUP BY f, block)"


@query(f"{_BLOCKS} SELECT f AS o_orderpriority, row, block FROM b")
def block_assign(spark, sf):
    sized = _order_cells(spark, sf).select("o_orderpriority", "row", cells.encoded_size().cast("long").alias("size"))
    return layout.assign_blocks(sized, ["o_orderpriority"], ["row"], "size", 4096).select("o_orderpriority", "row", "block")


def _stats(spark, sf):
    sized = _order_cells(spark, sf).select("o_orderpriority", "row", cells.encoded_size().cast("long").alias("size"))
    return layout.block_stats(layout.assign_blocks(sized, ["o_orderpriority"], ["row"], "size", 4096), ["o_orderpriority"], "row", "size")


@query(f"{_STATS} SELECT * FROM s")
def block_stats(spark, sf):
    return _stats(spark, sf)


@query(
    f"""{_STATS}, l AS (SELECT o_orderpriority, block, first_key, 0::BIGINT AS leaf, 8 + 16 + strlen(first_key) AS held FROM s WHERE block = 0
  UNION ALL SELECT s.o_orderpriority, s.block, s.first_key, l.leaf + (l.held >= 512)::BIGINT, CASE WHEN l.held >= 512 THEN 8 ELSE l.held END + 16 + strlen(s.first_key) FROM l JOIN s ON s.o_orderpriority = l.o_orderpriority AND s.block = l.block + 1)
SELECT o_orderpriority, leaf, count(*)::BIGINT AS entries, min(first_key) AS first_key FROM l GROUP BY o_orderpriority, leaf"""
)
def leaf_index(spark, sf):
    return layout.leaf_index(_stats(spark, sf), ["o_orderpriority"], 512)


@query(f"{_STATS} SELECT o_orderpriority, block // 16 AS node, count(*)::BIGINT AS entries, min(first_key) AS first_key FROM s GROUP BY o_orderpriority, block // 16")
def middle_index(spark, sf):
    return layout.middle_index(_stats(spark, sf), ["o_orderpriority"], 16)


@query(
    f"""{_STATS}, k AS (SELECT *, lag(last_key) OVER (PARTITION BY o_orderpriority ORDER BY block) AS b FROM s),
d AS (SELECT *, (SELECT min(i) FROM range(1, 11) AS r(i) WHERE substr(b, i::INT, 1) <> substr(first_key, i::INT, 1))::INT AS p FROM k)
SELECT o_orderpriority, block, CASE WHEN b IS NULL THEN first_key ELSE left(b, p - 1) || chr(ascii(substr(b, p, 1)) + 1) END AS index_key FROM d"""
)
def midpoint_keys(spark, sf):
    return layout.block_separators(_stats(spark, sf), ["o_orderpriority"]).select("o_orderpriority", "block", "index_key")


@query(
    """WITH k AS (SELECT o_orderpriority, count(*) * 100 AS n FROM orders GROUP BY 1),
p AS (SELECT 1048576 AS bits, (1048576 * (pow(ln(2), 2) / -ln(0.01)))::DOUBLE AS ideal), q AS (SELECT bits, ceil(ln(2) * (bits // floor(ideal)))::INT AS h FROM p),
m AS (SELECT h, floor(-bits / h * ln(1 - exp(ln(0.01) / h)))::BIGINT AS most FROM q)
SELECT o_orderpriority, h AS hash_count, most AS max_keys, ceil(n / most)::BIGINT AS chunks FROM k, m"""
)
def bloom_sizing(spark, sf):
    n = _read(spark, sf, "orders").groupBy("o_orderpriority").agg((F.count(F.lit(1)) * 100).alias("n"))
    return n.withColumn("b", layout.bloom_sizing(F.col("n"))).select("o_orderpriority", "b.hash_count", "b.max_keys", "b.chunks")


@query("SELECT DISTINCT lpad(o_custkey::VARCHAR, 10, '0') AS row FROM orders")
def bloom_row_keys(spark, sf):
    rows = _keys(_read(spark, sf, "orders"), "CUST,1,false,10", "o_orderkey").select(F.col("rk").alias("row"), F.lit("").alias("qualifier"))
    return layout.bloom_keys(rows, "row")


_M = 4294967295
#: Bytes of a text as numbers, and steps of the hash over them, each modulo 2^32; a product of two factors stays below 2^63.
_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda e: ('0x' || e)::BIGINT)"
_WORDS = (
    "list_transform(list_transform(range(len({0}) // 4), lambda i: (({0}[4 * i + 1] + {0}[4 * i + 2] * 256 + {0}[4 * i + 3] * 65536 + {0}[4 * i + 4] * 16777216) * 1540483477) & 4294967295), "
    "lambda k: (xor(k, k >> 24) * 1540483477) & 4294967295)"
)
_TAIL = "list_transform(range(len({0}) % 4), lambda i: (CASE WHEN {0}[len({0}) // 4 * 4 + i + 1] > 127 THEN {0}[len({0}) // 4 * 4 + i + 1] - 256 ELSE {0}[len({0}) // 4 * 4 + i + 1] END * (1 << (8 * i)::INT)) & 4294967295)"


def _murmur(source: str, columns: str, seed: str = "0") -> str:
    """SQL that adds `h`, the unsigned hash of the bytes `b`, to the columns of `source`."""
    body = f"list_reduce(list_prepend(xor(({seed}) & {_M}, len(b)), w), lambda x, k: xor((x * 1540483477) & {_M}, k))"
    tail = f"CASE WHEN len(t) > 0 THEN (list_reduce(list_prepend(x, t), lambda p, q: xor(p, q)) * 1540483477) & {_M} ELSE x END"
    return (
        f"(SELECT {columns}, xor(z, z >> 15) AS h FROM (SELECT *, (xor(y, y >> 13) * 1540483477) & {_M} AS z FROM (SELECT *, {tail} AS y FROM (SELECT *, {body} AS x "
        f"FROM (SELECT *, {_WORDS.format('b')} AS w, {_TAIL.format('b')} AS t FROM {source})))))"
    )


_SIGNED = "CASE WHEN {0} > 2147483647 THEN {0} - 4294967296 ELSE {0} END"


def _positions(source: str, columns: str, hashes: int, bits: int) -> str:
    """SQL that adds `at`, the list of places in a filter, to the columns of `source` (with bytes `b`)."""
    first = _murmur(source, f"{columns}, b")
    both = _murmur(f"(SELECT * EXCLUDE (h), h AS g FROM {first})", f"{columns}, g", "g")
    mixed = f"list_transform(range({hashes}), lambda i: (g + i * h) & {_M})"
    return f"(SELECT {columns}, list_transform({mixed}, lambda v: abs({_SIGNED.format('v')}) % {bits}) AS spots FROM {both})"


@query(f"SELECT c_custkey, ({_SIGNED.format('h')})::INT AS hash FROM {_murmur('(SELECT c_custkey, ' + _BYTES.format('c_name') + ' AS b FROM customer)', 'c_custkey')}")
def bloom_murmur(spark, sf):
    return _read(spark, sf, "customer").select("c_custkey", layout.murmur_hash(F.col("c_name")).alias("hash"))


def _filters(spark, sf):
    keys = _read(spark, sf, "orders").select("o_orderpriority", F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("row"))
    return layout.bloom_chunks(keys, ["o_orderpriority"], "row", 500, 7, 1024)


_KEYS = "(SELECT DISTINCT o_orderpriority, lpad(o_custkey::VARCHAR, 10, '0') AS row FROM orders)"
_CHUNKS = f"(SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY row) - 1) // 500 AS chunk, {_BYTES.format('row')} AS b FROM {_KEYS})"
_PLACES = _positions(_CHUNKS, "o_orderpriority, row, chunk", 7, 8192)


@query(
    f"""WITH p AS (SELECT * FROM {_PLACES}), n AS (SELECT o_orderpriority, chunk, count(*)::BIGINT AS n_keys, hex(encode(min(row))) AS first_key FROM p GROUP BY 1, 2),
s AS (SELECT o_orderpriority, chunk, count(DISTINCT v)::BIGINT AS n_bits, sum(DISTINCT v)::BIGINT AS sum_of_places FROM (SELECT o_orderpriority, chunk, unnest(spots) AS v FROM p) GROUP BY 1, 2)
SELECT o_orderpriority, chunk, n_keys, first_key, n_bits, sum_of_places FROM n JOIN s USING (o_orderpriority, chunk)"""
)
def bloom_build(spark, sf):
    """Every filter by its keys, its first key, how many bits it has and the sum of their places."""
    f = _filters(spark, sf).withColumn("m", layout.bloom_marks("bits"))
    return f.select("o_orderpriority", "chunk", "n_keys", F.hex("first_key").alias("first_key"), "m.n_bits", "m.sum_of_places")


@query(
    f"""WITH p AS (SELECT * FROM {_PLACES}), f AS (SELECT o_orderpriority, chunk, min(row) AS first_key, list(DISTINCT v) AS bits FROM (SELECT o_orderpriority, row, chunk, unnest(spots) AS v FROM p) GROUP BY 1, 2),
a AS (SELECT c_custkey, f.p AS o_orderpriority, lpad(c_custkey::VARCHAR, 10, '0') AS row FROM customer, (SELECT DISTINCT o_orderpriority AS p FROM orders) AS f),
q AS (SELECT * FROM {_positions('(SELECT *, ' + _BYTES.format('row') + ' AS b FROM a)', 'c_custkey, o_orderpriority, row', 7, 8192)}),
w AS (SELECT q.*, (SELECT max(chunk) FROM f WHERE f.o_orderpriority = q.o_orderpriority AND f.first_key <= q.row) AS chunk FROM q)
SELECT w.o_orderpriority, count(*)::BIGINT AS asked, count(*) FILTER (list_has_all(f.bits, w.spots))::BIGINT AS may_contain,
  count(*) FILTER (o.row IS NOT NULL)::BIGINT AS held, count(*) FILTER (o.row IS NOT NULL AND NOT coalesce(list_has_all(f.bits, w.spots), false))::BIGINT AS missed
FROM w LEFT JOIN f ON f.o_orderpriority = w.o_orderpriority AND f.chunk = w.chunk LEFT JOIN {_KEYS} AS o ON o.o_orderpriority = w.o_orderpriority AND o.row = w.row GROUP BY 1"""
)
def filter_probe(spark, sf):
    """Every customer asked of every priority's filters: how many may be there, how many are, and how many of these a filter missed."""
    files = _read(spark, sf, "orders").select("o_orderpriority").distinct()
    asked = _read(spark, sf, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("row"), F.explode(F.array(*[F.lit(r[0]) for r in files.collect()])).alias("o_orderpriority"))  # five files
    probed = layout.filter_probe(asked, _filters(spark, sf), "row", 7)
    held = _read(spark, sf, "orders").select("o_orderpriority", F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("row"), F.lit(True).alias("held")).distinct()
    both = probed.join(held, ["o_orderpriority", "row"], "left")
    return both.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if("may_contain").alias("may_contain"), F.count_if("held").alias("held"), F.count_if(F.col("held") & ~F.col("may_contain")).alias("missed")
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def might_contain(spark, sf):
    """Members of one file: its filters rule most others out, a join settles the rest."""
    keys = _read(spark, sf, "orders").filter(F.col("o_orderpriority").startswith("1")).select("o_orderpriority", F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("row"))
    chunks = layout.bloom_chunks(keys, ["o_orderpriority"], "row", 500, 7, 1024)
    asked = _read(spark, sf, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("row"), F.lit("1-URGENT").alias("o_orderpriority"))
    return layout.filter_probe(asked, chunks, "row", 7).filter("may_contain").join(keys, ["o_orderpriority", "row"], "left_semi").select("c_custkey")


@query(
    "SELECT o_orderkey, lpad(hex(strlen(lpad(o_custkey::VARCHAR, 10, '0'))), 4, '0') || hex(encode(lpad(o_custkey::VARCHAR, 10, '0'))) || '00' || hex(encode(o_orderpriority)) || '7F' || repeat('FF', 8) AS filter_key FROM orders"
)
def bloom_rowcol_keys(spark, sf):
    cells_ = _read(spark, sf, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("row"), F.col("o_orderpriority").alias("qualifier"))
    return cells_.select("o_orderkey", F.hex(layout.rowcol_column(F.col("row"), F.col("qualifier"))).alias("filter_key"))


@query(
    f"""{_STATS}, p AS (SELECT o_orderpriority, 'DATA' AS category, raw_bytes + 33 AS bytes FROM s UNION ALL SELECT o_orderpriority, 'INDEX', 20 * count(*) + 33 FROM s GROUP BY 1 UNION ALL SELECT DISTINCT o_orderpriority, 'FILE_INFO', 300 FROM s UNION ALL SELECT DISTINCT o_orderpriority, 'TRAILER', 4096 FROM s)
SELECT o_orderpriority, sum(bytes) FILTER (category = 'DATA')::BIGINT AS data_bytes, count(*) FILTER (category = 'DATA')::BIGINT AS data_blocks, sum(bytes) FILTER (category = 'INDEX')::BIGINT AS index_bytes, sum(bytes)::BIGINT AS accounted_bytes, true AS complete FROM p GROUP BY 1"""
)
def layout_summary(spark, sf):
    s = _stats(spark, sf)
    part = lambda df, c, b: df.select("o_orderpriority", F.lit(c).alias("category"), b.cast("long").alias("bytes"))
    files = s.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    parts = part(s, "DATA", F.col("raw_bytes") + 33).unionByName(part(files, "INDEX", F.col("n") * 20 + 33)).unionByName(part(files, "FILE_INFO", F.lit(300))).unionByName(part(files, "TRAILER", F.lit(4096)))
    size = parts.groupBy("o_orderpriority").agg(F.sum("bytes").alias("file_bytes"))
    return layout.layout_summary(parts.join(size, "o_orderpriority"), ["o_orderpriority"]).select("o_orderpriority", "data_bytes", "data_blocks", "index_bytes", "accounted_bytes", "complete")


# ---- merging and batches


@query("SELECT event_type, source_ordinal, count(*)::BIGINT AS n FROM (SELECT *, 0 AS source_ordinal FROM events WHERE event_id % 2 = 0 UNION ALL SELECT *, 1 FROM events WHERE event_id % 2 = 1) GROUP BY ALL")
def merge_union(spark, sf):
    df = _read(spark, sf, "events")
    return batches.merge([df.filter("event_id % 2 = 0"), df.filter("event_id % 2 = 1")]).groupBy("event_type", "source_ordinal").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS merged, (SELECT count(*) FROM (SELECT DISTINCT user_id, date_trunc('day', ts) FROM events))::BIGINT AS per_file")
def merge_conflict_dedup(spark, sf):
    """Keys are unique in a merged batch, but only within each file otherwise."""
    df = _read(spark, sf, "events").select("user_id", F.date_trunc("day", "ts").alias("file"), "event_id")
    merged = dedup.first_wins(df.select("user_id", "event_id", F.col("event_id").alias("_o")), ["user_id"], "_o").agg(F.count(F.lit(1)).alias("merged"))
    files = dedup.first_wins(df.select("user_id", "file", "event_id", F.col("event_id").alias("_o")), ["file", "user_id"], "_o").agg(F.count(F.lit(1)).alias("per_file"))
    return merged.crossJoin(files)  # one row each


_FILES = "SELECT 'f' || lpad(c_custkey::VARCHAR, 8, '0') AS path, (c_custkey * 7919 % 300 + 1) * 1048576 AS bytes, c_custkey * 9000 AS mtime_ms FROM customer"


def _files(spark, sf):
    k = F.col("c_custkey")
    return _read(spark, sf, "customer").select(F.concat(F.lit("f"), F.lpad(k.cast("string"), 8, "0")).alias("path"), ((k * 7919 % 300 + 1) * 1048576).alias("bytes"), (k * 9000).alias("mtime_ms"))


@query(
    f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (ORDER BY path) AS i FROM ({_FILES})),
b AS (SELECT path, i, 0::BIGINT AS batch, bytes AS size, 1::BIGINT AS n, mtime_ms AS since FROM f WHERE i = 1
  UNION ALL SELECT path, i, CASE WHEN c THEN batch + 1 ELSE batch END, CASE WHEN c THEN bytes ELSE size + bytes END, CASE WHEN c THEN 1 ELSE n + 1 END, CASE WHEN c THEN mtime_ms ELSE since END
  FROM (SELECT f.path, f.i, f.bytes, f.mtime_ms, b.batch, b.size, b.n, b.since, (b.size + f.bytes >= 536870912 OR b.n >= 500 OR f.mtime_ms - b.since >= 180000) AS c FROM b JOIN f ON f.i = b.i + 1))
SELECT path, batch FROM b"""
)
def batch_partition(spark, sf):
    return batches.batch_ids(_files(spark, sf))


@query(f"SELECT count(*)::BIGINT AS files, sum(bytes)::BIGINT AS total_bytes, (sum(bytes) // count(*))::BIGINT AS mean_bytes, CASE WHEN sum(bytes) // count(*) < 104857600 THEN 'merge-then-convert' ELSE 'parallel-convert' END AS strategy FROM ({_FILES})")
def batch_strategy(spark, sf):
    return batches.strategy(_files(spark, sf))


@query("SELECT count(*) FILTER (c_nationkey <> 3)::BIGINT AS succeeded, count(*) FILTER (c_nationkey = 3)::BIGINT AS failed, sum(c_custkey) FILTER (c_nationkey <> 3)::BIGINT AS cells, sum(strlen(c_name)) FILTER (c_nationkey <> 3)::BIGINT AS bytes FROM customer")
def batch_totals(spark, sf):
    df = _read(spark, sf, "customer").select(F.col("c_name").alias("path"), F.when(F.col("c_nationkey") == 3, 10).otherwise(0).alias("error_code"), F.col("c_custkey").alias("cells"), F.octet_length("c_name").cast("long").alias("bytes"))
    return metrics.batch_totals(df)


@query("SELECT o_orderkey, regexp_replace(o_orderpriority || '.arrow', '\\.arrow$', '') || '.cells' AS single, regexp_replace(o_orderpriority, '[^a-zA-Z0-9_-]', '_', 'g') || '_' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '.cells' AS merged FROM orders")
def output_names(spark, sf):
    name = F.concat("o_orderpriority", F.lit(".arrow"))
    return _read(spark, sf, "orders").select("o_orderkey", cells_io.output_name(name).alias("single"), cells_io.merged_name(F.col("o_orderpriority"), (F.col("o_orderkey") % 1000).cast("int")).alias("merged"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def skip_existing(spark, sf):
    done = _read(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return cells_io.not_yet_written(_read(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


_DIRECTORY = ("nation", "region", "supplier", "customer", "part")


@query(
    "SELECT 'region' AS name, 1 AS error_code, 0::BIGINT AS cells UNION ALL SELECT 'nation', 0, count(*) FROM nation UNION ALL SELECT 'supplier', 0, count(*) FROM supplier "
    "UNION ALL SELECT 'customer', 0, count(*) FROM customer UNION ALL SELECT 'part', 0, count(*) FROM part"
)
def directory_convert(spark, sf):
    """Five files at once, each to cells of its own; one of them isn't there, and the others go on."""
    names = {name: f"{sf}/{name}.parquet" for name in _DIRECTORY}
    how, target = directory.DirectoryOptions(form="parquet", parallelism=4), cells_io.scratch(spark, "directory-convert")

    def one(path: str, output: str) -> tuple[int, int]:
        if path.endswith("region.parquet"):
            raise InvalidArgument("this file is refused")
        return directory.write(*directory.read(spark, how.form, path), output, ConvertOptions(rule="KEY,0,false,10"), how.sink)

    outcome = batches.convert_each(spark, [(p, f"{target}/{n}") for n, p in names.items()], one, how.parallelism)
    return outcome.select(F.element_at(F.split("output", "/"), -1).alias("name"), "error_code", "cells")


# ---- verification


def _expected(spark, sf):
    df = _read(spark, sf, "orders")
    return df.select(F.col("o_orderkey").alias("row"), F.lit("cf").alias("family"), F.col("o_orderpriority").alias("value"))


def _actual(spark, sf):
    e = _expected(spark, sf).filter(F.col("row") % 97 != 0)
    return e.withColumn("value", F.when(F.col("row") % 89 == 0, "changed").otherwise(F.col("value")))


@query("SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'MISSING' WHEN o_orderkey % 89 = 0 THEN 'MISMATCH' ELSE 'OK' END AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def deep_verify(spark, sf):
    return verify.verdict(verify.deep_verify(_expected(spark, sf), _actual(spark, sf), ["row", "family"]))


@query("SELECT o_orderkey AS row FROM orders WHERE o_orderkey % 97 = 0")
def missing_cells(spark, sf):
    return verify.missing(_expected(spark, sf), _actual(spark, sf), ["row", "family"]).select("row")


@query("SELECT o_orderkey AS row FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0")
def mismatched_cells(spark, sf):
    return verify.deep_verify(_expected(spark, sf), _actual(spark, sf), ["row", "family"]).filter("status = 'MISMATCH'").select("row")


@query("SELECT count(DISTINCT o_custkey)::BIGINT AS n_rows, count(DISTINCT o_custkey) >= 100 AS passed FROM orders")
def row_count_check(spark, sf):
    return verify.row_count_check(_read(spark, sf, "orders"), "o_custkey", 100)


@query("SELECT o_orderkey AS position FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0")
def sequence_expect(spark, sf):
    position = lambda df: df.withColumn("position", F.col("row"))
    return verify.sequence_check(position(_expected(spark, sf)), position(_actual(spark, sf)), "position", ["row", "family", "value"]).select("position")


@query("SELECT count(*)::BIGINT AS n_lines, sum(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END)::BIGINT AS n_cells, sum(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE strlen(c_name) END)::BIGINT AS value_bytes FROM customer")
def tsv_parse(spark, sf):
    full = F.concat_ws("\t", F.hex(F.encode("c_mktsegment", "UTF-8")), F.lit("cf"), F.lit("q"), F.col("c_custkey").cast("string"), F.hex(F.encode("c_name", "UTF-8")))
    lines = _read(spark, sf, "customer").select(F.when(F.col("c_custkey") % 5 == 0, F.lit("41\tcf")).otherwise(full).alias("value"))
    n = lines.agg(F.count(F.lit(1)).alias("n_lines"))
    return n.crossJoin(cells_io.parse_expected(lines).agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.octet_length("value")).alias("value_bytes")))  # one row each


_META = "SELECT n_nationkey AS f, m AS name FROM nation, (VALUES ('hfile.LASTKEY'), ('hfile.AVG_KEY_LEN'), ('hfile.AVG_VALUE_LEN'), ('hfile.CREATE_TIME_TS'), ('hfile.KEY_OF_BIGGEST_CELL'), ('hfile.LEN_OF_BIGGEST_CELL'), ('DELETE_FAMILY_COUNT'), ('HISTORICAL')) AS t(m)"


@query(f"SELECT f, name FROM ({_META}) WHERE (f + strlen(name)) % 7 = 0 UNION ALL SELECT n_nationkey, 'hfile.TAGS_COMPRESSED' FROM nation WHERE n_nationkey % 4 = 0")
def required_meta(spark, sf):
    files = _read(spark, sf, "nation").select(F.col("n_nationkey").alias("f"))
    names = F.array(*[F.lit(m) for m in layout.REQUIRED_META])
    have = files.select("f", F.explode(names).alias("name")).filter((F.col("f") + F.length("name")) % 7 != 0)
    return verify.required_meta(have.unionByName(files.filter("f % 4 = 0").withColumn("name", F.lit("hfile.MAX_TAGS_LEN"))), ["f"])


@query("SELECT o_orderpriority, count(*)::BIGINT AS entries, true AS entries_ok FROM orders GROUP BY 1 HAVING count(*) > 0")
def metadata_expect(spark, sf):
    """Every file's entry count against what the source says."""
    source = _read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    stats = cells.file_stats(_order_cells(spark, sf), ["o_orderpriority"]).join(source, "o_orderpriority")
    return verify.metadata_check(stats, entries=F.col("n")).select("o_orderpriority", "entries", "entries_ok")


@query("SELECT o_orderkey AS row, 'OK' AS status FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AND ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 10 "
       "UNION ALL SELECT o_orderkey, 'MISMATCH' FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0 AND ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 10 "
       "UNION ALL SELECT o_orderkey, 'MISSING' FROM orders WHERE o_orderkey % 97 = 0 AND ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 10")  # fmt: skip
def sampled_verify(spark, sf):
    """The check of a tenth of all rows: both sides draw the same."""
    draw = lambda df: verify.sampled(df, "row", 10)
    return verify.deep_verify(draw(_expected(spark, sf)), draw(_actual(spark, sf)), ["row", "family"]).select("row", "status")


@query("SELECT count(*)::BIGINT AS n FROM (SELECT 1 WHERE false)")
def diff_impl(spark, sf):
    """Two ways to the first row of each key must agree."""
    df = _read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    one = dedup.first_wins(df.withColumn("_o", F.col("o_orderkey")), ["o_custkey"], "_o")
    two = df.withColumn("_n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("_n = 1").drop("_n")
    return verify.table_diff(one, two).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_OC} SELECT row, value FROM c ORDER BY row LIMIT 20")
def first_cells(spark, sf):
    return verify.first_cells(convert_orders(spark, sf), [F.col("row")], 20).select("row", "value")


# ---- metrics


@query("SELECT event_type, count(value)::BIGINT AS n, min(value) AS least, max(value) AS most, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def metric_histogram(spark, sf):
    return metrics.histogram(_read(spark, sf, "events"), ["event_type"], "value").drop("total")


@query("SELECT event_type, sum(user_id)::BIGINT AS total FROM events GROUP BY event_type")
def metric_counters(spark, sf):
    return metrics.counters(_read(spark, sf, "events"), "event_type", "user_id")


@query("SELECT event_type, arg_max(value, event_id) AS last_value FROM events GROUP BY event_type")
def metric_gauges(spark, sf):
    return metrics.gauges(_read(spark, sf, "events"), "event_type", "value", "event_id")


_RUNS = """SELECT 's' || lpad((r.k // 6)::VARCHAR, 9, '0') AS scenario, CASE WHEN r.k % 2 = 0 THEN 'native' ELSE 'java' END AS implementation, (r.k // 2 % 3)::INT AS iteration,
  CASE WHEN r.k // 6 % 5 = 1 AND r.k % 2 = 1 THEN 'parallel-convert' ELSE 'merge-then-convert' END AS strategy, 4 AS worker_parallelism, (CASE WHEN r.k // 6 % 5 = 2 AND r.k % 2 = 1 THEN 2 ELSE 1 END)::INT AS file_count,
  (1000 + CASE WHEN r.k // 6 % 5 = 3 AND r.k % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS cell_count, (100 + r.k * 37 % 91)::BIGINT AS elapsed_ms, NOT (r.k // 6 % 5 = 4 AND r.k % 6 = 5) AS success FROM (SELECT c_custkey AS k FROM customer) r"""


def _runs(spark, sf):
    k = F.col("c_custkey")
    s = F.floor(k / 6)
    java = k % 2 == 1
    return _read(spark, sf, "customer").select(
        F.concat(F.lit("s"), F.lpad(s.cast("string"), 9, "0")).alias("scenario"), F.when(java, "java").otherwise("native").alias("implementation"), (F.floor(k / 2) % 3).cast("int").alias("iteration"),
        F.when((s % 5 == 1) & java, "parallel-convert").otherwise("merge-then-convert").alias("strategy"), F.lit(4).alias("worker_parallelism"), F.when((s % 5 == 2) & java, 2).otherwise(1).alias("file_count"),
        (F.lit(1000) + F.when((s % 5 == 3) & java, 1).otherwise(0)).cast("long").alias("cell_count"), (F.lit(100) + k * 37 % 91).alias("elapsed_ms"), (~((s % 5 == 4) & (k % 6 == 5))).alias("success"),
    )


@query(f"SELECT scenario, implementation, avg(elapsed_ms) AS average_ms, bool_and(success) AS consistent, string_agg(DISTINCT strategy, ',') AS strategies FROM ({_RUNS}) GROUP BY 1, 2")
def perf_average(spark, sf):
    return metrics.perf_summary(_runs(spark, sf)).select("scenario", "implementation", "average_ms", "consistent", "strategies")


@query(
    f"""WITH p AS (SELECT scenario, implementation, avg(elapsed_ms) AS ms, bool_and(success) AS ok, min(strategy) AS st, min(file_count) AS fc, min(cell_count) AS cc FROM ({_RUNS}) GROUP BY 1, 2),
j AS (SELECT a.scenario, CASE WHEN b.scenario IS NULL THEN 'an implementation is missing' WHEN NOT a.ok OR NOT b.ok THEN 'iterations differ' WHEN a.st <> b.st THEN 'strategies differ' WHEN a.fc <> b.fc THEN 'file counts differ' WHEN a.cc <> b.cc THEN 'cell counts differ' ELSE 'comparable' END AS note, b.ms / a.ms AS x
  FROM (SELECT * FROM p WHERE implementation = 'native') a LEFT JOIN (SELECT * FROM p WHERE implementation = 'java') b USING (scenario))
SELECT scenario, note, CASE WHEN note = 'comparable' THEN x END AS speedup FROM j"""
)
def fair_speedup(spark, sf):
    return metrics.fair_speedup(_runs(spark, sf))


# ---- generated tables


@query("SELECT 3000::BIGINT AS n_rows, 3000::BIGINT AS n_keys, true AS rising, true AS maps_mostly_common, true AS texts_end")
def mock_signals(spark, sf):
    df = mock.signals(spark, 3000)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("REFID").alias("n_keys"), (F.max("REFID") < mock.FIRST_REFID + 3000 * 255).alias("rising"),
        (F.count_if(F.col("BIT_MAP") == 12) >= 2850).alias("maps_mostly_common"), F.bool_and(F.col("SIGSTORE").endswith("; ")).alias("texts_end"),
    )


@query("SELECT 3000::BIGINT AS n_rows, 3000::BIGINT AS n_keys, 1000::BIGINT AS n_lte, 11 AS msisdn_length")
def mock_sessions(spark, sf):
    df = mock.sessions(spark, 3000)
    key = rules.expression(rules.parse(mock.SESSION_RULE), visible(df))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.count_if(F.col("RAT_TYPE") == "LTE").alias("n_lte"), F.max(F.length("MSISDN")).alias("msisdn_length"))
