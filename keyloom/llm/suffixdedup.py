"""Exact removal of repeated byte strings with suffix arrays over content-defined shards.

1. Each start of a `length`-byte string is keyed by the smallest hash among the grams inside it, so equal strings have equal
   keys wherever they are; runs of starts with one key are segments. A key of one segment, whose gram that segment holds
   once, can have no repeat.
2. Segments of the other keys are counted by content. One with copies is repeated as a whole: if its key holds no other content nothing
   more is asked, its copies cost no suffix array. One of each other content is cut from its text.
3. Segments with one key meet in one shard, whose suffix array (induced sorting) and permuted common prefixes tell which starts
   are repeated. Keys with very many segments are split by two 64-bit hashes of each string, which are counted.
4. The repeated starts go back to every document with that segment; covered bytes are removed. Where copies were found by their 64-bit
   content hash within their 64-bit key, each copy's own bytes must have the 128-bit BLAKE2 digest of the one that was looked at, or the
   job stops.

Defined results: a null text is empty; repeated rows repeat each other; a null doc_id is a value of its own; an empty table gives
an empty result; extra columns are dropped. Two texts that share doc_id are told apart by 63 bits of a hash. A very long text is hashed
and cut in pieces; a string that is repeated anywhere is removed everywhere, none is kept as the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_joins, join_rows, materialise, own_columns, row_keyed, spare
from .hashing import blocks, mix, prefix, string_hash
from .suffixarray import repeated_starts

LENGTH = 200
GRAM = 50
#: Bytes that are cut or sorted at once.
BLOCK = 1 << 18
SHARD = 1 << 20
PIECE = 1 << 20
#: Starts in a segment at most; longer runs go on in the next segment.
RUN = 4096
#: A key with more segments than this is split by the hash of each string.
HOT = 4096
#: Other values of bytes, for a second hash that shares no collisions with the first.
_OTHER = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))


def _segments(texts: list[bytes], length: int, gram: int):
    """(text, start, starts, key, content hash, whether the key's gram is there again) arrays over texts that are hashed together."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - length + 1
    if n < 1:
        return [np.zeros(0, np.int64)] * 6
    sums, inverse = prefix(data)
    g = len(data) - gram + 1
    grams = least = mix((sums[gram:] - sums[:-gram]) * inverse[:g])
    width, inside = length - gram + 1, 1
    while 2 * inside <= width:
        least = np.minimum(least[:-inside], least[inside:])
        inside *= 2
    key = np.minimum(least[:n], least[width - inside : width - inside + n])
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    begins = ends - sizes
    first_of = np.cumsum(np.r_[0, np.maximum(sizes - length + 1, 0)])
    at = np.arange(len(text)) - first_of[text] + begins[text]
    key = key[at]
    if not len(at):
        return [np.zeros(0, np.int64)] * 6
    new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])]
    run = np.flatnonzero(new)
    size = np.diff(np.r_[run, len(at)])
    if (size > RUN).any():
        parts = -(-size // RUN)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        run, total = np.repeat(run, parts) + within * RUN, np.repeat(size, parts)
        size = np.minimum(RUN, total - within * RUN)
    begin = at[run]
    content = string_hash(sums, inverse, begin, size + length - 1)
    span = size + width - 1
    first = np.cumsum(span) - span
    same = grams[np.arange(span.sum()) + np.repeat(begin - first, span)] == np.repeat(key[run], span)
    again = np.add.reduceat(same, first, dtype=np.int64) > 1
    return text[run], begin - begins[text[run]], size, key[run].view(np.int64), content.view(np.int64), again


def _pieces(data: bytes, length: int):
    """(place, bytes) of parts that hold PIECE starts each, so that a very long text is never hashed as a whole."""
    for base in range(0, max(1, len(data) - length + 1), PIECE):
        yield base, data[base : base + PIECE + length - 1]


def _scan(length: int, gram: int):
    def run(batches):
        for batch in batches:
            r1, r2, text = (batch.column(k).to_pylist() for k in range(3))
            rows = ((a, b, piece, base) for a, b, t in zip(r1, r2, text) if len(t) * 4 >= length for base, piece in _pieces(t.encode("utf-8", "surrogatepass"), length))
            for part in blocks(rows, lambda r: len(r[2])):
                of, start, size, key, content, again = _segments([p[2] for p in part], length, gram)
                a, b = np.array([p[0] for p in part], np.int64), np.array([p[1] for p in part], np.int64)
                start = start + np.array([p[3] for p in part], np.int64)[of]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.array(a[of]), pa.array(b[of]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again.astype(bool))], ["m", "sh", "r1", "r2", "start", "n", "again"])

    return run


def _rows_once(batches):
    """(text, items) of each row; a repeated row is left out, as its strings are counted already."""
    seen = set()
    for batch in batches:
        for r1, r2, text, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if (r1, r2) not in seen:
                seen.add((r1, r2))
                yield text.as_py().encode("utf-8", "surrogatepass"), items.as_py()


def _digest(data: bytes) -> tuple[int, int]:
    both = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _cut(length: int):
    """Of each text its wanted segments: their bytes, and their digest where they have copies; without bytes where they need no array."""
    names, kinds = ["m", "sh", "n", "d1", "d2", "bytes"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        def strings():
            for data, items in _rows_once(batches):
                for x in items:
                    string = data[x["start"] : x["start"] + x["n"] + length - 1]
                    yield x["m"], x["sh"], x["n"], *(_digest(string) if x["cnt"] > 1 else (None, None)), None if x["sole"] else string

        for part in blocks(strings(), lambda s: len(s[5] or b"") + 32, 4 * BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names)

    return run


def _hash_strings(length: int):
    """Of each text's wanted segments two hashes of every string."""
    names, kinds = ["key", "also", "m", "sh", "off", "cnt"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        def strings():
            for data, items in _rows_once(batches):
                for x in items:
                    own = np.frombuffer(data[x["start"] : x["start"] + x["n"] + length - 1], np.uint8)
                    first, second = (string_hash(*prefix(p), np.arange(x["n"]), length).view(np.int64) for p in (own, _OTHER[own]))
                    yield first, second, x

        for part in blocks(strings(), lambda s: 8 * len(s[0]), BLOCK):
            columns = [np.concatenate([s[0] for s in part]), np.concatenate([s[1] for s in part])]
            n = [s[2]["n"] for s in part]
            columns += [np.repeat([s[2][c] for s in part], n) for c in ("m", "sh")]
            columns += [np.concatenate([np.arange(k) for k in n]), np.repeat([s[2]["cnt"] for s in part], n)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k == pa.int32() else c, k) for c, k in zip(columns, kinds)], names)

    return run


def _runs(mask: np.ndarray):
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()


def _joined_runs(batches):
    """Runs of the offsets that follow each other."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        out = []
        for m, sh, offs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            mask = np.zeros(max(offs) + 1, bool)
            mask[offs] = True
            out += [(m, sh, off, n, None, None) for off, n in zip(*_runs(mask))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], ["m", "sh", "off", "n", "d1", "d2"])


def _shards(length: int):
    """Rows come sorted by key. Whole keys gather until a shard is full; its suffix array answers for all of them. Segments with copies
    are repeated as a whole and keep their digest; those without bytes only pass."""
    names, kinds = ["m", "sh", "off", "n", "d1", "d2"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def shards(batches):
        shard, held, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if row[0] != last and (held >= SHARD or len(shard) >= SHARD // 32):
                    yield shard
                    shard, held = [], 0
                shard.append(row)
                held, last = held + len(row[5] or b""), row[0]
        if shard:
            yield shard

    def run(batches):
        for shard in shards(batches):
            masks = iter(repeated_starts([s[5] for s in shard if s[5] is not None], length))
            out: list[tuple] = []
            for m, sh, n, d1, d2, data in shard:
                mask = None if data is None else next(masks)
                out += [(m, sh, 0, n, d1, d2)] if d1 is not None else [(m, sh, off, k, None, None) for off, k in zip(*_runs(mask))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names)

    return run


def _cover(runs, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal (begin, end) of bytes covered by strings that start in `runs`."""
    found: list[tuple[int, int]] = []
    for start, n in sorted({(r["s"], r["n"]) for r in runs or ()}):
        end = min(size, start + n + length - 1)
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], end))
        else:
            found.append((start, end))
    return found


def _checked(data: bytes, runs, length: int):
    """`runs`, whose copied segments have the bytes that they should have."""
    for r in runs or ():
        if r["d1"] is not None and _digest(data[r["s"] : r["s"] + r["n"] + length - 1]) != (r["d1"], r["d2"]):
            raise ValueError("two segments of other bytes share a 64-bit hash within one key")
    return runs


def _inward(data: bytes, begin: int, end: int) -> tuple[int, int]:
    """The whole characters between these bytes."""
    while begin < end and data[begin] & 0xC0 == 0x80:
        begin += 1
    while end > begin and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return begin, end


def _outside(data: bytes, spans) -> bytes:
    edges = [0, *[e for s in spans for e in s], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _digests(length: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64()] * 4 + [pa.string()]

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for r1, r2, text, runs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = text.encode("utf-8", "surrogatepass")
                spans = _cover(_checked(data, runs, length), len(data), length)
                kept = _outside(data, spans)
                row = (None if r1 & 1 else r2, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                for c, v in zip(columns, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _texts(length: int):
    """Replaces text by what is left of it, and n_chars by its length; the last column has the runs."""

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            left = []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if runs:
                    data = text.encode("utf-8", "surrogatepass")
                    text = _outside(data, [_inward(data, *s) for s in _cover(_checked(data, runs, length), len(data), length)]).decode("utf-8", "surrogatepass")
                left.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(left, pa.string())
            if "n_chars" in batch.schema.names:
                k = batch.schema.names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in left], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def repeated_runs(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(r1, r2, runs): the runs of repeated starts of each text that has any."""
    found = keyed.mapInArrow(_scan(length, gram), "m long, sh long, r1 long, r2 long, start int, n int, again boolean")
    found = materialise(found, "segments")
    shared = materialise(found.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("again")).filter("c > 1 or again").drop("again"), "keys")
    with bloom_joins(found.sparkSession):  # most segments have a key of their own and need not be dealt out
        candidates = materialise(found.drop("again").join(shared.filter("c > 0"), "m"), "candidates")
    one = candidates.groupBy("m", "sh").agg(F.count(F.lit(1)).alias("cnt"), F.max("c").alias("c"), F.min(F.struct("r1", "r2", "start", "n")).alias("at"))
    item = F.struct("m", "sh", F.col("at.start").alias("start"), F.col("at.n").alias("n"), "cnt", ((F.col("cnt") == F.col("c")) & (F.col("cnt") > 1)).alias("sole"))
    one = one.select(F.col("at.r1").alias("r1"), F.col("at.r2").alias("r2"), item.alias("item"), (F.col("c") > HOT).alias("hot"))
    wanted = lambda which: keyed.join(one.filter(which).groupBy("r1", "r2").agg(F.collect_list("item").alias("items")), ["r1", "r2"]).select("r1", "r2", "text", "items")
    cut = wanted("not hot").mapInArrow(_cut(length), "m long, sh long, n int, d1 long, d2 long, bytes binary")
    repeated = cut.repartition("m").sortWithinPartitions("m").mapInArrow(_shards(length), "m long, sh long, off int, n int, d1 long, d2 long")
    strings = materialise(wanted("hot").mapInArrow(_hash_strings(length), "key long, also long, m long, sh long, off int, cnt long"), "strings")
    again = strings.groupBy("key", "also", "m").agg(F.sum("cnt").alias("c")).filter("c > 1").select("key", "also", "m")
    offsets = strings.join(again, ["key", "also", "m"], "left_semi").groupBy("m", "sh").agg(F.collect_set("off").alias("offs"))  # RUN at most
    repeated = repeated.unionByName(offsets.mapInArrow(_joined_runs, "m long, sh long, off int, n int, d1 long, d2 long"))
    back = candidates.select("m", "sh", "r1", "r2", "start").join(repeated, ["m", "sh"])
    run = F.struct((F.col("start") + F.col("off")).alias("s"), F.col("n").alias("n"), "d1", "d2")
    return back.groupBy("r1", "r2").agg(F.collect_set(run).alias("runs"))  # a row that is repeated has its runs once


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs and the digest of what is left."""
    keyed = row_keyed(docs)
    runs = repeated_runs(keyed, length)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return keyed.join(runs, ["r1", "r2"], "left").select("r1", "r2", "text", "runs").mapInArrow(_digests(length), schema)


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with the text that is left; a character of which a byte stays is whole."""
    (name,) = spare(docs, "_runs")
    runs = repeated_runs(row_keyed(docs), length).withColumnRenamed("runs", name)
    joined = join_rows(docs, runs, "left").select(*own_columns(docs), name)
    return joined.mapInArrow(_texts(length), docs.schema)


#: DuckDB SQL for `remove_repeats` at the default length, over the bytes in hex.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT rid, i, md5(substr(x, (2 * i + 1)::BIGINT, 400)) AS h FROM (SELECT rid, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400)),
r AS (SELECT rid, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS span FROM (SELECT rid, i, (i - lag(i, 1, -1000) OVER (PARTITION BY rid ORDER BY i) > 200)::INT AS new FROM r)),
s AS (SELECT rid, span, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY rid, span),
k AS (SELECT rid, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last FROM s GROUP BY rid),
p AS (SELECT rid, a, substr(x, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT) AS piece FROM (SELECT s.rid, a, x, lag(z, 1, 0) OVER (PARTITION BY s.rid ORDER BY a) AS before FROM s JOIN d ON d.rid = s.rid)),
t AS (SELECT rid, string_agg(piece, '' ORDER BY a) AS head FROM p GROUP BY rid)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN k USING (rid) LEFT JOIN t USING (rid)
"""
