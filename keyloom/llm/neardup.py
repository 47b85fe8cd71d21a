"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles are five neighbouring lower-case words. Their document frequencies are counted over all documents in a fixed number
   of hashed slots, as in the usual hashing TF-IDF. The weight is tf * (1 + min(1, ln((N + 1) / (df + 1)) / ln(COMMON)) / 2): a shingle in
   less than one of COMMON documents weighs 1.5 tf, one in all of them tf, so that shingles of a large group of copies keep their say. Other
   shingles of a slot add about (shingles a document) / SLOTS of all documents to a frequency, whatever the size of the corpus.
2. Each text gets `bands * rows` consistent weighted samples: two texts agree in one with the probability of their weighted
   Jaccard similarity. Equal texts are one node from here on.
3. Texts that share a band are compared by their samples in blocks of about a fixed size, and each block proposes a spanning forest of
   its best pairs. All members of a key with several blocks are compared with its middle, the member that agrees most with a block.
4. Every link is verified by the weighted Jaccard similarity of the whole texts; components of the links are the classes.
5. The forests only save work. Where a key still holds members of several components, every pair of them that agrees in enough samples is
   compared too: members are dealt to blocks, each pair of blocks is a group with the texts of its open pairs, and a pair is left out only
   when verified links already connect it. So which pairs are linked does not depend on how rows are dealt to tasks.

Defined results: a text without a word (null and empty too) is no duplicate of anything; under five words the whole text is the
shingle; repeated rows are one class; a null doc_id ranks last in its class and shows as null; an empty table gives an empty
result; extra columns are dropped by `classes` and kept by `deduplicate`. A very long text is hashed whole, in one task, with arrays
over it. Of equal best samples of a text the shingle with the smaller hash is taken; a class is named by its smallest doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_rows, materialise, own_columns, row_keyed, shown_id, whole_text, without_id
from .components import components
from .hashing import blocks, mix, windows, words

SHINGLE, BANDS, ROWS, SIMILAR = 5, 10, 3, 0.8
SLOTS = 1 << 18
PART = 1024
COMMON = 64
#: Of BANDS * ROWS samples a pair at 0.8 agrees in fewer than LEAST about once in a thousand.
LEAST = 17
#: Members of a key that are compared at once; members and bytes of text of a block where all pairs of blocks are.
MEMBERS, BLOCK, BLOCK_BYTES = 64, 1024, 4 << 20
#: Groups of partitions whose frequencies are added first.
PARTS_AT_ONCE = 512


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the midpoints of 2^16 equal shares."""
    x = np.r_[0.0, np.geomspace(1e-4, 40.0, 400_000)]
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


GAMMA = _gamma_table()
LOG_GAMMA = np.log(GAMMA)


def shingles(texts: list[bytes]):
    """(text, shingle hash, tf) sorted by text and hash, and the 128-bit hash of each text's words."""
    of, hashes, *_ = words(texts)
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    h = windows(hashes, SHINGLE)
    whole = of[: len(h)] == of[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
    text, h = of[: len(h)][whole], h[whole]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        total = mix(np.array([(hashes[first[i] : first[i] + n[i]] * np.arange(1, n[i] + 1, dtype=np.uint64)).sum() for i in short], np.uint64))
        text, h = np.r_[text, short], np.r_[h, total]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[new, len(h)])
    nodes: list[bytes | None] = [None] * len(texts)
    if len(hashes):
        place = (np.arange(len(hashes)) - first[of] + 1).astype(np.uint64)
        full = [i for i in range(len(texts)) if n[i]]
        sums = [np.add.reduceat(mix(hashes * np.uint64(k) + place * np.uint64(j)), first[full]) for k, j in ((3, 0x9E3779B97F4A7C15), (5, 0xC2B2AE3D27D4EB4F))]
        for i, a, b in zip(full, *sums):
            nodes[i] = int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")
    return text[new], h[new], tf, nodes


def _encoded(column) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _frequencies(batches):
    """Of this partition: documents, and how many have a shingle in each slot, in parts of PART slots."""
    count, n = np.zeros(SLOTS, np.int32), 0
    for batch in batches:
        for part in blocks(_encoded(batch.column(0)), len):
            text, h, *_ = shingles(part)
            seen = np.unique(text * SLOTS + _slot(h)) % SLOTS
            count += np.bincount(seen, minlength=SLOTS).astype(np.int32)
            n += len(part)
    parts = [(i // PART, count[i : i + PART].astype(np.int64)) for i in range(0, SLOTS, PART) if count[i : i + PART].any()]
    yield pa.RecordBatch.from_arrays([pa.array([-1, *[p for p, _ in parts]], pa.int32()), pa.array([np.array([n], np.int64).tobytes(), *[c.tobytes() for _, c in parts]], pa.binary())], ["part", "counts"])


def _add(key, table):
    total = sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def idf(docs: DataFrame) -> np.ndarray:
    """SLOTS weights from the document frequencies of all documents; a vector of fixed size. Partitions are added up in two steps."""
    rows = docs.select(whole_text().alias("text")).mapInArrow(_frequencies, "part int, counts binary")
    rows = rows.withColumn("some", F.spark_partition_id() % PARTS_AT_ONCE).groupBy("some", "part").applyInArrow(lambda key, table: _add(key[1:], table), "part int, counts binary")
    rows = rows.groupBy("part").applyInArrow(_add, "part int, counts binary").collect()  # SLOTS / PART rows and one
    df, n = np.zeros(SLOTS), 0
    for r in rows:
        if r["part"] < 0:
            n = int(np.frombuffer(r["counts"], np.int64)[0])
        else:
            df[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.int64)
    return (1 + np.minimum(1, np.log((n + 1) / (df + 1)) / np.log(COMMON)) / 2).astype(np.float32)


def samples(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """(texts, k) hashes of the consistent weighted samples; rows of texts without shingles stay 0."""
    out = np.zeros((n_texts, k), np.uint64)
    if not len(h):
        return out
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, len(text)])
    log_w = np.log(weight).astype(np.float32)
    for j in range(k):
        x = h * np.uint64(pow(0x9E3779B97F4A7C15, 2 * j + 1, 2**64))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        r = GAMMA[x >> np.uint64(48)]
        log_c = LOG_GAMMA[(x >> np.uint64(32)) & np.uint64(0xFFFF)]
        beta = (x & np.uint64(0xFFFFFFFF)).astype(np.float32) * np.float32(2**-32)
        t = np.floor(log_w / r + beta)
        a = log_c - r * (t - beta) - r
        best = np.minimum.reduceat(a, first)
        hit = np.flatnonzero(a == np.repeat(best, size))
        of = text[hit]
        hit = hit[np.r_[True, of[1:] != of[:-1]]]
        out[text[hit], j] = mix(h[hit] ^ (t[hit].astype(np.int64).view(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    return out


def _signatures(weights):
    names, kinds = ["r1", "r2", "node", "size", "sig"], [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32())]

    def run(batches):
        idf = weights.value
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _encoded(batch.column(2)))
            for part in blocks(rows, lambda r: len(r[2])):
                text, h, tf, nodes = shingles([p[2] for p in part])
                sig = (samples(text, h, tf * idf[_slot(h)], len(part), BANDS * ROWS) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                columns = [[p[0] for p in part], [p[1] for p in part], nodes, [len(p[2]) for p in part], list(sig)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _forest(agree: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Of the pairs that agree in `least` samples, best first, those that connect what is not connected yet."""
    i, j = np.nonzero(np.triu(agree >= least, 1))
    order = np.argsort(-agree[i, j], kind="stable")
    parent, out = list(range(len(agree))), []

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(i[order].tolist(), j[order].tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _by_group(batches, n_columns: int, n_key: int, solve, most: int = 20_000):
    """Rows come sorted by their first `n_key` columns; `solve` makes rows of those that share them."""
    held: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*(batch.column(k).to_pylist() for k in range(n_columns))):
            if held and held[-1][:n_key] != row[:n_key]:
                out += solve(held)
                held = []
            held.append(row)
            if len(out) > most:
                yield out
                out = []
        yield out
    yield solve(held) if held else []


_PAIRS = ["band", "key", "a", "b", "score", "sig"]


def _compare(batches):
    """Rows come sorted by band, key and block. Of each block come the pairs of its forest, and the member that agrees most with the
    others (the middle) where the key has more blocks."""

    def solve(rows):
        band, key, _, node, sig, blocks_of_key = rows[0]
        sigs = np.array([r[4] for r in rows])
        agree = (sigs[:, None] == sigs[None]).sum(2)
        out = [(band, key, rows[i][3], rows[j][3], 0, None) for i, j in _forest(agree, LEAST)]
        if blocks_of_key > 1:
            middle = int(agree.sum(1).argmax())
            out.append((band, key, rows[middle][3], None, int(agree[middle].sum() * 1000 // len(rows)), rows[middle][4]))
        return out

    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32())]
    for out in _by_group(batches, 6, 3, solve):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], _PAIRS)


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of texts that may be similar, see step 3; and (band, key, node) of every key with two members or more."""
    band = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), *[F.col("sig")[b * ROWS + r] for r in range(ROWS)]).alias("key")) for b in range(BANDS)]))
    signed = nodes.select("node", "sig")
    each = signed.select("node", band.alias("x")).select("node", "x.band", "x.key")
    shared = materialise(each.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "keys")
    met = each.join(shared, ["band", "key"]).join(signed, "node").withColumn("n", F.ceil(F.col("c") / MEMBERS))
    met = materialise(met.withColumn("block", F.pmod(F.xxhash64("node"), "n")).select("band", "key", "block", "node", "sig", "n"), "met")
    spread = met.repartition("band", "key", "block").sortWithinPartitions("band", "key", "block", "node")
    found = materialise(spread.mapInArrow(_compare, "band int, key long, a binary, b binary, score int, sig array<int>"), "pairs")
    middle = found.filter("b is null").groupBy("band", "key").agg(F.max(F.struct("score", F.col("a").alias("node"), "sig")).alias("mid"))
    large = met.filter("n > 1").join(middle, ["band", "key"]).filter(F.col("node") != F.col("mid.node"))
    agree = F.aggregate(F.zip_with("sig", "mid.sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    stars = large.filter(agree >= LEAST).select(F.col("node").alias("a"), F.col("mid.node").alias("b"))
    pairs = found.filter("b is not null").select("a", "b").unionByName(stars)
    return materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates"), met.select("band", "key", "node")


def weighted_jaccard(a: bytes, b: bytes, idf: np.ndarray) -> float:
    text, h, tf, _ = shingles([a, b])
    w = tf * idf[_slot(h)]
    split = np.searchsorted(text, 1)
    common, i, j = np.intersect1d(h[:split], h[split:], assume_unique=True, return_indices=True)
    low = np.minimum(w[:split][i], w[split:][j]).sum()
    return float(low / (w.sum() - low)) if len(h) else 0.0


def _verify(weights, least: float):
    def run(batches):
        for batch in batches:
            a, b = _encoded(batch.column(2)), _encoded(batch.column(3))
            value = pa.array([weighted_jaccard(x, y, weights.value) for x, y in zip(a, b)], pa.float64())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), value], ["a", "b", "similarity"])
            yield out.filter(pa.array([v >= least for v in value.to_pylist()], pa.bool_()))

    return run


#: Sides of a group: its one block, or the first and second of two.
ONE, FIRST, SECOND = range(3)


def _groups(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(gid, band, side, node, root): members (with their size in bytes) of keys that hold several components, in groups of one or two
    blocks, so that any two of different components meet. A component of over half a block has blocks of its own, which needn't meet
    each other."""
    ours = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = ours.groupBy("band", "key", "root").agg(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_BYTES).alias("full"))
    small = F.coalesce(F.sum(F.when(F.col("full") <= 0.5, F.col("full"))), F.lit(0.0)).alias("small")
    several = sizes.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n_roots"), small).filter("n_roots > 1").drop("n_roots")
    own = F.col("full") > 0.5
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.greatest(F.ceil(F.col(n)), F.lit(1)))
    dealt = ours.join(sizes.join(several, ["band", "key"]), ["band", "key", "root"]).select(
        "band", "key", "node", "root", F.when(own, F.col("root")).otherwise(F.lit(b"")).alias("home"), F.when(own, slot("node", "full")).otherwise(slot("root", "small")).alias("slot")
    )
    dealt = materialise(dealt, "dealt")
    block = dealt.groupBy("band", "key").agg(F.collect_set(F.struct("home", "slot")).alias("b"))
    two = block.select("band", "key", F.explode("b").alias("x"), "b").select("band", "key", "x", F.explode("b").alias("y"))
    two = two.filter("x <= y and (x.home <> y.home or x.home = X'')").withColumn("gid", F.monotonically_increasing_id())
    two = materialise(two, "groups")
    side = lambda c, k: F.struct(F.col(f"{c}.home").alias("home"), F.col(f"{c}.slot").alias("slot"), F.lit(k).alias("side"))
    sides = F.when(F.col("x") == F.col("y"), F.array(side("x", ONE))).otherwise(F.array(side("x", FIRST), side("y", SECOND)))
    sides = two.select("gid", "band", "key", F.explode(sides).alias("s")).select("gid", "band", "key", "s.*")
    return dealt.join(sides, ["band", "key", "home", "slot"]).select("gid", "band", "side", "node", "root")


def _open(sig: np.ndarray, roots: np.ndarray, side: np.ndarray, band: int, rows: int = 64) -> np.ndarray:
    """Which pairs of a group are to be compared: enough samples agree, their components differ, and no earlier band has both."""
    n, columns = len(sig), np.ascontiguousarray(sig.T)
    wanted = np.zeros((n, n), bool)
    for at in range(0, n, rows):
        part = slice(at, min(n, at + rows))
        agree, earlier = np.zeros((part.stop - at, n), np.int8), np.zeros((part.stop - at, n), bool)
        for b in range(len(columns) // ROWS):
            same = [c[part, None] == c[None] for c in columns[b * ROWS : (b + 1) * ROWS]]
            for x in same:
                agree += x
            if b < band:
                earlier |= np.logical_and.reduce(same)
        wanted[part] = (agree >= LEAST) & ~earlier & (roots[part, None] != roots[None]) & ((side[part, None] != side[None]) | (side[None] == ONE))
    return wanted


_GROUP = ["gid", "band", "side", "node", "root", "sig"]


def _mates(rows):
    _, roots = np.unique(np.array([r[4].hex() for r in rows]), return_inverse=True)
    return _open(np.array([r[5] for r in rows], np.int32), roots, np.array([r[2] for r in rows]), rows[0][1]), roots


def _with_open_pairs(batches):
    """The members of each group that have a pair to be compared."""

    def solve(rows):
        if len(rows) < 2:
            return []
        left = _mates(rows)[0]
        return [r[:5] for r, k in zip(rows, left.any(1) | left.any(0)) if k]

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    for out in _by_group(batches, len(_GROUP), 1, solve):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], _GROUP[:5])


def _links(texts: list[bytes], wanted: np.ndarray, roots: np.ndarray, idf: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Of the wanted pairs those that are similar; one is not compared where these links or `roots` connect it already."""
    text, h, tf, _ = shingles(texts)
    w = tf * idf[_slot(h)]
    vocabulary, at = np.unique(h, return_inverse=True)
    start, total = np.searchsorted(text, np.arange(len(texts) + 1)), np.bincount(text, w, len(texts))
    weight, roots, out = np.zeros(len(vocabulary)), roots.copy(), []
    for i in range(len(texts)):
        others = np.flatnonzero(wanted[i, i + 1 :] & (roots[i + 1 :] != roots[i])) + i + 1
        fits = np.minimum(total[others], total[i]) >= least * np.maximum(total[others], total[i])  # or they can't be similar
        others = others[fits]
        if not len(others):
            continue
        mine = slice(start[i], start[i + 1])
        weight[at[mine]] = w[mine]
        size = start[others + 1] - start[others]
        first = np.cumsum(size) - size
        where = np.repeat(start[others] - first, size) + np.arange(size.sum())
        low = np.add.reduceat(np.minimum(w[where], weight[at[where]]), first)
        weight[at[mine]] = 0
        for j in others[low >= least * (total[i] + total[others] - low)]:
            if roots[i] != roots[j]:
                out.append((i, int(j)))
                roots[roots == roots[j]] = roots[i]
    return out


def _verified(weights, least: float):
    def solve(rows):
        wanted, roots = _mates(rows)
        return [(rows[i][3], rows[j][3]) for i, j in _links([r[6] for r in rows], wanted, roots, weights.value, least)]

    def run(batches):
        coded = (pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(_encoded(b.column(6)), pa.binary())], [*_GROUP, "text"]) for b in batches)
        for out in _by_group(coded, len(_GROUP) + 1, 1, solve):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)] or [pa.array([], pa.binary())] * 2, ["a", "b"])

    return run


def _completed(keyed: DataFrame, nodes: DataFrame, members: DataFrame, links: DataFrame, weights, similar: float) -> DataFrame:
    """(node, root): components of `links` and of the similar pairs that these don't connect; see step 5."""
    roots = components(links)
    sorted_groups = lambda df: df.repartition("gid").sortWithinPartitions("gid", "node")
    sig = nodes.select("node", "sig")
    rows = _groups(members.join(nodes.select("node", "size"), "node"), roots).join(sig, "node").select(*_GROUP)
    left = materialise(sorted_groups(rows).mapInArrow(_with_open_pairs, "gid long, band int, side int, node binary, root binary"), "open")
    wanted = nodes.join(left.select("node").distinct(), "node").select("node", "sig", "r1", "r2")
    texts = materialise(keyed.join(wanted, ["r1", "r2"]).select("node", "sig", "text").dropDuplicates(["node"]), "open-texts")
    more = materialise(sorted_groups(left.join(texts, "node").select(*_GROUP, "text")).mapInArrow(_verified(weights, similar), "a binary, b binary"), "more-links")
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _classes(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): r1, r2 and node of every row, and of each node the smallest row key of its class. Classes are settled among
    nodes, where equal texts are one; tables between the joins let Spark split large keys."""
    keyed = row_keyed(docs)
    weights = docs.sparkSession.sparkContext.broadcast(idf(docs))  # SLOTS floats
    signed = materialise(keyed.select("r1", "r2", "text").mapInArrow(_signatures(weights), "r1 long, r2 long, node binary, size int, sig array<int>"), "signatures")
    first = lambda *more: F.min(F.struct(without_id().alias("last"), "r2", "r1", *more)).alias("x")
    nodes = materialise(signed.filter("node is not null").groupBy("node").agg(first("size", "sig")).select("node", "x.r1", "x.r2", "x.size", "x.sig"), "nodes")
    pairs, members = _candidates(nodes)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.select("node", "r1", "r2").join(ends, "node", "left_semi")
    texts = materialise(keyed.join(wanted, ["r1", "r2"]).select("node", "text").dropDuplicates(["node"]), "texts")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    links = both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(weights, similar), "a binary, b binary, similarity double")
    roots = _completed(keyed, nodes, members, links.select("a", "b"), weights, similar)
    least = nodes.select("node", "r1", "r2").join(roots, "node").groupBy("root").agg(first()).select("root", F.col("x.r1").alias("root_r1"), F.col("x.r2").alias("root_id"))
    least = materialise(least, "least")
    ours = nodes.select("node", "r1", "r2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = ours.join(least, "root", "left").select("node", F.coalesce("root_r1", "r1").alias("root_r1"), F.coalesce("root_id", "r2").alias("root_id"))
    return signed.select("r1", "r2", "node"), materialise(found, "classes")


def classify(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(r1, r2, root_id, root_r1): for each row key the smallest row key of its class."""
    rows, found = _classes(docs, similar)
    alone = rows.filter("node is null").select("r1", "r2", F.col("r2").alias("root_id"), F.col("r1").alias("root_r1"))
    return rows.filter("node is not null").join(found, "node").select("r1", "r2", "root_id", "root_r1").unionByName(alone)


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class) for every row."""
    return classify(docs, similar).select(shown_id().alias("doc_id"), shown_id("root_r1", "root_id").alias("class_id"))


def deduplicate(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of `docs` whose key is the smallest of their class, once each."""
    rows, found = _classes(docs, similar)
    keep = found.select(F.col("root_r1").alias("r1"), F.col("root_id").alias("r2")).distinct().unionByName(rows.filter("node is null").select("r1", "r2"))
    return join_rows(docs, keep, "left_semi", once=True).select(*own_columns(docs))
