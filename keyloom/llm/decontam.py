"""Benchmark decontamination by templates: numbers, names, pronouns and units become typed placeholders, windows of template tokens
are joined by hash with those of the benchmark, and the values in the placeholders must map one to one, so that the same question
with other numbers or names is found too.

What a token is depends on the token itself (a unit of one letter also on the number before it), never on where it stands, so a
passage has the same template in every text. A word with a capital is a name unless it is a common word; letters and digits are
parted, so `5km` and `20%` are a number and a unit. Names or numbers in a row are one, so those at an item's edge may run on into the
words around it and are not held to a mapping, nor are pronouns, which change with names. Two numbers of a question may be equal by
chance, so fewer of them have to map one to one.

The benchmark's index is shared with all tasks while its text is within `limit` bytes; a larger one is joined by shuffle, with the
same result: of each item only its rarest windows, one of which every leak must hold, propose pairs.

Defined results: null and empty texts match nothing; an item with fewer than MIN template tokens, or without a window of MIN literal
words, can't be found; repeated documents or items each give a row; null ids are carried along; an empty table gives an empty
result; extra columns are dropped by `leaks` and kept by `remove`. A very long text is searched whole, in memory. Of several places of an
item in a document the best by coverage, equal values and consistency is reported; of equal ones the first.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_joins, join_rows, materialise, own_columns, row_keyed, shown_id
from .hashing import blocks, mix, prefix, string_hash, windows

WINDOW, MIN = 8, 3
#: Share of an item's windows that a document must hold; shares of its names and units, and of its numbers, that must map one to one.
COVERED, CONSISTENT, NUMBERS_CONSISTENT = 0.5, 0.8, 0.5
#: Tokens by which windows of one alignment may be apart.
TOLERANCE = 8
LIMIT = 32 << 20

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
UNITS = (
    "mm cm km inch inches foot feet yard yards mile miles mg kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons ml liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years percent cent cents dollar dollars euro euros usd eur degree degrees celsius fahrenheit "
    "meter meters metre metres kilometer kilometers kilometre kilometres mph kmh watt watts volt volts joule joules % $ € £ °"
).split()
#: Units only right after a number.
UNITS_AFTER = "m g l h s t min mins sec secs hr hrs in ft oz kw kwh w v c f k".split()
PRONOUNS = "he she him her his hers himself herself".split()
#: Words that are no names, with a capital or without.
COMMON = (
    "the a an if when while after before how what which who whose whom where why there then each every all some any many much more most few several in on at by for from to of with without into over under "
    "and or but so because since as than is are was were be been do does did has have had can could will would should may might must let find given suppose assume consider calculate determine "
    "it they them their its we us our you your i me my this that these those no not yes both either during between per total only also about note now"
).split()

LITERAL, NUMBER, NAME, UNIT, PRONOUN = range(5)
_CODE = mix(np.array([0, 11, 22, 33, 44], np.uint64))
#: Classes of characters: between tokens, letters, digits, tokens of their own.
GAP, LETTER, DIGIT, ALONE = range(4)
_PLANES = 1 << 17
_STOPS = ".!?:;\n\"。！？।؟"


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, lower case, has a lower case, ends a sentence) of the code points below _PLANES; the last stands for all others."""
    kind, lower = np.zeros(_PLANES, np.uint8), np.arange(_PLANES, dtype=np.uint32)
    for cp in range(_PLANES):
        ch = chr(cp)
        group = unicodedata.category(ch)
        if 0x3040 <= cp < 0x3100 or 0x3400 <= cp < 0xA000 or group == "Lo" and 0xF900 <= cp < 0xFB00 or cp == _PLANES - 1:
            kind[cp] = ALONE  # scripts without spaces
        elif group in ("Nd",):
            kind[cp] = DIGIT
        elif group[0] in "LM" or group in ("Nl", "No"):
            kind[cp] = LETTER
        small = ch.lower()
        if len(small) == 1 and small != ch:
            lower[cp] = ord(small)
    kind[[ord(c) for c in "%$€£°"]] = ALONE
    stops = np.zeros(_PLANES, bool)
    stops[[ord(c) for c in _STOPS]] = True
    return kind, lower, lower != np.arange(_PLANES), stops


def _tokens(points: np.ndarray):
    """(begin, end, class, hash of the lower case) of every token."""
    classes, lower, _, _ = _characters()
    known = np.minimum(points, _PLANES - 1)
    kind = classes[known]
    low = np.where(points < _PLANES, lower[known], points)
    begins = (kind != GAP) & (np.r_[True, kind[1:] != kind[:-1]] | (kind == ALONE))
    begin = np.flatnonzero(begins)
    last = np.r_[kind[1:] != kind[:-1], True] | (kind == ALONE)
    end = np.flatnonzero((kind != GAP) & last) + 1
    sums, inverse = prefix(low)
    return begin, end, kind[begin], string_hash(sums, inverse, begin, end - begin)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")


@functools.cache
def _word_sets() -> list[np.ndarray]:
    return [np.sort(_tokens(_points(names))[3]) for names in (NUMBER_WORDS, UNITS, UNITS_AFTER, PRONOUNS, COMMON)]


def _among(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    return words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h


@dataclass
class Template:
    """Template tokens of texts: text, code, kind and the hash of what stood there."""

    text: np.ndarray
    code: np.ndarray
    kind: np.ndarray
    value: np.ndarray

    def windows(self, size: int):
        """(first token, hash) of each window in one text with MIN literal words."""
        h = windows(self.code, size)
        if not len(h):
            return np.zeros(0, np.int64), h
        literal = np.cumsum(np.r_[0, self.kind == LITERAL])
        ok = (self.text[: len(h)] == self.text[size - 1 :]) & (literal[size:] - literal[:-size] >= min(MIN, size))
        return np.flatnonzero(ok), h[ok]


def canonical(texts: list[str]) -> Template:
    points = _points(texts)
    begin, end, classes, h = _tokens(points)
    n = len(h)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
    if not n:
        return Template(text, h, np.zeros(0, np.int8), h)
    _, _, capitals, stop = _characters()
    numbers, units, after, pronouns, common = _word_sets()
    kind = np.zeros(n, np.int8)
    kind[capitals[np.minimum(points[begin], _PLANES - 1)]] = NAME
    kind[_among(h, common)] = LITERAL
    kind[_among(h, pronouns)] = PRONOUN
    kind[_among(h, units)] = UNIT
    kind[(classes == DIGIT) | _among(h, numbers)] = NUMBER
    kind[1:][(kind[:-1] == NUMBER) & (text[1:] == text[:-1]) & _among(h[1:], after)] = UNIT
    stops = np.cumsum(np.r_[0, stop[np.minimum(points, _PLANES - 1)]])
    opens = np.r_[True, (text[1:] != text[:-1]) | (stops[begin[1:]] > stops[end[:-1]]) & (begin[1:] > end[:-1] + 1)]
    goes_on = np.r_[False, (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME))] & ~opens
    first = np.flatnonzero(~goes_on)
    at = (np.arange(n) - np.repeat(first, np.diff(np.r_[first, n])) + 1).astype(np.uint64)
    value = np.add.reduceat(mix(h * at), first)
    kind = kind[first]
    return Template(text[first], np.where(kind == LITERAL, value, _CODE[kind]), kind, value)


@dataclass
class Index:
    ids: list
    template: Template
    n_windows: np.ndarray
    by_size: dict  # window size: sorted hashes, their first postings, postings (token) in the order of the hashes

    @staticmethod
    def of(ids: list, texts: list[str]) -> Index:
        t = canonical(texts)
        tokens = np.bincount(t.text, minlength=len(ids))
        n_windows, by_size = np.zeros(len(ids), np.int64), {}
        for size in sorted({WINDOW} | {int(x) for x in tokens if MIN <= x < WINDOW}):
            first, h = t.windows(size)
            mine = tokens[t.text[first]] >= WINDOW if size == WINDOW else tokens[t.text[first]] == size
            first, h = first[mine], h[mine]
            n_windows += np.bincount(t.text[first], minlength=len(ids))
            order = np.argsort(h, kind="stable")
            keys, start = np.unique(h[order], return_index=True)
            by_size[size] = keys, np.r_[start, len(h)], first[order]
        return Index(ids, t, n_windows, by_size)

    def match(self, texts: list[str], covered: float, consistent: float):
        """(text, item, coverage, consistent share, whether every value is the same) of the leaks among these texts."""
        doc, item = canonical(texts), self.template
        parts = []
        for size, (keys, start, postings) in self.by_size.items():
            first, h = doc.windows(size)
            if not len(keys) or not len(h):
                continue
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == h)
            n = start[at[hit] + 1] - start[at[hit]]
            post = np.repeat(start[at[hit]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            parts.append((np.repeat(first[hit], n), postings[post], np.full(n.sum(), size)))
        if not parts:
            return []
        d, i, size = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((d - i, i, item.text[i], doc.text[d]))
        d, i, size = d[order], i[order], size[order]
        pair = np.flatnonzero(np.r_[True, (item.text[i[1:]] != item.text[i[:-1]]) | (doc.text[d[1:]] != doc.text[d[:-1]])]) if len(d) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(pair, np.r_[pair[1:], len(d)]):
            best = self._best(doc, d[a:b], i[a:b], size[a:b], covered, consistent)
            if best:
                coverage, same, share = best
                out.append((int(doc.text[d[a]]), int(item.text[i[a]]), coverage, share, same))
        return out

    def _best(self, doc: Template, d: np.ndarray, i: np.ndarray, size: np.ndarray, covered: float, consistent: float):
        """(coverage, whether every value is the same, consistent share) of the best way to place an item in a document, or None. Each
        window counts once. Its places are taken nearest to an alignment (document token less item token), for every alignment:
        all windows, and those alone that are within TOLERANCE of it; also the first place of each."""
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        n = int(self.n_windows[self.template.text[i[0]]])
        if len(first) < covered * n:
            return None
        last = np.r_[first[1:], len(i)] - 1
        shift = d - i
        shift -= shift.min()
        width = int(shift.max()) + 1
        window = np.repeat(np.arange(len(first)), last - first + 1)
        place = window * width + shift
        best, tried = None, set()

        def judge(chosen):
            nonlocal best
            key = chosen.tobytes()
            if len(chosen) < covered * n or key in tried or best and (len(chosen) / n, True, 1.0) <= best:
                return
            tried.add(key)
            same, share, held = self._values(doc, d[chosen], i[chosen], size[chosen], consistent)
            if held and (best is None or (len(chosen) / n, same, share) > best):
                best = len(chosen) / n, same, share

        judge(first)
        for at in np.unique(shift):
            right = np.searchsorted(place, np.arange(len(first)) * width + at)
            left, right = np.maximum(right - 1, first), np.minimum(right, last)
            near = np.where(np.abs(shift[left] - at) <= np.abs(shift[right] - at), left, right)
            judge(near)
            judge(near[np.abs(shift[near] - at) <= TOLERANCE])
            if best and best >= (len(first) / n, True, 1.0):
                break
        return best

    def _values(self, doc: Template, d: np.ndarray, i: np.ndarray, size: np.ndarray, consistent: float) -> tuple[bool, float, bool]:
        """Whether every placeholder has the same value on both sides, the share of them (but for pronouns) that map one to one, and
        whether enough of them do: names and units, and numbers, each for themselves."""
        span = np.concatenate([np.arange(s) for s in size])
        there = np.unique(np.c_[np.repeat(i, size) + span, np.repeat(d, size) + span], axis=0)
        kind = self.template.kind[there[:, 0]]
        there, kind = there[kind != LITERAL], kind[kind != LITERAL]
        same = self.template.value[there[:, 0]] == doc.value[there[:, 1]]
        # a name or number at the item's edge may go on in the words around it
        own = self.template.text == self.template.text[i[0]]
        edge = np.isin(there[:, 0], np.flatnonzero(own)[[0, -1]]) & ((kind == NAME) | (kind == NUMBER))
        there, kind = there[(kind != PRONOUN) & ~edge], kind[(kind != PRONOUN) & ~edge]
        if not len(there):
            return bool(same.all()), 1.0, True
        pairs, of = np.unique(np.c_[self.template.value[there[:, 0]], doc.value[there[:, 1]]], axis=0, return_inverse=True)
        _, x, nx = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
        _, y, ny = np.unique(pairs[:, 1], return_inverse=True, return_counts=True)
        single = (nx[x] == 1) & (ny[y] == 1)
        kind_of = np.zeros(len(pairs), np.int8)
        kind_of[of.ravel()] = kind
        number = kind_of == NUMBER
        held = all(not part.any() or single[part].mean() >= least for part, least in ((number, min(consistent, NUMBERS_CONSISTENT)), (~number, consistent)))
        return bool(same.all()), float(single.mean()), bool(held)


_OUT = "r1 long, r2 long, item_id long, coverage double, consistency double, exact boolean"


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["r1", "r2", "item_id", "coverage", "consistency", "exact"])


def _by_broadcast(keyed: DataFrame, items: DataFrame, covered: float, consistent: float) -> DataFrame:
    rows = items.collect()  # within the limit
    index = keyed.sparkSession.sparkContext.broadcast(Index.of([r["item_id"] for r in rows], [r["text"] for r in rows]))

    def run(batches):
        for batch in batches:
            for part in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))), lambda r: len(r[2])):
                found = index.value.match([p[2] for p in part], covered, consistent)
                yield _batch([(part[k][0], part[k][1], index.value.ids[item], *rest) for k, item, *rest in found])

    return keyed.mapInArrow(run, _OUT)


def _by_shuffle(keyed: DataFrame, items: DataFrame, covered: float, consistent: float) -> DataFrame:
    """Windows of both sides meet by hash; pairs that may cover enough are then compared as texts. An item of n windows that is found
    lacks n - ceil(covered * n) of them at most, so one of its n - ceil(covered * n) + 1 rarest is there: common windows propose
    nothing, however many documents and items hold them."""

    def of_items(batches):
        for batch in batches:
            for part in blocks(zip(batch.column(0).to_pylist(), _texts(batch.column(1))), lambda r: len(r[1])):
                index = Index.of([p[0] for p in part], [p[1] for p in part])
                rows = [(int(h), size, k, index.ids[w], int(index.n_windows[w])) for size, (keys, start, post) in index.by_size.items() for j, h in enumerate(keys.view(np.int64)) for k in post[start[j] : start[j + 1]].tolist() for w in [int(index.template.text[k])]]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["h", "size", "at", "item", "n"])

    numbered = materialise(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    theirs = materialise(numbered.select("item", "text").mapInArrow(of_items, "h long, size int, at long, item long, n long"), "windows")
    sizes = [r["size"] for r in theirs.select("size").distinct().collect()]  # WINDOW and less

    def of_docs(batches):
        for batch in batches:
            for part in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))), lambda r: len(r[2])):
                t = canonical([p[2] for p in part])
                for size in sizes:
                    first, h = t.windows(size)
                    of = np.unique(np.rec.fromarrays([t.text[first], h.view(np.int64)]))
                    text = of["f0"].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(of["f1"]), pa.array([size] * len(text), pa.int32()), pa.array([part[k][0] for k in text], pa.int64()), pa.array([part[k][1] for k in text], pa.int64())], ["h", "size", "r1", "r2"])

    with bloom_joins(keyed.sparkSession):
        ours = keyed.mapInArrow(of_docs, "h long, size int, r1 long, r2 long").join(theirs.select("h", "size").distinct(), ["h", "size"])
        ours = materialise(ours, "shared-windows")
    spread = ours.groupBy("h", "size").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "h", "at")  # the windows of one item
    ranked = theirs.join(spread, ["h", "size"], "left").withColumn("rank", F.row_number().over(by_rarity))
    rare = ranked.filter("df is not null").filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * covered) + 1).select("h", "size", "item").distinct()
    pairs = ours.join(rare, ["h", "size"]).select("r1", "r2", "item").distinct()

    def compare(batches):
        for batch in batches:
            rows = []
            for r1, r2, item_id, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), _texts(batch.column(3)), _texts(batch.column(4))):
                rows += [(r1, r2, item_id, *rest) for _, _, *rest in Index.of([0], [b]).match([a], covered, consistent)]
            yield _batch(rows)

    texts = keyed.join(pairs, ["r1", "r2"]).join(numbered.withColumnRenamed("text", "item_text"), "item")
    return texts.select("r1", "r2", "item_id", "text", "item_text").mapInArrow(compare, _OUT)


def find(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, consistent: float = CONSISTENT, limit: int = LIMIT) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    return (_by_broadcast if size <= limit else _by_shuffle)(row_keyed(docs), items, covered, consistent)


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, coverage, consistency and exact (no value differs) of every leak."""
    found = find(docs, benchmark, **options)
    return found.select(shown_id().alias("doc_id"), "item_id", "coverage", "consistency", "exact")


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no item was found."""
    found = materialise(find(docs, benchmark, **options).select("r1", "r2").distinct(), "leaks")
    return join_rows(docs, found, "left_anti").select(*own_columns(docs))
