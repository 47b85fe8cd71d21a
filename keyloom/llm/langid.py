"""Language identification by nearest centroid: hashed byte trigrams (TF-IDF, unit length), several spherical k-means
centroids per language, cosine, and rejection of texts that are farther from their centroid than nearly all training texts.

Defined results: null text or text without a letter is `und` with score 0 (rejected); without any labelled row every text is
`und`; a null doc_id counts as the empty string in the fold rule; repeated rows are each predicted, and count once in the fit; extra
columns are dropped; an empty table gives an empty result. Very long texts are counted whole, CHUNK bytes at a time. Of equally near
centroids the first wins: languages in the order of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import blocks

DIMS = 1 << 13
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters become a space, so that digits and marks say nothing.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Texts, and bytes of text, that are counted together.
GROUP, CHUNK = 64, 1 << 20
#: More texts than are wanted are drawn first, by this factor, so that enough remain.
SPARE = 4


@dataclass
class Model:
    langs: list[str]
    owner: np.ndarray  # of each centroid: index in langs
    centroids: np.ndarray  # (centroids, DIMS)
    idf: np.ndarray
    floor: np.ndarray  # of each centroid: least cosine that isn't rejected


def counts(texts: list[str]) -> np.ndarray:
    """(texts, DIMS) counts of hashed byte trigrams of the whole texts."""
    coded = [(" " + " ".join(t.lower().split()) + " ").encode("utf-8", "ignore").translate(_FOLD) for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    ends = np.cumsum([len(c) for c in coded])
    total = np.zeros(len(texts) * DIMS, np.int64)
    for at in range(0, len(data) - 2, CHUNK):
        part = data[at : at + CHUNK + 2].astype(np.uint32)
        code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        slot = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
        of = np.searchsorted(ends, np.arange(at, at + len(part)), side="right")
        inside = of[:-2] == of[2:]
        total += np.bincount(of[:-2][inside] * DIMS + slot[inside], minlength=len(total))
    return total.reshape(len(texts), DIMS).astype(np.float32)


def _grouped(rows, text):
    """Lists of at most GROUP rows and about CHUNK bytes of text."""
    for part in blocks(rows, lambda r: len(text(r)), CHUNK):
        for at in range(0, len(part), GROUP):
            yield part[at : at + GROUP]


def unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(tf: np.ndarray, langs: list[str], per_lang: int = 4, rounds: int = 12) -> Model:
    """Fit on the counts of texts. Starts are spread over the rows in order, so the result depends on the input alone."""
    idf = (np.log((len(langs) + 1) / ((tf > 0).sum(0) + 1)) + 1).astype(np.float32)
    x, names = unit(tf, idf), sorted(set(langs))
    which = np.array([names.index(v) for v in langs])
    owner, centroids, floor = [], [], []
    for k in range(len(names)):
        own = x[which == k]
        c = own[np.linspace(0, len(own) - 1, min(per_lang, len(own))).astype(int)]
        for _ in range(rounds):
            near = (own @ c.T).argmax(1)
            c = np.stack([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        best = (own @ c.T).max(1)
        owner += [k] * len(c)
        centroids.append(c)
        floor += [float(np.quantile(best, 0.005)) * 0.8] * len(c)
    return Model(names, np.array(owner), np.concatenate(centroids), idf, np.array(floor))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
    lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    for part in _grouped(known, lambda i: texts[i]):
        cosine = unit(counts([texts[i] for i in part]), model.idf) @ model.centroids.T
        for i, row in zip(part, cosine):
            j = int(row.argmax())
            lang[i], score[i], rejected[i] = model.langs[model.owner[j]], float(min(1.0, max(0.0, row[j]))), bool(row[j] < model.floor[j])
    return lang, score, rejected


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _vectors(batches):
    """Counts of each text as its slots and their values, so that no text goes to the driver."""
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        for part in _grouped(rows, lambda r: r[2]):
            tf = counts([r[2] for r in part])
            slots = [np.flatnonzero(row) for row in tf]
            values = [row[s] for row, s in zip(tf, slots)]
            columns = [pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()), pa.array([s.astype("<u2").tobytes() for s in slots], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "draw", "slots", "tf"])


def sample(docs: DataFrame, sample_per_lang: int) -> DataFrame | None:
    """(lang, draw, text): at most `sample_per_lang` different texts per language, those with the smallest hashes of all. The rate only
    spares the sort of the others."""
    rows = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit("langid"), "text").alias("draw"), "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}  # a row per language
    if not sizes:
        return None
    share = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    rate = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, SPARE * sample_per_lang / max(n, 1)) + 1e-12)])
    drawn = rows.filter(share <= rate[F.col("lang")]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("draw", 11), "draw")
    return drawn.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample_per_lang).drop("k")


def train(docs: DataFrame, sample_per_lang: int = 400, per_lang: int = 4) -> Model | None:
    """Fit on at most `sample_per_lang` labelled texts per language (a documented bound), drawn from all rows by a hash of the text; the
    driver gets their counts, at most DIMS for a text."""
    picked = sample(docs, sample_per_lang)
    rows = [] if picked is None else picked.mapInArrow(_vectors, "lang string, draw long, slots binary, tf binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["draw"]))
    tf = np.zeros((len(rows), DIMS), np.float32)
    for row, r in zip(tf, rows):
        row[np.frombuffer(r["slots"], "<u2")] = np.frombuffer(r["tf"], np.float32)
    return fit(tf, [r["lang"] for r in rows], per_lang)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row; reads doc_id and text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS floats for each centroid

    def run(batches):
        for batch in batches:
            lang, score, rejected = predict(shared.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
