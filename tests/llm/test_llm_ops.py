import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SMALL, rows_of

from keyloom.llm import decontam, langid, neardup, packing, quality, sharding, suffixarray, suffixdedup, tokencount
from keyloom.llm import queries as registered
from keyloom.llm.tokens import encoder


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.queries()) == list(range(1, 11))


# ---- 6 quality rules


def test_quality_equals_sql(spark, duck):
    ours, theirs = rows_of(registered.op6_quality_rules(spark, SMALL).toPandas()), rows_of(duck.execute(quality.ORACLE).df())
    assert ours == theirs


def test_quality_against_brute_force(odd):
    import re

    def plain(text):
        words = [w for w in re.split("[\x09-\x0d\x20]+", text or "") if w]
        lines = [x for x in (text or "").split("\n") if re.search("[^\x09-\x0d\x20]", x)]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed

    got = quality.measure(odd).collect()
    key = lambda r: (r["doc_id"] or -1, r["n_words"], r["word_chars"])
    want = sorted((i or -1, *plain(t)) for i, t in texts(odd))
    assert sorted((*key(r), r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_line_rules_against_plain_patterns(spark):
    import re

    shouting, navigation, terminal = r"([^\t-\r ]+!!( |$)){4}", r"([^|»]+[|»][\t-\r ]*){4}", r"""[.!?:;…。！？]["')\]»”’*#$%&]*$"""
    long = "These are the words of a plain line that is long enough to hold a few marks without being full of them, "
    ends = ["so great!! it was!! and then!! at last!! it ended.", "so!! very!! very!! great!!", "so!! very!!  very!! great!! end.", "Great!!!!!!!! it was.", "a || b || c.", "a | b | c | d | e.", "a | b |  | c | d.", "a » b » c » d » e.", "he said." + "'" * 13, "he said" + "'" * 13, "end", "end.", "!!!! !!!! !!!! !!!!"]
    lines = [long * k + e for e in ends for k in (0, 1, 9)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_lines_failed"] for r in quality.measure(df).collect()}
    symbols = [len(re.findall("[#*$%&|<>]", x)) * 100 > len(x) * 8 for x in lines]
    assert got == {i: int(bool(re.search(shouting, x) or re.search(navigation, x) or s or not re.search(terminal, x.rstrip(" ")))) for i, (x, s) in enumerate(zip(lines, symbols))}


def test_lines_of_many_scripts(spark):
    """Ten words or more each: kept are texts of any script whose lines end as that script does."""
    good = [
        "यह एक लंबा वाक्य है जो बहुत से शब्दों से बना है और ठीक से समाप्त होता है।", "هل هذا نص طويل مكتوب بكلمات كثيرة حتى يكون له عشر كلمات أو أكثر؟", "یہ ایک لمبا جملہ ہے جس میں دس سے زیادہ الفاظ ہیں اور ختم ہوتا ہے۔",
        "นี่ คือ ข้อความ ยาว ที่ เขียน ด้วย คำ มาก กว่า สิบ คำ ใน ภาษา ไทย", "ນີ້ ແມ່ນ ຂໍ້ຄວາມ ຍາວ ທີ່ ມີ ຫຼາຍ ກວ່າ ສິບ ຄຳ ໃນ ພາສາ ລາວ", "这 是 一 个 很 长 的 句 子 它 有 十 多 个 词。", "Это длинное предложение, в котором больше десяти слов и есть точка в самом конце.",
        "« Un » et « deux » et « trois » et « quatre » sont des mots de cette phrase.", "A line of ten words or more that has a carriage return at its end.\r\nAnd another one.\r",
    ]
    bad = ["Home | News | Sport | Money | More of it and all the other pages that we have.", "Home › News › Sport › Money › all of the pages that are here for you to read.", "Alle Rechte vorbehalten, und das gilt für jedes einzelne Wort auf dieser langen Seite.", "a line of ten words or more that never comes to any end"]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.measure(df).collect()}
    assert got == {i: (False, i < len(good)) for i in range(len(good) + len(bad))}


def test_quality_sql_on_odd_lines(spark):
    import duckdb

    ends = ["so great!! it was!! and then!! at last!! it ended.", "so!! very!! very!! great!!", "Great!!!!!!!! it was.", "a || b || c.", "a | b | c | d | e.", "a » b » c » d » e.", "« a » « b » « c » « d ».", "he said." + "'" * 13, "end", "end.\r", "ไทย", "क।", "x #### y."]
    line = "These are the words of a plain line that is long enough to hold a few marks without being full of them, "
    rows = [(i, f"{line}{e}\n{line}{line}.") for i, e in enumerate(ends)] + [(100 + i, line * 3 + e) for i, e in enumerate(ends)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert rows_of(quality.measure(df).toPandas()) == rows_of(con.execute(quality.ORACLE).df())


def test_quality_uses_no_python(docs):
    plan = quality.measure(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_quality_keeps_good_and_drops_bad(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    r = quality.measure(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(x["quality"], x["kept"]): x["count"] for x in r}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= max(1, 0.02 * n.get((0, False), 0))


def test_clean_keeps_columns(odd, nothing):
    out = quality.clean(odd)
    assert out.columns == odd.columns and {r["_q"] for r in out.select("_q").collect()} <= {7, None}
    assert quality.clean(nothing).count() == 0


# ---- 8 sharding


def test_shards(spark, docs, odd, nothing):
    for df in (docs, odd):
        got = sharding.place(df).collect()
        assert len(got) == df.count()
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 8)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(df))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.place(nothing).count() == 0


def test_shards_equal_sql(spark, duck):
    ours, theirs = rows_of(registered.op8_rendezvous_shards(spark, SMALL).toPandas()), rows_of(duck.execute(sharding.ORACLE).df())
    assert ours == theirs


def test_shards_of_one_repeated_record(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 10)
    df = spark.createDataFrame([(1, "x")] * 500 + [(i, "y") for i in range(100)], "doc_id long, text string").repartition(4)
    slots = defaultdict(list)
    for r in sharding.place(df).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == 600


def test_weights_shift_rows(spark):
    df = spark.range(4000).selectExpr("id doc_id", "'x' text")
    n = Counter(r["shard"] for r in sharding.place(df, 2, [1.0, 3.0]).collect())
    assert 0.7 < n[1] / 4000 < 0.8


def test_sharding_uses_no_python(docs):
    plan = sharding.place(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 9 packing, 3 token counts


ODD_IDS = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "  \n\t<|endoftext|>\n ", "", "don't 123 \u00e9\u4e2d\U0001f600"]


def tokenizer():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizer(docs, odd):
    plain, ordinary = tokenizer(), tokenizer()
    ordinary.encode_special_tokens = True
    for text in [t or "" for df in (docs, odd) for _, t in texts(df)] + ODD_IDS:
        assert plain.encode(text, add_special_tokens=False).ids == list(encoder(special=True)(text))
        assert ordinary.encode(text, add_special_tokens=False).ids == encoder()(text)


def test_packing_against_the_tokenizer_and_plain_cuts(spark, docs, odd):
    t = tokenizer()
    for df in (docs, odd, spark.createDataFrame(list(enumerate(ODD_IDS)), "doc_id long, text string")):
        want = Counter()
        for doc_id, text in texts(df):
            ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
            n = len(ids)
            while at < n:
                size = min(2048, 1 << ((n - at).bit_length() - 1))
                want[doc_id, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), n] += 1
                at += size
        got = packing.pack(df).collect()
        assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
        assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
        assert [r["bucket"] for r in sorted(got, key=lambda r: r["sequence_id"])] == sorted(r["bucket"] for r in got)


def test_sequences_do_not_depend_on_partitions(spark, docs, tmp_path):
    numbered = lambda df: sorted(tuple(r) for r in packing.pack(df).collect())
    assert numbered(docs.repartition(1)) == numbered(docs.repartition(13))
    packing.write(docs, f"file://{tmp_path}/buckets")
    for r in spark.read.parquet(f"file://{tmp_path}/buckets").selectExpr("bucket", "size(ids) n").distinct().collect():
        assert r["n"] == 1 << r["bucket"]


def test_packing_puts_documents_together_again(docs):
    by_doc = defaultdict(list)
    for r in packing.pack(docs, with_ids=True).collect():
        by_doc[r["doc_id"]].append(r)
    assert len(by_doc) == docs.count()
    for i, text in texts(docs):
        want, at = [*encoder(special=True)(text or ""), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["length"], r["doc_tokens"]) == (at, len(r["ids"]), len(want)) and r["ids"] == want[at : at + r["length"]]
            at += r["length"]
        assert at == len(want)


def test_packing_of_odd_texts(odd, nothing):
    got = packing.pack(odd, with_ids=True).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    for r in got:
        assert r["length"] == 1 << r["bucket"] <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    want = Counter()
    for i, text in texts(odd):
        want[i] += len(encoder(special=True)(text or "")) + 1
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want and packing.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing, 1000)


def test_cuts():
    assert packing.cuts(1, 8) == [1] and packing.cuts(8, 8) == [8] and packing.cuts(23, 8) == [8, 8, 4, 2, 1]


@pytest.mark.parametrize("block", [1 << 19, 37])
def test_token_counts(odd, nothing, block, monkeypatch):
    monkeypatch.setattr(tokencount, "BLOCK", block)
    sample = odd if block > 100 else odd.filter("doc_id is null or doc_id <> 900004")
    got = Counter((r["doc_id"], r["n_tokens"]) for r in tokencount.count(sample).collect())
    assert got == Counter((i, len(encoder()(t or ""))) for i, t in texts(sample))
    assert tokencount.count(nothing).count() == 0


# ---- 4 language identification


def test_languages_held_out(docs):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in want if got[i]["held_out"]]
    assert held == [i for i in want if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == want[i] for i in held]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_equal_plain_nearest_centroids(docs):
    """Every prediction against a plain version: trigrams counted one by one, cosine with each centroid, the largest wins."""
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    fold = lambda c: chr(c) if c >= 128 or chr(c).isalpha() else " "
    for i, text in texts(docs):
        coded = (" " + " ".join((text or "").lower().split()) + " ").encode()
        coded = bytes(ord(fold(c)) for c in coded)
        tf = Counter(((coded[k] << 16 | coded[k + 1] << 8 | coded[k + 2]) * 2654435761 % 2**32) >> 19 for k in range(len(coded) - 2))
        vector = {k: np.log1p(v) * float(model.idf[k]) for k, v in tf.items()}
        norm = sum(v * v for v in vector.values()) ** 0.5
        cosine = [sum(v * float(c[k]) for k, v in vector.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosine))
        assert got[i]["score"] == pytest.approx(cosine[best], abs=1e-4)
        assert got[i]["lang_pred"] == model.langs[model.owner[best]] or max(c for c, o in zip(cosine, model.owner) if model.langs[o] == got[i]["lang_pred"]) > cosine[best] - 1e-5


def test_language_sample_has_a_true_limit(spark):
    """Of any language at most so many texts, also where one row is repeated very often or has no doc_id."""
    rows = spark.range(20_000).selectExpr("cast(null as long) doc_id", "concat('some words ', id) text", "'aa' lang").union(spark.range(20_000).selectExpr("id doc_id", "'the same text' text", "'bb' lang")).union(spark.range(30).selectExpr("id doc_id", "concat('few ', id) text", "'cc' lang"))
    n = Counter(r["lang"] for r in langid.sample(rows, 50).collect())
    assert n["aa"] == 50 and n["bb"] == 1 and 0 < n["cc"] <= 30


def test_counts_of_long_texts_in_pieces(monkeypatch):
    words = ["some words and more words " * 50, "", "é" * 99, "x"]
    whole = langid.counts(words)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert (langid.counts(words) == whole).all()


def test_languages_of_odd_texts(odd, nothing):
    got = langid.identify(odd, langid.train(odd)).collect()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und >= {900001, 900002, 900003, 900006} and len(got) == odd.count()
    assert langid.train(nothing) is None and langid.identify(nothing, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_prediction_ignores_other_columns(docs):
    model = langid.train(docs)
    changed = docs.withColumn("lang", docs["source"])
    same = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect())
    assert same(docs) == same(changed)


# ---- 5 suffix arrays


def test_suffix_arrays_and_prefixes(monkeypatch):
    rng = np.random.default_rng(1)
    for small in (suffixarray.SMALL, 0):
        monkeypatch.setattr(suffixarray, "SMALL", small)
        for _ in range(60):
            k = int(rng.integers(1, 6))
            t = np.r_[rng.integers(1, k + 1, int(rng.integers(1, 50))), 0]
            plain = t.tolist()
            sa = suffixarray.suffix_array(t, k + 1)
            assert sa.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
            phi, plcp = suffixarray.permuted_common_prefixes(t, sa)
            for a, b in zip(sa, sa[1:]):
                n = next(i for i in range(len(plain)) if plain[a + i] != plain[b + i])
                assert phi[b] == a and plcp[b] == n


def plain_removal(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = Counter()
    for (doc_id, _), b in zip(rows, data):
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out[doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup_equals_sql(spark, duck):
    ours, theirs = rows_of(registered.op5_suffix_array_dedup(spark, SMALL).toPandas()), rows_of(duck.execute(suffixdedup.ORACLE).df())
    assert ours == theirs


def _scan_with(piece, *args):
    """The scan with another piece size, set on the executors too."""
    run = _SCAN(*args)

    def inner(batches):
        suffixdedup.PIECE = piece
        return run(batches)

    return inner


_SCAN = suffixdedup._scan


@pytest.mark.parametrize("hot,piece", [(4096, 1 << 20), (1, 300)])
def test_suffix_dedup_equals_brute_force(odd, docs, nothing, hot, piece, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    monkeypatch.setattr(suffixdedup, "_scan", lambda *a: _scan_with(piece, *a))
    for df in (docs, odd.filter("doc_id is null or doc_id <> 900004")):
        assert Counter(tuple(r) for r in suffixdedup.remove_repeats(df).collect()) == plain_removal(texts(df), 200)
    assert suffixdedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_short_strings(spark):
    rows = [(1, "abababababab"), (2, "xxabababyy"), (3, "zzzzzzzzzzzzzzzzzzzz"), (4, "abcdefgh"), (5, "abcdefgh"), (6, "abc"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = suffixdedup.row_keyed(df)
    for length, gram in ((4, 2), (5, 3), (8, 4)):
        runs = {r["r2"]: r["runs"] for r in suffixdedup.repeated_runs(keyed, length, gram).collect()}
        for (i, t), want in zip(rows, [plain_removal(rows, length)] * len(rows)):
            removed = sum(b - a for a, b in suffixdedup._cover(runs.get(i), len(t), length))
            assert (i, len(t), removed) in {k[:3] for k in want}


def test_suffix_dedup_of_a_row_repeated_very_often(spark):
    """A row repeated twenty thousand times, with many segments: its runs come back once, not once a copy."""
    rng = np.random.default_rng(2)
    text = " ".join(f"w{x}" for x in rng.integers(0, 9999, 300))
    df = spark.range(20_000).selectExpr("7L doc_id", f"'{text}' text").union(spark.createDataFrame([(8, "short"), (9, text[:500])], "doc_id long, text string"))
    got = Counter(tuple(r) for r in suffixdedup.remove_repeats(df).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {(7, len(text), len(text), 1, empty): 20_000, (8, 5, 0, 0, hashlib.sha256(b"short").hexdigest()): 1, (9, 500, 500, 1, empty): 1}
    runs = suffixdedup.repeated_runs(suffixdedup.row_keyed(df)).collect()
    assert max(len(r["runs"]) for r in runs) < len(text) / 10


def test_copied_segments_are_held_against_their_bytes():
    data = b"abcdefgh" * 40
    good = {"s": 0, "n": 3, "d1": None, "d2": None}
    d1, d2 = suffixdedup._digest(data[:202])
    assert suffixdedup._checked(data, [good, {**good, "d1": d1, "d2": d2}], 200)
    with pytest.raises(ValueError):
        suffixdedup._checked(data, [{**good, "d1": d1, "d2": d2 + 1}], 200)


def test_strip_keeps_columns_and_characters(spark, odd, nothing):
    out = suffixdedup.strip(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert suffixdedup.strip(nothing).count() == 0
    passage = "é" * 150
    df = spark.createDataFrame([(1, "a" + passage + "b", "x"), (2, "ü" + passage + "c", "y"), (3, None, "z")], "doc_id long, text string, runs string")
    assert sorted((r["doc_id"], r["text"], r["runs"]) for r in suffixdedup.strip(df).collect()) == [(1, "ab", "x"), (2, "üc", "y"), (3, None, "z")]


# ---- 2 near-duplicates


def exact_classes(rows, idf):
    """(roots, links): components of the pairs at 0.8 by weighted Jaccard similarity, over all pairs, and these pairs."""
    text, h, tf, _ = neardup.shingles([(t or "").lower().encode() for t in rows])
    w = tf * idf[neardup._slot(h)]
    total = np.bincount(text, w, len(rows))
    places = defaultdict(list)
    for k, x in enumerate(h.tolist()):
        places[x].append(k)
    low = Counter()
    for ks in places.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                low[int(text[b]), int(text[a])] += min(w[a], w[b])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [(a, b) for (a, b), x in low.items() if x >= 0.8 * (total[a] + total[b] - x) - 1e-9]
    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(rows))], links


def groups(pairs):
    out = defaultdict(set)
    for member, label in pairs:
        out[label].add(member)
    return sorted(sorted(v) for v in out.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_duplicates_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = sorted(texts(docs))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    roots, _ = exact_classes([t for _, t in rows], neardup.idf(docs))
    assert groups((i, got[i]) for i, _ in rows) == groups((i, w) for (i, _), w in zip(rows, roots))
    assert all(got[c] == c for c in got.values())


def planted(seed=9):
    """Clusters of up to 150 members whose links run from below 0.8 to nearly 1, and texts of their own."""
    rng = np.random.default_rng(seed)
    rows = []
    for size in (150, 150, 40, 40, 12, 5, 5, 3, 2, 2, *[1] * 120):
        base = [f"w{x}" for x in rng.integers(0, 50_000, int(rng.integers(80, 400)))]
        for _ in range(size):
            own = base[:]
            for at in rng.integers(0, len(own), int(len(own) * rng.uniform(0, 0.03)) if size > 1 else 0):
                own[at] = f"n{rng.integers(0, 10**6)}"
            rows.append(" ".join(own))
    return list(enumerate(rows))


def test_recall_among_planted_clusters(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    roots, links = exact_classes([t for _, t in rows], neardup.idf(df))
    assert len(links) > 5000 and np.mean([got[a] == got[b] for a, b in links]) >= 0.99
    assert all(roots[i] == roots[c] for i, c in got.items())  # nothing joins that no chain of links joins


def test_classes_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(planted(4), "doc_id long, text string")
    found, before = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 3, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({r["doc_id"]: r["class_id"] for r in neardup.classes(df.repartition(n)).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == found[2]


def test_near_duplicates_of_edited_texts(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        for k in range(3):
            w = t.split()
            for at in rng.integers(0, 300, 4):
                w[at] = f"new{k}{at}"
            rows.append((1000 + 10 * i + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert all(got[i] == (i if i < 1000 else (i - 1000) // 10) for i, _ in rows)


def test_copies_inside_a_template_group(spark):
    """Texts of one template at about 0.75, too many for a block, and pairs among them at about 0.82."""
    rng = np.random.default_rng(5)
    template = [f"t{k}" for k in range(700)]
    rows = []
    for k in range(200):
        own, twin = [template[:], template[:]], rng.integers(0, 700 - 45, 2)
        for w in own:
            w[twin[0] : twin[0] + 14] = [f"p{k}x{i}" for i in range(14)]
        for side, w in enumerate(own):
            at = (twin[0] + 100 + 200 * side) % 600
            w[at : at + 26] = [f"q{k}y{side}z{i}" for i in range(26)]
        rows += [(2 * k + side, " ".join(w)) for side, w in enumerate(own) if side == 0 or k % 4 == 0]
    idf = neardup.idf(spark.createDataFrame(rows, "doc_id long, text string"))
    text, h, tf, _ = neardup.shingles([t.encode() for _, t in rows])
    _, at = np.unique(h, return_inverse=True)
    w = np.zeros((len(rows), at.max() + 1))
    w[text, at] = tf * idf[neardup._slot(h)]
    low = np.array([np.minimum(w, x).sum(1) for x in w])
    similar = low / (w.sum(1)[:, None] + w.sum(1)[None] - low)
    want = {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(similar >= 0.8, 1)))}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert len(want) >= 40 and not [p for p in want if got[p[0]] != got[p[1]]]


def test_odd_texts_are_no_duplicates_of_empty_ones(odd, nothing):
    got = neardup.classes(odd).collect()
    assert len(got) == odd.count()
    assert all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] in (900001, 900002, 900003))
    out = neardup.deduplicate(odd)
    assert out.columns == odd.columns
    kept = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(kept) == len(set(kept)) + sum(k is None for k in kept) - (None in kept)
    assert neardup.deduplicate(nothing).count() == 0


def test_similarity_weighs_rare_shingles():
    idf = np.ones(neardup.SLOTS, np.float32)
    assert neardup.weighted_jaccard(b"a b c d e f", b"a b c d e f", idf) == 1.0
    assert neardup.weighted_jaccard(b"a b c d e f", b"a b c d e g", idf) == pytest.approx(1 / 3)
    assert neardup.weighted_jaccard(b"", b"", idf) == 0.0


def test_samples_agree_as_often_as_weights_do():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = h[:300], h[100:]
    w = rng.uniform(0.5, 3, 400)
    s = neardup.samples(np.r_[np.zeros(300, int), np.ones(300, int)], np.r_[a, b], np.r_[w[:300], w[100:]], 2, 600)
    assert abs((s[0] == s[1]).mean() - w[100:300].sum() / w.sum()) < 0.08


# ---- 1 decontamination


def test_leaks_equal_verbatim_passages(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    flat = lambda t: " ".join((t or "").split())
    want = {(i, b["item_id"]) for i, t in texts(docs) for b in bench.collect() if flat(b["text"]) in flat(t)}
    got = [decontam.leaks(docs, bench, **o).collect() for o in ({}, {"limit": 0})]
    assert {(r["doc_id"], r["item_id"]) for r in got[0]} == want
    assert sorted(map(tuple, got[0])) == sorted(map(tuple, got[1]))


def test_questions_with_other_values(spark):
    ask = "A train leaves {} at {} and goes {} {} in {} hours. How fast does the train go on average over the whole way?".format
    docs = [(1, "Intro. " + ask("Paris", 9, 300, "miles", 5) + " End."), (2, ask("Rome", 8, 300, "km", 2)), (3, "x " * 30), (4, None), (5, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(9, ask("Rome", 8, 300, "km", 2)), (10, None), (11, "one"), (12, "tiny green question")], "item_id long, text string")
    for options in ({}, {"limit": 0}):
        got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.leaks(docs, items, **options).collect()}
        assert got == {(1, 9): False, (2, 9): True}
    short = spark.createDataFrame([(6, "Is this a tiny green question, or not?")], "doc_id long, text string")
    assert decontam.leaks(short, items).count() == 1


def test_questions_that_repeat_a_template(spark):
    sells = "she sells {} red apples for {} dollars each to her ".format
    item = f"On one day {sells(3, 2)}neighbour and on the next {sells(5, 4)}oldest cousin"
    other = f"On one day {sells(8, 9)}neighbour and on the next {sells(7, 6)}oldest cousin"
    partial = f"On one day {sells(4, 3)}neighbour"
    docs = [(1, item), (2, "Well then. " + item + " today."), (3, other), (4, f"{partial}. {'Words go on here. ' * 30} {item}"), (5, f"{item}. {'Words go on here. ' * 30} {partial}"), (6, "Words go on here. " * 30)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for options in ({}, {"limit": 0}):
        got = {r["doc_id"]: (r["coverage"], r["consistency"], r["exact"]) for r in decontam.leaks(docs, items, **options).collect()}
        assert got == {i: (1.0, 1.0, i != 3) for i in range(1, 6)}


def test_decontamination_keeps_clean_rows(spark, odd, nothing):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    out = decontam.remove(odd, bench)
    leaked = {r["doc_id"] for r in decontam.leaks(odd, bench).collect()}
    assert out.columns == odd.columns and out.count() == odd.filter(~odd["doc_id"].isin(list(leaked)) | odd["doc_id"].isNull()).count()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(odd, empty).count() == 0 and decontam.remove(odd, empty).count() == odd.count() and decontam.remove(nothing, bench).count() == 0


def plain_template(text):
    """Tokens (code, kind, value) by the rules as the docstring states them, one character after another."""
    import regex

    alone = "%$€£°\u3040-\u30ff\u3400-\u9fff"
    low = lambda w: "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
    found = [(m.group(), m.start(), m.end()) for m in regex.finditer(rf"[{alone}]|[^\W_\d{alone}]+(?:(?![{alone}])[\p{{L}}\p{{M}}\p{{Nl}}\p{{No}}])*|[\p{{M}}\p{{No}}]+|\d+", text, regex.V0)]
    kinds = []
    for k, (w, _, _) in enumerate(found):
        kind = decontam.NAME if low(w[0]) != w[0] else decontam.LITERAL
        kind = decontam.LITERAL if low(w) in decontam.COMMON else kind
        kind = decontam.PRONOUN if low(w) in decontam.PRONOUNS else kind
        kind = decontam.UNIT if low(w) in decontam.UNITS or kinds and kinds[-1] == decontam.NUMBER and low(w) in decontam.UNITS_AFTER else kind
        kinds.append(decontam.NUMBER if w.isdecimal() or low(w) in decontam.NUMBER_WORDS else kind)
    out = []
    for k, ((w, a, b), kind) in enumerate(zip(found, kinds)):
        gap = text[found[k - 1][2] : a] if k else ""
        if k and kind == kinds[k - 1] and kind in (decontam.NUMBER, decontam.NAME) and not (len(gap) > 1 and set(gap) & set(decontam._STOPS)):
            out[-1] = (out[-1][0], kind, out[-1][2] + (low(w),))
        else:
            out.append((low(w) if kind == decontam.LITERAL else kind, kind, (low(w),)))
    return out


def plain_leaks(docs, items):
    def windows(t, size):
        return [(k, tuple(x[0] for x in t[k : k + size])) for k in range(len(t) - size + 1) if sum(x[1] == decontam.LITERAL for x in t[k : k + size]) >= min(3, size)]

    def values(item, doc, places, size):
        slots = {(i + k, d + k) for i, d in places for k in range(size) if item[i + k][1] != decontam.LITERAL}
        same = all(item[i][2] == doc[d][2] for i, d in slots)
        pairs = {}
        for i, d in sorted(slots):
            if item[i][1] != decontam.PRONOUN and not (i in (0, len(item) - 1) and item[i][1] in (decontam.NAME, decontam.NUMBER)):
                pairs[item[i][2], doc[d][2]] = item[i][1]
        left, right = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
        single = {p: left[p[0]] == 1 and right[p[1]] == 1 for p in pairs}
        share = lambda want: (lambda x: sum(x) / len(x) if x else 1.0)([v for p, v in single.items() if want(pairs[p])])
        held = share(lambda k: k == decontam.NUMBER) >= 0.5 and share(lambda k: k != decontam.NUMBER) >= 0.8
        return same, share(lambda k: True), held

    found, seen = [], {}
    for item_id, item_text in items:
        item = plain_template(item_text)
        size = min(len(item), 8)
        wanted = windows(item, size) if size >= 3 else []
        for doc_id, text in docs:
            if (doc_id, size) not in seen:
                places = defaultdict(list)
                doc = plain_template(text or "")
                for k, w in windows(doc, size) if size >= 3 else []:
                    places[w].append(k)
                seen[doc_id, size] = doc, places
            doc, places = seen[doc_id, size]
            met = [(i, places[w]) for i, w in wanted if w in places]
            if not met or len(met) < 0.5 * len(wanted):
                continue
            ways = [[(i, d[0]) for i, d in met]]
            for at in sorted({x - i for i, d in met for x in d}):
                near = [(i, min(d, key=lambda x, i=i: (abs(x - i - at), x))) for i, d in met]
                ways += [near, [(i, x) for i, x in near if abs(x - i - at) <= 8]]
            best = None
            for way in ways:
                if len(way) >= 0.5 * len(wanted):
                    same, share, held = values(item, doc, way, size)
                    if held and (best is None or (len(way) / len(wanted), same, share) > best):
                        best = len(way) / len(wanted), same, share
            if best:
                found.append((doc_id, item_id, best[0], best[2], best[1]))
    return found


def test_leaks_equal_the_whole_method_in_plain_python(spark):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    leaks = [tuple(r) for r in decontam.leaks(docs, bench).collect()]
    hit, rows = {r[0] for r in leaks}, texts(docs)
    sample = [(i, t) for i, t in rows if i in hit or i % 9 == 0]
    want = plain_leaks(sample, [(r["item_id"], r["text"]) for r in bench.collect() if r["text"]])
    assert sorted(want) == sorted(leaks) and len(want) > 10


ANNA = "{} has {} apples in a basket. {} gives {} apples to a friend and buys {} more at the market. How many apples does {} have now?".format
ASKED = {
    "anna": (ANNA("Anna", 12, "Anna", 3, 5, "Anna"), ANNA("Peter", 20, "Peter", 7, 9, "Peter"), ANNA("Anna", 15, "Peter", 4, 6, "Maria")),
    "tom": ("Tom runs 5km in 20min and rests for 10% of the whole time before the way back home.", "Susan runs 8km in 35min and rests for 20% of the whole time before the way back home.", "Susan walks to the shop and rests on the way back home before the evening."),
    "janet": (
        "Janet's ducks lay 16 eggs per day. She eats three for breakfast every morning and bakes muffins for her friends every day with four. She sells the rest at the market for $2 per egg. How much does she make every day?",
        "Robert's ducks lay 25 eggs per day. He eats five for breakfast every morning and bakes muffins for his friends every day with two. He sells the rest at the market for $3 per egg. How much does he make every day?",
        "Robert sells eggs at the market for $3 each. How much does he make every day if the ducks lay 25 eggs?",
    ),
    "russian": ("Поезд выехал из города Москва в 9 часов и прошёл 300 километров за 5 часов. С какой скоростью он ехал всё это время?", "Поезд выехал из города Омск в 7 часов и прошёл 480 километров за 6 часов. С какой скоростью он ехал всё это время?", "Поезд стоял в городе Омск и долго ждал, пока все люди войдут и сядут на места у окна."),
    "accents": ("Élodie achète 4 pommes au marché et donne 2 pommes à son ami Örjan avant le soir.", "Ägidius achète 9 pommes au marché et donne 5 pommes à son ami Łukasz avant le soir.", "Élodie va au marché avec son ami Örjan et rentre à la maison avant le soir."),
}


@pytest.mark.parametrize("options", [{}, {"limit": 0}])
def test_questions_with_other_names_and_units(spark, options):
    around = "Some words of a page come first. {} And other words of the page follow."
    items = spark.createDataFrame([(k, v[0]) for k, v in enumerate(ASKED.values())], "item_id long, text string")
    rows = [(10 * k + j, around.format(v[j])) for k, v in enumerate(ASKED.values()) for j in range(3)]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items, **options).collect()}
    assert got == {(10 * k + j, k): j == 0 for k in range(len(ASKED)) for j in range(2)}


def test_a_passage_after_a_name(spark):
    """The passage begins with a name that stands in it again, and a capital stands before it."""
    item = "Anna met the old man at the gate and gave the bread to Anna before the bell rang, so Anna left the gate at last"
    docs = spark.createDataFrame([(1, f"it was Maria {item} and so on."), (2, f"it was Maria. {item}")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for options in ({}, {"limit": 0}):
        assert {r["doc_id"] for r in decontam.leaks(docs, items, **options).collect()} == {1, 2}


def test_templates_do_not_depend_on_the_place():
    for item, *_ in ASKED.values():
        alone, within = decontam.canonical([item]), decontam.canonical(["Anna und Peter. " + item + " Ja, Anna!"])
        a, b = alone.code.tolist(), within.code.tolist()
        assert any(b[k : k + len(a)] == a for k in range(len(b)))


def test_rows_with_one_id_and_other_texts(spark):
    """Texts that a 30-bit hash of the text takes for one."""
    rows = [(1, "alpha beta gamma delta text number 149591"), (1, "alpha beta gamma delta text number 384672")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")
    assert sorted(r["text"] for r in neardup.deduplicate(df).collect()) == [t for _, t in rows]
    assert neardup.row_keyed(df).distinct().count() == 2
    assert Counter(tuple(r) for r in suffixdedup.remove_repeats(df).collect()) == plain_removal(rows * 2, 200)


def test_a_window_that_everything_shares(spark):
    """Items and documents that all hold one passage propose no pairs by it."""
    common = "this sentence stands in every single text of the table without any change at all"
    own = lambda k: " ".join("w" + f"{k:02}{j:02}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(30))
    docs = spark.createDataFrame([(k, f"{common} {own(k)}") for k in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"{common} {own(k)}") for k in range(30)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items, limit=0).collect()}
    assert got == {(k, k) for k in range(30)}
