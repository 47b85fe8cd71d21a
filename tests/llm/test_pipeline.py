import hashlib
from collections import Counter

from helpers import SMALL
from test_llm_ops import exact_classes, plain_leaks, plain_removal, tokenizer

import corpus_pipeline
from keyloom.llm import neardup, quality, suffixdedup


def test_stages(spark, odd, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SMALL).columns == odd.columns
        assert stage(spark, nothing, SMALL).count() == 0


def test_run_equals_the_stages_in_plain_python(spark, docs):
    """Surviving texts of every stage, and the pieces at the end."""
    cleaned = sorted((r["doc_id"], r["text"]) for r in quality.clean(docs).collect())  # held against SQL in its own tests
    idf = neardup.idf(quality.clean(docs))
    classes, _ = exact_classes([t for _, t in cleaned], idf)
    first = [cleaned[k] for k in sorted(set(classes))]
    removed = plain_removal(first, 200)
    stripped = {r["doc_id"]: r["text"] for r in suffixdedup.strip(spark.createDataFrame(first, "doc_id long, text string")).collect()}
    assert set(stripped) == {i for i, _ in first}
    for i, n, gone, spans, digest in removed:
        if not gone:
            assert hashlib.sha256(stripped[i].encode()).hexdigest() == digest
        else:
            assert n - gone <= len(stripped[i].encode()) <= n - gone + 6 * spans
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r["text"]]
    leaked = {x[0] for x in plain_leaks(sorted(stripped.items()), items)}
    t, want = tokenizer(), Counter()
    for i, text in stripped.items():
        if i not in leaked:
            want[i] += len(t.encode(text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r["doc_id"]] += r["length"]
        assert r["length"] & (r["length"] - 1) == 0 and r["doc_tokens"] == want[r["doc_id"]]
    assert got == want and len(got) > 50
