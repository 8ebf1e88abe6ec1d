"""The stages of the pipeline, each on what the one before kept, against plain Python."""

from collections import Counter

import corpus_pipeline
from lexigrove.llm import quality

from .test_neardup import brute_kept
from .test_operators import words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf)
        after = docs.collect()
        seen.append(name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality rules":
            kept = {r.doc_id for r in quality.judged(spark.createDataFrame(before, docs.schema)).where("kept").collect()}
            assert {r.doc_id for r in after} == kept and len(after) == len(kept)
        if name == "simhash near-dedup":
            assert sorted(r.doc_id for r in after) == brute_kept([(r.doc_id, r.text) for r in before])
        if name == "pii pseudonyms":
            assert len(after) == len(before) and all(len(r.text) == r.n_chars for r in after)
            assert not any("@" in r.text and r.text == o.text for r, o in zip(sorted(after), sorted(before)))
        if name == "mix sources":
            n = Counter(r.doc_id for r in after)
            assert max(n.values()) <= 2
            total, mixed = (sum(len(words(r.text)) for r in x) for x in (before, after))
            assert abs(mixed - 1.5 * total) < 0.05 * total
        if name == "pack":
            assert Counter(r.doc_id for r in after if r.start == 0) == Counter(r.doc_id for r in before)
    assert len(seen) == 5


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
