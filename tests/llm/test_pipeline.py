"""The stages against plain versions, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from rasterweave.llm import pieces, quality
from rasterweave.sources.settle import settle
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(settle(stage(spark, kept[-1], SF)))
    for k in kept[1:-1]:
        assert k.schema == docs.schema

    def texts(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    first, good, single, clean, masked = map(texts, kept[:5])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.digest(docs, labels).collect()}
    assert good == {d: t for d, t in first.items() if scores[d] >= 0.3}
    assert single == {d: good[d] for d, _, c in brute.classes(good.items(), 5, 80) if c == d}
    assert clean == {d: single[d] for d, _, _, _, _, bad in brute.contaminated(single.items(), bench) if not bad}
    assert masked.keys() == clean.keys()
    for d, text in clean.items():
        spans = brute.secrets(text)
        assert not brute.secrets(masked[d])
        if not spans and masked[d] != text:
            assert "[secret]" in masked[d]
    assert sum(masked[d] != t for d, t in clean.items() if not brute.secrets(t)) <= 0.02 * len(clean)
    assert {(r["doc_id"], r["n_chars"]) for r in kept[4].collect()} == {(d, len(t)) for d, t in masked.items()}
    back = pieces.decode(kept[5], pieces.vocabulary()).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == masked
