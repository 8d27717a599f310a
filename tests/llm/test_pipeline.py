"""The pipeline's stages: columns, what each lets through, and the same end by run() and stage by stage."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from loomwire.llm import decontaminate, jaccard_join, mixing, packing, quality
from loomwire.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [Counter(r.doc_id for r in s.select("doc_id").collect()) for s in seen[:5]]
    model = quality.fit(docs, table(spark, SF, "labels"))
    assert set(ids[1]) == {r.doc_id for r in quality.score(docs, model).filter("predicted = 1").collect()}
    assert set(ids[2]) == {r.component_id for r in jaccard_join.join(seen[1]).collect()}
    bad = {r.doc_id for r in decontaminate.contaminated(seen[2], table(spark, SF, "benchmark")).collect()}
    assert set(ids[3]) == set(ids[2]) - bad
    for r in mixing.plan(seen[3]).collect():
        turns = sum(t * 2 >= r.size and t > 0 for t in (r.taken_first, r.taken_again))
        assert ids[4].get(r.doc_id, 0) == turns
    tokens = lambda df: sum(r.cu_seqlens[-1] for r in df.collect())
    assert tokens(seen[5]) == tokens(packing.pack(seen[4])) == tokens(corpus_pipeline.run(spark, SF))
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_of_odd_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""
    text = " ".join(f"w{i % 97}x{i}" for i in range(3000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id at all here", "en", None, 17), (4, text, None, "s", 9), (4, text, None, "s", 9), (5, text, "en", "t", 9), (6, "One two", "de", "t", 7), (None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        docs = docs.withColumns({c: F.lit("clash") for c in ("score", "predicted", "held_out", "point", "_point", "h", "taken", "shard", "size", "item_id", "text_hash", "n", "_at", "_doc", "a.b", "extra_0", "TEXT_", "d", "k.point")})
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < 4:
                assert out.columns == docs.columns
                kept = out.select("score", "h", "taken", "n").distinct().collect()
                assert all(set(r) == {"clash"} for r in kept)
                docs = written(out, "odd")
            else:
                out.collect()
