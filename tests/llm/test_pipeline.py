"""The pipeline end to end, and its stages one by one."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from panelworks.llm.queries import QUERIES
from pyspark.sql import functions as F


def test_stages_keep_columns_and_only_shrink(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and ids <= kept and docs.count() == len(ids), name
        kept = ids
    assert 0.5 * n < len(kept) < n


def test_stages_take_odd_rows_clashing_columns_and_empty_tables(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(1, None), (2, ""), (3, " "), (None, "no id"), (None, None), (4, "a"), (4, "a"), (5, "x" * 20_000), (4, "another text of the same id"), (6, "漢字 İ ß 🙂")]
    names = ["n", "h", "key", "text_key", "kept", "score", "row", "node", "lang_", "label", "_text_key", "_row", "doc"]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.unionByName(more).withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} >= {None, 1, 2, 3, 4, 5, 6}
        else:
            assert out.columns == docs.columns, name
            left = Counter((r["doc_id"], r["text"]) for r in out.collect())
            had = Counter((r["doc_id"], r["text"]) for r in docs.collect())
            assert not left - had, name
            if name != "near_dedup":
                assert all(left[r] == odd.count(r) for r in odd), name
            assert all(r[c] == c for r in out.limit(5).collect() for c in names)


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "packing"]
    used = out.groupBy("sequence_id").sum("length").collect()
    assert used and max(r[1] for r in used) <= 1024


def test_queries_are_registered_once_for_each_operator():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))
