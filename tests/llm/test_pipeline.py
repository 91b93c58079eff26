"""The corpus pipeline, stage by stage."""

import corpus_pipeline
import __spark_entry__ as entry
from aeris.llm import decontaminate, exact_dedup, jaccard_join
from aeris.llm.common import read_table


def test_registered():
    names = list(entry.queries())
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)] and "pipeline" in names


def test_stages(spark, sf_small, tmp_path):
    docs = read_table(spark, sf_small, "documents")
    before = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before[name] = docs
        out = stage(spark, docs, sf_small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in before.items()}
    dropped = {r.doc_id for r in exact_dedup.exact_dedup(before["exact"]).where("not kept").collect()}
    assert ids["near"] == ids["exact"] - dropped
    joined = jaccard_join.jaccard_join(before["near"]).collect()
    assert ids["benchmark"] == {r.doc_id for r in joined if r.doc_id == r.class_id}
    leaks = {r.doc_id for r in decontaminate.matches(before["benchmark"], read_table(spark, sf_small, "benchmark")).collect()}
    assert ids["packed"] == ids["benchmark"] - leaks and leaks
    assert {r.doc_id for r in docs.select("doc_id").collect()} == ids["packed"]
    assert corpus_pipeline.run(spark, sf_small).count() == docs.count()
