"""The pipeline's stages: names, columns, and decisions that take effect."""

import corpus_pipeline
from pyspark.sql import functions as F

from weft.llm import decontaminate, line_dedup, order_minhash
from weft.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "mixing"]


def test_decisions_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    kept, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, SMALL).cache()
        assert kept.columns == docs.columns
        assert kept.join(before, "doc_id", "left_anti").count() == 0
        seen.append(kept)
    lines = line_dedup.line_classes(seen[1])
    assert lines.filter("not keep").count() == 0
    assert order_minhash.classes(seen[2]).filter("doc_id != class_id").count() == 0
    assert decontaminate.matches(kept, table(spark, SMALL, "benchmark")).count() == 0
    clean = seen[2].join(decontaminate.matches(seen[2], table(spark, SMALL, "benchmark")).select("doc_id").distinct(), "doc_id", "left_anti")
    assert kept.count() == clean.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0
    assert out.filter(F.col("mix_order").isNull()).count() == 0


def test_stages_accept_no_documents(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
