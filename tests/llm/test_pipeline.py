"""The pipeline: columns, decisions that take effect, rows that stay as they are."""

from collections import Counter

import corpus_pipeline
from foliant.llm import language_id, minhash, quality_rules


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("source", "n")
    before = Counter(map(tuple, docs.collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        rows = Counter(map(tuple, after.collect()))
        assert not rows - before and sum(rows.values()) > 0
        docs, before = spark.createDataFrame([r for r, k in rows.items() for _ in range(k)], docs.schema), rows
    packed = corpus_pipeline.pack_sequences(spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in before}


def test_decisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    out = language_id.identify(docs)
    assert ids(language_id.keep_identified(docs)) == ids(out.where("NOT rejected AND lang_pred <> 'und'"))
    assert ids(quality_rules.keep_good(docs)) == ids(quality_rules.judge(docs).where("kept"))
    assert ids(minhash.keep_one(docs)) == ids(minhash.link_components(docs, 5, 80).where("kept"))


def test_nulls_and_repeats(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text, "en"), (None, text, "en"), (1, None, None), (1, text + " more", "en"), (1, text + " more", "en"), (2, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert quality_rules.keep_good(docs).count() == 4
    kept = minhash.keep_one(docs).collect()
    assert sorted((r.doc_id, str(r.text)) for r in kept) == [(1, "None"), (1, text + " more"), (2, "")]
    for f in (quality_rules.keep_good, minhash.keep_one, language_id.keep_identified):
        assert f(docs.limit(0)).count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
