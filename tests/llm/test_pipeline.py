import corpus_pipeline
from pyspark.sql import functions as F

from logwarden.llm import bpe, decontaminate, minhash, quality_classifier, quality_rules

from tests.llm.test_decontaminate import brute as benchmark_hits
from tests.llm.test_minhash import brute as components


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept: verdicts row by row, duplicates by all
    pairs, benchmark windows by plain search, and one result row for every survivor."""
    docs, marks, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model, forest = quality_classifier.learned(docs, marks), quality_rules.learned(docs, marks)
    good = {r.doc_id for r in quality_classifier.scored(docs, model).where("predicted = 1").collect()}
    good &= {r.doc_id for r in quality_rules.judged(docs, forest).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    firsts = {least for _, _, least in components(rows, 5)}
    tests = [(r.item_id, r.text) for r in items.collect()]
    left = {i for i, t in rows if i in firsts and not benchmark_hits(t, tests, decontaminate.WINDOW)[1]}
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(left)
    want = bpe.round_trip_digests(docs).where(F.col("doc_id").isin(left)).orderBy("doc_id").collect()
    assert got.orderBy("doc_id").collect() == want


def test_stages_return_the_columns_of_documents(spark, sf_dir, documents, odd):
    empty, rows = documents([]), documents(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf_dir).collect() == []
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns, name
        out.collect()
    assert minhash.representatives(rows).count() <= len(odd)
    assert len(corpus_pipeline.STAGES) == 5
