import corpus_pipeline
from panelyard.llm import queries


def test_stages_over_the_smallest_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "span_dedup", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {x.doc_id for x in docs.collect()}
    assert out and {x.doc_id for x in out} <= ids
    assert all(x.copy >= 1 for x in out) and len({(x.doc_id, x.copy) for x in out}) == len(out)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
