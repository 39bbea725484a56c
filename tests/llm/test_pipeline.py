import corpus_pipeline
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages_work_on_what_their_predecessors_kept(spark, tmp_path):
    docs, counts = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append((docs.count(), after.count()))
        if i < 4:
            assert after.columns == columns
        if i < 2:
            assert after.exceptAll(docs).count() == 0
        docs = after
    (all_docs, good), (_, distinct), (_, cut), _, (mixed, encoded) = counts
    assert all_docs > good > distinct == cut and mixed == encoded
    again = corpus_pipeline.run(spark, DATA)
    total = F.sum("n_tokens").alias("n")
    assert again.agg(total).collect() == docs.agg(total).collect() and again.count() == encoded
