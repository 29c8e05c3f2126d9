from pyspark.sql import functions as F

from panelyard.plans import model_queries as Q
from panelyard.plans.metric_queries import docs


def test_every_fold_year_is_scored(spark, sf_dir):
    _, _, df = Q.train_test(spark, sf_dir)
    first = df.agg(F.min("yr")).first()[0]
    want = {x.yr: x.n for x in df.where((F.col("yr") > first) & (F.col("yr") <= 1999)).groupBy("yr").agg(F.count("*").alias("n")).collect()}
    assert {x.fold: x.n for x in Q.oof(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n")).collect()} == want
    assert {x.fold for x in Q.candidates(spark, sf_dir).select("fold").distinct().collect()} == {*want, -1}


def test_nested_cv_scores_every_document(spark, sf_dir):
    got = Q.nested(spark, sf_dir)
    want = docs(spark, sf_dir).select("doc_id").distinct().count()
    assert got.count() == want and got.select("fold").distinct().count() == 3
