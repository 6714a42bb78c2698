from siftwork.plans.query import SearchQuery
from siftwork.streaming import watch


def test_each_batch_is_searched_once(spark, tmp_path):
    query = SearchQuery(("alpha", "beta"), ("gamma",), 20)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame([(1, "alpha, beta"), (2, "alpha"), (3, "alpha beta gamma"), (4, None)], "doc_id long, text string").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    watch(stream, query, out, checkpoint, once=True).awaitTermination()
    assert [r["doc_id"] for r in spark.read.parquet(out).collect()] == [1]
    spark.createDataFrame([(5, "betas of alpha")], "doc_id long, text string").write.mode("append").parquet(source)
    watch(stream, query, out, checkpoint, once=True).awaitTermination()
    rows = spark.read.parquet(out).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["raw_excerpts"]) for r in rows] == [(1, ["alpha, beta"]), (5, ["betas of alpha"])]
