import __spark_entry__
import corpus_pipeline
from siftwork.llm import bpe, decontaminate, near_dedup, pii, quality
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_their_effect(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = __spark_entry__.queries()["pipeline"](spark, SF)
    assert out.columns == [*docs.columns, "tokens", "n_tokens", "round_trip"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(r["round_trip"] for r in rows.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    # the same by hand, stage by stage
    score = {r["doc_id"]: r["score"] for r in quality.scores(docs, docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = {k for k, s in score.items() if s >= quality.THRESHOLD}
    assert 0 < len(kept) < len(texts)
    left = docs.where(docs["doc_id"].isin(sorted(kept)))
    kept = {r["doc_id"] for r in near_dedup.near_duplicates(left, 3, 85).collect() if r["kept"]}
    left = docs.where(docs["doc_id"].isin(sorted(kept)))
    kept = {r["doc_id"] for r in decontaminate.overlaps(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r["n_hit"] == 0}
    assert set(rows) == kept and len(rows) == out.count()
    left = docs.where(docs["doc_id"].isin(sorted(kept)))
    masked = {r["doc_id"]: r["text"] for r in pii.masked(left).collect()}
    assert {k: r["text"] for k, r in rows.items()} == masked and any(masked[k] != texts[k] for k in masked)
    assert {r["doc_id"]: r["tokens"] for r in bpe.encoded(left.where("false").union(spark.createDataFrame([(k, t, None, None, None) for k, t in masked.items()], left.schema))).collect()} == {k: r["tokens"] for k, r in rows.items()}


def test_each_stage_takes_odd_documents(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = cases.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        n = out.count()
        assert n == len(cases.ROWS) if name in ("pii", "bpe") else n <= len(cases.ROWS)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_the_rest_does_without_these_operators(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = __spark_entry__.queries()
    assert "search_documents" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert "pipeline" not in __spark_entry__.oracle_sql()
