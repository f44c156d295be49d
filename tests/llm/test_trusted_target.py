from codeloom.llm import quality_rules


def test_target_covers_all_trusted_documents(spark):
    n = 20_500
    docs = spark.range(n).selectExpr("id doc_id", "'abcd' text")
    labels = spark.range(n).selectExpr("id doc_id", "1 quality")
    counts = quality_rules.gram_counts(docs, quality_rules.trusted_ids(labels.union(labels.limit(9)))).collect()
    assert [(r.raw, r.target) for r in counts] == [(n, n)]
