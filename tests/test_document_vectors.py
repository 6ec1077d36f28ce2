"""Document vectors by pieces of the corpus."""

from affinity.operators import text as X


def test_a_piece_gets_each_vector_once(spark, monkeypatch):
    """Two pieces and more; lists with null, unknown and repeated words."""
    monkeypatch.setattr(X, "PIECE", 4)
    lists = spark.createDataFrame([("p", ["x", "x", "y"]), ("q", ["z", None]), ("r", ["x", "z", "x", "y"]), ("s", None)], "_id string, _t array<string>")
    terms = spark.createDataFrame([("x", [1.0, 0.0], 2.0), ("y", [0.0, 1.0], 1.0), ("v", [9.0, 9.0], 1.0), ("z", [5.0, 5.0], 0.0)], "term string, vector array<float>, w double")
    got = {r["_id"]: (r["mean"], r["known"]) for r in X.mean_vectors(lists, terms).collect()}
    assert got == {"p": ([0.8, 0.2], 5.0), "r": ([0.8, 0.2], 5.0)}


def test_vectors_are_not_shuffled_for_each_word_of_a_text(spark):
    docs = spark.createDataFrame([(i, ["red", "green", "blue", f"w{i % 3}"]) for i in range(30)], "id bigint, tokens array<string>")
    plan = X.doc_vectors(X.word2vec(size=4).fit(docs), docs)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "aggregate_metrics" not in plan.lower() and "ObjectHashAggregate" not in plan
