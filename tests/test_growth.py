"""What must not grow with the tables: broadcasts, windows left out, shuffled copies."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from affinity.functions.stemmer import stem
from affinity.llm import decontaminate, pseudolik
from affinity.operators import cells
from affinity.operators import joins as J
from affinity.operators import split as SP
from affinity.operators import text as X
from affinity.operators import vectors as V
from affinity.session import cut_lineage


def test_ratings_are_not_broadcast(spark):
    rows = [(u, (u * 7 + i * 3) % 40, 3.0) for u in range(30) for i in range(6)]
    rated = cut_lineage(spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double"))
    for like in (None, rated.filter("item_id % 2 = 0")):
        got = SP.negative_sample(rated, like=like)
        anti = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftAnti" in x]
        assert anti and all("SortMergeJoin" in x for x in anti)
        assert not {tuple(r) for r in got.collect()} & {r[:2] for r in rows}


def test_tries_are_not_broadcast(spark):
    rows = [(u, (u * 7 + i * 3) % 40, 3.0) for u in range(30) for i in range(6)]
    rated = cut_lineage(spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double"))
    for like in (None, rated.filter("item_id % 2 = 0")):
        got = SP.negative_sample(rated, like=like)
        per_user = {u: sum(r["user_id"] == u for r in got.collect()) for u in range(30)}
        assert like is not None or set(per_user.values()) == {6}
        joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "[idx#" in x]
        assert joins and all("SortMergeJoin" in x for x in joins)


def test_windows_far_from_where_a_probe_puts_the_start(spark):
    """Twelve words stand before the probes, so the best window starts twelve words before the place they name."""
    front, rare, tail = [f"f{i}" for i in range(100)], [f"r{i}" for i in range(24)], [f"t{i}" for i in range(30)]
    items = {0: front + rare + tail, 1: [*front, "own", *tail], **{i: [f"x{i}y{j}" for j in range(10)] + tail for i in range(2, 40)}}
    words = [f"p{i}" for i in range(20)] + front + [f"n{i}" for i in range(12)] + rare + tail + [f"q{i}" for i in range(9)]
    count = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
    df = Counter(s for x in items.values() for s in count(x))
    mass = lambda c: sum(np.log1p(40 / df[s] if s in df else 40) * n for s, n in c.items())
    target = count(items[0])
    windows = [count(words[a : a + len(items[0])]) for a in range(len(words) - 4)]
    best = max(mass(w & target) / mass(w | target) for w in windows)
    assert best >= 0.8
    docs = spark.createDataFrame([(7, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {r.item_id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert abs(got[0].similarity - best) < 1e-5


def test_every_word_is_a_target_of_the_training(spark):
    """Each word stands at one place of its document only, so a place that is left out shows in the score."""
    text = " ".join(["ash", "birch", "cedar", "date", "elm", "fir", "gum", "hazel"])
    docs = spark.range(4000).selectExpr("id AS doc_id", f"'{text}' AS text").repartition(2)
    for places in (text, " ".join(text.split()[:3])):
        one = spark.createDataFrame([(0, places)], "doc_id long, text string")
        assert pseudolik.score(one, pseudolik.fit(docs)).first().mean_log_likelihood > -4


def test_a_training_batch_is_a_few_array_calls(monkeypatch):
    """Places around a document are empty, and a slice of many batches is joined once, not once for each batch."""
    padded, place = pseudolik._padded(np.array([5, 6, 7, 8]), np.array([0, 3, 3, 4]))
    pad = pseudolik.PAD
    around = padded[place[:, None] + pseudolik._OFFSETS].tolist()
    assert around == [[pad, pad, 6, 7], [pad, 5, 7, pad], [5, 6, pad, pad], [pad] * 4]
    top = (1 << 64) - 1
    for known in ([7], [0, 5, 6, 1 << 48, (1 << 48) + 1, top], [3, top - 1]):
        known, h = np.array(known, np.uint64), np.array([0, 5, 8, (1 << 48) + 1, 1 << 50, top - 1, top], np.uint64)
        assert pseudolik._first_not_below(known, h).tolist() == np.searchsorted(known, h).tolist()
    monkeypatch.setattr(pseudolik, "BATCH", 8)
    joined, steps, concatenate = [], [], np.concatenate
    monkeypatch.setattr(np, "concatenate", lambda x, *a: joined.append(sum(map(len, x))) or concatenate(x, *a))
    monkeypatch.setattr(pseudolik, "train_step", lambda net, seen, ctx, y: steps.append(len(y)))
    text = pa.table({"text": [" ".join(f"w{i % 50}" for i in range(1000))] * 2})

    class Whole:  # hands the batches to the training function of a round
        select = groupBy = applyInPandas = lambda self, *a: self
        collect = lambda self: []

        def mapInArrow(self, run, schema):
            self.rows = list(run(iter(text.to_batches())))
            return self

    empty = np.array([], np.uint64)
    pseudolik._train_round(Whole(), empty, empty.astype(np.int64), pseudolik.Network.start().pack(), 0)
    assert sum(steps) == 1000 and set(steps) == {8}
    assert sum(n for n in joined if n <= 1000) < 3000


def test_stems_need_no_shuffle(spark):
    rows = [(1, ["running", "flies", "running"]), (1, ["cities", None]), (None, []), (2, None), (3, [None])]
    got = X.stem_tokens(spark.createDataFrame(rows, "doc_id long, tokens array<string>"), "doc_id")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(1, (stem("running"), stem("flies"), stem("running"))), (1, (stem("cities"),)), (None, ()), (2, None), (3, (None,))}
    assert {(r.doc_id, r.tokens if r.tokens is None else tuple(r.tokens)) for r in got.collect()} == want


def test_copy_groups_shuffle_documents_not_words(spark):
    rows = [(5, ["a", "b", "a"]), (3, ["b", "a", "a"]), (4, ["a", "b"]), (7, ["b"]), (7, ["a"]), (8, []), (9, None), (None, ["a", "b"])]
    got = X.copy_groups(spark.createDataFrame(rows, "doc_id long, tokens array<string>"), "doc_id")
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(5, 3), (3, 3), (4, 4), (7, 4), (None, 4)}


def test_leaves_grow_with_a_table_of_many_dimensions(spark, monkeypatch):
    """With 16 leaves at most a vector travels 16 times, however many vectors there are; the rows are those of any leaf size."""
    monkeypatch.setattr(cells, "CELL", 20)
    x = np.random.default_rng(3).normal(size=(2000, 16))
    many = cut_lineage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"))
    assert V._leaf_size(many) == 125
    assert V._leaf_size(many.withColumn("v", F.slice("v", 1, 2))) == 20
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    got = {r.id: r.neighbor for r in V.knn_l2_exact(many, "id", "v", 1).collect()}
    assert [got[i] for i in range(len(x))] == d.argmin(axis=1).tolist()


def test_predictions_are_made_once_for_the_pairs(spark):
    made = spark.sparkContext.accumulator(0)

    def predict(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = [(u, float((u * i) % 7)) for u in range(5) for i in range(8)]
    neg = spark.createDataFrame(rows, "user_id bigint, prediction double")
    pos = spark.createDataFrame([(u, 3.0) for u in range(6)] + [(None, 1.0)], neg.schema)  # user 5 has no negatives
    got = {r["user_id"]: (r["n_pos"], r["n_neg"], r["n_wins"]) for r in J.pos_neg_pairs(pos, neg.mapInPandas(predict, neg.schema)).collect()}
    assert got == {u: (1, 8, sum(v == u and p < 3.0 for v, p in rows)) for u in range(5)}
    assert made.value == len(rows)
