import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from affinity.operators import aggregates as A
from affinity.operators import baseline as B
from affinity.operators import clean as K
from affinity.operators import cocluster as CC
from affinity.operators import joins as J
from affinity.operators import metrics as M
from affinity.operators import recommend as P
from affinity.operators import similarity as S
from affinity.operators import split as SP


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def matrix(df):
    r = {(x["user_id"], x["item_id"]): x["rating"] for x in df.collect()}
    return r, sorted({u for u, _ in r}), sorted({i for _, i in r})


def test_pair_sums_with_a_hot_user(skewed):
    r, users, items = matrix(skewed)
    want = {}
    for i, j in combinations(items, 2):
        both = [(r[u, i], r[u, j]) for u in users if (u, i) in r and (u, j) in r]
        if both:
            want[i, j] = (len(both), sum(a * b for a, b in both))
    for floor in (10, 10**9):
        got = {(x["item_i"], x["item_j"]): (x["n"], x["dot"]) for x in S.corated_pairs(skewed, floor).collect()}
        assert got == want


def test_zero_filled_pearson_is_pearson_of_the_dense_matrix(toy):
    r, users, items = matrix(toy)
    dense = np.array([[r.get((u, i), 0.0) for i in items] for u in users])
    corr = np.corrcoef(dense.T)
    pairs = toy.sparkSession.createDataFrame(list(combinations(items, 2)), "item_i bigint, item_j bigint")
    got = S.item_pearson_zero_filled(toy, pairs).collect()
    assert len(got) == 6
    for x in got:
        assert x["sim"] == pytest.approx(corr[items.index(x["item_i"]), items.index(x["item_j"])])
    # pairs nobody rated both of are negative, so leaving them out cannot change a neighbourhood
    assert all(x["sim"] < 0 for x in got if x["n"] == 0)


def test_corated_pearson_needs_two_and_variance(spark):
    df = spark.createDataFrame(
        [(1, 1, 3.0), (2, 1, 3.0), (1, 2, 1.0), (2, 2, 5.0), (3, 3, 2.0), (1, 3, 2.0)], "user_id bigint, item_id bigint, rating double"
    )
    assert rows(S.item_pearson_corated(df)) == [(1, 2, 2, None)]


def test_knn_centered_by_hand(toy):
    sims = S.item_pearson_zero_filled(toy)
    s = {(x["item_i"], x["item_j"]): x["sim"] for x in S.mirror(sims).collect()}
    means = {x["item_id"]: x["item_mean"] for x in A.item_means_zero_filled(toy).collect()}
    r, users, items = matrix(toy)
    g = sum(r.values()) / len(r)
    got = {(x["user_id"], x["item_id"]): x["prediction"] for x in P.knn_centered_predict(toy, sims, J.anti_testset(toy)).collect()}
    assert set(got) == {(u, i) for u in users for i in items if (u, i) not in r}
    for (u, t), p in got.items():
        near = [(s[t, j], r[u, j] - means[j]) for j in items if (u, j) in r and s.get((t, j), 0) > 0]
        want = means[t] + sum(a * b for a, b in near) / sum(a for a, _ in near) if near else g
        assert p == pytest.approx(want)


def test_slope_one_by_hand(toy):
    r, users, items = matrix(toy)
    dev = {}
    for i in items:
        for j in items:
            d = [r[u, i] - r[u, j] for u in users if i != j and (u, i) in r and (u, j) in r]
            if d:
                dev[i, j] = sum(d) / len(d)
    for x in P.slope_one(toy, J.anti_testset(toy)).collect():
        u, t = x["user_id"], x["item_id"]
        own = [r[u, j] for j in items if (u, j) in r]
        d = [dev[t, j] for j in items if (u, j) in r and (t, j) in dev]
        assert x["prediction"] == pytest.approx(sum(own) / len(own) + (sum(d) / len(d) if d else 0.0))


def test_slope_one_unknown_user_gets_global_mean(spark, toy):
    t = spark.createDataFrame([(99, 1)], "user_id bigint, item_id bigint")
    assert P.slope_one(toy, t).first()["prediction"] == pytest.approx(33 / 9)


def test_anti_testset_with_small_chunks(skewed):
    r, users, items = matrix(skewed)
    want = sorted((u, i) for u in users for i in items if (u, i) not in r)
    assert rows(J.anti_testset(skewed, chunk=7)) == want


def test_negative_sample(skewed, monkeypatch):
    monkeypatch.setattr(SP, "STEP", 8)
    r, users, items = matrix(skewed)
    got = rows(SP.negative_sample(skewed))
    assert len(got) == len(set(got)) and not set(got) & set(r)
    per = defaultdict(int)
    for u, _ in got:
        per[u] += 1
    for u in users:
        rated = sum((u, i) in r for i in items)
        assert per[u] == min(rated, len(items) - rated)


@pytest.mark.parametrize("n", [1, 2, 6, 25, 1000, 1024])
def test_step_visits_every_index(n):
    s = SP.coprime_step(n)
    assert {t * s % n for t in range(n)} == set(range(n))


def test_auc_without_the_pair_product(spark):
    rng = np.random.default_rng(5)
    pos = [(int(u), float(rng.integers(0, 6))) for u in rng.integers(0, 5, 80)]
    neg = [(int(u), float(rng.integers(0, 6))) for u in rng.integers(0, 5, 90)]
    p, n = (spark.createDataFrame(x, "user_id bigint, prediction double") for x in (pos, neg))
    counts = J.counts_left_outer(J.pos_neg_pairs(p, n))
    want = {}
    for u in range(5):
        pairs = [(a, b) for v, a in pos if v == u for w, b in neg if w == u]
        want[u] = (len(pairs), sum(a > b for a, b in pairs))
    assert {x["user_id"]: (x["total"], x["correct"]) for x in counts.collect()} == want
    assert M.mean_auc(counts).first()["mean_auc"] == pytest.approx(np.mean([c / t for t, c in want.values()]))


def test_every_alpha_of_the_als_grid_is_a_fit_of_its_own(skewed):
    train, test = SP.train_test(skewed, ["user_id", "item_id"], 20)
    runs = P.als_grid(train, test, [2, 3], [0.1], [1, 40], max_iter=2, blocks=2)
    got = runs.collect()
    assert sorted((r["rank"], r["alpha"]) for r in got) == [(2, 1.0), (2, 40.0), (3, 1.0), (3, 40.0)]
    assert len({r["rmse"] for r in got}) == 4 and [r["rmse"] for r in got] == sorted(r["rmse"] for r in got)
    alone = P.als_grid(train, test, [2], [0.1], [40], max_iter=2, blocks=2).first()
    assert alone["rmse"] == pytest.approx(next(r["rmse"] for r in got if (r["rank"], r["alpha"]) == (2, 40.0)))
    explicit = P.als_grid(train, test, [2], [0.1, 1.0], None, max_iter=2)
    assert explicit.columns == ["rank", "reg", "rmse", "mae"] and explicit.count() == 2
    for runs_ in (runs, explicit):
        best = P.als_best(skewed, train, test, runs_, max_iter=2).collect()
        assert len(best) == 1 and 0 <= best[0]["auc"] <= 1 and best[0]["rmse"] == runs_.first()["rmse"]


def test_negatives_like_a_held_out_part(skewed):
    _, test = SP.train_test(skewed, ["user_id", "item_id"], 30)
    got = rows(SP.negative_sample(skewed, like=test))
    rated, items = {(r["user_id"], r["item_id"]) for r in skewed.collect()}, {r["item_id"] for r in skewed.collect()}
    wanted, left = defaultdict(int), defaultdict(int)
    for r in test.collect():
        wanted[r["user_id"]] += 1
    for u in wanted:
        left[u] = len(items) - sum(v == u for v, _ in rated)
    assert not set(got) & rated and len(set(got)) == len(got)
    assert all(sum(v == u for v, _ in got) == min(n, left[u]) for u, n in wanted.items())


def test_knn_grid_equals_one_cross_validation_per_setting(skewed):
    folded = SP.kfold_assign(skewed, ["user_id", "item_id"], 3)
    measures = {"cosine": lambda t: S.item_cosine_corated(t).withColumn("sim", F.round("sim", 9))}
    got = {r["k"]: (r["mean_rmse"], r["mean_mae"]) for r in P.knn_grid(folded, measures, [2, 3, 30], 3).collect()}
    for k in (2, 30):
        scores = P.cross_validate(folded, lambda train, test, k=k: P.knn_basic_predict(train, measures["cosine"](train), test, k), 3)
        m = P.cross_validation_means(scores).first()
        assert got[k] == pytest.approx((m["mean_rmse"], m["mean_mae"]))
    assert set(got) == {2, 3, 30}


def test_knn_grid_on_biases_equals_one_cross_validation_per_setting(skewed):
    folded = SP.kfold_assign(skewed, ["user_id", "item_id"], 3)
    for fit in (lambda t: B.baseline_als(t, 2), lambda t: B.baseline_gd(t, 2)):

        def measure(train, fit=fit):
            return S.item_pearson_baseline(B.residuals(train, fit(train))).withColumn("sim", F.round("sim", 9))

        got = P.knn_grid(folded, {}, [4], 3, centred={"pb": measure}).collect()
        scores = P.cross_validate(folded, lambda train, test, m=measure: P.knn_basic_predict(train, m(train), test, 4), 3)
        m = P.cross_validation_means(scores).first()
        assert [(r["sim"], r["k"]) for r in got] == [("pb", 4)]
        assert (got[0]["mean_rmse"], got[0]["mean_mae"]) == pytest.approx((m["mean_rmse"], m["mean_mae"]))


def test_factor_scores_equal_a_fit_for_each_fold(skewed):
    """With a huge penalty factors vanish, so the random start has no say; with a small one they fit the train rows."""
    folded = SP.kfold_assign(skewed, ["user_id", "item_id"], 3)
    scores = P.factor_scores(folded, [4], [1e9, 0.01], n_factors=3, folds=3)
    got = {(r["fold"], r["part"]): (r["rmse"], r["mae"], r["n"]) for r in scores.filter("reg > 1").collect()}
    alone = P.cross_validate_fitted(folded, lambda train, rows: P.biased_mf(train, rows, 3, 1e9, 4), 3)
    want = {(r["fold"], r["part"]): (r["rmse"], r["mae"], r["n"]) for r in alone.collect()}
    assert set(got) == set(want) and len(got) == 6
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    close = {(r["fold"], r["part"]): r["rmse"] for r in scores.filter("reg < 1").collect()}
    assert all(close[f, "train"] < got[f, "train"][0] for f in range(3))
    grid = P.factor_grid(folded, epochs=[2], regs=[0.1, 1.0], n_factors=2, folds=3).collect()
    assert [r["mean_rmse"] for r in grid] == sorted(r["mean_rmse"] for r in grid) and len(grid) == 2


def test_fitted_folds_equal_cross_validation(skewed):
    def predict(train, rows):
        return CC.co_clustering_predict(train, CC.co_clustering(train, n_epochs=1), rows)

    folded = SP.kfold_assign(skewed, ["user_id", "item_id"], 2)
    got = sorted((r["fold"], r["part"], round(r["rmse"], 9), r["n"]) for r in P.cross_validate_fitted(folded, predict, 2).collect())
    want = P.cross_validate(folded, predict, 2, train_scores=True).collect()
    assert got == sorted((r["fold"], r["part"], round(r["rmse"], 9), r["n"]) for r in want)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_top_n_from_similarities_equals_top_n_of_all_unrated_pairs(toy, skewed, n):
    for ratings in (toy, skewed):
        sims = S.item_pearson_zero_filled(ratings)
        all_pairs = P.knn_centered_predict(ratings, sims, J.anti_testset(ratings)).withColumn("prediction", F.round("prediction", 6))
        want = rows(P.top_n_per_user(all_pairs, n).select("user_id", "item_id", "prediction", "rank"))
        assert rows(P.knn_centered_top_n(ratings, sims, n).select("user_id", "item_id", "prediction", "rank")) == want
    none = toy.limit(0)
    assert P.knn_centered_top_n(none, S.item_pearson_zero_filled(toy).limit(0), n).count() == 0


def test_smallest_missing_reads_the_gaps(spark):
    rng = np.random.default_rng(4)
    items = sorted(rng.choice(1000, 40, replace=False).tolist())
    held = {1: items[:], 2: items[3:], 3: items[::2], 4: items[:35], 5: [items[39]], 6: rng.choice(items, 20, replace=False).tolist()}
    known = spark.createDataFrame([(u, i) for u, ids in held.items() for i in ids], "user_id bigint, item_id bigint")
    table = spark.createDataFrame([(i,) for i in items], "item_id bigint")
    for n in (1, 4, 100):
        want = [(u, i) for u, ids in held.items() for i in [i for i in items if i not in ids][:n]]
        assert rows(P.smallest_missing(known, table, n)) == sorted(want)


def test_als_recommends_unrated_items_only(skewed):
    model = P.als(rank=3, max_iter=3).fit(skewed)
    rated = {(r["user_id"], r["item_id"]) for r in skewed.collect()}
    per = {}
    for r in P.als_recommend_top_n(model, 7, skewed).collect():
        assert (r["user_id"], r["item_id"]) not in rated
        per.setdefault(r["user_id"], []).append((r["rank"], r["prediction"], r["item_id"]))
    users, items = {u for u, _ in rated}, {i for _, i in rated}
    scores = {(r["user_id"], r["item_id"]): r["prediction"] for r in model.transform(J.anti_testset(skewed)).collect()}
    for u in users:
        left = items - {i for v, i in rated if v == u}
        got = sorted(per.get(u, []))
        assert [r for r, _, _ in got] == list(range(1, min(7, len(left)) + 1))
        best = sorted((scores[u, i] for i in left), reverse=True)[:7]
        assert [p for _, p, _ in got] == pytest.approx(best, abs=1e-5)
    assert {r["user_id"] for r in P.als_recommend_top_n(model, 2).collect()} == users


def test_top_n(toy):
    preds = toy.withColumn("prediction", F.col("rating"))
    got = {x["user_id"]: x["items"] for x in P.top_n_lists(preds, 2).collect()}
    assert got == {1: [1, 3], 2: [4, 1], 3: [3, 2], 4: [1]}


def test_neighbour_lists(toy):
    sims = S.item_cosine_corated(toy)
    lists = S.similarity_lists(sims, width=2).collect()
    assert all(len(x["entries"]) <= 2 for x in lists)
    assert sum(len(x["entries"]) for x in lists) == 2 * sims.count()
    best = {x["item_i"]: x["item_j"] for x in S.row_argmax(sims).collect()}
    assert best == {x["item_i"]: x["item_j"] for x in S.top_k_neighbors(sims, 1).collect()}


def test_baselines(toy):
    r, users, items = matrix(toy)
    mu = sum(r.values()) / len(r)
    bu, bi = dict.fromkeys(users, 0.0), {}
    for _ in range(3):
        bi = {i: sum(r[k] - mu - bu[k[0]] for k in r if k[1] == i) / (10 + sum(k[1] == i for k in r)) for i in items}
        bu = {u: sum(r[k] - mu - bi[k[1]] for k in r if k[0] == u) / (15 + sum(k[0] == u for k in r)) for u in users}
    b = B.baseline_als(toy, 3)
    assert {x["item_id"]: x["bi"] for x in b.items.collect()} == pytest.approx(bi)
    assert {x["user_id"]: x["bu"] for x in b.users.collect()} == pytest.approx(bu)
    for x in B.baseline_predict(toy, b).collect():
        assert x["prediction"] == pytest.approx(mu + bu[x["user_id"]] + bi[x["item_id"]])


def test_gradient_baseline_is_stable_for_a_hot_user(skewed):
    loss = []
    for epochs in (1, 12):
        b = B.baseline_gd(skewed, epochs, lr=0.5)
        loss.append(M.rmse(B.baseline_predict(skewed, b)).first()["rmse"])
    assert loss[1] < loss[0]


def test_co_clustering_improves_on_its_start(spark):
    """Ratings made from planted user and item groups, a fifth of them missing."""
    blocks = [[5.0, 1.0, 3.0], [1.0, 4.0, 2.0], [2.0, 3.0, 5.0]]
    data = [(u, i, blocks[u * 3 // 24][i * 3 // 18]) for u in range(24) for i in range(18) if (u * 7 + i * 5) % 5]
    df = spark.createDataFrame(data, "user_id bigint, item_id bigint, rating double").cache()
    start = CC.hash_clusters(df)
    done = CC.co_clustering(df, n_epochs=3)
    err = [M.rmse(CC.co_clustering_predict(df, c, df)).first()["rmse"] for c in (start, done)]
    assert err[1] < 0.8 * err[0]
    assert {x["g"] for x in done.users.collect()} <= {0, 1, 2}
    unknown = spark.createDataFrame([(999, 1), (1, 999), (999, 999)], "user_id bigint, item_id bigint")
    got = CC.co_clustering_predict(df, done, unknown)
    assert got.count() == 3 and got.filter("prediction IS NULL").count() == 0


def test_cross_validation_covers_every_row_once(skewed):
    folds = SP.kfold_assign(skewed, ["user_id", "item_id"], 3)
    scores = P.cross_validate(folds, P.slope_one, 3, train_scores=True)
    test = scores.filter("part = 'test'").agg(F.sum("n")).first()[0]
    assert test == skewed.count() and scores.count() == 6
    assert P.cross_validation_means(scores).count() == 2


def test_errors_agree_with_the_evaluator(toy):
    preds = toy.withColumn("prediction", F.col("rating") * 0.9 + 0.2)
    for name, fn in (("rmse", M.rmse), ("mae", M.mae)):
        ev = RegressionEvaluator(metricName=name, labelCol="rating", predictionCol="prediction")
        assert fn(preds).first()[0] == pytest.approx(ev.evaluate(preds))


def test_als_drops_unknown_and_repeats(spark, skewed):
    unseen = spark.createDataFrame([(999, 0, 3.0)], "user_id bigint, item_id bigint, rating double")
    out = [rows(P.als_fit_predict(skewed.coalesce(1), skewed.unionByName(unseen), rank=2, max_iter=2)[1]) for _ in range(2)]
    assert out[0] == out[1] and all(not math.isnan(x[-1]) and x[0] != 999 for x in out[0])
    assert out[0] and P.als_grid(skewed, skewed, [2], [0.1], [1, 10], max_iter=2).count() == 2


def test_biased_mf_stays_on_the_scale(spark, skewed):
    unseen = spark.createDataFrame([(999, 0, 3.0)], "user_id bigint, item_id bigint, rating double")
    got = P.biased_mf(skewed, skewed.unionByName(unseen), n_factors=2, n_epochs=2)
    lo, hi, n = got.agg(F.min("prediction"), F.max("prediction"), F.count("prediction")).first()
    assert 1 <= lo and hi <= 5 and n == skewed.count() + 1


def test_splits(spark, skewed):
    n = skewed.count()
    parts = SP.random_split(skewed, [0.8, 0.1], 3)
    assert sum(p.count() for p in parts) == n
    train, test = SP.train_test(skewed, ["user_id", "item_id"], 30)
    assert train.count() + test.count() == n and 0 < test.count() < n
    labelled = spark.range(500).select("id", (F.col("id") < 7).cast("int").alias("y"))
    sample = SP.balanced_class_sample(labelled, "y", "id", 50)
    assert rows(sample.groupBy("y").count()) == [(0, 50), (1, 50)]
    assert sample.filter("y = 1 AND id >= 7").count() == 0
    assert rows(SP.downsample_negatives(labelled, "y", "id", 2.0).groupBy("y").count()) == [(0, 14), (1, 7)]


def test_item_means_fall_back_to_the_global_mean(spark):
    df = spark.createDataFrame([(1, 1, 4.0), (2, 1, 2.0), (1, 2, 0.0)], "user_id bigint, item_id bigint, rating double")
    assert rows(A.item_means_zero_filled(df)) == [(1, 3.0), (2, 3.0)]


def test_cleaning(spark):
    df = spark.createDataFrame([("1", "2", "4.5"), ("x", "3", "?")], "user_id string, item_id string, rating string")
    assert {tuple(r) for r in K.cast_ratings(df).collect()} == {(1, 2, 4.5), (None, 3, None)}
    big = df.sparkSession.range(5000).selectExpr("id", "id % 1000 AS part", "CAST(id % 7 AS DOUBLE) AS x", "CASE WHEN id % 2 = 0 THEN 'a' END AS s", "map('k', id) AS m")
    exact = {r["column"]: r for r in K.table_profile(big).collect()}
    near = {r["column"]: r for r in K.table_profile(big, approximate=True).collect()}
    assert [exact[c]["distinct_values"] for c in ("id", "part", "x", "s", "m")] == [5000, 1000, 7, 1, None]
    assert exact["s"]["nulls"] == 2500 and exact["m"]["rows"] == 5000
    for c, r in near.items():
        assert (r["type"], r["rows"], r["nulls"]) == (exact[c]["type"], exact[c]["rows"], exact[c]["nulls"])
        assert r["distinct_values"] == pytest.approx(exact[c]["distinct_values"], rel=0.06) if c != "m" else r["distinct_values"] is None
    assert "Expand" not in K.table_profile(big)._jdf.queryExecution().optimizedPlan().toString()
    prof = {r["column"]: r for r in K.table_profile(df.withColumn("z", F.lit(None).cast("int"))).collect()}
    assert prof["z"]["nulls"] == 2 and prof["z"]["distinct_values"] == 0 and prof["user_id"]["distinct_values"] == 2
    nested = spark.createDataFrame([("A", (["x"], None)), ("B", None)], "asin string, related struct<also_viewed:array<string>,bought:array<string>>")
    assert rows(K.flatten_related(nested).select("asin", F.size("also_viewed")))[0] == ("A", 1)
    assert K.flatten_related(nested).count() == 2
    assert K.drop_columns(df, "rating", "no_such").columns == ["user_id", "item_id"]
