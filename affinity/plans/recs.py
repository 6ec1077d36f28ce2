"""Queries over item similarity, rating prediction and recommendation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinity.operators import baseline as B
from affinity.operators import cocluster as CC
from affinity.operators import metrics as M
from affinity.operators import recommend as P
from affinity.operators import similarity as S
from affinity.operators import split as SP
from affinity.operators.aggregates import item_means_zero_filled
from affinity.operators.joins import anti_testset
from affinity.plans.basics import HASH
from affinity.plans.registry import BRAND, RATINGS, query, r6, s6
from affinity.session import cut_lineage
from affinity.sources import tables as T

# ---------------------------------------------------------------- similarity

PAIRS = """pairs AS (SELECT a.item_id AS item_i, b.item_id AS item_j, count(*) AS n, sum(a.rating) AS si, sum(b.rating) AS sj,
  sum(a.rating * a.rating) AS qi, sum(b.rating * b.rating) AS qj, sum(a.rating * b.rating) AS dot
  FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2)"""
ZERO = f"""{PAIRS}, tot AS (SELECT item_id, sum(rating) AS t, sum(rating * rating) AS u FROM ratings GROUP BY 1),
m AS (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS m FROM ratings),
half AS (SELECT item_i, item_j, n, (m * dot - i.t * j.t) / sqrt(nullif((m * i.u - i.t * i.t) * (m * j.u - j.t * j.t), 0)) AS sim
  FROM pairs JOIN tot i ON i.item_id = item_i JOIN tot j ON j.item_id = item_j, m)"""
CORATED = f"""{PAIRS}, half AS (SELECT item_i, item_j, n, (n * dot - si * sj) / sqrt(nullif((n * qi - si * si) * (n * qj - sj * sj), 0)) AS sim
  FROM pairs WHERE n >= 2)"""
COSINE = f"{PAIRS}, half AS (SELECT item_i, item_j, n, dot / nullif(sqrt(qi * qj), 0) AS sim FROM pairs)"
MIRROR = "sims AS (SELECT item_i, item_j, sim FROM half UNION ALL SELECT item_j, item_i, sim FROM half)"
HALF_OUT = f"SELECT item_i, item_j, n, {s6('sim')} AS sim FROM half"


def _six(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


@query("ratings_matrix_long", f"WITH {RATINGS} SELECT item_id AS user_id, user_id AS item_id, rating FROM ratings")
def ratings_matrix_long(spark, sf):
    return S.transpose(T.ratings(spark, sf))


@query("corated_pairs", f"WITH {BRAND}, {PAIRS} SELECT * FROM pairs")
def corated_pairs(spark, sf):
    return S.corated_pairs(T.brand_ratings(spark, sf))


@query("item_pearson_zero_filled", f"WITH {BRAND}, {ZERO} {HALF_OUT}")
def item_pearson_zero_filled(spark, sf):
    return _six(S.item_pearson_zero_filled(cut_lineage(T.brand_ratings(spark, sf))), "sim")


@query("item_pearson_corated", f"WITH {BRAND}, {CORATED} {HALF_OUT}")
def item_pearson_corated(spark, sf):
    return _six(S.item_pearson_corated(T.brand_ratings(spark, sf)), "sim")


@query("item_cosine_corated", f"WITH {BRAND}, {COSINE} {HALF_OUT}")
def item_cosine_corated(spark, sf):
    return _six(S.item_cosine_corated(T.brand_ratings(spark, sf)), "sim")


@query(
    "similarity_lists",
    f"""WITH {BRAND}, {ZERO}, {MIRROR} SELECT item_i, item_j // 8 AS part, count(*) AS n,
      string_agg(CAST(item_j AS VARCHAR), ',' ORDER BY item_j) AS items, {s6("sum(sim)")} AS sim_sum FROM sims GROUP BY 1, 2""",
)
def similarity_lists(spark, sf):
    lists = S.similarity_lists(S.item_pearson_zero_filled(cut_lineage(T.brand_ratings(spark, sf))), width=8)
    ids = F.array_join(F.transform("entries", lambda e: e["item_j"].cast("string")), ",")
    sims = F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["sim"])
    return lists.select("item_i", "part", F.size("entries").cast("bigint").alias("n"), ids.alias("items"), r6(sims).alias("sim_sum"))


def _sparse_cosine(spark, sf):
    return S.item_cosine_corated(T.ratings(spark, sf)).withColumn("sim", r6("sim"))


SPARSE_COSINE = f"{RATINGS}, {PAIRS}, half AS (SELECT item_i, item_j, {s6('dot / nullif(sqrt(qi * qj), 0)')} AS sim FROM pairs), {MIRROR}"


@query(
    "top_k_neighbors",
    f"WITH {SPARSE_COSINE} SELECT item_i, item_j, sim, CAST(row_number() OVER w AS INTEGER) AS rank FROM sims WINDOW w AS (PARTITION BY item_i ORDER BY sim DESC, item_j) QUALIFY row_number() OVER w <= 5",
)
def top_k_neighbors(spark, sf):
    return S.top_k_neighbors(_sparse_cosine(spark, sf), 5)


@query("row_argmax", f"WITH {SPARSE_COSINE} SELECT item_i, item_j, sim FROM sims QUALIFY row_number() OVER (PARTITION BY item_i ORDER BY sim DESC, item_j) = 1")
def row_argmax(spark, sf):
    return S.row_argmax(_sparse_cosine(spark, sf))


@query("neighbors_sorted", f"WITH {BRAND}, {ZERO}, {MIRROR} SELECT item_i, item_j, {s6('sim')} AS sim FROM sims WHERE item_i = 7 ORDER BY sim DESC, item_j")
def neighbors_sorted(spark, sf):
    return _six(S.neighbors_sorted(S.item_pearson_zero_filled(cut_lineage(T.brand_ratings(spark, sf))), 7), "sim")


# ---------------------------------------------------------------- baselines

CENTRED = "mean AS MATERIALIZED (SELECT avg(rating) AS mu FROM ratings), x AS MATERIALIZED (SELECT user_id, item_id, rating, rating - mu AS x FROM ratings, mean)"


def _als_sql(epochs: int, reg_i: float = 10, reg_u: float = 15) -> str:
    out = [CENTRED, "u0 AS (SELECT DISTINCT user_id, CAST(0 AS DOUBLE) AS bu FROM x)"]
    for e in range(epochs):
        out.append(f"i{e + 1} AS MATERIALIZED (SELECT item_id, sum(x - bu) / ({reg_i} + count(*)) AS bi FROM x JOIN u{e} USING (user_id) GROUP BY 1)")
        out.append(f"u{e + 1} AS MATERIALIZED (SELECT user_id, sum(x - bi) / ({reg_u} + count(*)) AS bu FROM x JOIN i{e + 1} USING (item_id) GROUP BY 1)")
    out.append(f"users AS (SELECT * FROM u{epochs})")
    out.append(f"items AS (SELECT * FROM i{epochs})")
    return ", ".join(out)


def _gd_sql(epochs: int, lr: float = 0.01, reg: float = 0.02) -> str:
    out = [CENTRED, "u0 AS (SELECT DISTINCT user_id, CAST(0 AS DOUBLE) AS bu FROM x)", "i0 AS (SELECT DISTINCT item_id, CAST(0 AS DOUBLE) AS bi FROM x)"]
    lr_, reg_ = f"CAST({lr} AS DOUBLE)", f"CAST({reg} AS DOUBLE)"
    for e in range(epochs):
        out.append(f"e{e} AS MATERIALIZED (SELECT user_id, item_id, bu, bi, x - bu - bi AS e FROM x JOIN u{e} USING (user_id) JOIN i{e} USING (item_id))")
        for t, k, b in (("u", "user_id", "bu"), ("i", "item_id", "bi")):
            step = f"max({b}) + {lr_} * (sum(e) - {reg_} * count(*) * max({b})) / (1 + {lr_} * count(*) * (1 + {reg_}))"
            out.append(f"{t}{e + 1} AS MATERIALIZED (SELECT {k}, {step} AS {b} FROM e{e} GROUP BY 1)")
    out.append(f"users AS (SELECT * FROM u{epochs})")
    out.append(f"items AS (SELECT * FROM i{epochs})")
    return ", ".join(out)


BIASES = f"""SELECT 'user' AS kind, user_id AS id, {s6("bu")} AS bias FROM users UNION ALL
  SELECT 'item', item_id, {s6("bi")} FROM items UNION ALL SELECT 'mean', CAST(0 AS BIGINT), {s6("mu")} FROM mean"""


def _bias_rows(b: B.Baseline):
    users = b.users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), r6("bu").alias("bias"))
    items = b.items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), r6("bi").alias("bias"))
    mean = b.mean.select(F.lit("mean").alias("kind"), F.lit(0).cast("bigint").alias("id"), r6("mu").alias("bias"))
    return users.unionByName(items).unionByName(mean)


@query("baseline_als", f"WITH {RATINGS}, {_als_sql(10)} {BIASES}")
def baseline_als(spark, sf):
    return _bias_rows(B.baseline_als(T.ratings(spark, sf), 10))


@query("baseline_gd", f"WITH {RATINGS}, {_gd_sql(20)} {BIASES}")
def baseline_gd(spark, sf):
    return _bias_rows(B.baseline_gd(T.ratings(spark, sf), 20))


RESIDUALS = f"{_als_sql(10)}, res AS (SELECT user_id, item_id, x - bu - bi AS rating FROM x JOIN users USING (user_id) JOIN items USING (item_id))"


@query(
    "item_pearson_baseline",
    f"""WITH {BRAND}, {RESIDUALS}, {PAIRS.replace("FROM ratings a JOIN ratings b", "FROM res a JOIN res b")}
    SELECT item_i, item_j, n, {s6("dot / nullif(sqrt(qi * qj), 0) * (n - 1) / (n - 1 + 100)")} AS sim FROM pairs""",
)
def item_pearson_baseline(spark, sf):
    r = cut_lineage(T.brand_ratings(spark, sf))
    return _six(S.item_pearson_baseline(B.residuals(r, B.baseline_als(r, 10))), "sim")


# ---------------------------------------------------------------- prediction

TARGETS = """targets AS (SELECT user_id, item_id FROM (SELECT DISTINCT user_id FROM ratings), (SELECT DISTINCT item_id FROM ratings)
  EXCEPT SELECT user_id, item_id FROM ratings)"""
G = "g AS (SELECT avg(rating) FILTER (rating > 0) AS g FROM ratings)"
CENTERED = f"""{BRAND}, {ZERO}, {MIRROR}, {TARGETS}, {G},
means AS (SELECT item_id, CASE WHEN t / m > 0 THEN t / m ELSE g END AS item_mean FROM tot, m, g),
acc AS (SELECT t.user_id, t.item_id, sum(sim * (rating - item_mean)) / sum(sim) AS shift
  FROM targets t JOIN ratings r ON r.user_id = t.user_id AND r.item_id <> t.item_id
  JOIN sims s ON s.item_i = t.item_id AND s.item_j = r.item_id AND sim > 0 JOIN means k ON k.item_id = r.item_id GROUP BY 1, 2),
preds AS (SELECT user_id, item_id, {s6("coalesce(item_mean + shift, g)")} AS prediction
  FROM targets LEFT JOIN acc USING (user_id, item_id) LEFT JOIN means USING (item_id), g)"""


def _centered(spark, sf):
    r = cut_lineage(T.brand_ratings(spark, sf))
    preds = P.knn_centered_predict(r, S.item_pearson_zero_filled(r), cut_lineage(anti_testset(r)))
    return _six(preds, "prediction")


def _centered_top_n(spark, sf):
    r = cut_lineage(T.brand_ratings(spark, sf))
    return _six(P.knn_centered_top_n(r, S.item_pearson_zero_filled(r), 10), "prediction")


@query("knn_centered_predict", f"WITH {CENTERED} SELECT * FROM preds")
def knn_centered_predict(spark, sf):
    return _centered(spark, sf)


@query(
    "top_n_per_user",
    f"WITH {CENTERED} SELECT user_id, item_id, prediction, CAST(row_number() OVER w AS INTEGER) AS rank FROM preds WINDOW w AS (PARTITION BY user_id ORDER BY prediction DESC, item_id) QUALIFY row_number() OVER w <= 10",
)
def top_n_per_user(spark, sf):
    return _centered_top_n(spark, sf)


@query(
    "top_n_lists",
    f"""WITH {CENTERED}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS rank FROM preds)
    SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS items FROM t WHERE rank <= 10 GROUP BY user_id""",
)
def top_n_lists(spark, sf):
    lists = P.ranked_lists(_centered_top_n(spark, sf))
    return lists.select("user_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query(
    "knn_basic_predict",
    f"""WITH {BRAND}, {COSINE}, {MIRROR}, {TARGETS}, {G},
    near AS (SELECT t.user_id, t.item_id, round(sim, 9) AS sim, rating, row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY round(sim, 9) DESC, r.item_id) AS k
      FROM targets t JOIN ratings r USING (user_id) JOIN sims s ON s.item_i = t.item_id AND s.item_j = r.item_id AND sim > 0),
    acc AS (SELECT user_id, item_id, sum(sim * rating) / sum(sim) AS p FROM near WHERE k <= 5 GROUP BY 1, 2)
    SELECT user_id, item_id, {s6("coalesce(p, g)")} AS prediction FROM targets LEFT JOIN acc USING (user_id, item_id), g""",
)
def knn_basic_predict(spark, sf):
    r = cut_lineage(T.brand_ratings(spark, sf))
    sims = S.item_cosine_corated(r).withColumn("sim", F.round("sim", 9))
    return _six(P.knn_basic_predict(r, sims, cut_lineage(anti_testset(r)), 5), "prediction")


SLOPE = """dev AS (SELECT a.item_id AS item_i, b.item_id AS item_j, avg(a.rating - b.rating) AS dev FROM ratings a JOIN ratings b
    ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2),
  umean AS (SELECT user_id, avg(rating) AS mu FROM ratings GROUP BY 1)"""


@query(
    "slope_one",
    f"""WITH {BRAND}, {SLOPE}, {TARGETS}, d AS (SELECT t.user_id, t.item_id, avg(dev) AS d FROM targets t JOIN ratings r USING (user_id)
      JOIN dev ON item_i = t.item_id AND item_j = r.item_id GROUP BY 1, 2)
    SELECT user_id, item_id, {s6("mu + coalesce(d, 0)")} AS prediction FROM targets JOIN umean USING (user_id) LEFT JOIN d USING (user_id, item_id)""",
)
def slope_one(spark, sf):
    r = cut_lineage(T.brand_ratings(spark, sf))
    return _six(P.slope_one(r, cut_lineage(anti_testset(r))), "prediction")


BY_ITEM_MEAN = f"{RATINGS}, im AS (SELECT item_id, avg(rating) AS prediction FROM ratings GROUP BY 1), preds AS (SELECT rating, prediction FROM ratings JOIN im USING (item_id))"


def _by_item_mean(spark, sf):
    r = T.ratings(spark, sf)
    return r.join(r.groupBy("item_id").agg(F.avg("rating").alias("prediction")), "item_id")


@query("rmse", f"WITH {BY_ITEM_MEAN} SELECT {s6('sqrt(avg((prediction - rating) * (prediction - rating)))')} AS rmse FROM preds")
def rmse(spark, sf):
    return _six(M.rmse(_by_item_mean(spark, sf)), "rmse")


@query("mae", f"WITH {BY_ITEM_MEAN} SELECT {s6('avg(abs(prediction - rating))')} AS mae FROM preds")
def mae(spark, sf):
    return _six(M.mae(_by_item_mean(spark, sf)), "mae")


def _folds(spark, sf, k):
    return cut_lineage(SP.kfold_assign(T.brand_ratings(spark, sf), ["user_id", "item_id"], k))


@query(
    "cross_validate",
    f"""WITH {BRAND}, rf AS (SELECT *, CAST({HASH} % 5 AS INTEGER) AS fold FROM ratings), folds AS (SELECT unnest(range(5)) AS f),
    tr AS (SELECT f, user_id, item_id, rating FROM rf, folds WHERE fold <> f),
    dev AS (SELECT a.f, a.item_id AS item_i, b.item_id AS item_j, avg(a.rating - b.rating) AS dev FROM tr a JOIN tr b ON a.f = b.f AND a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL),
    umean AS (SELECT f, user_id, avg(rating) AS mu FROM tr GROUP BY ALL), g AS (SELECT f, avg(rating) AS g FROM tr GROUP BY 1),
    d AS (SELECT t.fold AS f, t.user_id, t.item_id, avg(dev) AS d FROM rf t JOIN tr r ON r.f = t.fold AND r.user_id = t.user_id AND r.item_id <> t.item_id
      JOIN dev ON dev.f = t.fold AND item_i = t.item_id AND item_j = r.item_id GROUP BY ALL),
    p AS (SELECT t.fold, rating, coalesce(mu + coalesce(d, 0), g) AS prediction FROM rf t LEFT JOIN umean ON umean.f = t.fold AND umean.user_id = t.user_id
      LEFT JOIN d ON d.f = t.fold AND d.user_id = t.user_id AND d.item_id = t.item_id JOIN g ON g.f = t.fold)
    SELECT fold, 'test' AS part, {s6("sqrt(avg((prediction - rating) * (prediction - rating)))")} AS rmse, {s6("avg(abs(prediction - rating))")} AS mae, count(*) AS n FROM p GROUP BY fold""",
)
def cross_validate(spark, sf):
    return _six(P.cross_validate(_folds(spark, sf, 5), P.slope_one, 5), "rmse", "mae")


@query("grid_search_report")
def grid_search_report(spark, sf):
    """Item kNN over k and similarity, three folds."""

    def make(k: int, sim: str):
        def predict(train, test):
            sims = {"cosine": S.item_cosine_corated, "pearson": S.item_pearson_corated}[sim](train)
            return P.knn_basic_predict(train, sims, test, k)

        return predict

    grid = [{"k": k, "sim": s} for k in (2, 5) for s in ("cosine", "pearson")]
    return P.grid_search_report(_folds(spark, sf, 3), grid, make, 3)


@query(
    "knn_grid",
    f"""WITH {BRAND}, rf AS (SELECT *, {HASH} % 10 AS fold FROM ratings), fs AS (SELECT unnest(range(10)) AS f), ks AS (SELECT unnest(range(2, 40)) AS k),
    tr AS MATERIALIZED (SELECT f, user_id, item_id, rating FROM rf, fs WHERE fold <> f), g AS (SELECT f, avg(rating) FILTER (rating > 0) AS g FROM tr GROUP BY 1),
    pairs AS MATERIALIZED (SELECT f, a.item_id AS item_i, b.item_id AS item_j, count(*) AS n, sum(a.rating) AS si, sum(b.rating) AS sj,
      sum(a.rating * a.rating) AS qi, sum(b.rating * b.rating) AS qj, sum(a.rating * b.rating) AS dot FROM tr a JOIN tr b USING (f, user_id) WHERE a.item_id <> b.item_id GROUP BY ALL),
    sims AS (SELECT 'cosine' AS sim_name, f, item_i, item_j, round(dot / nullif(sqrt(qi * qj), 0), 9) AS sim FROM pairs
      UNION ALL SELECT 'pearson', f, item_i, item_j, round((n * dot - si * sj) / sqrt(nullif((n * qi - si * si) * (n * qj - sj * sj), 0)), 9) FROM pairs WHERE n >= 2),
    near AS (SELECT sim_name, t.fold AS f, t.user_id, t.item_id, sim, r.rating, row_number() OVER (PARTITION BY sim_name, t.user_id, t.item_id ORDER BY sim DESC, r.item_id) AS i
      FROM rf t JOIN tr r ON r.f = t.fold AND r.user_id = t.user_id AND r.item_id <> t.item_id JOIN sims s ON s.f = t.fold AND s.item_i = t.item_id AND s.item_j = r.item_id AND sim > 0),
    acc AS (SELECT sim_name, f, user_id, item_id, k, sum(sim * rating) / sum(sim) AS p FROM near JOIN ks ON i <= k GROUP BY ALL),
    e AS (SELECT n.sim_name, t.fold AS f, ks.k, coalesce(p, g) - t.rating AS e FROM rf t CROSS JOIN ks CROSS JOIN (SELECT DISTINCT sim_name FROM sims) n JOIN g ON g.f = t.fold
      LEFT JOIN acc a ON a.sim_name = n.sim_name AND a.user_id = t.user_id AND a.item_id = t.item_id AND a.k = ks.k),
    per AS (SELECT sim_name, f, k, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM e GROUP BY ALL)
    SELECT sim_name AS sim, CAST(k AS INTEGER) AS k, {s6("avg(rmse)")} AS mean_rmse, {s6("avg(mae)")} AS mean_mae FROM per GROUP BY ALL""",
)
def knn_grid(spark, sf):
    """Item kNN for k from 2 to 39 and two measures, ten folds."""

    def rounded(measure):
        return lambda train: measure(train).withColumn("sim", F.round("sim", 9))

    measures = {"cosine": rounded(S.item_cosine_corated), "pearson": rounded(S.item_pearson_corated)}
    return _six(P.knn_grid(_folds(spark, sf, 10), measures), "mean_rmse", "mean_mae")


@query("knn_baseline_grid")
def knn_baseline_grid(spark, sf):
    """Item kNN for k from 2 to 39 on residuals of biases from either method, ten folds."""

    def pearson(fit):
        return lambda train: S.item_pearson_baseline(B.residuals(train, fit(train)))

    centred = {"pearson_baseline_als": pearson(B.baseline_als), "pearson_baseline_gd": pearson(B.baseline_gd)}
    return _six(P.knn_grid(_folds(spark, sf, 10), {}, centred=centred), "mean_rmse", "mean_mae")


# ---------------------------------------------------------------- factor models


def _train_test(spark, sf):
    return SP.train_test(cut_lineage(T.ratings(spark, sf)), ["user_id", "item_id"], 11)


@query("als_fit_predict")
def als_fit_predict(spark, sf):
    train, test = _train_test(spark, sf)
    return P.als_fit_predict(train, test)[1]


@query("als_grid")
def als_grid(spark, sf):
    """Implicit fits over rank, penalty and alpha; the operator's defaults are the full grid."""
    train, test = _train_test(spark, sf)
    return P.als_grid(train, test, [2, 5, 10, 15], [1.0, 0.025, 0.001], [1, 5, 10], threads=8, blocks=2)


@query("als_best")
def als_best(spark, sf):
    """The best of a few settings, fitted again and judged by ranking."""
    r = cut_lineage(T.ratings(spark, sf))
    train, test = SP.train_test(r, ["user_id", "item_id"], 11)
    return P.als_best(r, train, test, P.als_grid(train, test, [2, 10], [0.025], [1, 10], threads=8, blocks=2))


@query("als_recommend_top_n")
def als_recommend_top_n(spark, sf):
    r = cut_lineage(T.ratings(spark, sf))
    return P.als_recommend_top_n(P.als().fit(r), 10, r)


@query(
    "als_top_n_facts",
    f"""WITH {RATINGS}, m AS (SELECT count(DISTINCT item_id) AS m FROM ratings)
    SELECT user_id, least(10, any_value(m) - count(*)) AS n, CAST(least(10, any_value(m) - count(*)) AS BIGINT) AS last_rank,
           CAST(0 AS BIGINT) AS n_rated, CAST(0 AS BIGINT) AS n_rising FROM ratings, m GROUP BY 1""",
)
def als_top_n_facts(spark, sf):
    """What must hold whatever the factors are: ten items or all that are left, none rated, by falling prediction."""
    r = cut_lineage(T.ratings(spark, sf))
    top = P.als_recommend_top_n(P.als().fit(r), 10, r).withColumn("user_id", F.col("user_id").cast("bigint"))
    known = r.select("user_id", F.col("item_id").cast("int").alias("item_id"), F.lit(1).alias("known"))
    before = F.lag("prediction").over(W.partitionBy("user_id").orderBy("rank"))
    top = top.join(known, ["user_id", "item_id"], "left").withColumn("rising", F.coalesce((F.col("prediction") > before).cast("int"), F.lit(0)))
    return top.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").cast("bigint").alias("last_rank"), F.count("known").alias("n_rated"), F.sum("rising").alias("n_rising")
    )


@query("als_ranking_auc")
def als_ranking_auc(spark, sf):
    """Implicit ALS judged by how often held-out items beat sampled unrated ones, per user."""
    from affinity.operators.joins import counts_left_outer, pos_neg_pairs

    r = cut_lineage(T.ratings(spark, sf))
    train, test = SP.train_test(r, ["user_id", "item_id"], 11)
    model, pos = P.als_fit_predict(train, test, implicit=True)
    neg = model.transform(SP.negative_sample(r)).withColumn("prediction", F.col("prediction").cast("double"))
    neg = neg.join(test.select("user_id").distinct(), "user_id", "left_semi")
    return M.mean_auc(counts_left_outer(pos_neg_pairs(pos, neg)))


@query("biased_mf")
def biased_mf(spark, sf):
    train, test = _train_test(spark, sf)
    return P.biased_mf(train, test)


@query("factor_grid")
def factor_grid(spark, sf):
    """Epochs and penalties of the biased factor model, ten folds, with train scores."""
    return P.factor_grid(_rating_folds(spark, sf))


def _rating_folds(spark, sf):
    return SP.kfold_assign(T.ratings(spark, sf), ["user_id", "item_id"], 10)


@query("cross_validate_factors")
def cross_validate_factors(spark, sf):
    """Ten epochs and a penalty of 0.6: errors of each of ten folds on its test and train rows."""
    return P.factor_scores(_rating_folds(spark, sf), [10], [0.6])


@query(
    "cross_validate_facts",
    f"""WITH {BRAND}, rf AS (SELECT CAST({HASH} % 10 AS INTEGER) AS fold FROM ratings), f AS (SELECT DISTINCT fold FROM rf)
    SELECT f.fold, CASE WHEN rf.fold = f.fold THEN 'test' ELSE 'train' END AS part, count(*) AS n, 1 AS ordered FROM rf, f GROUP BY 1, 2""",
)
def cross_validate_facts(spark, sf):
    """What must hold whatever the factors are: a rating is in one test part and nine train parts, and no error is below 0."""
    scores = P.factor_scores(_folds(spark, sf, 10), [2], [0.6], n_factors=2)
    ok = (F.col("rmse") >= F.col("mae")) & (F.col("mae") >= 0)
    return scores.select("fold", "part", "n", ok.cast("int").alias("ordered"))


@query("co_clustering")
def co_clustering(spark, sf):
    r = cut_lineage(T.brand_ratings(spark, sf))
    c = CC.co_clustering(r, 3, 3, n_epochs=5)
    return CC.co_clustering_predict(r, c, cut_lineage(anti_testset(r)))


@query(
    "co_clustering_predict",
    f"""WITH {BRAND}, {TARGETS},
    uc AS (SELECT user_id, avg(rating) AS mu, CAST(concat('0x', substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS g FROM ratings GROUP BY 1),
    ic AS (SELECT item_id, avg(rating) AS mi, CAST(concat('0x', substr(md5(CAST(item_id AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS h FROM ratings GROUP BY 1),
    pl AS (SELECT g, h, rating FROM ratings JOIN uc USING (user_id) JOIN ic USING (item_id)),
    a AS (SELECT g, h, avg(rating) AS a FROM pl GROUP BY 1, 2), au AS (SELECT g, avg(rating) AS au FROM pl GROUP BY 1), ai AS (SELECT h, avg(rating) AS ai FROM pl GROUP BY 1)
    SELECT user_id, item_id, {s6("a - au - ai + mu + mi")} AS prediction FROM targets JOIN uc USING (user_id) JOIN ic USING (item_id)
    JOIN a USING (g, h) JOIN au USING (g) JOIN ai USING (h)""",
)
def co_clustering_predict(spark, sf):
    r = cut_lineage(T.brand_ratings(spark, sf))
    return _six(CC.co_clustering_predict(r, CC.hash_clusters(r), cut_lineage(anti_testset(r))), "prediction")


@query("item_means", f"WITH {BRAND}, t AS (SELECT count(DISTINCT user_id) AS n FROM ratings) SELECT item_id, {s6('sum(rating) / any_value(n)')} AS item_mean FROM ratings, t GROUP BY 1")
def item_means(spark, sf):
    return _six(item_means_zero_filled(T.brand_ratings(spark, sf)), "item_mean")
