"""Rating prediction and top-n lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinity.operators.aggregates import item_means_zero_filled
from affinity.operators.baseline import Baseline, baseline_als, baseline_predict, residuals
from affinity.operators.joins import counts_left_outer, pos_neg_pairs
from affinity.operators.metrics import errors, mean_auc
from affinity.operators.scale import grouped_index, range_bucket, split_join, with_row
from affinity.operators.similarity import corated_pairs, mirror
from affinity.operators.split import negative_sample
from affinity.session import cut_lineage

RATING_SCALE = (1.0, 5.0)

Predictor = Callable[[DataFrame, DataFrame], DataFrame]


def _global_mean(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.avg(F.when(F.col("rating") > 0, F.col("rating"))).alias("g"))


def _rated_neighbors(targets: DataFrame, rated: DataFrame) -> DataFrame:
    """Every target next to the other items its user rated; a user with many of both is cut into pieces."""
    t = targets.select("user_id", "item_id")
    return split_join(t, rated, ["user_id"], ["item_id"], ["item_j"]).filter("item_id <> item_j")


def _positive_sims(sims: DataFrame) -> DataFrame:
    return mirror(sims).filter("sim > 0").withColumnRenamed("item_i", "item_id")


def knn_centered_predict(ratings: DataFrame, sims: DataFrame, targets: DataFrame) -> DataFrame:
    """m_t + sum(s * (r - m_j)) / sum(s) over the items j the user rated with s > 0.

    All targets at once. The target itself is no neighbour of its own, and a target without
    neighbours gets the global mean. Item means count a missing rating as 0.
    """
    means = item_means_zero_filled(ratings)
    rated = (
        ratings.filter("rating > 0")
        .join(means, "item_id")
        .select("user_id", F.col("item_id").alias("item_j"), (F.col("rating") - F.col("item_mean")).alias("dev"))
    )
    sums = (
        _rated_neighbors(targets, rated)
        .join(_positive_sims(sims), ["item_id", "item_j"])
        .groupBy("user_id", "item_id")
        .agg(F.sum(F.col("sim") * F.col("dev")).alias("num"), F.sum("sim").alias("ws"))
    )
    guess = F.col("item_mean") + F.col("num") / F.col("ws")
    full = targets.join(sums, ["user_id", "item_id"], "left").join(means, "item_id", "left")
    return (
        with_row(full, _global_mean(ratings))
        .withColumn("prediction", F.coalesce(guess, F.col("g")))
        .select(*targets.columns, "prediction")
    )


def knn_basic_predict(ratings: DataFrame, sims: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """Weighted mean of the user's ratings of the k most similar items with s > 0, else the global mean."""
    rated = ratings.select("user_id", F.col("item_id").alias("item_j"), "rating")
    w = W.partitionBy("user_id", "item_id").orderBy(F.col("sim").desc(), "item_j")
    sums = (
        _rated_neighbors(targets.select("user_id", "item_id").distinct(), rated)
        .join(_positive_sims(sims), ["item_id", "item_j"])
        .withColumn("_k", F.row_number().over(w))
        .filter(F.col("_k") <= k)
        .groupBy("user_id", "item_id")
        .agg(F.sum(F.col("sim") * F.col("rating")).alias("num"), F.sum("sim").alias("ws"))
    )
    return (
        with_row(targets.join(sums, ["user_id", "item_id"], "left"), _global_mean(ratings))
        .withColumn("prediction", F.coalesce(F.col("num") / F.col("ws"), F.col("g")))
        .select(*targets.columns, "prediction")
    )


def slope_one_deviations(ratings: DataFrame) -> DataFrame:
    """(item_i, item_j, n, dev): mean of r_i - r_j over common users, both directions."""
    dev = (F.col("si") - F.col("sj")) / F.col("n")
    there = F.struct(F.col("item_i"), F.col("item_j"), F.col("n"), dev.alias("dev"))
    back = F.struct(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j"), F.col("n"), (-dev).alias("dev"))
    return corated_pairs(ratings).select(F.inline(F.array(there, back)))


def slope_one(ratings: DataFrame, targets: DataFrame) -> DataFrame:
    """User mean plus the mean deviation to the items the user rated (Lemire & Maclachlan 2005).

    Without any common rater the user mean stands; an unknown user gets the global mean.
    """
    dev = slope_one_deviations(ratings).select(F.col("item_i").alias("item_id"), "item_j", "dev")
    rated = ratings.select("user_id", F.col("item_id").alias("item_j"))
    mean_dev = (
        _rated_neighbors(targets, rated)
        .join(dev, ["item_id", "item_j"])
        .groupBy("user_id", "item_id")
        .agg(F.avg("dev").alias("d"))
    )
    user_mean = ratings.groupBy("user_id").agg(F.avg("rating").alias("mu"))
    full = targets.join(user_mean, "user_id", "left").join(mean_dev, ["user_id", "item_id"], "left")
    return (
        with_row(full, _global_mean(ratings))
        .withColumn("prediction", F.coalesce(F.col("mu") + F.coalesce("d", F.lit(0.0)), F.col("g")))
        .select(*targets.columns, "prediction")
    )


def top_n_per_user(predictions: DataFrame, n: int = 10) -> DataFrame:
    """n best estimates per user with their rank; map tasks keep n per user before the shuffle."""
    w = W.partitionBy("user_id").orderBy(F.col("prediction").desc(), "item_id")
    return predictions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def knn_centered_top_n(ratings: DataFrame, sims: DataFrame, n: int = 10, digits: int = 6) -> DataFrame:
    """The n best unrated items per user by :func:`knn_centered_predict`, without predicting every unrated item.

    Candidates come from the similarities: the items similar to what a user rated. All other unrated items have the
    global mean as prediction, so of those only the n smallest ids can matter, and only to users with fewer than n
    candidates above the mean. They are read off the gaps between the positions of a user's rated items and
    candidates in the list of all items. Predictions are rounded to ``digits`` before they are ranked.
    """
    mean = ratings.agg(F.avg(F.when(F.col("rating") > 0, F.col("rating")))).first()[0]
    if mean is None:
        return ratings.select("user_id", "item_id", F.lit(0.0).alias("prediction"), F.lit(0).alias("rank")).limit(0)
    near = cut_lineage(_positive_sims(sims).filter("item_id <> item_j").select("item_id", "item_j", "sim"))
    means = cut_lineage(item_means_zero_filled(ratings))
    rated = (
        ratings.filter("rating > 0")
        .join(means, "item_id")
        .select("user_id", F.col("item_id").alias("item_j"), (F.col("rating") - F.col("item_mean")).alias("dev"))
    )
    sums = (
        split_join(rated, near, ["item_j"], ["user_id"], ["item_id"])
        .groupBy("user_id", "item_id")
        .agg(F.sum(F.col("sim") * F.col("dev")).alias("num"), F.sum("sim").alias("ws"))
        .join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    )
    guess = F.col("item_mean") + F.col("num") / F.col("ws")
    found = cut_lineage(sums.join(means, "item_id").select("user_id", "item_id", F.round(guess, digits).alias("prediction")))
    rest = F.round(F.lit(float(mean)), digits)
    per = found.groupBy("user_id").agg(F.count_if(F.col("prediction") > rest).alias("_above"), F.count(F.lit(1)).alias("_c"))
    per = ratings.groupBy("user_id").agg(F.count_distinct("item_id").alias("_r")).join(per, "user_id", "left").fillna(0)
    # too few candidates, and items left that are neither rated nor candidates
    short = per.filter((F.col("_above") < n) & (F.col("_r") + F.col("_c") < means.count()))
    short = cut_lineage(short.select("user_id"))
    if short.limit(1).count() == 0:
        return top_n_per_user(found, n)
    known = ratings.select("user_id", "item_id").unionByName(found.select("user_id", "item_id")).distinct()
    fill = smallest_missing(cut_lineage(known.join(short, "user_id", "left_semi")), ratings.select("item_id").distinct(), n)
    return top_n_per_user(found.unionByName(fill.withColumn("prediction", rest)), n)


def smallest_missing(known: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id): for each user of ``known`` the n smallest of the distinct ``items`` it does not hold.

    Among sorted positions, a gap before the i-th known one has as many missing positions before it as its start
    exceeds i; only gaps with fewer than n before them are opened, so a user gives n rows at most.
    """
    items = cut_lineage(items)
    placed = cut_lineage(grouped_index(items, [], range_bucket(items, "item_id"), [F.col("item_id")], "pos"))
    end = placed.count()
    held = split_join(known, placed, ["item_id"], ["user_id"], ["pos"]).select("user_id", "pos")
    held = held.unionByName(known.select("user_id").distinct().withColumn("pos", F.lit(end).cast("long")))
    w = W.partitionBy("user_id").orderBy("pos")
    start = F.coalesce(F.lag("pos").over(w) + 1, F.lit(0))
    gaps = held.select("user_id", start.alias("start"), F.col("pos").alias("stop"), (start - F.row_number().over(w) + 1).alias("before"))
    gaps = gaps.filter((F.col("start") < F.col("stop")) & (F.col("before") < n))
    last = F.least(F.col("stop"), F.col("start") + n - F.col("before")) - 1
    missing = cut_lineage(gaps.select("user_id", F.explode(F.sequence("start", last)).alias("pos")))
    return split_join(missing, placed, ["pos"], ["user_id"], ["item_id"]).select("user_id", "item_id")


def top_n_lists(predictions: DataFrame, n: int = 10) -> DataFrame:
    """(user_id, items): the ordered item ids; a list holds n at most."""
    return ranked_lists(top_n_per_user(predictions, n))


def ranked_lists(top: DataFrame) -> DataFrame:
    """(user_id, items) from ranked rows."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return top.groupBy("user_id").agg(F.transform(ranked, lambda x: x["item_id"]).alias("items"))


def als(rank: int = 10, reg: float = 0.01, alpha: float = 1.0, max_iter: int = 10, implicit: bool = False, seed: int = 17) -> ALS:
    """Explicit by default, which is what RMSE against stars needs; implicit for ranking. Users and items
    not seen in training are dropped from predictions instead of scoring NaN."""
    return ALS(
        rank=rank,
        regParam=reg,
        alpha=alpha,
        maxIter=max_iter,
        implicitPrefs=implicit,
        seed=seed,
        userCol="user_id",
        itemCol="item_id",
        ratingCol="rating",
        coldStartStrategy="drop",
    )


def als_fit_predict(train: DataFrame, test: DataFrame, **params: float) -> tuple[ALSModel, DataFrame]:
    model = als(**params).fit(train)
    pred = model.transform(test)
    return model, pred.withColumn("prediction", F.col("prediction").cast("double"))


def als_recommend_top_n(model: ALSModel, n: int = 10, rated: DataFrame | None = None) -> DataFrame:
    """(user_id, rank, item_id, prediction) for all users, by blocked factor products.

    With ``rated`` (user_id, item_id) what a user has rated is left out. A user with c ratings needs n + c items to be
    sure of n others; users are put into classes by that number's next power of two, so there are few classes, each
    one asks for no more than twice what it needs, and the rated items leave by an anti-join.
    """

    def flat(recs: DataFrame) -> DataFrame:
        return recs.select("user_id", F.inline("recommendations")).select("user_id", "item_id", F.col("rating").cast("double").alias("prediction"))

    if rated is None:
        return top_n_per_user(flat(model.recommendForAllUsers(n)), n).select("user_id", "rank", "item_id", "prediction")
    users = model.userFactors.select(F.col("id").alias("user_id"))
    held = cut_lineage(rated.select(F.col("user_id").cast("int"), F.col("item_id").cast("int")).distinct())
    need = users.join(held.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")), "user_id", "left")
    need = cut_lineage(need.select("user_id", F.ceil(F.log2(F.coalesce("c", F.lit(0)) + n)).cast("int").alias("power")))
    items = model.itemFactors.count()
    out: DataFrame | None = None
    for row in need.select("power").distinct().orderBy("power").collect():  # 31 at most, as ids are ints
        wanted = need.filter(F.col("power") == row["power"]).select("user_id")
        recs = flat(model.recommendForUserSubset(wanted, min(1 << row["power"], items)))
        out = recs if out is None else out.unionByName(recs)
    if out is None:
        return top_n_per_user(flat(model.recommendForAllUsers(n)), n).select("user_id", "rank", "item_id", "prediction")
    new = out.join(held, ["user_id", "item_id"], "left_anti")
    return top_n_per_user(new, n).select("user_id", "rank", "item_id", "prediction")


def biased_mf(train: DataFrame, test: DataFrame, n_factors: int = 10, reg: float = 0.6, n_epochs: int = 10, seed: int = 17) -> DataFrame:
    """Biases, then explicit factors on what they leave, clipped to the rating scale."""
    b = baseline_als(train, n_epochs)
    model = als(rank=n_factors, reg=reg, max_iter=n_epochs, seed=seed).setColdStartStrategy("nan").fit(residuals(train, b))
    raw = baseline_predict(model.transform(test).withColumnRenamed("prediction", "_f"), b, "_b")
    fit = F.col("_b") + F.nanvl(F.col("_f").cast("double"), F.lit(0.0))
    lo, hi = RATING_SCALE
    return raw.withColumn("prediction", F.least(F.greatest(fit, F.lit(lo)), F.lit(hi))).drop("_f", "_b")


def cross_validate(ratings: DataFrame, predict: Predictor, k: int = 10, fold: str = "fold", train_scores: bool = False) -> DataFrame:
    """(fold, part, rmse, mae, n) per fold; ``ratings`` carries the fold number. One DataFrame for all folds."""
    out: DataFrame | None = None
    for f in range(k):
        train = ratings.filter(F.col(fold) != f).drop(fold)
        parts = {"test": ratings.filter(F.col(fold) == f).drop(fold)}
        if train_scores:
            parts["train"] = train
        for part, rows in parts.items():
            e = errors(predict(train, rows)).select(F.lit(f).alias("fold"), F.lit(part).alias("part"), "rmse", "mae", "n")
            out = e if out is None else out.unionByName(e)
    return out


def _side_by_side(spark: SparkSession, run: Callable[[tuple], list[tuple]], settings: list[tuple], threads: int) -> list[tuple]:
    """Rows of ``run`` for every setting; job groups and local properties of the session go with each thread."""
    with ThreadPoolExecutor(threads) as pool:
        return [row for rows in pool.map(inheritable_thread_target(spark)(run), settings) for row in rows]


def _fold_parts(ratings: DataFrame, fold: str, f: int) -> tuple[DataFrame, DataFrame]:
    """(train rows, all rows with their part) of a fold."""
    part = F.when(F.col(fold) == f, "test").otherwise("train")
    return ratings.filter(F.col(fold) != f).drop(fold), ratings.withColumn("part", part).drop(fold)


def cross_validate_fitted(ratings: DataFrame, predict: Predictor, k: int = 10, fold: str = "fold", threads: int = 4) -> DataFrame:
    """(fold, part, rmse, mae, n) like :func:`cross_validate` with train scores, for predictors that fit a model.

    A fold's model is fitted once and judged on its test and its train rows in one pass; ``predict`` keeps the
    columns of its targets. Folds run side by side over one stored table, and leave two rows each on the driver.
    """
    stored = cut_lineage(ratings)

    def run(setting: tuple) -> list[tuple]:
        train, marked = _fold_parts(stored, fold, setting[0])
        return [(setting[0], *row) for row in errors(predict(train, marked), "part").collect()]

    rows = _side_by_side(ratings.sparkSession, run, [(f,) for f in range(k)], threads)
    return ratings.sparkSession.createDataFrame(rows, "fold int, part string, rmse double, mae double, n bigint")


def _folds_apart(ratings: DataFrame, folds: int, fold: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): (fold, user_id, item_id, rating) of all folds with ids numbered apart, so that no pair crosses two folds."""

    def apart(df: DataFrame) -> DataFrame:
        both = [(F.col(c) * folds + F.col(fold)).alias(c) for c in ("user_id", "item_id")]
        return df.select(F.col(fold).cast("int").alias("fold"), *both, "rating")

    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))
    return cut_lineage(apart(ratings.withColumn(fold, F.explode(others)))), cut_lineage(apart(ratings))


def _centred_by_fold(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row with the mean of each fold, the ratings less it)."""
    level = train.groupBy("fold").agg(F.avg("rating").alias("_mean"))
    less = train.join(F.broadcast(level), "fold").select("user_id", "item_id", (F.col("rating") - F.col("_mean")).alias("rating"))
    return level, less


def factor_scores(
    ratings: DataFrame, epochs: Iterable[int] = (5, 10), regs: Iterable[float] = (0.4, 0.6), n_factors: int = 10, folds: int = 10, fold: str = "fold", threads: int = 4
) -> DataFrame:
    """(epochs, reg, fold, part, rmse, mae, n) of :func:`biased_mf` for every setting, on test and train rows of each fold.

    One fit serves all folds: ids are numbered apart by fold, and both the biases and the alternating least squares
    solve each id from its own ratings and partners only, so a fold gets what it would get alone (from another
    random start). Ids times ``folds`` must fit an int; see assign_ids. Biases are fitted once for each number of
    epochs, penalties run side by side, and each fit leaves two rows a fold on the driver. Alternating least squares
    has no step size, so there is no axis for one.
    """
    spark = ratings.sparkSession
    train, test = _folds_apart(ratings, folds, fold)
    level, less = _centred_by_fold(train)
    marked = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).join(F.broadcast(level), "fold")
    marked, less = cut_lineage(marked), cut_lineage(less)
    regs, lo, hi = [(float(r),) for r in regs], *map(F.lit, RATING_SCALE)
    rows: list[tuple] = []
    for n in map(int, epochs):
        base = Baseline(*map(cut_lineage, baseline_als(less, n)))
        left = cut_lineage(residuals(less, base))
        targets = cut_lineage(baseline_predict(marked, base, "_b"))

        def run(setting: tuple, n: int = n, left: DataFrame = left, targets: DataFrame = targets) -> list[tuple]:
            model = als(rank=n_factors, reg=setting[0], max_iter=n).setColdStartStrategy("nan").fit(left)
            guess = F.col("_mean") + F.col("_b") + F.nanvl(F.col("prediction").cast("double"), F.lit(0.0))
            fit = model.transform(targets).withColumn("prediction", F.least(F.greatest(guess, lo), hi))
            return [(n, setting[0], *row) for row in errors(fit, "fold", "part").collect()]

        rows += _side_by_side(spark, run, regs, threads)
    return spark.createDataFrame(rows, "epochs int, reg double, fold int, part string, rmse double, mae double, n bigint")


def factor_grid(ratings: DataFrame, **settings: object) -> DataFrame:
    """(epochs, reg, mean_rmse, mean_mae, train_rmse, train_mae): :func:`factor_scores` over all folds, best first."""

    def mean(part: str, score: str, out: str) -> Column:
        return F.avg(F.when(F.col("part") == part, F.col(score))).alias(out)

    kinds = [("test", "rmse", "mean_rmse"), ("test", "mae", "mean_mae"), ("train", "rmse", "train_rmse"), ("train", "mae", "train_mae")]
    runs = factor_scores(ratings, **settings)
    return runs.groupBy("epochs", "reg").agg(*[mean(*k) for k in kinds]).orderBy("mean_rmse", "epochs", "reg")


def cross_validation_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("part").agg(F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"), F.count(F.lit(1)).alias("folds"))


def grid_search_report(
    ratings: DataFrame, grid: Iterable[dict], make: Callable[..., Predictor], k: int = 10, fold: str = "fold"
) -> DataFrame:
    """(params..., mean_rmse, mean_mae), best first. One row per parameter set reaches the driver."""
    spark, rows, names = ratings.sparkSession, [], None
    for params in grid:
        names = list(params)
        m = cross_validation_means(cross_validate(ratings, make(**params), k, fold)).first()
        rows.append((*params.values(), m["mean_rmse"], m["mean_mae"]))
    if not rows:
        raise ValueError("the grid has no parameter set")
    return spark.createDataFrame(rows, [*names, "mean_rmse", "mean_mae"]).orderBy("mean_rmse", *names)


def knn_grid(
    ratings: DataFrame,
    measures: dict[str, Callable[[DataFrame], DataFrame]],
    ks: Iterable[int] = range(2, 40),
    folds: int = 10,
    fold: str = "fold",
    centred: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """(sim, k, mean_rmse, mean_mae) of :func:`knn_basic_predict` for every measure and k, over all folds.

    The folds go through each measure side by side: ids are numbered apart by fold, so no pair crosses two folds
    (a measure must be a sum over pairs or per-id figures, without figures of the whole table). A measure in
    ``centred`` gets the ratings less the train mean of their fold: biases fitted to those are the ones each fold
    would get alone, as their common mean is 0. Neighbours are ranked once, and running
    sums over their rank give the prediction of every k; a target with fewer neighbours keeps its last one.
    """
    ks = sorted(set(ks))
    most = ks[-1]

    train, test = _folds_apart(ratings, folds, fold)
    means = train.groupBy("fold").agg(F.avg(F.when(F.col("rating") > 0, F.col("rating"))).alias("g"))
    rated = train.select("user_id", F.col("item_id").alias("item_j"), F.col("rating").alias("r"))
    w = W.partitionBy("user_id", "item_id").orderBy(F.col("sim").desc(), "item_j")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    all_ks = F.array(*[F.lit(k) for k in ks])
    out: DataFrame | None = None
    _, less = _centred_by_fold(train)
    todo = [(name, m, train.drop("fold")) for name, m in measures.items()] + [(name, m, less) for name, m in (centred or {}).items()]
    for name, measure, table in todo:
        near = _rated_neighbors(test, rated).join(_positive_sims(measure(table)), ["item_id", "item_j"])
        near = near.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
        guess = F.sum(F.col("sim") * F.col("r")).over(so_far) / F.sum("sim").over(so_far)
        near = near.select("user_id", "item_id", "k", guess.alias("p"), F.lead("k").over(w).isNull().alias("last"))
        covers = F.filter(all_ks, lambda k: (k == F.col("k")) | (F.col("last") & (k > F.col("k"))))
        each = near.select("user_id", "item_id", "p", F.explode(covers).alias("k"))
        full = test.select("*", F.explode(all_ks).alias("k")).join(each, ["user_id", "item_id", "k"], "left").join(F.broadcast(means), "fold")
        e = F.coalesce("p", "g") - F.col("rating")
        per = full.groupBy("fold", "k").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
        mean = per.groupBy("k").agg(F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"))
        rows = cut_lineage(mean.select(F.lit(name).alias("sim"), "k", "mean_rmse", "mean_mae"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("the grid has no measure")
    return out.orderBy("mean_rmse", "sim", "k")


def als_grid(
    train: DataFrame,
    test: DataFrame,
    ranks: Iterable[int] = range(2, 16),
    regs: Iterable[float] = (1.0, 0.025, 0.001),
    alphas: Iterable[float] | None = range(1, 11),
    max_iter: int = 10,
    threads: int = 4,
    blocks: int = 10,
) -> DataFrame:
    """(rank, reg, alpha, rmse, mae) of a fit for every setting, best first; ties go to the smaller setting.

    With ``alphas`` the fits are implicit, and each alpha is a fit of its own; with None they are explicit, and there
    is no column alpha. Both tables are written once; ``threads`` fits run side by side, so that the cluster is busy
    although one fit has many short stages. Each fit leaves two numbers on the driver.
    """
    spark = train.sparkSession
    train, test = cut_lineage(train), cut_lineage(test)
    names = ["rank", "reg"] if alphas is None else ["rank", "reg", "alpha"]
    settings = [(int(r), float(g), *a) for r in ranks for g in regs for a in ([()] if alphas is None else [(float(x),) for x in alphas])]

    def run(setting: tuple) -> list[tuple]:
        model = als(**dict(zip(names, setting, strict=True)), max_iter=max_iter, implicit=alphas is not None)
        fit = model.setNumBlocks(blocks).fit(train)
        e = errors(fit.transform(test)).first()
        return [(*setting, e["rmse"], e["mae"])]

    rows = _side_by_side(spark, run, settings, threads)
    kinds = ["rank int", "reg double", "alpha double"][: len(names)]
    return spark.createDataFrame(rows, ", ".join([*kinds, "rmse double", "mae double"])).orderBy("rmse", *names)


def als_best(ratings: DataFrame, train: DataFrame, test: DataFrame, runs: DataFrame, max_iter: int = 10) -> DataFrame:
    """The best row of :func:`als_grid`, its model fitted again and judged by ranking: (rank, reg, alpha, rmse, auc).

    Per user the held-out items are set against as many sampled items the user has not rated; auc is the mean share
    of pairs in which the held-out item scores higher.
    """
    best = runs.limit(1).first()
    implicit = "alpha" in best
    params = {"alpha": best["alpha"]} if implicit else {}
    model, pos = als_fit_predict(train, test, rank=best["rank"], reg=best["reg"], max_iter=max_iter, implicit=implicit, **params)
    neg = model.transform(negative_sample(ratings, like=test)).withColumn("prediction", F.col("prediction").cast("double"))
    auc = mean_auc(counts_left_outer(pos_neg_pairs(pos, neg))).first()
    names = [c for c in runs.columns if c != "mae"]
    kinds = ", ".join(f"{c} {t}" for c, t in runs.dtypes if c != "mae")
    return ratings.sparkSession.createDataFrame([(*[best[c] for c in names], auc["mean_auc"])], f"{kinds}, auc double")


