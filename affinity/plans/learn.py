"""Queries over the view/buy data set, classifiers and their metrics, texts and vectors."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVCModel
from pyspark.sql import functions as F

from affinity.functions.stopwords import ENGLISH
from affinity.operators import aggregates as A
from affinity.operators import classify as C
from affinity.operators import metrics as M
from affinity.operators import split as SP
from affinity.operators import text as X
from affinity.operators import tuning as TU
from affinity.operators import vectors as V
from affinity.operators import viewbuy as VB
from affinity.plans.registry import TEXTS, VIEWBUY, query, r6, s6
from affinity.session import cut_lineage, scratch_dir
from affinity.sources import tables as T
from affinity.sources.writers import get_or_fit_model as stored_or_fit

# ---------------------------------------------------------------- view -> buy

DATASET = f"""{VIEWBUY}, pairs AS (
  SELECT CAST(v.item AS VARCHAR) AS item_id, coalesce(brand, 'No Brand') AS brand, price, CAST(v.other AS VARCHAR) AS user_also_view,
    CAST(b.other IS NOT NULL AS INTEGER) AS user_buy_after_viewing_bool
  FROM viewed v LEFT JOIN bought b ON v.item = b.item AND v.other = b.other LEFT JOIN attrs ON attrs.item = v.item),
data AS (SELECT *, dense_rank() OVER (ORDER BY item_id) - 1 AS item_id_int, dense_rank() OVER (ORDER BY user_also_view) - 1 AS user_also_view_int,
  dense_rank() OVER (ORDER BY brand) - 1 AS brand_int FROM pairs)"""
SPLIT = "CAST(concat('0x', substr(md5(item_id || '|' || user_also_view), 1, 8)) AS BIGINT) % 100 < 20"
FEATS = list(VB.FEATURES)


def _six(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


def _dataset(spark, sf):
    return VB.view_buy_dataset(T.metadata(spark, sf))


@query("view_buy_dataset", f"WITH {DATASET} SELECT * FROM data")
def view_buy_dataset(spark, sf):
    return _dataset(spark, sf)


def _split(spark, sf):
    return SP.train_test(cut_lineage(_dataset(spark, sf)), ["item_id", "user_also_view"], 20)


@query(
    "impute_mean",
    f"""WITH {DATASET}, m AS (SELECT avg(price) AS m FROM data WHERE NOT ({SPLIT}))
    SELECT item_id, user_also_view, {s6("coalesce(price, m)")} AS price FROM data, m WHERE {SPLIT}""",
)
def impute_mean(spark, sf):
    train, test = _split(spark, sf)
    return _six(C.impute_mean(train, test, ["price"]).select("item_id", "user_also_view", "price"), "price")


IMPUTED = f"""{DATASET}, pm AS (SELECT avg(price) AS pm FROM data WHERE NOT ({SPLIT})),
full_rows AS (SELECT item_id, user_also_view, {SPLIT} AS is_test, item_id_int, user_also_view_int, brand_int, coalesce(price, pm) AS price FROM data, pm)"""


def _prepared(spark, sf):
    """(train, test) with prices imputed and features scaled by the train rows."""
    train, test = _split(spark, sf)
    full_train, full_test = C.impute_mean(train, train, ["price"]), C.impute_mean(train, test, ["price"])
    return C.scale_standard(full_train, full_train, FEATS), C.scale_standard(full_train, full_test, FEATS)


@query(
    "scale_standard",
    f"""WITH {IMPUTED}, st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in FEATS)} FROM full_rows WHERE NOT is_test)
    SELECT item_id, user_also_view, {", ".join(f"{s6(f'({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END')} AS {c}" for c in FEATS)}
    FROM full_rows, st WHERE is_test""",
)
def scale_standard(spark, sf):
    _, test = _prepared(spark, sf)
    return _six(test.select("item_id", "user_also_view", *FEATS), *FEATS)


def _labelled(df):
    from affinity.operators.clean import ml_vector

    keyed = df.withColumn("label", F.col(VB.LABEL).cast("double"))
    return ml_vector(keyed, FEATS).select("item_id", "user_also_view", "label", "features")


def _learn_split(spark, sf):
    train, test = _prepared(spark, sf)
    return cut_lineage(_labelled(train)), cut_lineage(_labelled(test))


@query("svm_linear")
def svm_linear(spark, sf):
    train, test = _learn_split(spark, sf)
    model = C.svm_linear(1.0, train.count()).fit(train)
    return M.binary_confusion(model.transform(test), "label", "prediction")


@query("svm_rbf")
def svm_rbf(spark, sf):
    train, test = _learn_split(spark, sf)
    n = train.count()

    def lifted(df):
        return C.rff(df, 0.5, len(FEATS), 64).drop("features").withColumnRenamed("rff", "features")

    model = C.svm_linear(10.0, n).fit(lifted(train))
    return M.binary_confusion(model.transform(lifted(test)), "label", "prediction")


@query("svm_grid")
def svm_grid(spark, sf):
    train, _ = _learn_split(spark, sf)
    folds = SP.kfold_assign(train, ["item_id", "user_also_view"], 3)
    return C.svm_grid(folds.select("label", "features", "fold"), len(FEATS), [1, 100], [0.001], folds=3, rff_dim=32, max_iter=10)


@query("svm_best")
def svm_best(spark, sf):
    """The best of a grid, fitted again, stored, loaded and judged on the hold-out."""
    train, test = _learn_split(spark, sf)
    folds = SP.kfold_assign(train, ["item_id", "user_also_view"], 3).select("label", "features", "fold")
    grid = C.svm_grid(folds, len(FEATS), [1, 100], [0.001], folds=3, rff_dim=32, max_iter=10)
    return TU.svm_best(grid, train, test, len(FEATS), scratch_dir(spark), rff_dim=32)


@query("decision_scores")
def decision_scores(spark, sf):
    train, test = _learn_split(spark, sf)
    out = C.decision_scores(C.svm_linear(1.0, train.count()).fit(train), test)
    return out.select("item_id", "user_also_view", "label", "score", "prediction")


@query("get_or_fit_model")
def get_or_fit_model(spark, sf):
    """Fitted once, loaded the second time; both give the same scores."""
    train, test = _learn_split(spark, sf)
    path = scratch_dir(spark)
    fit = lambda: C.svm_linear(1.0, train.count()).fit(train)
    first = stored_or_fit(spark, path, LinearSVCModel, fit)
    again = stored_or_fit(spark, path, LinearSVCModel, fit)
    a = C.decision_scores(first, test).select("item_id", "user_also_view", "score")
    b = C.decision_scores(again, test).select("item_id", "user_also_view", F.col("score").alias("loaded"))
    return a.join(b, ["item_id", "user_also_view"]).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("score") - F.col("loaded"))).alias("gap"))


# ---------------------------------------------------------------- metrics: text length as score of quality

SCORED = "scored AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, CAST(quality AS INTEGER) AS label, CAST(n_chars > 500 AS INTEGER) AS pred FROM documents JOIN labels USING (doc_id))"
CURVE = """per AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY score),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM per)"""


def _scored(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = T.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return docs.join(labels, "doc_id").withColumn("pred", (F.col("score") > 500).cast("int"))


@query("accuracy", f"WITH {SCORED} SELECT {s6('avg(CAST(pred = label AS INTEGER))')} AS accuracy, count(*) AS n FROM scored")
def accuracy(spark, sf):
    return _six(M.accuracy(_scored(spark, sf), "pred", "label"), "accuracy")


@query("error_rate", f"WITH {SCORED} SELECT count(*) FILTER (pred <> label) AS errors, count(*) AS n, {s6('avg(CAST(pred <> label AS INTEGER))')} AS rate FROM scored")
def error_rate(spark, sf):
    return _six(M.error_rate(_scored(spark, sf).withColumn("p", F.col("pred") * 0.9), "p", "label"), "rate")


@query("confusion_matrix", f"WITH {SCORED} SELECT label AS actual, pred AS predicted, count(*) AS n FROM scored GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_scored(spark, sf), "label", "pred")


@query(
    "binary_confusion",
    f"WITH {SCORED} SELECT count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp FROM scored",
)
def binary_confusion(spark, sf):
    return M.binary_confusion(_scored(spark, sf), "label", "pred")


@query("roc_curve", f"WITH {SCORED}, {CURVE} SELECT score AS threshold, {s6('fp / n')} AS fpr, {s6('tp / p')} AS tpr FROM cum")
def roc_curve(spark, sf):
    return _six(M.roc_curve(_scored(spark, sf), "label", "score"), "fpr", "tpr")


@query("roc_curve_labels", f"WITH {SCORED.replace('CAST(n_chars AS DOUBLE) AS score', 'CAST(n_chars > 500 AS INTEGER) AS score')}, {CURVE} SELECT score AS threshold, {s6('fp / n')} AS fpr, {s6('tp / p')} AS tpr FROM cum")
def roc_curve_labels(spark, sf):
    """The curve of hard predictions."""
    return _six(M.roc_curve(_scored(spark, sf), "label", "pred"), "fpr", "tpr")


BINS = 40


@query(
    "roc_curve_binned",
    f"""WITH {SCORED.replace("CAST(n_chars AS DOUBLE) AS score", f"least(greatest(floor(n_chars / CAST(2500 AS DOUBLE)), 0), {BINS - 1}) * 2500 AS score")}, {CURVE}
    SELECT score AS threshold, {s6("fp / n")} AS fpr, {s6("tp / p")} AS tpr FROM cum""",
)
def roc_curve_binned(spark, sf):
    binned = M.binned(_scored(spark, sf), "score", BINS, 0.0, 100000.0)
    return _six(M.roc_curve(binned, "label", "score"), "fpr", "tpr")


@query(
    "auc_trapezoid",
    f"""WITH {SCORED} SELECT {s6("sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*)")} AS auc
    FROM scored a JOIN scored b ON a.label = 1 AND b.label = 0""",
)
def auc_trapezoid(spark, sf):
    return _six(M.auc_trapezoid(_scored(spark, sf), "label", "score"), "auc")


@query("pr_curve", f"WITH {SCORED}, {CURVE} SELECT score AS threshold, {s6('tp / (tp + fp)')} AS precision, {s6('tp / p')} AS recall FROM cum")
def pr_curve(spark, sf):
    return _six(M.pr_curve(_scored(spark, sf), "label", "score"), "precision", "recall")


@query("average_precision", f"WITH {SCORED}, {CURVE} SELECT {s6('sum(pos * tp / (tp + fp) / p)')} AS average_precision FROM cum")
def average_precision(spark, sf):
    return _six(M.average_precision(_scored(spark, sf), "label", "score"), "average_precision")


@query(
    "average_precision_micro",
    f"""WITH classes AS (SELECT unnest(range(10)) AS c), scored AS (
      SELECT CAST(label = c AS INTEGER) AS label, CAST(embedding[c + 1] AS DOUBLE) AS score FROM embeddings, classes), {CURVE}
    SELECT {s6("sum(pos * tp / (tp + fp) / p)")} AS average_precision FROM cum""",
)
def average_precision_micro(spark, sf):
    """All classes judged jointly; the first ten components stand for class scores."""
    e = T.table(spark, sf, "embeddings").select("label", F.slice("embedding", 1, 10).cast("array<double>").alias("scores"))
    rows = cut_lineage(M.micro_rows(e, "label", "scores"))
    return _six(M.average_precision(rows, "label", "score"), "average_precision")


# ---------------------------------------------------------------- image features


def _embeddings(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    return C.with_vector(e, "embedding").select("vec_id", "label", "features")


@query("mlp_classify")
def mlp_classify(spark, sf):
    train, test = SP.train_test(cut_lineage(_embeddings(spark, sf)), ["vec_id"], 40)
    out = C.mlp([64, 32, 16, 10]).fit(train).transform(test)
    return M.accuracy(out, "prediction", "label")


@query("mlp_embedding")
def mlp_embedding(spark, sf):
    data = cut_lineage(_embeddings(spark, sf))
    return C.mlp_embedding(C.mlp([64, 32, 16, 10]).fit(data), data, "vec_id")


# ---------------------------------------------------------------- vectors

DOUBLES = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query(
    "vector_pearson",
    f"""WITH {DOUBLES}, f AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, unnest(a.v) AS x, unnest(b.v) AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
    SELECT id_a, id_b, {s6("(count(*) * sum(x * y) - sum(x) * sum(y)) / sqrt(nullif((count(*) * sum(x * x) - sum(x) * sum(x)) * (count(*) * sum(y * y) - sum(y) * sum(y)), 0))")} AS r FROM f GROUP BY 1, 2""",
)
def vector_pearson(spark, sf):
    e = T.table(spark, sf, "embeddings")
    pairs = e.select(F.col("vec_id").alias("id_a"), (F.col("vec_id") + 1).alias("id_b"))
    return _six(V.vector_pearson(pairs, e, "vec_id", "embedding"), "r")


@query(
    "vector_cosine",
    f"WITH {DOUBLES} SELECT a.vec_id AS id_a, b.vec_id AS id_b, {s6('list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))')} AS cos FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
)
def vector_cosine(spark, sf):
    e = T.table(spark, sf, "embeddings")
    pairs = e.select(F.col("vec_id").alias("id_a"), (F.col("vec_id") + 1).alias("id_b"))
    return _six(V.vector_cosine(pairs, e, "vec_id", "embedding"), "cos")


@query(
    "vector_cosine_pairs",
    f"WITH {DOUBLES} SELECT a.vec_id AS id_a, b.vec_id AS id_b, {s6('list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))')} AS cos FROM e a JOIN e b ON a.vec_id < b.vec_id",
)
def vector_cosine_pairs(spark, sf):
    return _six(V.vector_cosine_pairs(T.table(spark, sf, "embeddings"), "vec_id", "embedding"), "cos")


NEAREST = f"""WITH {DOUBLES}, d AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v) AS approx,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS dist FROM e a JOIN e b ON true)
  SELECT id, CAST(row_number() OVER w AS INTEGER) AS rank, neighbor, {s6("dist")} AS dist FROM d"""


@query("knn_l2_exact", f"{NEAREST} WHERE id <> neighbor WINDOW w AS (PARTITION BY id ORDER BY dist, neighbor) QUALIFY row_number() OVER w <= 3")
def knn_l2_exact(spark, sf):
    return _six(V.knn_l2_exact(T.table(spark, sf, "embeddings"), "vec_id", "embedding", 3), "dist")


@query("knn_l2_exact_self", f"{NEAREST} WINDOW w AS (PARTITION BY id ORDER BY dist, neighbor) QUALIFY row_number() OVER w <= 1")
def knn_l2_exact_self(spark, sf):
    """k = 1 with the query itself among the candidates."""
    return _six(V.knn_l2_exact(T.table(spark, sf, "embeddings"), "vec_id", "embedding", 1, include_self=True), "dist")


@query("knn_l2_approx")
def knn_l2_approx(spark, sf):
    """Three neighbours of every vector, rounded like the exact search."""
    return _six(V.knn_l2_approx(T.table(spark, sf, "embeddings"), "vec_id", "embedding", 3), "dist")


@query("near_pairs_l2")
def near_pairs_l2(spark, sf):
    return V.near_pairs_l2(T.table(spark, sf, "embeddings"), "vec_id", "embedding", 1.2)


COS3 = ", ".join(f"(SELECT v FROM e WHERE vec_id = {i}) AS q{i}" for i in (0, 1, 2))


def _half(q: str) -> str:
    return f"(1 + list_dot_product(v, {q}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({q}, {q})))) / 2"


@query(
    "most_similar_cosmul",
    f"WITH {DOUBLES}, q AS (SELECT {COS3}) SELECT vec_id, {s6(f'{_half(chr(113) + str(0))} * {_half(chr(113) + str(1))} / ({_half(chr(113) + str(2))} + 0.000001)')} AS score FROM e, q WHERE vec_id NOT IN (0, 1, 2)",
)
def most_similar_cosmul(spark, sf):
    return _six(V.most_similar_cosmul(T.table(spark, sf, "embeddings"), "vec_id", "embedding", [0, 1], [2], topn=None), "score")


@query(
    "concat_embeddings",
    f"WITH {DOUBLES} SELECT vec_id, CAST(len(v) * 2 AS BIGINT) AS dim, {s6('v[1] + v[64]')} AS ends FROM e",
)
def concat_embeddings(spark, sf):
    e = T.table(spark, sf, "embeddings")
    rev = e.select("vec_id", F.reverse("embedding").alias("back"))
    both = V_concat(e, rev)
    ends = F.get("embedding", F.lit(0)) + F.get("embedding", F.lit(64))
    return both.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), r6(ends).alias("ends"))


def V_concat(a, b):
    return X.concat_embeddings(a, b, "vec_id", "embedding", "back")


# ---------------------------------------------------------------- text

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
TOKENS = f"toks AS (SELECT doc_id, {WORDS} AS tokens FROM documents)"
STOPS = ", ".join(f"'{w}'" for w in ENGLISH)
CLEAN = rf"""{TOKENS}, clean AS (SELECT doc_id, list_filter(list_transform(tokens, lambda t: regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', '', 'g')),
  lambda t: length(t) > 1 AND NOT list_contains([{STOPS}], t)) AS tokens FROM toks)"""


def _tokens(spark, sf):
    return X.tokenize_words(T.table(spark, sf, "documents").select("doc_id", "text")).drop("text")


def _as_text(df):
    joined = F.array_join("tokens", " ")
    return df.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.md5(joined).alias("token_md5"))


@query("tokenize_words", f"WITH {TOKENS} SELECT doc_id, len(tokens) AS n, md5(coalesce(array_to_string(tokens, ' '), '')) AS token_md5 FROM toks")
def tokenize_words(spark, sf):
    return _as_text(_tokens(spark, sf))


@query("clean_tokens", f"WITH {CLEAN} SELECT doc_id, len(tokens) AS n, md5(coalesce(array_to_string(tokens, ' '), '')) AS token_md5 FROM clean")
def clean_tokens(spark, sf):
    return _as_text(X.clean_tokens(_tokens(spark, sf)))


@query("vocab_min_count", f"WITH {TOKENS}, t AS (SELECT unnest(tokens) AS term FROM toks) SELECT term, count(*) AS n FROM t GROUP BY term HAVING count(*) >= 2")
def vocab_min_count(spark, sf):
    return X.vocab_min_count(_tokens(spark, sf))


@query("stem_tokens")
def stem_tokens(spark, sf):
    return _as_text(X.stem_tokens(cut_lineage(X.clean_tokens(_tokens(spark, sf))), "doc_id"))


@query("label_text_pairs", f"WITH {TEXTS} SELECT md5(text) AS text, CAST(label AS INTEGER) AS label FROM texts")
def label_text_pairs(spark, sf):
    return X.label_text_pairs(T.review_texts(spark, sf), "text", "label").withColumn("text", F.md5("text"))


@query("tagged_documents", f"WITH {TOKENS} SELECT 'SENT_' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS tag, len(tokens) AS n FROM toks")
def tagged_documents(spark, sf):
    from affinity.operators.clean import sentence_tags

    docs = _tokens(spark, sf)
    tags = sentence_tags(docs.select("doc_id"), "doc_id")
    tagged = X.tagged_documents(docs.join(tags, "doc_id"), "tokens", "tag")
    return tagged.select("tag", F.size("tokens").cast("bigint").alias("n"))


@query(
    "text_cosine_distance",
    f"""WITH {TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) GROUP BY ALL),
    sig AS (SELECT doc_id, md5(string_agg(term || ':' || tf, ' ' ORDER BY term)) AS sig, sum(tf * tf) AS sq FROM tf GROUP BY 1),
    rep AS (SELECT min(doc_id) AS doc_id, any_value(sq) AS sq, count(*) AS copies FROM sig GROUP BY sig.sig),
    t AS (SELECT doc_id, term, tf, sq, copies FROM tf JOIN rep USING (doc_id)),
    dots AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, sum(a.tf * b.tf) / sqrt(CAST(any_value(a.sq) AS DOUBLE) * any_value(b.sq)) AS sim,
        any_value(a.copies) * any_value(b.copies) AS pairs
      FROM t a JOIN t b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2)
    SELECT doc_id_a, doc_id_b, {s6("1 - sim")} AS distance, pairs FROM dots WHERE 1 - sim <= 0.2
    UNION ALL SELECT doc_id, doc_id, 0.0::DOUBLE, copies * (copies - 1) // 2 FROM rep WHERE copies > 1""",
)
def text_cosine_distance(spark, sf):
    toks = cut_lineage(_tokens(spark, sf))
    return _six(X.text_cosine_distance(toks, "doc_id", max_distance=0.2), "distance")


@query(
    "copy_groups",
    f"""WITH {TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) GROUP BY ALL),
    sig AS (SELECT doc_id, md5(string_agg(term || ':' || tf, ' ' ORDER BY term)) AS sig FROM tf GROUP BY 1)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS representative FROM sig""",
)
def copy_groups(spark, sf):
    return X.copy_groups(cut_lineage(_tokens(spark, sf)), "doc_id")


def _review_tokens(spark, sf):
    return cut_lineage(X.clean_tokens(X.tokenize_words(T.review_texts(spark, sf))).select("doc_id", "label", "tokens"))


def _w2v(df, passes=1, size=100):
    return X.word2vec(size=size, max_iter=passes, partitions=4).fit(df)


@query("word2vec_fit")
def word2vec_fit(spark, sf):
    return X.word_vectors(_w2v(_review_tokens(spark, sf)))


@query("find_synonyms")
def find_synonyms(spark, sf):
    docs = _review_tokens(spark, sf)
    top = X.vocab_min_count(docs).orderBy(F.desc("n"), "term").first()["term"]
    return X.find_synonyms(_w2v(docs), top, 5)


@query("doc_vectors")
def doc_vectors(spark, sf):
    docs = _review_tokens(spark, sf)
    return X.doc_vectors(_w2v(docs), docs).select("doc_id", "docvec")


@query("infer_doc_vectors")
def infer_doc_vectors(spark, sf):
    """Vectors for documents that had no part in training."""
    train, unseen = SP.train_test(_review_tokens(spark, sf), ["doc_id"], 20)
    return X.doc_vectors(_w2v(train), unseen).select("doc_id", "docvec")


@query("most_similar_docs")
def most_similar_docs(spark, sf):
    docs = _review_tokens(spark, sf)
    return V.knn_cosine(X.doc_vectors(_w2v(docs), docs).select("doc_id", "docvec"), "doc_id", "docvec", 10)


def _doc_features(spark, sf):
    docs = _review_tokens(spark, sf)
    vecs = X.doc_vectors(_w2v(docs, size=32), docs)  # standard errors need more rows than dimensions
    return cut_lineage(C.with_vector(vecs.withColumn("label", F.col("label").cast("double")), "docvec").select("doc_id", "label", "features"))


@query("random_forest_grid")
def random_forest_grid(spark, sf):
    data = SP.kfold_assign(_doc_features(spark, sf), ["doc_id"], 3)
    model = C.random_forest_grid(data, [10, 20], folds=3)
    return C.grid_table(data, model, [(10,), (20,)]).withColumnRenamed("p0", "trees")


@query("random_forest_best")
def random_forest_best(spark, sf):
    """The chosen forest on the documents that the grid has not seen."""
    train, test = SP.train_test(_doc_features(spark, sf), ["doc_id"], 20)
    model = C.random_forest_grid(SP.kfold_assign(cut_lineage(train), ["doc_id"], 3), [10, 20], folds=3)
    return TU.forest_best(model, [10, 20], test)


@query("logistic_fit")
def logistic_fit(spark, sf):
    return C.logistic_summary(_doc_features(spark, sf))


@query("compare_embeddings")
def compare_embeddings(spark, sf):
    """Mean vectors, idf-weighted vectors and both side by side, direct and inferred, by error rate."""
    docs = _review_tokens(spark, sf)

    def mean(model, rows):
        return X.doc_vectors(model, rows).select("doc_id", "docvec")

    def idf(model, rows):
        return X.idf_doc_vectors(model, rows, "doc_id")

    def both(model, rows):
        other = idf(model, rows).withColumnRenamed("docvec", "other")
        return X.concat_embeddings(mean(model, rows), other, "doc_id", "docvec", "other", "docvec")

    runs = TU.compare_embeddings(docs, "doc_id", "label", _w2v, {"mean": mean, "idf": idf, "mean+idf": both}, passes=(1, 2, 5))
    return A.best_by_metric(runs, "model", "error_rate", "pass")
