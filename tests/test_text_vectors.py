from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.functions.stemmer import stem
from affinity.operators import cells
from affinity.operators import text as X
from affinity.operators import vectors as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_words_keep_accents_digits_and_underscores(spark):
    df = spark.createDataFrame([("Élan d'été, THE the_end 42x!",)], "text string")
    toks = X.tokenize_words(df).first()["tokens"]
    assert toks == ["élan", "d", "été", "the", "the_end", "42x"]
    clean = X.clean_tokens(X.tokenize_words(df)).first()["tokens"]
    assert clean == ["élan", "été", "theend", "42x"]


@pytest.mark.parametrize(
    "word,want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"),
        ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
        ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("triplicate", "triplic"),
        ("electrical", "electr"), ("goodness", "good"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"),
        ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"),
        ("oscillators", "oscil"), ("bled", "bled"), ("sing", "sing"), ("feed", "feed"), ("sized", "size"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def test_stem_tokens_keeps_order(spark):
    df = spark.createDataFrame([(1, ["running", "cats", "running"]), (2, [])], "id int, tokens array<string>")
    assert rows(X.stem_tokens(df, "id").select("id", "tokens")) == [(1, ["run", "cat", "run"]), (2, [])]
    shared = spark.createDataFrame([(1, ["cats"]), (1, ["runs", "cats"]), (1, ["cats"]), (None, ["dogs"]), (3, None)], "id bigint, tokens array<string>")
    got = sorted(((r["id"], r["tokens"]) for r in X.stem_tokens(shared, "id").collect()), key=repr)
    assert got == sorted([(1, ["cat"]), (1, ["run", "cat"]), (1, ["cat"]), (None, ["dog"]), (3, None)], key=repr)


def test_vocabulary(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["c", "b"],)], "tokens array<string>")
    assert rows(X.vocab_min_count(df)) == [("a", 2), ("b", 2)]


def _texts():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    weights = np.array([1 / (i + 1) for i in range(40)])
    out = [(i, list(rng.choice(words, size=int(rng.integers(1, 25)), p=weights / weights.sum()))) for i in range(60)]
    out += [(100 + i, list(reversed(out[3][1]))) for i in range(30)]  # a third of the texts are copies
    return [(i, [str(t) for t in toks]) for i, toks in out]


@pytest.mark.parametrize("limit", [0.0, 0.2, 0.6, 0.95])
def test_text_distance_is_exact(spark, limit):
    data = _texts()
    first = {}
    for i, toks in data:
        first.setdefault(tuple(sorted(Counter(toks).items())), i)
    vec = {i: Counter(dict(k)) for k, i in first.items()}
    want = {}
    for a, b in combinations(sorted(vec), 2):
        dot = sum(vec[a][t] * vec[b][t] for t in vec[a])
        d = 1 - dot / np.sqrt(sum(x * x for x in vec[a].values()) * sum(x * x for x in vec[b].values()))
        if dot and d <= limit:
            want[a, b] = d
    df = spark.createDataFrame(data, "id bigint, tokens array<string>")
    out = X.text_cosine_distance(df, "id", max_distance=limit).collect()
    got = {(r["id_a"], r["id_b"]): r["distance"] for r in out if r["id_a"] != r["id_b"]}
    assert got == pytest.approx(want)
    # every pair of documents counts once, copies among themselves too
    copies = Counter(first[tuple(sorted(Counter(toks).items()))] for _, toks in data)
    pairs = {(r["id_a"], r["id_b"]): r["pairs"] for r in out}
    assert pairs == {(a, b): copies[a] * copies[b] for a, b in want} | {(a, a): n * (n - 1) // 2 for a, n in copies.items() if n > 1}
    groups = dict(rows(X.copy_groups(df, "id")))
    assert {groups[100 + i] for i in range(30)} == {3}


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 5)) * 5
    pts = [centres[i % 6] + rng.normal(size=5) * 0.3 for i in range(150)]
    pts += [pts[0]] * 75  # a third are copies of one vector
    return [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(pts)]


@pytest.mark.parametrize("k,self_", [(1, False), (4, False), (1, True), (3, True)])
def test_knn_is_exact_with_copies_cells_and_chunks(spark, points, k, self_):
    m = np.array([p for _, p in points])
    d = ((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)
    want = {}
    for i in range(len(m)):
        order = sorted((d[i, j], j) for j in range(len(m)) if self_ or j != i)[:k]
        want[i] = [j for _, j in order]
    df = spark.createDataFrame(points, "id bigint, v array<float>")
    got = V.knn_l2_exact(df, "id", "v", k, self_, cell=10)
    lists = {}
    for r in sorted(got.collect(), key=lambda r: (r["id"], r["rank"])):
        lists.setdefault(r["id"], []).append(r["neighbor"])
        assert r["dist"] == pytest.approx(d[r["id"], r["neighbor"]])
    assert lists == want


def test_knn_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id bigint, v array<double>")
    assert rows(V.knn_l2_exact(df, "id", "v", 5)) == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]
    assert V.knn_l2_exact(df.limit(0), "id", "v", 5).count() == 0


def test_cosines(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-3.0, 0.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "id bigint, v array<double>"
    )
    want = {(1, 2): 0, (1, 3): -1, (1, 5): 1, (2, 3): 0, (2, 5): 0, (3, 5): -1}
    for block in (2, 100):
        got = {(r["id_a"], r["id_b"]): r["cos"] for r in V.vector_cosine_pairs(df, "id", "v", block).collect()}
        assert got == pytest.approx(want)
    assert rows(V.vector_cosine_pairs(df, "id", "v", 2, min_cos=0.5)) == [(1, 5, 1.0)]
    pairs = spark.createDataFrame([(1, 5), (1, 4)], "id_a bigint, id_b bigint")
    assert rows(V.vector_cosine(pairs, df, "id", "v")) == [(1, 4, None), (1, 5, 1.0)]
    near = {r["id"]: r["neighbor"] for r in V.knn_cosine(df, "id", "v", 1).collect()}
    assert near[1] == 5 and 4 not in near
    assert [r["id"] for r in V.most_similar(df, "id", "v", [1.0, 0.1], 2).collect()] == [1, 5]


def test_cosmul(spark):
    df = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(8)], "id bigint, v array<double>")
    got = {r["id"]: r["score"] for r in V.most_similar_cosmul(df, "id", "v", [0, 1], [3], topn=None).collect()}
    for i in (2, 4, 5, 6, 7):
        want = (1 + np.cos(i)) / 2 * (1 + np.cos(i - 1)) / 2 / ((1 + np.cos(i - 3)) / 2 + 1e-6)
        assert got[i] == pytest.approx(want)
    assert set(got) == {2, 4, 5, 6, 7}


def test_lsh_finds_most_close_pairs(spark, points):
    df = spark.createDataFrame(points, "id bigint, v array<float>")
    m = np.array([p for i, p in points if i < 150])
    d = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2))
    want = {(i, j) for i, j in combinations(range(150), 2) if d[i, j] < 0.5}
    got = {(r["id_a"], r["id_b"]) for r in V.near_pairs_l2(df, "id", "v", 0.5, bucket=4.0, tables=6).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_word_and_document_vectors(spark):
    docs = spark.createDataFrame([(i, ["red", "green", "blue", f"w{i % 3}"]) for i in range(30)], "id bigint, tokens array<string>")
    model = X.word2vec(size=4).fit(docs)
    words = {r["word"]: np.array(r["vector"]) for r in X.word_vectors(model).collect()}
    doc = X.doc_vectors(model, docs).filter("id = 1").first()
    assert np.allclose(doc["docvec"], np.mean([words[t] for t in doc["tokens"]], axis=0))
    unseen = spark.createDataFrame([(99, ["red", "unheard"])], "id bigint, tokens array<string>")
    assert len(X.doc_vectors(model, unseen).first()["docvec"]) == 4
    odd = spark.createDataFrame([(1, ["red", "unheard"]), (1, ["red", "unheard"]), (2, []), (3, ["unheard"]), (4, None)], "id bigint, tokens array<string>")
    got = sorted((r["id"], [round(x, 6) for x in r["docvec"]]) for r in X.doc_vectors(model, odd).collect())
    half = [round(x / 2, 6) for x in words["red"]]
    assert got == [(1, half), (1, half), (2, [0.0] * 4), (3, [0.0] * 4), (4, [0.0] * 4)]
    own = {r["id"]: r["docvec"] for r in model.transform(docs).collect()}
    assert all(np.allclose(r["docvec"], own[r["id"]].toArray()) for r in X.doc_vectors(model, docs).collect())
    weighted = {r["id"]: r["docvec"] for r in X.idf_doc_vectors(model, odd, "id").collect()}
    assert np.allclose(weighted[1], words["red"]) and weighted[3] == [0.0] * 4 and len(weighted) == 4
    assert X.find_synonyms(model, "red", 2).count() == 2
    both = X.concat_embeddings(X.doc_vectors(model, docs), X.idf_doc_vectors(model, docs, "id").withColumnRenamed("docvec", "o"), "id", "docvec", "o")
    assert both.select(F.size("embedding")).distinct().collect()[0][0] == 8 and both.count() == 30


def test_visits_of_the_neighbour_search_do_not_grow_with_the_table(spark):
    rng = np.random.default_rng(11)
    visited = []
    for n in (1500, 3000):
        pts = [(f"{i:05d}", p, [i]) for i, p in enumerate(rng.normal(size=(n, 2)).tolist())]
        df = spark.createDataFrame(pts, "sig string, v array<double>, members array<bigint>").cache()
        tree = cells.build(df, cell=50)
        met = V._in_reach(tree, V._at_home(tree, 4), 4).select("sig", "leaf").unionByName(tree.rows.select("sig", "leaf"))
        visited.append(met.join(tree.leaves.select("leaf", "n"), "leaf").agg(F.sum("n")).first()[0] / n)
    assert visited[1] < 1.25 * visited[0] and visited[1] < 500


def test_approximate_neighbours_have_k_rows_and_high_recall(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 16)) * 2
    pts = [(i, (centres[i % 12] + rng.normal(size=16) * 0.4).tolist()) for i in range(1200)]
    pts += [(1200 + i, pts[7][1]) for i in range(100)]
    df = spark.createDataFrame(pts, "id bigint, v array<double>").cache()
    exact = {(r["id"], r["rank"]): r["dist"] for r in V.knn_l2_exact(df, "id", "v", 5, cell=100).collect()}
    got = V.knn_l2_approx(df, "id", "v", 5, cell=60, probes=6).collect()
    assert Counter(r["id"] for r in got) == {i: 5 for i, _ in pts}
    same = sum(r["dist"] <= exact[r["id"], r["rank"]] + 1e-9 for r in got)
    assert same >= 0.95 * len(got)
    assert all(r["dist"] >= exact[r["id"], r["rank"]] - 1e-9 for r in got)
