"""Tokens, vocabulary, text distance, document vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.functions.columns import words
from affinity.functions.stemmer import stem
from affinity.functions.stopwords import ENGLISH
from affinity.operators import cells
from affinity.operators.scale import with_row
from affinity.session import cut_lineage


def tokenize_words(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Lower-cased words of the whole text."""
    return df.withColumn(out, words(F.col(text)))


def clean_tokens(df: DataFrame, col: str = "tokens", stop: Sequence[str] = ENGLISH) -> DataFrame:
    """Lower, keep letters and digits, then drop stop words and what is one character or less."""
    lowered = F.transform(col, lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", ""))
    return df.withColumn(col, F.filter(lowered, lambda t: (F.length(t) > 1) & ~t.isin(*stop)))


def term_counts(df: DataFrame, key: str, col: str = "tokens") -> DataFrame:
    """(key, term, tf)."""
    return df.select(key, F.explode(col).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocab_min_count(df: DataFrame, col: str = "tokens", min_count: int = 2) -> DataFrame:
    """(term, n) of the terms that occur at least ``min_count`` times."""
    n = df.select(F.explode(col).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") >= min_count)


STEMS = 200_000  # stems a task keeps from one batch to the next


def stem_vocabulary(df: DataFrame, col: str = "tokens") -> DataFrame:
    """(term, stem) of the distinct terms: the Python stemmer sees each term once."""

    @F.pandas_udf("string")
    def porter(s: pd.Series) -> pd.Series:
        return s.map(stem)

    terms = df.select(F.explode(col).alias("term")).distinct()
    return terms.select("term", porter("term").alias("stem"))


def _list_id(col: str) -> Column:
    """A digest of a token list; equal lists have equal ones."""
    return F.sha2(F.to_json(F.array(F.col(col))), 256)


def stem_tokens(df: DataFrame, key: str, col: str = "tokens") -> DataFrame:
    """Tokens replaced by their stems, in order.

    A row's stems follow from its tokens alone, so nothing is shuffled and rows may share a ``key``. A task stems a term
    once for each batch and keeps the stems of ``STEMS`` terms beyond it. Tokens that are null are left out, unless there
    are no others.
    """

    @F.pandas_udf("array<string>")
    def porter(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}

        def one(tokens: np.ndarray | None) -> list[str | None] | None:
            if tokens is None:
                return None
            out = []
            for t in tokens:
                if t is not None:
                    if t not in known:
                        known[t] = stem(t)
                    out.append(known[t])
            return out or list(tokens)

        for batch in lists:
            if len(known) > STEMS:
                known.clear()
            yield batch.map(one)

    return df.withColumn(col, porter(col))


def label_text_pairs(df: DataFrame, text: str, label: str) -> DataFrame:
    return df.select(F.col(text).alias("text"), F.col(label).alias("label"))


def tagged_documents(df: DataFrame, tokens: str, tag: str) -> DataFrame:
    return df.select(F.col(tokens).alias("tokens"), F.col(tag).alias("tag"))


def count_vectors(df: DataFrame, key: str, col: str = "tokens") -> DataFrame:
    """(key, copies, terms): one row per different term-count vector.

    ``key`` is the smallest key that has the vector and ``copies`` how many have it, so copies of a text
    are one vector from here on. ``terms`` is a document's own sorted array of (term, tf).
    """
    t = F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("terms")
    docs = term_counts(df, key, col).groupBy(key).agg(t)
    sig = F.sha2(F.to_json("terms"), 256)
    return docs.groupBy(sig.alias("sig")).agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies"), F.any_value("terms").alias("terms")
    )


def copy_groups(df: DataFrame, key: str, col: str = "tokens") -> DataFrame:
    """(key, representative): which vector of :func:`count_vectors` stands for a document."""
    # equal term counts are equal sorted tokens; the rows of a key are one document
    whole = df.filter(F.size(col) > 0).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(col))).alias("tokens"))
    docs = whole.select(key, F.sha2(F.to_json("tokens"), 256).alias("sig"))
    rep = docs.groupBy("sig").agg(F.min(key).alias("representative"))
    return docs.join(rep, "sig").select(key, "representative")


HEAD = 256  # most frequent terms, whose counts are compared as dense vectors


def text_cosine_distance(df: DataFrame, key: str, col: str = "tokens", max_distance: float = 0.5) -> DataFrame:
    """(key_a, key_b, distance, pairs): count vectors within a cosine distance, exact.

    Documents with equal vectors are one row, named by their smallest key (see :func:`copy_groups`); ``pairs`` is
    the number of pairs of documents that a row stands for. Copies of one text are the row (key, key, 0.0).

    Frequent words bring nearly all documents of a language together, so terms are no way to find candidates. Instead
    the counts of the ``HEAD`` most frequent terms and the norm of all the rest make a short vector whose cosine is an
    upper bound of the documents' cosine. A tree of cells over these vectors (:mod:`affinity.operators.cells`) leaves
    the blocks of documents that can hold a pair; in a block the bound picks candidates, and their rare terms,
    sorted by number, complete the product.
    """
    if not 0 <= max_distance < 1:
        raise ValueError("max_distance must be in [0, 1); at 1 every pair without a common term counts")
    rows = _short_vectors(count_vectors(df, key, col), key)
    pair = F.struct(F.lit(0).cast("long").alias("dot"), "sq", F.col("sq").alias("sq_b"), "id", F.col("id").alias("id_b"), "copies", F.col("copies").alias("copies_b"))
    schema = rows.select(pair.alias("p")).select("p.*").schema
    kind = rows.schema["id"].dataType
    tree = cells.build(rows)
    if tree is None:
        empty = df.sparkSession.createDataFrame([], "distance double, pairs long").withColumn("a", F.lit(None).cast(kind))
        return empty.select(F.col("a").alias(f"{key}_a"), F.col("a").alias(f"{key}_b"), "distance", "pairs")
    bound = F.lit((2.0 * max_distance) ** 0.5)  # of the distance of two unit vectors
    asked = tree.rows.select("sig", "v", "sq", "id", "copies", "tail", "tf", F.col("leaf").alias("own"), bound.alias("bound"))
    # two leaves meet once
    asked = cells.visits(asked, tree).filter("own <= leaf").drop("bound")
    found = cells.products(asked, tree, _close_documents(1.0 - max_distance), schema)
    distance = 1 - F.col("dot") / F.sqrt(F.col("sq").cast("double") * F.col("sq_b"))
    close = found.select(
        F.least("id", "id_b").alias(f"{key}_a"), F.greatest("id", "id_b").alias(f"{key}_b"), distance.alias("distance"), (F.col("copies") * F.col("copies_b")).alias("pairs")
    ).filter(F.col("distance") <= max_distance)
    n = F.col("copies")
    copies = tree.rows.filter("copies > 1").select(
        F.col("id").alias(f"{key}_a"), F.col("id").alias(f"{key}_b"), F.lit(0.0).alias("distance"), F.floor(n * (n - 1) / 2).cast("long").alias("pairs")
    )
    return close.unionByName(copies)


def _short_vectors(docs: DataFrame, key: str) -> DataFrame:
    """(sig, id, copies, sq, v, tail, tf): the short unit vector, and the terms outside of it with their counts.

    Terms go by a 64-bit hash. The seed is raised until no two terms of the corpus share one.
    """
    docs = cut_lineage(docs.select("sig", F.col(key).alias("id"), "copies", "terms"))
    vocabulary = cut_lineage(docs.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    seed = 0
    while True:
        number = F.xxhash64("term", F.lit(seed))
        if vocabulary.groupBy(number).count().filter("count > 1").limit(1).count() == 0:
            break
        seed += 1
    top = vocabulary.orderBy(F.desc("df"), "term").limit(HEAD).select(number.alias("h")).collect()
    head = np.array(sorted(r["h"] for r in top), np.int64)

    numbers = F.transform("terms", lambda t: F.xxhash64(t["term"], F.lit(seed)))
    sq = F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + t["tf"] * t["tf"])
    flat = docs.select("sig", "id", "copies", sq.alias("sq"), numbers.alias("tail"), F.col("terms.tf").alias("tf"))

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v, tail, tf = [], [], []
            for n, c, total in zip(pdf["tail"], pdf["tf"], pdf["sq"], strict=True):
                order = np.argsort(n)
                n, c = n[order], c[order]
                at = np.minimum(np.searchsorted(head, n), len(head) - 1)
                known = head[at] == n
                x = np.zeros(len(head) + 1)
                x[at[known]] = c[known]
                x[-1] = np.sqrt(float((c[~known] ** 2).sum()))
                v.append(x / np.sqrt(float(total)))
                tail.append(n[~known])
                tf.append(c[~known])
            yield pdf.assign(v=v, tail=tail, tf=tf)

    schema = flat.withColumn("v", F.lit(None).cast("array<double>")).schema
    return cut_lineage(flat.mapInPandas(shorten, schema))


def _close_documents(min_sim: float) -> cells.Block:
    """The pairs of a block with a cosine of ``min_sim`` or a little less, with their integer product."""

    def flat(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = rows["tail"].map(len).to_numpy(np.int64)
        if not n.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(rows["tail"].to_list()), np.repeat(np.arange(len(rows)), n), np.concatenate(rows["tf"].to_list()).astype(np.float64)

    def short(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norm = np.sqrt(rows["sq"].to_numpy(np.float64))
        x = cells.matrix(rows["v"]) * norm[:, None]
        return np.rint(x[:, :-1]), x[:, -1], norm  # counts are whole numbers

    def block(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        home = q["own"].to_numpy() == q["leaf"].to_numpy()
        head_b, rest_b, norm_b = short(b)
        terms, row_b, tf_b = flat(b)
        order = np.argsort(terms, kind="stable")
        terms, row_b, tf_b = terms[order], row_b[order], tf_b[order]
        ids, ids_b = q["id"].to_numpy(), b["id"].to_numpy()
        out = []
        for s in range(0, len(q), 256):
            part = q.iloc[s : s + 256]
            head, rest, norm = short(part)
            dot = head @ head_b.T
            need = min_sim * (1 - 1e-9) * norm[:, None] * norm_b[None, :]
            maybe = dot + rest[:, None] * rest_b[None, :] * (1 + 1e-9) >= need
            maybe &= (ids[s : s + 256, None] < ids_b[None, :]) | ~home[s : s + 256, None]
            rows = np.flatnonzero(maybe.any(axis=1))
            if not len(rows):
                continue
            dot, maybe, need = dot[rows], maybe[rows], need[rows]
            t, r, c = flat(part.iloc[rows])
            lo, hi = np.searchsorted(terms, t, "left"), np.searchsorted(terms, t, "right")
            n = hi - lo
            # one slot for each entry of a query that meets an entry of the base
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            slot = np.repeat(r, n) * len(b) + row_b[at]
            dot += np.bincount(slot, np.repeat(c, n) * tf_b[at], dot.size).reshape(dot.shape)
            i, j = np.nonzero(maybe & (dot >= need))
            a = part.iloc[rows[i]]
            o = b.iloc[j]
            out.append(
                pd.DataFrame(
                    {
                        "dot": np.rint(dot[i, j]).astype(np.int64), "sq": a["sq"].to_numpy(), "sq_b": o["sq"].to_numpy(), "id": a["id"].to_numpy(),
                        "id_b": o["id"].to_numpy(), "copies": a["copies"].to_numpy(), "copies_b": o["copies"].to_numpy(),
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame()

    return block


def word2vec(size: int = 100, min_count: int = 2, max_iter: int = 1, seed: int = 17, partitions: int = 1, col: str = "tokens", out: str = "docvec") -> Word2Vec:
    return Word2Vec(
        vectorSize=size, minCount=min_count, maxIter=max_iter, seed=seed, numPartitions=partitions, inputCol=col, outputCol=out
    )


def word_vectors(model: Word2VecModel) -> DataFrame:
    """(word, vector array)."""
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def find_synonyms(model: Word2VecModel, word: str, n: int = 5) -> DataFrame:
    return model.findSynonyms(word, n)


PIECE = 500_000  # words of text in a piece


def mean_vectors(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """(_id, mean, known): weighted mean of the word vectors of a token list (_id, _t), and the weight of its known words.

    ``terms`` has (term, vector array<float>, w), and an occurrence of a term counts w; those of 0 or less count nothing.
    Lists are dealt to pieces, and a piece gets the vectors of the words that it has, each once: what is shuffled grows
    with the different words of the pieces, not with the words of the texts. Lists without a known word have no row.
    """
    n = lists.agg(F.sum(F.size("_t").cast("bigint"))).first()[0] or 0
    pieces = max(1, -(-n // PIECE))
    dealt = lists.select(F.pmod(F.xxhash64("_id"), F.lit(pieces)).alias("piece"), "_id", "_t")
    held = dealt.select(F.col("piece").alias("at"), F.explode("_t").alias("term")).distinct().join(terms.filter("w > 0"), "term")
    held = held.select("at", "term", "vector", "w")

    def means(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(words):
            return pd.DataFrame({"_id": [], "mean": [], "known": []})
        number, w = pd.Index(words["term"]), words["w"].to_numpy(np.float64)
        vectors = np.stack(words["vector"].to_list())
        ids, mean, known = [], [], []
        for i, tokens in zip(texts["_id"], texts["_t"], strict=True):
            at = number.get_indexer(tokens) if tokens is not None and len(tokens) else np.zeros(0, np.int64)
            at, tf = np.unique(at[at >= 0], return_counts=True)
            if len(at):
                share = w[at] * tf
                ids.append(i)
                known.append(share.sum())
                mean.append((share @ vectors[at].astype(np.float64)) / known[-1])
        return pd.DataFrame({"_id": ids, "mean": mean, "known": known})

    return dealt.groupBy("piece").cogroup(held.groupBy("at")).applyInPandas(means, "_id string, mean array<double>, known double")


def _vectors(model: Word2VecModel) -> DataFrame:
    """(term, vector array<float>), which is how the model holds them."""
    return model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector", "float32").alias("vector"))


def _each_list(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the id of their token list, and (_id, _t) of the different lists."""
    rows = df.withColumn("_id", _list_id(col))
    return rows, cut_lineage(rows.groupBy("_id").agg(F.any_value(col).alias("_t")))


def doc_vectors(model: Word2VecModel, df: DataFrame, out: str = "docvec", col: str = "tokens") -> DataFrame:
    """Mean of the word vectors of a document, as an array; words the model does not know count as zero.

    Works for documents not seen in training. Every row has a vector, zeros if no word is known.
    """
    rows, lists = _each_list(df, col)
    mean = mean_vectors(lists, _vectors(model).withColumn("w", F.lit(1.0)))
    zero = F.array_repeat(F.lit(0.0), model.getVectorSize())
    share = F.col("known") / F.size(col)
    full = rows.join(mean, "_id", "left").withColumn(out, F.coalesce(F.transform("mean", lambda x: x * share), zero))
    return full.drop("_id", "mean", "known")


def idf_doc_vectors(model: Word2VecModel, df: DataFrame, key: str, col: str = "tokens", out: str = "docvec") -> DataFrame:
    """(key, out): mean of the word vectors weighted by tf * idf over the known words; zeros if there are none."""
    rows, lists = _each_list(df, col)
    # a term counts once for each row that has its list
    copies = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_c"))
    n_docs = df.agg(F.count(F.lit(1)).alias("n_docs"))
    terms = lists.join(copies, "_id").select("_c", F.explode(F.array_distinct("_t")).alias("term"))
    idf = with_row(terms.groupBy("term").agg(F.sum("_c").alias("df")), n_docs)
    idf = idf.select("term", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)).alias("w"))
    mean = mean_vectors(lists, _vectors(model).join(idf, "term"))
    zero = F.array_repeat(F.lit(0.0), model.getVectorSize())
    return rows.join(mean, "_id", "left").select(key, F.coalesce("mean", zero).alias(out))


def concat_embeddings(a: DataFrame, b: DataFrame, key: str, col_a: str, col_b: str, out: str = "embedding") -> DataFrame:
    """Two embeddings of the same key side by side."""
    return a.select(key, col_a).join(b.select(key, F.col(col_b).alias("_other")), key).select(
        key, F.concat(F.col(col_a).cast("array<double>"), F.col("_other").cast("array<double>")).alias(out)
    )
