"""Registered queries of the operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm import (
    bpe, decontaminate, editprint, licences, merkle, neardup, pii, pseudolik, quality, secretscan, spelling, substrings, toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, count="n_entities")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, threshold=80)


def op5_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.edited(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand as files source/lang/doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")
    return licences.scan(_table(spark, sf_dir, "documents").select("doc_id", path, "text"))


_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in licences.TEMPLATES)
OP7_SQL = rf"""
WITH files AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
each AS (SELECT doc_id, path, len(regexp_split_to_array(trim(text), '\s+')) AS words,
                unnest(regexp_split_to_array(text, '\n|[.!?]+\s+')) AS s
         FROM files WHERE regexp_matches(lower(text), '{licences.CUE}')),
sec AS (SELECT doc_id, path, words, lower(trim(s)) AS form FROM each WHERE regexp_matches(lower(s), '{licences.CUE}')),
forms AS (SELECT form, count(*) AS n FROM sec GROUP BY 1),
tpl(licence, notice) AS (VALUES {_VALUES}),
ft AS (SELECT form, t, count(*) AS tf FROM (SELECT form, unnest(regexp_extract_all(form, '[a-z0-9]+')) AS t FROM forms) GROUP BY 1, 2),
tt AS (SELECT licence, t, count(*) AS tf
       FROM (SELECT licence, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS t FROM tpl) GROUP BY 1, 2),
df AS (SELECT t, sum(n) AS df FROM (SELECT t, n FROM ft JOIN forms USING (form) UNION ALL SELECT t, 1 FROM tt) GROUP BY 1),
tot AS (SELECT coalesce(sum(n), 0) + {len(licences.TEMPLATES)} AS n FROM forms),
idf AS (SELECT t, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, tot),
a AS (SELECT form, t, tf * idf AS a FROM ft JOIN idf USING (t)),
b AS (SELECT licence, t, tf * idf AS b FROM tt JOIN idf USING (t)),
na AS (SELECT form, sqrt(sum(a * a)) AS na FROM a GROUP BY 1),
nb AS (SELECT licence, sqrt(sum(b * b)) AS nb FROM b GROUP BY 1),
dots AS (SELECT form, licence, sum(a * b) AS dot FROM a JOIN b USING (t) GROUP BY 1, 2),
cosines AS (SELECT form, licence, round(dot / (na * nb), 6) AS cosine FROM dots JOIN na USING (form) JOIN nb USING (licence)),
found AS (SELECT doc_id, path, words, form, licence, cosine
          FROM sec JOIN (SELECT * FROM cosines WHERE cosine >= {licences.MIN_COSINE}
                         QUALIFY row_number() OVER (PARTITION BY form ORDER BY cosine DESC, licence) = 1) USING (form)),
own AS (SELECT doc_id, any_value(path) AS path, arg_min(licence, (-cosine, licence)) AS licence, max(cosine) AS cosine,
               2 * sum(len(regexp_split_to_array(form, '\s+'))) >= max(words) AS whole FROM found GROUP BY 1),
dirs AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, arg_min(licence, (-cosine, licence)) AS licence, max(cosine) AS cosine
         FROM own WHERE whole OR regexp_matches(regexp_extract(path, '[^/]*$'), '{licences.NAME}') GROUP BY 1),
heir AS (SELECT f.doc_id, d.licence, d.cosine, d.dir FROM files f JOIN dirs d ON d.dir = '' OR starts_with(f.path, d.dir || '/')
         WHERE f.doc_id NOT IN (SELECT doc_id FROM own)
         QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(d.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.licence, h.licence) AS licence, coalesce(o.cosine, h.cosine) AS cosine,
       CASE WHEN o.doc_id IS NOT NULL THEN 'own' WHEN h.doc_id IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN o.doc_id IS NULL THEN h.dir END AS from_dir
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN heir h USING (doc_id)"""


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pseudolik.score(docs, pseudolik.fit(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
firsts AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 13)) AS p FROM win JOIN firsts USING (k) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY e.p) AS t
         FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def op11_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(_table(spark, sf_dir, "documents"))


def op12_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_recursive_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(_table(spark, sf_dir, "documents"))


# CRC-32 of a list of bytes, bit by bit for the table of the 256 single bytes
_CRC_TABLE = """crc(t) AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))))"""


def _crc(codes: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run, count(*) AS k
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
         WHERE length(run) >= 7 GROUP BY 1, 2),
codes AS (SELECT run, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
            lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b FROM runs),
hashed AS (SELECT run, k, {_crc('b')} AS h FROM codes, crc),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word,
                 CAST(sum(k) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
gaps AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM gaps a JOIN gaps b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM pairs GROUP BY 1),
own AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
        FROM words w LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM own UNION ALL SELECT c.word, o.form FROM chain c JOIN own o ON c.root = o.word WHERE o.form IS NOT NULL)
SELECT o.word, o.form, c.root, o.n, o.n_near, o.form_n
FROM own o JOIN chain c USING (word) JOIN own e ON c.root = e.word WHERE e.form IS NULL"""

def _fields(text: str) -> str:
    values = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in merkle.FIELDS]
    return " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values)


# levels of all trees side by side: the sources' first, then the tree over their subroots
OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (SELECT *, {_crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")} AS h FROM documents, crc),
hashed AS (SELECT doc_id, source, sha256({_fields('text')}) AS leaf,
             sha256({_fields("CASE WHEN coalesce(h % 2 = 0, false) THEN replace(text, chr(10), '') ELSE text END")}) AS tampered
           FROM docs),
leaves AS (SELECT *, coalesce('=' || source, '-') AS tree,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed),
up(tree, lvl, i, h, n) AS (
  SELECT tree, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, lvl, i // 3),
subs AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, i, h, n) AS (
  SELECT 0, i, h, n FROM subs
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, i // 3),
highest AS (SELECT tree, max(lvl) AS lvl FROM up GROUP BY 1),
nodes AS (SELECT tree, lvl, i, h, n FROM up WHERE n > 1
          UNION ALL SELECT s.tree, t.lvl + 1000, t.i, t.h, t.n FROM top t, (SELECT DISTINCT tree FROM subs) s WHERE t.n > 1),
sides AS (SELECT a.tree, a.lvl, a.i, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i) AS l, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i) AS r
          FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 GROUP BY 1, 2, 3),
climb(doc_id, leaf, tree, lvl, i, proof, folded) AS (
  SELECT doc_id, leaf, tree, 0, i, '', tampered FROM leaves
  UNION ALL
  SELECT * FROM (
    SELECT c.doc_id, c.leaf, c.tree, CASE WHEN c.lvl < 1000 AND c.lvl = hi.lvl THEN 1000 ELSE c.lvl + 1 END AS lvl,
           CASE WHEN c.lvl < 1000 AND c.lvl = hi.lvl THEN s.i ELSE c.i // 3 END AS i,
           CASE WHEN c.lvl < 1000 AND c.lvl = hi.lvl THEN c.proof ELSE c.proof || coalesce(g.l, '') || coalesce(g.r, '') END AS proof,
           CASE WHEN c.lvl < 1000 AND c.lvl = hi.lvl THEN c.folded ELSE sha256(coalesce(g.l, '') || c.folded || coalesce(g.r, '')) END AS folded
    FROM climb c JOIN highest hi USING (tree) JOIN subs s USING (tree)
    LEFT JOIN sides g ON g.tree = c.tree AND g.lvl = c.lvl AND g.i = c.i
    WHERE c.lvl < 1000 + (SELECT max(lvl) FROM top))),
done AS (SELECT * FROM climb WHERE lvl = 1000 + (SELECT max(lvl) FROM top))
SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = r.h AS verified
FROM done d JOIN subs s USING (tree), (SELECT h FROM top WHERE n = 1) r"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_surrogates, op2_decontaminate, op3_quality, op4_minhash, op5_edit_embedding, op6_bpe, op7_licences, op8_pseudo_likelihood,
        op9_toxicity, op10_fm_index, op11_token_efficiency, op12_trie_frontier, op13_recursive_climb,
    )
}
TWINS: dict[str, str] = {"op7_licences": OP7_SQL, "op10_fm_index": OP10_SQL, "op12_trie_frontier": OP12_SQL, "op13_recursive_climb": OP13_SQL}
