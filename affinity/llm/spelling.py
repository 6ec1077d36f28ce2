"""Spelling variants: words one edit apart, found by walking tries of the vocabulary.

One edit leaves the first half of a word or its last half as it is. So every word walks two kinds of tries, one of
the words read forwards and one of the words read backwards, starts below its untouched half, and never fans out
over the crowded nodes near a root. There is a trie for every word length: a word walks the one of its own length,
where it may replace a letter, and the one of words one shorter, where it may leave a letter out (a letter put in is
the same pair seen from the other word). A node is named by its letters; a node with one word below it is a leaf and
holds that word.

The state of a walk is (word, position, node, edits). All walks go down one level at a time by a join with the edge
table; a node has at most as many edges as the alphabet letters. A walk that has spent its edit must go on letter by
letter and ends at a leaf, whose word is a neighbour if the rest agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.textops import mix, random_words
from affinity.operators.scale import heavy_keys, split_join
from affinity.session import cut_lineage

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 7
MIN_COUNT = 2
FACTOR = 10  # a form is so many times as frequent
DROP = 31  # one in so many occurrences loses a letter
DEPTH = 64  # longer words are compared by their hashes with one letter left out
HOT = 200_000  # walks at one node (rows of one key) beyond which they are split


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the runs of letters in ``text``, A-Z in lower case, one in ``DROP`` with a letter deleted.

    Which run loses which letter follows from the checksum of ``doc_id:run``; a null doc_id counts as empty text.
    A null or empty text has no words; rows that repeat count again.
    """
    # a run that is too short stays so when it loses a letter
    long_runs = F.regexp_extract_all("text", F.lit(f"(?<!{RUN}){RUN}{{{min_length},}}"), F.lit(0))
    ascii_only = F.octet_length("run") == F.length("run")
    lowered = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = docs.select("doc_id", F.explode(long_runs).alias("run")).select("doc_id", lowered.alias("run"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    h = F.crc32(key.cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % DROP == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count)


def _half(length: Column) -> Column:
    """Depth at which walks enter the trie of words of this length: no more than either untouched half."""
    return F.floor((length - 1) / 2).cast("int")


def _letter(word: str, place: Column) -> Column:
    """One letter by its place from 0."""
    return F.substring(F.col(word), place + 1, F.lit(1))


def _read_both_ways(words: DataFrame) -> DataFrame:
    """(back, w, n): each word as read forwards and backwards."""
    both = F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("w")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("w"))))
    return words.select(both.alias("_b"), "n").select("_b.*", "n")


def _edges(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes at entry depth, and (back, size, node, level, kids): the edges of every node with two words or more.

    A kid has its letter c, the letters that may follow, and, where it is a leaf, its only word and that word's n.
    Level 0 is the entry depth of the trie.
    """
    size = F.length("w")
    depth = F.explode(F.sequence(_half(size), size))
    each = sides.select("back", size.alias("size"), "w", "n", depth.alias("depth"))
    nodes = each.groupBy("back", "size", F.substring(F.col("w"), F.lit(1), F.col("depth")).alias("node")).agg(
        F.count(F.lit(1)).alias("below"),
        F.array_join(F.collect_set(_letter("w", F.col("depth"))), "").alias("then"),
        F.min(F.struct("w", "n")).alias("only"),
    )
    nodes = nodes.withColumn("only", F.when(F.col("below") == 1, F.col("only")))
    nodes = cut_lineage(nodes.withColumn("level", F.length("node") - _half(F.col("size"))))
    kid = F.struct(F.substring(F.col("node"), F.length("node"), F.lit(1)).alias("c"), "then", "only")
    parent = F.substring(F.col("node"), F.lit(1), F.length("node") - 1)
    kids = nodes.filter("level > 0").groupBy("back", "size", parent.alias("node"), (F.col("level") - 1).cast("int").alias("level"))
    kids = kids.agg(F.count(F.lit(1)).alias("_k"), F.collect_list(kid).alias("kids"), F.max("only").alias("_o"))
    # one kid that is a leaf: its parent is a leaf too, and no walk goes on from there
    edges = kids.filter("NOT (_k = 1 AND _o IS NOT NULL)").drop("_k", "_o")
    return nodes.filter("level = 0").drop("level"), cut_lineage(edges)


STATE = ["back", "size", "w", "n", "pos", "node", "edits"]
PAIR = ["back", "size", "w", "n", "only.w AS v", "only.n AS m"]


def _enter(sides: DataFrame, entries: DataFrame) -> tuple[DataFrame, bool]:
    """Walks at their entry nodes, with ``only`` where a leaf's word is a neighbour; and whether some node is hot.

    A walk keeps to the nodes below its entry node and comes to each by one way, so no node deeper down has
    more walks than an entry node.
    """
    length = F.length("w")
    tries = F.explode(F.array(length, length - 1))
    start = sides.select("back", tries.alias("size"), "w", "n").withColumn("node", F.substring(F.col("w"), F.lit(1), _half(F.col("size"))))
    key = ["back", "size", "node"]
    hot = heavy_keys(start, entries, key, HOT) is not None
    rows = split_join(start, entries, key, ["w"], ["then"], HOT) if hot else start.join(entries, key)
    rows = rows.filter(F.col("only").isNull() | (F.levenshtein("w", "only.w", 1) == 1))
    return cut_lineage(rows.select("back", "size", "w", "n", F.length("node").alias("pos"), "node", F.lit(0).alias("edits"), "only")), hot


def _descend(states: DataFrame, edges: DataFrame, hot: bool) -> DataFrame:
    """The walks one level deeper, with ``only`` where a leaf's word is a neighbour; those that cannot go on are gone.

    Without an edit a walk goes on along its letter; in the trie of its own length it replaces the letter by a greater
    one (the smaller word of a pair finds the other); in the trie of shorter words it leaves out the last letter of a
    row of equal ones. With its edit spent it has only its next letter. So an edge is taken in one way at most.
    """
    key = ["back", "size", "node"]
    joined = split_join(states, edges, key, ["w"], ["kids"], HOT) if hot else states.join(edges, key)
    rows = joined.select(*STATE, _letter("w", F.col("pos")).alias("own"), _letter("w", F.col("pos") + 1).alias("after"), F.explode("kids").alias("kid"))
    c, same, fresh = F.col("kid.c"), F.length("w") == F.col("size"), F.col("edits") == 0
    along = c == F.col("own")
    replace = fresh & same & (c > F.col("own"))
    leave_out = fresh & ~same & (c == F.col("after"))  # not the own letter, so it is the last of its row
    rows = rows.filter(along | replace | leave_out)
    rows = rows.select(
        "back", "size", "w", "n",
        (F.col("pos") + F.when(along | replace, 1).otherwise(2)).alias("pos"),
        F.concat("node", "kid.c").alias("node"),
        F.when(along, F.col("edits")).otherwise(1).alias("edits"),
        "kid",
    )
    leaf, spent = F.col("kid.only").isNotNull(), F.col("edits") == 1
    # with the edit spent the rest must agree; on the way, the next letter must be among those that follow
    rest = F.expr("substring(w, pos + 1) = substring(kid.only.w, length(node) + 1)")
    ends = F.when(spent, rest).otherwise((F.length("w") > F.col("size")) & (F.levenshtein("w", "kid.only.w", 1) == 1))
    on = ~spent | F.col("kid.then").contains(_letter("w", F.col("pos")))
    return rows.filter(F.when(leaf, ends).otherwise(on)).select(*STATE, F.col("kid.only").alias("only"))


def _short_pairs(words: DataFrame) -> DataFrame:
    """(a, n, b, m): each pair of neighbours among words of at most ``DEPTH`` letters, once."""
    sides = cut_lineage(_read_both_ways(words))
    entries, edges = _edges(sides)
    rows, hot = _enter(sides, entries)
    pairs, level = [], 0
    while True:  # at most DEPTH / 2 + 1 levels
        pairs.append(rows.filter("only IS NOT NULL").selectExpr(*PAIR))
        states = rows.filter("only IS NULL").select(*STATE)
        if states.limit(1).count() == 0:
            break
        rows = cut_lineage(_descend(states, edges.filter(F.col("level") == level), hot))
        level += 1
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    # what is found backwards but begins alike has been found forwards
    half = _half(F.col("size"))
    alike = F.substring(F.reverse("w"), F.lit(1), half) == F.substring(F.reverse("v"), F.lit(1), half)
    out = out.filter(~F.col("back") | ~alike)
    word = lambda x: F.when(F.col("back"), F.reverse(x)).otherwise(F.col(x))
    return out.select(word("w").alias("a"), "n", word("v").alias("b"), "m")


_LETTER = random_words(512, 41), random_words(512, 43)
_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _left_out(word: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Two 64-bit hashes of the word, and of the word without each of its letters."""
    cp = np.frombuffer(word.encode("utf-32-le"), np.uint32) & 511
    whole, each = [], []
    for table, step in zip(_LETTER, _STEP, strict=True):
        x = table[cp]
        up = np.full(len(x) + 1, step, np.uint64)
        up[0] = 1
        up = np.multiply.accumulate(up)
        before = np.concatenate([[np.uint64(0)], np.cumsum(x * up[:-1])])
        after = (before[-1] - before[1:]) * np.uint64(pow(int(step), -1, 1 << 64))  # moved up by one place
        each.append(mix(before[:-1] + after).view(np.int64))
        whole.append(mix(before[-1:]).view(np.int64))
    return whole, each


def _long_pairs(words: DataFrame) -> DataFrame:
    """The pairs in which a word is longer than ``DEPTH``: equal when one letter is left out of one or of both.

    A word gives a row for each of its letters, so the work grows with the letters. Words that agree without the letter
    in one place differ in that letter alone, so no key holds more of them than there are letters.
    """
    rows = words.filter(F.length("word") >= DEPTH).select(F.sha2("word", 256).alias("id"), "word", "n")
    rows = cut_lineage(rows)
    spec = "id string, size int, place int, h1 long, h2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w in zip(b.column("id").to_pylist(), b.column("word").to_pylist(), strict=True):
                whole, each = _left_out(w)
                cp = np.array(list(w))
                last = np.append(cp[1:] != cp[:-1], True)  # a row of equal letters loses its last one
                h1, h2 = np.concatenate([whole[0], each[0]]), np.concatenate([whole[1], each[1]])
                place = np.append(-1, np.where(last, np.arange(len(w)), -2 - np.arange(len(w))))
                for a in range(0, len(place), 1 << 16):
                    z = slice(a, a + (1 << 16))
                    k = len(place[z])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * k), pa.array(np.full(k, len(w), np.int32)), pa.array(place[z].astype(np.int32)), pa.array(h1[z]), pa.array(h2[z])],
                        ["id", "size", "place", "h1", "h2"],
                    )

    marks = cut_lineage(rows.select("id", "word").mapInArrow(run, spec))
    # place -1: the whole word; below: a letter in the middle of a row of equal ones, which only replacing needs
    whole = marks.filter("place = -1").select(F.col("id").alias("i"), "size", "h1", "h2")
    gaps = marks.filter("place <> -1").withColumn("spot", F.when(F.col("place") < -1, -2 - F.col("place")).otherwise(F.col("place")))
    shorter = gaps.filter("place >= 0").select("id", (F.col("size") - 1).alias("size"), "h1", "h2").join(whole, ["size", "h1", "h2"]).select("id", "i")
    key = ["size", "spot", "h1", "h2"]
    replaced = gaps.select("id", *key).join(gaps.select(F.col("id").alias("i"), *key), key).filter("id < i").select("id", "i")
    near = shorter.unionByName(replaced)
    a = rows.select("id", F.col("word").alias("a"), "n")
    b = rows.select(F.col("id").alias("i"), F.col("word").alias("b"), F.col("n").alias("m"))
    out = near.join(a, "id").join(b, "i").select("a", "n", "b", "m")
    return out.filter((F.greatest(F.length("a"), F.length("b")) > DEPTH) & (F.levenshtein("a", "b", 1) == 1))


def neighbours(words: DataFrame) -> DataFrame:
    """(a, n, b, m): each two words one inserted, deleted or replaced letter apart, once, with their counts."""
    short = _short_pairs(words.filter(F.length("word") <= DEPTH))
    if words.filter(F.length("word") > DEPTH).limit(1).count() == 0:
        return short
    return short.unionByName(_long_pairs(words))


def _roots(forms: DataFrame) -> DataFrame:
    """(form, root) for every form in (word, form): links are followed by doubling, as each step is FACTOR times up."""
    up = forms.select(F.col("word").alias("form"), F.col("form").alias("root"))
    used = forms.select("form").distinct()
    now = cut_lineage(used.join(up, "form", "left").select("form", F.coalesce("root", "form").alias("root")))
    while True:
        far = now.select(F.col("form").alias("root"), F.col("root").alias("far"))
        after = cut_lineage(split_join(now, far, ["root"], ["form"], ["far"], HOT))
        if after.filter("root <> far").limit(1).count() == 0:
            return now
        now = after.select("form", F.col("far").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of a table with doc_id and text.

    The form of a word is its neighbour of the largest count, the smallest in code-point order among equals, if that
    count is at least ``FACTOR`` times its own; root is the end of the chain of forms. An empty table has no words.
    """
    words = cut_lineage(vocabulary(docs.select("doc_id", "text")))
    pairs = neighbours(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("m").alias("n"), F.col("a").alias("b"), F.col("n").alias("m")))
    per = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    rows = words.join(per, "word", "left")
    enough = -F.col("best.m") >= FACTOR * F.col("n")
    rows = cut_lineage(
        rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))
    )
    has = rows.filter("form IS NOT NULL")
    roots = _roots(has.select("word", "form"))
    found = split_join(has, roots, ["form"], ["word"], ["root"], HOT)
    alone = rows.filter("form IS NULL").withColumn("root", F.col("word"))
    return found.unionByName(alone).select("word", "form", "root", "n", "n_near", "form_n")
