"""Licence scans: TF-IDF cosine of licence sentences to templates, then inheritance along the path.

A sentence with a licence cue is a section; sections in one form are classified once and counted as often
as they occur. A section's licence is the template with the largest TF-IDF cosine of ``MIN_COSINE`` or more; the
inverse document frequency covers all sections of the table and the templates. A file's own licence is its best
section. A licence file (by name, or with at least half of its words in licence sections) gives its licence to
its directory; files without one of their own take that of the nearest directory above.

Results in odd cases: null and empty texts have no section and may inherit; ties go to the licence that
sorts first; a null path has no directory; repeated rows give repeated rows; an empty table gives an empty
one; other columns are kept, those called like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.session import cut_lineage

MIN_COSINE = 0.5
CUE = r"licen[sc]|copyright|public domain|spdx"
SENTENCE = r"\n|[.!?]+\s+"
NAME = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
RESULTS = ("licence", "cosine", "origin", "from_dir")
# fixed values: the notices that the licences ask for, shortened to their first sentence
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0, Creative Commons Attribution NonCommercial 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return df.select(key, F.explode(words).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias("tf"))


def classify(forms: DataFrame) -> DataFrame:
    """(form, licence, cosine) of distinct sections ``form`` that occur ``n`` times; only those that match."""
    spark = forms.sparkSession
    templates = spark.createDataFrame(list(TEMPLATES), "licence string, notice string")
    own, given = _terms(forms, "form", "form"), _terms(templates, "licence", "notice")
    df = own.join(forms, "form").groupBy("t").agg(F.sum("n").alias("n"))
    df = df.union(given.groupBy("t").agg(F.count(F.lit(1)))).groupBy("t").agg(F.sum("n").alias("df"))
    total = forms.agg(F.sum("n")).first()[0] or 0
    n = float(total + len(TEMPLATES))
    idf = df.select("t", (F.log(F.lit(1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    a = own.join(idf, "t").withColumn("a", F.col("tf") * F.col("idf"))
    b = given.join(idf, "t").withColumn("b", F.col("tf") * F.col("idf")).select("licence", "t", "b")  # a few terms of each template
    na = a.groupBy("form").agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"))
    nb = b.groupBy("licence").agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    dots = a.join(F.broadcast(b), "t").groupBy("form", "licence").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("m")
    scored = dots.join(na, "form").join(F.broadcast(nb), "licence").withColumn("cosine", cosine)
    return scored.filter(F.col("cosine") >= MIN_COSINE).groupBy("form").agg(best).select("form", "m.licence", (-F.col("m.c")).alias("cosine"))


def scan(files: DataFrame) -> DataFrame:
    """The files (with ``path`` and ``text``) with licence, cosine, origin (own or inherited) and from_dir; text is dropped."""
    keep = [c for c in files.columns if c not in RESULTS and c != "text"]
    key = "_f"
    while key in {c.lower() for c in keep}:
        key += "_"
    files = files.select(*keep, "text", F.xxhash64("path", "text").alias(key))
    rows = files.select("path", "text", F.col(key).alias("_f"))
    cued = rows.filter(F.lower("text").rlike(CUE)).select("path", "text", "_f").distinct()
    each = cued.select("path", "_f", F.size(F.split(F.trim("text"), r"\s+")).alias("words"), F.explode(F.split("text", SENTENCE)).alias("s"))
    sections = cut_lineage(each.filter(F.lower("s").rlike(CUE)).select("path", "_f", "words", F.lower(F.trim("s")).alias("form")))
    forms = cut_lineage(sections.groupBy("form").agg(F.count(F.lit(1)).alias("n")))
    found = sections.join(cut_lineage(classify(forms)), "form")
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("m")
    own = found.groupBy("path", "_f").agg(best, F.max("words").alias("words"), F.sum(F.size(F.split("form", r"\s+"))).alias("said"))
    own = cut_lineage(own.select("path", "_f", "m.licence", (-F.col("m.c")).alias("cosine"), (F.col("said") * 2 >= F.col("words")).alias("whole")))
    up = F.regexp_replace("path", "/?[^/]*$", "")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(NAME)
    dirs = own.filter(F.col("path").isNotNull() & (F.col("whole") | named)).select(up.alias("dir"), "licence", "cosine")
    dirs = cut_lineage(dirs.groupBy("dir").agg(best).select("dir", "m.licence", (-F.col("m.c")).alias("cosine")))

    # each file meets its directories, at most as many as its path has parts; the deepest one with a licence wins
    parts = F.split(up, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    open_files = rows.select("path", "_f").filter("path is not null").join(own.select("_f"), "_f", "left_anti").distinct()
    near = open_files.select("_f", F.explode(F.array_distinct(above)).alias("dir")).join(dirs, "dir")
    heir = near.groupBy("_f").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "licence", "cosine")).alias("m"))
    heir = heir.select("_f", "m.licence", "m.cosine", F.lit("inherited").alias("origin"), F.col("m.dir").alias("from_dir"))
    mine = own.select("_f", "licence", "cosine", F.lit("own").alias("origin"), F.lit(None).cast("string").alias("from_dir"))
    found = cut_lineage(mine.unionByName(heir)).withColumnRenamed("_f", key)
    return files.drop("text").join(found, key, "left").drop(key)
