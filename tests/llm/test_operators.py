"""The ten operators against brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, duck

import __spark_entry__ as entry
from affinity.llm import bpe, components, decontaminate, editprint, fmindex, licences, neardup, pii, pseudolik, quality, substrings, textops, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeats, and columns called like the operators' own."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
        (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
        (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
        (3, ""), (4, None), (5, "   \n\t "), (6, "word"), (7, long), (8, long + " end"), (None, "one two three four five six"),
        (None, None), (9, "é 漢字 'tis Ünï 😀 it's"), (10, "a " * 3000),
    ]
    full = [(i, t, "en", "s", len(t or ""), 0.5, 1, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, part int, ids string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0)))


def groups(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 80 * len(sets[x] | sets[y]):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


# 1 surrogates


def test_surrogates_keep_type_format_and_coreference():
    text = "Ann@mail.example.com, +1 (974) 555-3436, 97.51.17.173, 4111 1111 1111 1111; Ms Anna Bell met Mr Bell. Госпожа Иванова. DE89 3704 0044 0532 0130 00"
    new, n = pii.replace(text, {})
    assert n == 9 and pii.replace(text, {}) == (new, n) and pii.replace(text, {}, b"other key")[0] != new
    for gone in ("Ann@", "555-3436", "97.51.17.173", "4111 1111", "Bell", "Иванова", "DE89"):
        assert gone not in new
    kinds = [(k.split(":")[0]) for *_, k, _ in pii.detect(new)]
    assert kinds == [k.split(":")[0] for *_, k, _ in pii.detect(text)]
    names = re.search(r"Ms (\w+) (\w+) met Mr (\w+)\. Госпожа ([А-Яа-я]+)\.", new)
    assert names and names[2] == names[3] and names[1] in pii.GIVEN["latin", "f"]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and re.search(r"\d{4} \d{4} \d{4} \d{4}", new)


def test_surrogates_leave_other_numbers_alone():
    text = "Order 9807915762804491, version 1.2.3, 12:30, 2024-01-02, 300.1.2.3, Sirens and Maria sang."
    assert pii.replace(text, {}) == (text, 0)


def test_surrogates_are_distinct_over_the_corpus(spark):
    rows = [(i, f"Mr {a.capitalize()} wrote to {a}{i}@x.org") for i, a in enumerate(["ab", "cd", "ef"] * 5)]
    rows += [(100 + i, f"{a} {n.capitalize()} left") for i, (a, n) in enumerate((a, n) for a in pii.GIVEN["latin", "m"] for n in ("alan", "boro"))]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), count="n").collect()}
    given, last = defaultdict(set), defaultdict(set)
    for i, t in rows[15:]:
        a, b, _ = t.split()
        x, y, _ = out[i].text.split()
        given[a].add(x)
        last[b].add(y)
    assert all(len(v) == 1 for v in [*given.values(), *last.values()])
    firsts = [next(iter(v)) for v in given.values()]
    assert len(set(firsts)) == len(given) and not set(firsts) & set(given)
    mails = {out[i].text.split()[-1] for i in range(15)}
    assert len(mails) == 15 and {m.split("@")[1] for m in mails} != {"x.org"} and len({m.split("@")[1] for m in mails}) == 1


# 2 decontamination


def test_decontamination_equals_brute_force(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.first()
    w = item.text.split()
    near = w.copy()
    near[1] = "changed"
    extra = [(90_001, "before it " + item.text + " after it"), (90_002, "x y z " + " ".join(near) + " z"), (90_003, " ".join(w[: len(w) // 2]))]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(both, bench).collect()}
    items = {r.item_id: r.text.lower().split() for r in bench.collect()}
    count = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
    df = Counter(s for x in items.values() for s in count(x))
    weight = lambda s: np.log1p(len(items) / df[s]) if s in df else np.log1p(len(items))
    want = set()
    for i, t in [*texts.items(), *extra]:
        x = t.lower().split()
        own = count(x)
        for k, y in items.items():
            target = count(y)
            if not set(own) & set(target):
                continue
            for a in range(max(1, len(x) - 4)):
                window = count(x[a : a + len(y)])
                less, more = window & target, window | target
                if sum(weight(s) * c for s, c in less.items()) >= 0.8 * sum(weight(s) * c for s, c in more.items()):
                    want.add((i, k))
    assert set(got) == want and (90_001, item.item_id) in want
    hit = got[90_001, item.item_id]
    assert (hit.start_word, hit.n_words, hit.hamming, hit.similarity) == (2, len(w), 0, 1.0)
    assert {r.doc_id for r in decontaminate.decontaminate(both, bench).collect()} == {i for i in [*texts, *(e[0] for e in extra)] if i not in {d for d, _ in want}}


def test_decontamination_plan_has_no_python(spark, docs):
    plan = decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 3 and 9, the classifiers


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n1 = int(y.sum())
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("op", "label", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.8)])
def test_classifiers_on_held_out_rows(spark, op, label, least):
    own, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    own = own.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = op.score(own, op.fit(own, labels)).join(labels, "doc_id").toPandas()
    assert got["score"].between(0, 1).all() and set(got["predicted"]) <= {0, 1}
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    out = got[got["held_out"]]
    assert auc(out[label].to_numpy(), out["score"].to_numpy()) >= least
    assert (out["predicted"] == out[label]).mean() >= 0.9


@pytest.mark.parametrize(("op", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_without_labels(spark, odd, none, op, label):
    labels = spark.createDataFrame([(1, None)], f"doc_id long, {label} int")
    got = op.score(odd, op.fit(odd, labels)).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (None, 0)], f"doc_id long, {label} int")
    assert op.score(none, op.fit(none, one)).count() == 0


# 4 near duplicates


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, docs, texts, k):
    base = max(texts.values(), key=len).split()[:60]
    more = []
    for i in range(300):  # a large group whose members link only through some of each other
        w = base.copy()
        for j in range(i % 4):
            w[(i * 7 + j * 13) % 60] = f"edit{i}_{j}"
        more.append((10_000 + i, " ".join(w)))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    sets = {i: shingles(t, k) for i, t in [*texts.items(), *more]}
    want = groups(sets)
    got = {r.doc_id: r for r in neardup.near_duplicates(both, k).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets.items())
    assert sorted(r.doc_id for r in neardup.deduplicate(both, k).collect()) == sorted({*want.values()})


def test_links_and_copies_grow_with_the_group(spark):
    """Twice the near copies of one text: twice the links and copies, not four times."""
    base, size = [f"word{j}" for j in range(120)], []
    for n in (150, 300):
        rows = []
        for i in range(n):
            w = base.copy()
            for j in range(1 + i % 3):
                w[(i * 7 + j * 31) % 120] = f"edit{i}_{j}"
            rows.append((i, " ".join(w)))
        table = spark.createDataFrame(rows, "doc_id long, text string")
        sigs = neardup.fingerprints(table, 4).selectExpr("doc_id c", "n_shingles n", "bands")
        links = neardup.confirmed_links(table, sigs, 4, 80).collect()
        sets = {i: shingles(t, 4) for i, t in rows}
        assert all(100 * len(sets[r.a] & sets[r.b]) >= 80 * len(sets[r.a] | sets[r.b]) for r in links)
        assert n - len(set(groups(sets).values())) <= len(links) <= 2 * n
        size.append(len(links))
    assert size[1] <= 2.3 * size[0]


def test_posterior_bounds():
    least = neardup.least_matches(80)
    assert len(least) == neardup.HASHES // neardup.BATCH and list(least) == sorted(least) and least[-1] < 0.8 * neardup.HASHES


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 100), (5, 5)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 200: 100}


# 5 fingerprints


def test_edit_fingerprints(docs, texts):
    got = {r.doc_id: r for r in editprint.edited(docs).collect()}
    ids = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, f = texts[i], texts[nxt]
        cut = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + f[:cut]).encode()).hexdigest()
        assert got[i].n_chars == len(t)
        assert t == f or len(t) < 20 or got[i].near_edited > got[i].near_next
    plain = {r.doc_id: r.fingerprint for r in editprint.fingerprint(docs).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(plain[i])
    assert all(len(v) == 1 for v in by_text.values())


def test_walk_equals_its_definition():
    data, offs = textops.utf8(pa.array(["abcaé漢", "", "zzz", "b"]))
    points, at = editprint.characters(data, offs)
    leave = editprint._leave().reshape(editprint.CLASSES, editprint.PERIOD)
    want = []
    for a, z in zip(at[:-1], at[1:], strict=True):
        t = 0
        for p in points[a:z]:
            c = int((editprint._CLASS[p & 0xFFF] >> np.uint64(40)) + (p >> np.uint32(12))) % editprint.CLASSES
            t += int(leave[c, t % editprint.PERIOD])
            want.append(t)
    assert editprint.walk(points, at).tolist() == want


def test_near_fingerprints(spark, texts):
    t = max(texts.values(), key=len)[:3000]
    rows = [(1, t), (2, t), (3, t[:2950] + "changed at the end"), (4, t[::-1]), (5, None)]
    got = dict(editprint.near(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


# 6 byte-level BPE


def test_bpe_equals_the_library(docs, texts, odd):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*texts.values(), "", None, "'s's're'r 'x''s", "  a \n\n b\t", "x" * 900 + "1" * 300, "　é 漢字!?", *(r.text for r in odd.collect())]
    data, offs = textops.utf8(pa.array(rows))
    e = bpe.Encoder(bpe.vocabulary())
    ids, at = e.encode(data, offs)
    for i, t in enumerate(rows):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t or "")
    assert e.v.decode(ids)[0].tobytes() == data.tobytes()
    for r in bpe.digests(docs).collect():
        own = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_tables(odd):
    got = bpe.decode(bpe.encode(odd)).collect()
    assert len(got) == odd.count() and all(bytes(r.decoded).decode() == (r.text or "") for r in got)
    for r in got:
        raw = (r.text or "").encode()
        assert r.starts == sorted(r.starts) and all(0 <= s < len(raw) for s in r.starts)


# 7 licences


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "print(1)"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/y.py", "code"), ("a/z.py", "# Licensed under the Apache License, Version 2.0.\n" + "code more words here " * 9), ("q/w.py", None), ("v.py", ""),
    ]
    got = {r.path: (r.licence, r.origin, r.from_dir) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own", None), "a/b/x.py": ("GPL-3.0", "inherited", "a/b"), "a/b/COPYING": ("GPL-3.0", "own", None),
        "a/b/c/y.py": ("GPL-3.0", "inherited", "a/b"), "a/z.py": ("Apache-2.0", "own", None), "q/w.py": (None, None, None), "v.py": (None, None, None),
    }


# 8 pseudo-likelihood


def test_pseudo_likelihood_learns(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = pseudolik.fit(own)
    mean = lambda m: (lambda r: r.log_likelihood.sum() / r.n_tokens.sum())(pseudolik.score(own, (*fitted[:2], m)).toPandas())
    assert mean(fitted[2]) > mean(pseudolik.Network.start().pack()) + 1


def test_pseudo_likelihood_is_a_distribution():
    net = pseudolik.Network.start(3)
    ctx = np.array([[5, 9, 70, pseudolik.PAD]])
    every = np.arange(pseudolik.PAD)
    assert abs(np.exp(pseudolik.log_prob(net, np.repeat(ctx, len(every), 0), every)).sum() - 1) < 1e-4


# 10 substrings


def removed(texts):
    first, out = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        cover = [False] * len(w)
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                cover[j : j + 13] = [True] * 13
        out[i] = (len(w), sum(cover), " ".join(x for x, c in zip(w, cover, strict=True) if not c))
    return out


def test_repeats_equal_brute_force(spark, docs, texts):
    passage = " ".join(f"p{i}" for i in range(40))
    more = [(20_000 + i, f"own{i} {passage} end{i}") for i in range(200)] + [(30_000, "la " * 60), (30_001, "la " * 14)]
    more += [(30_002 + i, " ".join(f"p{j}" for j in range(i, i + 13))) for i in range(5)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = removed(texts | dict(more))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(both).collect()} == want


def test_fm_index_finds_all():
    rng = np.random.Generator(np.random.PCG64(1))
    text = rng.integers(1, 4, 400)
    text[::20] = 0
    text[-1] = 0
    index = fmindex.FMIndex(text)
    assert sorted(index.sa.tolist()) == list(range(400))
    starts = np.array([i for i in range(396) if 0 not in text[i : i + 4]])
    live, lo, hi = fmindex.matches(index, text, starts, 4)
    for i, a, z in zip(live.tolist(), lo.tolist(), hi.tolist(), strict=True):
        assert sorted(index.sa[a:z].tolist()) == [j for j in starts if (text[j : j + 4] == text[i : i + 4]).all()]
    assert set(starts) - set(live.tolist()) == {i for i in starts if sum((text[j : j + 4] == text[i : i + 4]).all() for j in starts) == 1}


# odd rows, for every operator


def test_odd_rows(spark, odd):
    n = odd.count()
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "short")], "item_id long, text string")
    hits = decontaminate.contaminated(odd, bench).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(1, 1), (2, 1)}
    assert decontaminate.decontaminate(odd, bench).count() == n - 3
    near = neardup.near_duplicates(odd, 5).collect()
    assert len(near) == n and {(r.doc_id, r.component_id) for r in near} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7), (9, 9), (10, 10), (None, None)}
    kept = neardup.deduplicate(odd, 5)
    assert kept.columns == odd.columns and kept.count() == n - 3
    cut = {r.doc_id: r.n_removed for r in substrings.remove_repeats(odd).collect()}
    assert cut == {1: 0, 2: 14, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 40_000, 9: 0, 10: 0, None: 0}
    prints = editprint.edited(odd).collect()
    assert len(prints) == n and {r.n_chars for r in prints if r.doc_id in (3, 4)} == {0}
    assert len(bpe.digests(odd).collect()) == n
    scored = pseudolik.score(odd, pseudolik.fit(odd)).collect()
    assert len(scored) == n and {r.log_likelihood for r in scored if r.doc_id in (3, 4, 5)} == {0.0}
    hidden = pii.pseudonymise(odd)
    assert hidden.columns == odd.columns and sorted(map(str, hidden.collect())) == sorted(map(str, odd.collect()))
    assert licences.scan(odd.withColumnRenamed("source", "path")).count() == n


def test_columns_called_like_the_helpers_own(spark):
    """Every helper column the surrogates and licence scans add may be there already, with clashes drawn again."""
    rows = [(i, f"Dr Ada Ray{chr(97 + i // 26)}{chr(97 + i % 26)} called", f"d/{i}", i, i, i) for i in range(600)]
    rows += [(600, "MIT License: Permission is hereby granted, free of charge", "d/LICENSE", 1, 2, 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, path string, text_id int, later int, _f int")
    hidden = pii.pseudonymise(table)
    assert hidden.columns == table.columns
    got = {r.doc_id: r for r in hidden.collect()}
    assert len({r.text for r in got.values()}) == 601 and all(got[i].text_id == got[i].later == got[i]._f == i for i in range(600))
    scan = licences.scan(table)
    assert scan.count() == 601 and {r._f for r in scan.filter("doc_id < 600").collect()} == set(range(600))


def test_written_case_does_not_break_coreference():
    new, n = pii.replace("Mr Bell met Mr BELL and Mrs Stone", {})
    words = new.split()
    assert n == 3 and words[1].upper() == words[4] and words[1] != "Bell" and words[7] != words[1]


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(none, bench).count() == 0
    for got in (
        neardup.near_duplicates(none), neardup.deduplicate(none), substrings.remove_repeats(none), editprint.edited(none), editprint.near(none), bpe.digests(none),
        pseudolik.score(none, pseudolik.fit(none)), pii.pseudonymise(none), licences.scan(none.withColumnRenamed("source", "path")),
    ):
        assert got.count() == 0


# registered queries and the pipeline

LLM = sorted(q for q in entry.queries() if re.match(r"op\d+_|pipeline$", q))


def test_all_are_registered():
    assert sorted({int(q[2:].split("_")[0]) for q in LLM if q != "pipeline"}) == list(range(1, 14)) and "pipeline" in LLM


@pytest.mark.parametrize("name", [q for q in LLM if q in entry.oracle_sql()])
def test_twins(spark, name):
    assert compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_pipeline_stages(spark, docs, texts):
    import corpus_pipeline as p

    from affinity.session import cut_lineage

    now = docs
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = cut_lineage(stage(spark, now, SF))
        after = {r.doc_id: r.text for r in now.collect()}
        assert now.columns == docs.columns and set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == set(groups({i: shingles(t, 5) for i, t in before.items()}).values())
        elif name == "pii":
            later = {i: t for i, t in before.items() if t != after[i]}
            assert set(after) == set(before) and {i for i, t in before.items() if pii.detect(t)} == set(later)
        else:
            assert all(after[i] == before[i] for i in after)
    last = p.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()}
    assert sorted(map(str, p.run(spark, SF).collect())) == sorted(map(str, last))
