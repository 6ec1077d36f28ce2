"""Secrets in texts: three plain patterns, and strings that a tokenizer finds as hard as noise.

A byte-pair vocabulary is learnt from text people write, so words and names in code take few tokens, while
a random string falls apart into pieces of one or two characters. A run of key characters is therefore
reported when its characters per token stay at or below a ratio. Digests and identifiers are as
inefficient as keys without being secret; they are recognised by form, or by a given list, and left out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.textops import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_CHARS = 16
MAX_RATIO = 2.0  # characters per token; random base64 of 16 characters and more has a median of 1.4 to 1.6
WORD_RATIO = 1.6  # for runs of letters in one case, which may be plain words of any language
PIECE = 4096  # a longer run is tokenised piece by piece, and the counts are added

KINDS = ("assign", "access", "hex", "random")  # the order among spans that start together

# The plain patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ASSIGN_CHARS = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters in all
HEX = re.compile(r"[0-9a-f]{32,}")

CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}")
PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Forms of digests (hex digits of MD5, SHA-1, SHA-2; base64 after an algorithm's name) and identifiers.
DIGEST = re.compile(r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|(?:sha1|sha256|sha384|sha512|md5)[-_=].*)")
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|[0-9+/_=-]+(?:T[0-9+-]+Z?)?"  # numbers, dates, rules
    r"|(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)?(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)?)+"  # words and numbers with joints
)


@lru_cache(2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(run: str, vocabulary: str = VOCABULARY) -> int:
    """Number of tokens of a run of characters, by a rank file of the installed package or any path."""
    e = _encoding(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    return sum(len(e.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def _repeats(run: str) -> bool:
    """A few characters over and over: rules and padding, not keys."""
    return len(set(run[:PIECE])) <= 4


def is_random(run: str, known: Collection[str] = frozenset(), count: Callable[[str], int] = tokens) -> bool:
    if run in known or _repeats(run) or DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    return len(run) <= (WORD_RATIO if PLAIN.fullmatch(run) else MAX_RATIO) * count(run)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain patterns, leftmost and without overlaps in each kind."""
    out = []
    low = text.lower()  # the words of the first pattern are sought only where one can be
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spans(text: str, known: Collection[str] = frozenset(), count: Callable[[str], int] = tokens) -> list[tuple[int, int, int]]:
    """The plain spans and those of random runs that none of them overlaps, by start and kind."""
    base = base_spans(text)
    out, i, reach = list(base), 0, 0
    for m in CANDIDATE.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach, i = max(reach, base[i][2]), i + 1
        if reach <= m.start() and is_random(m.group(), known, count):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def scan(docs: DataFrame, text: str = "text", out: str = "secrets", known: Collection[str] = frozenset(), vocabulary: str = VOCABULARY) -> DataFrame:
    """The table with ``out``: its secrets as an array of (kind, start, end, value), by start and kind.

    Offsets count code points, the end is exclusive. ``known`` lists strings that are no secrets (digests of
    published files, say); it travels with the job and should stay short. A null or empty text has no secrets; rows
    that repeat are each scanned; all other columns come through, a column called ``out`` is replaced.
    """
    columns = [c for c in docs.columns if c != out]
    kind = "array<struct<kind:string,start:int,end:int,value:string>>"
    schema = docs.select(*columns, F.lit(None).cast(kind).alias(out)).schema
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    known = frozenset(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(run: str) -> int:
            return tokens(run, vocabulary)

        for b in slices(batches, text):
            found = []
            for t in b.column(text).to_pylist():
                at = spans(t, known, count) if t else []
                found.append([{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e]} for s, k, e in at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, item)], [*b.schema.names, out])

    return docs.select(*columns).mapInArrow(run, schema)


def rendered(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of a table with doc_id and text."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *map(_number, KINDS), F.sha2(rendered(base), 256).alias("base_sha256"), rendered(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """The table with every secret in ``text`` replaced by ``mark``; overlapping secrets give way to one mark."""
    held = "__secrets"
    # each span's end is the furthest reached so far, so a span inside another one adds nothing
    step = F.aggregate(
        F.col(held),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                F.concat(
                    a["done"],
                    F.when(s["start"] >= a["at"], F.concat(F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.lit("")),
                ).alias("done"),
                s["end"].alias("at"),
            )
        ),
    )
    rows = scan(docs, text, held, **options).withColumn("__step", step)
    rest = F.concat(F.col("__step.done"), F.expr(f"substring(`{text}`, __step.at + 1)"))
    return rows.withColumn(text, F.when(F.col(text).isNotNull(), rest)).select(*docs.columns)
