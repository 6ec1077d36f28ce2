"""Column -> Column helpers, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a word is, and which characters wrap and quote a list kept as text.
WORD = r"[\p{L}\p{N}_]+"
LIST_BRACKETS = r"[\[\]]"
LIST_QUOTES = "'"


def strip_chars(c: Column, pattern: str = LIST_BRACKETS) -> Column:
    return F.regexp_replace(c, pattern, "")


def split_nth(c: Column, n: int, sep: str = ",") -> Column:
    """n-th (0-based) field; null when there are fewer."""
    return F.get(F.split(c, sep), n)


def list_elements(c: Column) -> Column:
    """``"['A', 'B']"`` -> distinct, trimmed, unquoted, non-empty elements."""
    bare = F.regexp_replace(F.regexp_replace(c, LIST_BRACKETS, ""), LIST_QUOTES, "")
    parts = F.transform(F.split(bare, ","), lambda s: F.trim(s))
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


def flag_not_null(c: Column) -> Column:
    return c.isNotNull().cast("int")


def words(c: Column) -> Column:
    """Lower-cased words of a text."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def vector_from_text(c: Column) -> Column:
    """``"[0.1, 0.2]"`` or ``"0.1 0.2"`` -> array<double>; null when it is not a list of numbers."""
    inner = F.regexp_replace(F.trim(F.regexp_replace(c, LIST_BRACKETS, "")), r"[,\s]+", ",")
    return F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equally long arrays."""
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_l2(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def nullif0(c: Column) -> Column:
    """Null instead of zero, for denominators (ANSI mode raises on division by zero)."""
    return F.when(c != 0, c)


def hash_number(*cols: Column) -> Column:
    """A 32-bit number from md5, equal in any engine; parts are joined with '|'."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
