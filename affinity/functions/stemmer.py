"""Porter stemmer (Porter 1980), applied to distinct terms only.

The rules are data: each step lists its suffixes with their replacement and the condition on the
measure of the stem.
"""

from __future__ import annotations

import re

# Suffix -> replacement of steps 2, 3 and 4 as published.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()

_VOWEL_RUNS = re.compile(r"v+c+")


def _shape(s: str) -> str:
    """'c' / 'v' per letter; y is a vowel after a consonant."""
    out = ""
    for ch in s:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(_VOWEL_RUNS.findall(_shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"


def _cvc(s: str) -> bool:
    return _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"


def _longest(word: str, suffixes: object) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            return w[: -len(suffix)] + put
    return w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
    if cut is None:
        return w
    w = w[: -len(cut)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _double_consonant(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _cvc(w) else w


def _replace(w: str, table: dict[str, str]) -> str:
    s = _longest(w, table)
    if s and _measure(w[: -len(s)]) > 0:
        return w[: -len(s)] + table[s]
    return w


def _strip4(w: str) -> str:
    s = _longest(w, STEP4)
    if s is None or _measure(w[: -len(s)]) <= 1:
        return w
    stem = w[: -len(s)]
    return w if s == "ion" and stem[-1:] not in ("s", "t") else stem


def _final(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    return _final(_strip4(_replace(_replace(w, STEP2), STEP3)))
