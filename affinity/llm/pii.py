"""PII surrogates: keyed, type-consistent replacements of detected entities.

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment cards (Luhn-valid), US social security
numbers, IBANs (valid check digits), quoted credentials, and personal names after a title or a known given
name. The surrogate of an entity is drawn from a keyed hash of its type and normal form, so that one
entity has one surrogate in the whole corpus (coreference). Surrogates keep punctuation, grouping, letter
case, country code, card issuer digit and valid check digits; a given name keeps its gender and script, a
surname its script, and both are replaced part by part, so "Anna Bell" and "Ms Bell" stay one person.

Distinctness is checked over the corpus: all distinct entities are grouped by surrogate; where two share
one, or one equals a real entity, all but the first draw again with the next attempt number, until no
clash is left. Only entities with a later attempt travel back to their texts.

Results in odd cases: null texts stay null, empty ones empty; repeated rows get equal results; a null
doc_id is treated like any other; other columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.textops import slices
from affinity.session import cut_lineage

KEY = b"public example key"  # a deployment passes its own
ROUNDS = 50

# fixed values: common given names by script and gender, and titles that tell the gender
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sarah Alice Elena Sofia Marie Claire Lucia Carmen Ingrid Helga Mary Linda Susan Karen Emily".split(),
    ("latin", "m"): "John James Robert Michael David Thomas Peter Paul Daniel Martin Hans Karl Pierre Louis Carlos Miguel William Henry Frank Oscar".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Иван Алексей Сергей Дмитрий Андрей Николай Владимир Михаил".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Πέτρος".split(),
}
TITLES = {
    "m": "Mr Sir Herr Monsieur Señor Sr Don Господин".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Doña Госпожа".split(),
    "": "Dr Prof".split(),
}
SYLLABLES = {
    "latin": "ba ber dan del far gor hal kin lan mar nor pel ris sand tor val wes zim".split(),
    "cyrillic": "ба вер гор дан зим кол лан мар нов пет рог сан тор фед".split(),
    "greek": "βα γορ δαν καλ λαν μαρ νικ παπ ροδ σαν τορ".split(),
}
_GENDER = {n: g for (_, g), names in GIVEN.items() for n in names} | {t: g for g, ts in TITLES.items() for t in ts}
_WORD = r"[^\W\d_][^\W\d_'’]*(?:-[^\W\d_]+)?"
_NAMES = re.compile(
    r"(?<!\w)(?=[A-ZА-ЯΆ-Ω])(?:(?P<title>" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? (?P<a>" + _WORD + r")(?: (?P<b>" + _WORD + r"))?"
    r"|(?P<given>" + "|".join(n for ns in GIVEN.values() for n in ns) + r") (?P<last>" + _WORD + r"))(?!\w)"
)
_VALUES = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]*\w@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\w|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?|\d{1,4}[ .-]?)(?:\d{2,4}[ .-]?){1,3}\d{2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))"
    r"|(?:token|key|secret|password|passwd)\s*[=:]\s*[\"'](?P<secret>[A-Za-z0-9+/_-]{16,})[\"']"
)


_TRIGGER = re.compile("[0-9@=:]")  # no value is without one of these
_CUES = ahocorasick.Automaton()  # a text without a title or given name has no names
for _name in _GENDER:
    _CUES.add_word(_name, True)
_CUES.make_automaton()


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities of a text, in order and without overlaps."""
    found = []
    for m in _VALUES.finditer(text) if _TRIGGER.search(text) else ():
        kind = m.lastgroup
        a, z = m.span(kind)
        raw = text[a:z]
        if kind == "card":
            norm = re.sub(r"\D", "", raw)
            if _luhn(norm) or len(set(norm)) == 1:
                continue
        elif kind == "iban":
            norm = raw.replace(" ", "")
            if not 15 <= len(norm) <= 34 or _mod97(norm) != 1:
                continue
        elif kind == "phone":
            norm = re.sub(r"[^\d+]", "", raw)
            if len(norm) < 9:
                continue
        else:
            norm = raw.lower() if kind == "email" else raw
        found.append((a, z, kind, norm))
    for m in _NAMES.finditer(text) if next(_CUES.iter(text), None) else ():
        if m["given"]:
            gender, parts = _GENDER[m["given"]], [("given", "given"), ("last", "surname")]
        elif m["b"] and m["b"][0].isupper():
            gender, parts = _GENDER[m["title"]] or _GENDER.get(m["a"], ""), [("a", "given"), ("b", "surname")]
        else:
            gender, parts = "", [("a", "surname")]
        if not all(m[g][0].isupper() for g, _ in parts):
            continue
        for g, kind in parts:
            script = _script(m[g])
            found.append((*m.span(g), f"given:{script}:{gender}" if kind == "given" else f"surname:{script}", m[g].title()))
    found.sort()
    out, end = [], 0
    for e in found:
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


def _stream(key: bytes, kind: str, norm: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from blake2b(f"{kind}\0{norm}\0{attempt}\0{block}".encode("utf-8", "surrogatepass"), key=key, digest_size=64).digest()
        block += 1


def _alike(text: str, draw: Iterator[int]) -> str:
    """Letters to letters and digits to digits, case and other characters kept."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(next(draw) % 10))
        elif c.isalpha():
            new = chr(97 + next(draw) % 26)
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, norm: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The replacement of a normal form; later attempts give others."""
    draw = _stream(key, kind, norm, attempt)
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        host, _, top = domain.rpartition(".")
        # one domain keeps one surrogate, whatever the mailbox
        return f"{_alike(local, draw)}@{_alike(host, _stream(key, 'domain', host, 0))}.{top}"
    if kind == "ip":
        return ".".join(str(1 + next(draw) % 254) for _ in range(4))
    if kind == "card":
        body = norm[0] + _alike(norm[1:-1], draw)
        return body + str(-_luhn(body + "0") % 10)
    if kind == "iban":
        body = norm[:2] + "00" + _alike(norm[4:], draw)
        return f"{norm[:2]}{98 - _mod97(body):02d}{body[4:]}"
    if kind == "phone":
        head = 2 if norm.startswith("+") else 0  # the first digit of the country code stays
        return norm[:head] + _alike(norm[head:], draw)
    if kind.startswith("given:"):
        _, script, gender = kind.split(":")
        pool = GIVEN[script, gender] if gender else GIVEN[script, "f"] + GIVEN[script, "m"]
        # later attempts join as many names as it takes, so distinct names never run out
        parts = [pool[next(draw) % len(pool)] for _ in range(1 + (attempt + 2) // 3)]
        return "-".join(parts)
    if kind.startswith("surname:"):
        own = SYLLABLES[kind.split(":")[1]]
        name = "".join(own[next(draw) % len(own)] for _ in range(3 + attempt // 4))
        return name.capitalize()
    return _alike(norm, draw)


def _fit(raw: str, kind: str, new: str) -> str:
    """Lays the surrogate over the written form: grouping and case of the text stay."""
    if kind in ("card", "iban", "phone"):
        chars = iter(new)
        keep = (lambda c: c.isdigit() or c == "+") if kind == "phone" else str.isalnum
        return "".join(next(chars) if keep(c) else c for c in raw)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(raw, new, strict=True))
    return new.upper() if raw.isupper() and len(raw) > 1 else new


def replace(text: str, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str, int]:
    """The text with surrogates, and the number of entities replaced."""
    found = detect(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, z, kind, norm in found:
        out += [text[at:a], _fit(text[a:z], kind, surrogate(kind, norm, attempts.get((kind, norm), 0), key))]
        at = z
    return "".join([*out, text[at:]]), len(found)


def _later(docs: DataFrame, key: bytes) -> DataFrame | None:
    """(text_id, later): for each text its entities with a later attempt than the first; None if there are none."""

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = {(i, e[2], e[3]) for i, t in zip(b.column("text_id").to_pylist(), b.column("text").to_pylist(), strict=True) for e in detect(t)}
            cols = list(zip(*sorted(rows), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["text_id", "kind", "norm"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("kind", "norm", "attempt")]
            new = [surrogate(k, n, a, key) for k, n, a in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], [*b.schema.names, "new"])

    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("text_id"), "text")
    met = cut_lineage(texts.mapInArrow(entities, "text_id long, kind string, norm string"))
    distinct = cut_lineage(met.select("kind", "norm").distinct())
    real = distinct.select("kind", F.col("norm").alias("new"), F.lit(1).alias("taken"))
    now = distinct.select("kind", "norm", F.lit(0).alias("attempt"))
    for _ in range(ROUNDS):
        drawn = cut_lineage(now.mapInArrow(draw, "kind string, norm string, attempt int, new string"))
        # names of any gender share a space; who drew first keeps the surrogate
        space = F.split("kind", ":")[0]
        owner = drawn.groupBy(space.alias("space"), "new").agg(F.min(F.struct("attempt", "kind", "norm")).alias("own"))
        checked = drawn.withColumn("space", space).join(owner, ["space", "new"])
        checked = checked.join(real.withColumn("space", space).select("space", "new", "taken").distinct(), ["space", "new"], "left")
        clash = F.col("taken").isNotNull() | (F.col("own.norm") != F.col("norm")) | (F.col("own.kind") != F.col("kind"))
        now = cut_lineage(checked.select("kind", "norm", (F.col("attempt") + clash.cast("int")).alias("attempt"), clash.alias("clash")))
        if now.filter("clash").limit(1).count() == 0:
            break
        now = now.drop("clash")
    else:
        raise RuntimeError(f"surrogates still clash after {ROUNDS} rounds")
    later = now.filter("attempt > 0").select("kind", "norm", "attempt")
    if later.limit(1).count() == 0:
        return None
    each = met.join(later, ["kind", "norm"]).distinct()
    return cut_lineage(each.groupBy("text_id").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("later")))


def _free(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: bytes = KEY, count: str | None = None) -> DataFrame:
    """The table with surrogates in ``text``; ``count`` names a column for the number of entities replaced."""
    columns = [c for c in docs.columns if c != count]
    key_name, later_name = _free("text_id", columns), _free("later", columns)
    rows = docs.select(*columns, F.xxhash64("text").alias(key_name))
    later = _later(docs, key)
    if later is None:
        rows = rows.withColumn(later_name, F.lit(None).cast("array<struct<kind:string,norm:string,attempt:int>>"))
    else:
        rows = rows.join(later.select(F.col("text_id").alias(key_name), F.col("later").alias(later_name)), key_name, "left")
    out = docs.select(*columns, *([F.lit(0).alias(count)] if count else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            new, n = [], []
            for t, later in zip(b.column("text").to_pylist(), b.column(later_name).to_pylist(), strict=True):
                attempts = {(x["kind"], x["norm"]): x["attempt"] for x in later or ()}
                done = replace(t, attempts, key) if t is not None else (None, 0)
                new.append(done[0])
                n.append(done[1])
            own = {c: b.column(c) for c in columns} | {"text": pa.array(new, pa.string())} | ({count: pa.array(n, pa.int32())} if count else {})
            yield pa.RecordBatch.from_arrays(list(own.values()), list(own))

    return rows.select(*columns, later_name).mapInArrow(run, out)
