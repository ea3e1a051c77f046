"""Personal data replaced by surrogates.

Entities found: e-mail addresses, IPv4 addresses, phone numbers, payment card
numbers, access tokens (hexadecimal, key ids, prefixed tokens, web tokens, private
key blocks), and given and family names after a form of address. Once a name is
found in a text, its other capitalised mentions there are the same entity. Each
distinct entity of the corpus gets one surrogate, drawn by a keyed hash: of the
same type, script, gender, letter case and punctuation, with digits for digits.
So an entity reads the same wherever it stands (coreference), and without the
key nothing leads back.

Surrogates are checked against each other and against all entities found: where
two entities drew the same one, or one that exists in the corpus, all but one
draw again until all differ. Names are drawn from lists, so late draws hyphenate
several; short e-mail names grow letters. A name in a script without a list gets
other letters of that script. IPv4 addresses can't grow: some 250 million
different ones are the most, then the run ends with an error.

Two passes read the texts: documents without an entity stay where they are, the
others are written once and meet their surrogates in a join.

Defined results: null and empty texts stay as they are. Rows that agree in id
and text are treated alike; ids may be null. Empty tables give empty results.
Columns of any name pass through; the added one is called ``pii_entities``, with
underscores appended while the table has a column of that name.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize, ship_package

KEY = b"replace this key in production"
# Draws before the surrogate is made longer, and in all.
EASY_DRAWS, MAX_DRAWS = 8, 64

# Forms of address by gender, and lists of given and family names by script.
ADDRESS = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("m", "latin"): ("Adam", "Ben", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noah", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Viktor"),
    ("f", "latin"): ("Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Ida", "Julia", "Karin", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sofia", "Teresa", "Vera"),
    ("m", "cyrillic"): ("Александр", "Борис", "Виктор", "Глеб", "Дмитрий", "Егор", "Иван", "Кирилл", "Михаил", "Николай"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Надежда", "Ольга", "Татьяна"),
}
FAMILY = {
    "latin": ("Abel", "Becker", "Castro", "Dumont", "Ekberg", "Fischer", "Garnier", "Hansen", "Ibarra", "Jensen", "Keller", "Lindberg", "Moreno", "Novak", "Ortega", "Petit", "Romero", "Schubert", "Torres", "Vidal"),
    "cyrillic": ("Белов", "Волков", "Громов", "Зайцев", "Козлов", "Лебедев", "Морозов", "Новиков", "Орлов", "Соколов"),
}

_TITLES = {title: gender for gender, titles in ADDRESS.items() for title in titles}
_GENDER = {name: gender for (gender, _), names in GIVEN.items() for name in names}
_NAME = r"[^\W\d_a-zß-öø-ÿа-я][^\W\d_]+"
_WORD = re.compile(r"[^\W\d_]+")
# Access tokens that keep their letters' case; what the group ``kept`` holds says what they are and stays.
_TOKENS = {
    "aws": r"(?<![0-9A-Za-z])(?P<kept>AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "github": r"(?<![0-9A-Za-z_])(?P<kept>gh[pousr]_)[0-9A-Za-z]{36,255}(?![0-9A-Za-z])",
    "jwt": r"(?<![0-9A-Za-z_.-])(?P<kept>eyJ)[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{5,}",
    "pem": r"(?P<kept>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)[0-9A-Za-z+/=\s]+(?=-----END (?:[A-Z]+ )*PRIVATE KEY-----)",
}
_KEPT = {name: re.compile(pattern) for name, pattern in _TOKENS.items()}
_ENTITY = re.compile(
    "".join(f"(?P<secret_{name}>{pattern.replace('?P<kept>', '?:')})|" for name, pattern in _TOKENS.items())
    + r"(?P<email>(?<![\w.+%-])[\w.+%-]*\w@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*\d)(?=\d*[A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![\w+])\+(?:\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|\d{1,3}(?P<gap>[ .-])\d{1,4}(?:(?P=gap)\d{2,4}){1,4}|\d{8,15})(?!\.?\d))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<card>(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d))"
    r"|\b(?P<title>" + "|".join(_TITLES) + r")\.? (?P<first>" + _NAME + r")(?: (?P<last>" + _NAME + r"))?"
)
_HINT = re.compile(r"\d|@|eyJ|gh[pousr]_|A[KS]IA|-----BEGIN|\b(?:" + "|".join(_TITLES) + r")\b")

ENTITY = pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
_ENTITY_SQL = "struct<kind:string,value:string,start:int,stop:int>"


def _script(name: str) -> str:
    """The script of the first letter, as Unicode names it."""
    return unicodedata.name(name[0], "other").split(" ")[0].split("-")[0].lower()


@lru_cache(4096)
def _letters_like(letter: str) -> str:
    """Letters of the same script and category among the 128 code points around this one."""
    first = ord(letter) & ~127
    around = map(chr, range(first, first + 128))
    alike = [c for c in around if unicodedata.category(c) == unicodedata.category(letter) and _script(c) == _script(letter)]
    return "".join(c for c in alike if c.casefold() == c) or letter


def find_entities(text: str | None) -> list[dict]:
    """Entities of a text: kind, value (what makes two mentions the same), start and stop."""
    if not text or not _HINT.search(text):
        return []
    found = []

    def add(kind: str, value: str, start: int, stop: int) -> None:
        found.append({"kind": kind, "value": value, "start": start, "stop": stop})

    for m in _ENTITY.finditer(text):
        kind = m.lastgroup
        if m["title"]:
            first, last = m["first"], m["last"]
            gender = _TITLES[m["title"]]
            if last or first in _GENDER:
                gender = _GENDER.get(first, gender)
                gender = "m" if gender == "n" else gender
                add(f"given-{gender}-{_script(first)}", first.casefold(), *m.span("first"))
            else:
                last = first
            if last:
                add(f"family-{_script(last)}", last.casefold(), *(m.span("last") if m["last"] else m.span("first")))
        elif kind in ("phone", "card"):
            digits = re.sub(r"\D", "", m[0])
            kind = f"{kind}-{'luhn' if luhn(digits) else 'plain'}" if kind == "card" else kind
            add(kind, digits, *m.span())
        elif kind.startswith("secret_"):
            add(kind.replace("_", "-"), m[0], *m.span())
        else:
            add(kind, m[0].lower(), *m.span())
    return _with_bare_mentions(text, found)


def _with_bare_mentions(text: str, found: list[dict]) -> list[dict]:
    """Adds the capitalised words of the text that are names found in it, outside other entities."""
    names = {}
    for e in found:
        if e["kind"].startswith(("given-", "family-")):
            names.setdefault(e["value"], e["kind"])
    if not names:
        return found
    bare, at = [], 0
    for m in _WORD.finditer(text):
        while at < len(found) and found[at]["stop"] <= m.start():
            at += 1
        kind = names.get(m[0].casefold())
        apart = at == len(found) or m.end() <= found[at]["start"]
        if kind and apart and not m[0][0].islower():
            bare.append({"kind": kind, "value": m[0].casefold(), "start": m.start(), "stop": m.end()})
    return sorted(found + bare, key=lambda e: e["start"])


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


class _Draws:
    """An endless stream of keyed numbers for one entity and draw."""

    def __init__(self, key: bytes, kind: str, value: str, draw: int) -> None:
        self.seed = hmac.new(key, f"{kind}\0{value}\0{draw}".encode(), hashlib.sha256).digest()
        self.block, self.rest = 0, b""

    def below(self, n: int) -> int:
        if len(self.rest) < 8:
            self.rest += hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        number, self.rest = int.from_bytes(self.rest[:8], "big"), self.rest[8:]
        return number % n

    def like(self, text: str, cased: bool = False) -> str:
        """Letters for letters, digits for digits; lower-case letters only unless ``cased``."""
        letters = "abcdefghijklmnopqrstuvwxyz"

        def drawn(c: str) -> str:
            if c.isdigit():
                return str(self.below(10))
            if not c.isalpha():
                return c
            letter = letters[self.below(26)]
            return letter.upper() if cased and c.isupper() else letter

        return "".join(map(drawn, text))

    def of_script(self, name: str, longer: int) -> str:
        """As many letters of the name's script, and more if asked for."""
        letters = [_letters_like(c) for c in name + name[-1] * longer]
        drawn = "".join(x[self.below(len(x))] for x in letters)
        return drawn[0].upper() + drawn[1:]


def surrogate(key: bytes, kind: str, value: str, draw: int) -> str:
    """The value that replaces ``value`` at this draw."""
    draws = _Draws(key, kind, value, draw)
    if kind == "email":
        name, domain = value.rsplit("@", 1)
        longer = "" if draw < EASY_DRAWS else draws.like("a" * (draw - EASY_DRAWS + 2))
        # Names under example.com and its like stay there; others move below a reserved domain.
        host = domain if re.search(r"(^|\.)example\.(com|net|org)$", domain) else draws.like(domain.split(".")[0]) + ".example"
        return f"{draws.like(name)}{longer}@{host}"
    if kind == "ip":
        first = 10 if draw < EASY_DRAWS else 240 + draws.below(15)
        return f"{first}.{draws.below(256)}.{draws.below(256)}.{draws.below(256)}"
    if kind == "phone":
        # Country code stays, and so does the fictitious exchange.
        digits = value[0] + draws.like(value[1:])
        fictitious = len(value) == 11 and value[4:7] == "555" and draw < EASY_DRAWS
        return digits[:4] + "555" + digits[7:] if fictitious else digits
    if kind.startswith("card"):
        digits = draws.like(value[:-1])
        check = next(d for d in "0123456789" if luhn(digits + d))
        return digits + (check if kind.endswith("luhn") else str((int(check) + 1 + draws.below(9)) % 10))
    if kind == "secret":
        return "".join("0123456789abcdef"[draws.below(16)] for _ in value)
    if kind.startswith("secret-"):
        kept = _KEPT[kind.removeprefix("secret-")].match(value + "-----END PRIVATE KEY-----")["kept"]
        return kept + draws.like(value[len(kept) :], cased=True)
    part, *rest = kind.split("-")
    if rest[-1] not in FAMILY:
        return draws.of_script(value, draw // 4)
    names = GIVEN[rest[0], rest[1]] if part == "given" else FAMILY[rest[0]]
    return "-".join(names[draws.below(len(names))] for _ in range(1 + draw // 4))


def render(original: str, kind: str, replacement: str) -> str:
    """The surrogate in the format of the original: its separators, its letter case."""
    if kind == "phone" or kind.startswith("card"):
        digits = iter(replacement)
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if original.isupper() and len(original) > 1:
        return replacement.upper()
    if kind == "email":
        # The domain has no case of its own.
        name = original.rsplit("@", 1)[0]
        return "".join(b.upper() if a.isupper() else b for a, b in zip(name, replacement)) + replacement[len(name) :]
    return replacement


def _mark(text_at: int, wanted: bool):
    """Keeps the rows with entities, and adds these; or keeps the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_entities(text.as_py()) for text in batch.column(text_at)]
            mask = pa.array([bool(x) == wanted for x in found], pa.bool_())
            kept = batch.filter(mask)
            if wanted:
                entities = pa.array([x for x in found if x], pa.list_(ENTITY))
                kept = pa.RecordBatch.from_arrays([*kept.columns, entities], [*kept.schema.names, "entities"])
            yield kept

    return run


def _draw(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, draws = (batch.column(c).to_pylist() for c in ("kind", "value", "draw"))
            drawn = [surrogate(key, k, v, d) for k, v, d in zip(kinds, values, draws)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(drawn, pa.string())], [*batch.schema.names, "surrogate"]
            )

    return run


def assign(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """``(kind, value, surrogate)``: a surrogate for each distinct ``(kind, value)``, all different and none an entity."""
    schema = "kind string, value string, draw int, surrogate string"
    taken = F.lower("surrogate")
    entities = materialize(entities.select("kind", "value").distinct(), "entities")
    def of_names(kind: Column) -> Column:
        """Names of all kinds count as one kind here, as one person's given name may be another's family name."""
        return F.when(kind.rlike("^(given|family)-"), F.lit("name")).otherwise(kind)

    known = entities.select(of_names(F.col("kind")).alias("known_kind"), F.lower("value").alias("known_value")).distinct()
    waiting, settled, draw = entities, None, 0
    while waiting.take(1):
        if draw > MAX_DRAWS:
            raise ValueError("The surrogates of some type are used up")
        drawn = waiting.withColumn("draw", F.lit(draw)).mapInArrow(_draw(key), schema)
        first = Window.partitionBy("kind", taken).orderBy(F.col("draw"), F.col("value"))
        pool = drawn if settled is None else drawn.unionByName(settled)
        # A surrogate may not be any entity's own value either.
        clash = (of_names(F.col("kind")) == F.col("known_kind")) & (taken == F.col("known_value"))
        ranked = pool.withColumn("rank", F.row_number().over(first)).join(known, clash, "left")
        settled_now = ranked.withColumn("ok", (F.col("rank") == 1) & F.col("known_value").isNull())
        state = materialize(settled_now.select("kind", "value", "draw", "surrogate", "ok"), "surrogates")
        settled = state.where("ok").select("kind", "value", "draw", "surrogate")
        waiting = state.where("not ok").select("kind", "value")
        draw += 1
    if settled is None:
        return entities.withColumn("surrogate", F.lit(None).cast("string"))
    return settled.select("kind", "value", "surrogate")


def _replace(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, entities, given in zip(*(batch.column(k).to_pylist() for k in (text_at, -2, -1))):
                by_entity = {(x["kind"], x["value"]): x["surrogate"] for x in given}
                parts, at = [], 0
                for e in entities:
                    original = text[e["start"] : e["stop"]]
                    parts += [text[at : e["start"]], render(original, e["kind"], by_entity[e["kind"], e["value"]])]
                    at = e["stop"]
                texts.append("".join([*parts, text[at:]]))
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """All rows with their columns, the text with surrogates, and ``pii_entities``: kind, value, start, stop in the old text.

    ``pii_entities`` is null for rows without any.
    """
    ship_package(docs.sparkSession)
    names = docs.columns
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text_at, id_at = names.index(text_col), names.index(id_col)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    with_list = f"{schema}, entities array<{_ENTITY_SQL}>"
    clean = rows.mapInArrow(_mark(text_at, False), schema)
    found = materialize(rows.mapInArrow(_mark(text_at, True), with_list), "texts-with-entities")
    identity = [F.col(f"c{id_at}").alias("key_id"), F.xxhash64(f"c{text_at}").alias("key_text")]
    mentions = found.select(*identity, F.explode("entities").alias("e")).select("key_id", "key_text", "e.kind", "e.value").distinct()
    surrogates = assign(mentions, key)
    given = (
        mentions.join(surrogates, ["kind", "value"])
        .groupBy("key_id", "key_text")
        .agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("given"))
    )
    same = identity_equal(f"c{id_at}", f"c{text_at}")
    joined = found.join(given, same).select(*found.columns, "given")
    replaced = joined.mapInArrow(_replace(text_at), with_list)
    none = F.lit(None).cast(f"array<{_ENTITY_SQL}>").alias("entities")
    whole = replaced.unionByName(clean.select("*", none))
    added = "pii_entities"
    while added.lower() in map(str.lower, names):
        added += "_"
    return whole.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.col("entities").alias(added))


def identity_equal(id_col: str, text_col: str):
    return F.col(id_col).eqNullSafe(F.col("key_id")) & (F.xxhash64(text_col) == F.col("key_text"))
