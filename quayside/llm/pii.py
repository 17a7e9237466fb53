"""Personal data replaced by keyed surrogates.

Entities are found in every text and normalised; one entity has one surrogate over the whole
corpus (coreference), two entities of a type never share one (distinctness), and no surrogate is an
entity that occurs.  Surrogates come from a keyed hash and keep type, gender, script and format.
They are drawn for distinct entities only; those that collide are drawn again, and where a format
(such as addresses of one letter at one host) is nearly full, those left are matched with what is
free in it.  If nothing is, the address gets longer: distinctness comes before its length.

A person is introduced by a title or a phrase ("my name is").  Given names and the family name have
surrogates of their own, so "Mrs Anna Keller", "Dr Anna Keller", "Mrs Keller" and the bare "Anna
Keller", "Keller" or "Anna" later in that text stay one person.  A title is no part of the identity:
the gender of a given name is what most of its titles in the corpus say.  A person that its text
never introduces is not found, and the last of several names counts as the family name.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_counted, slices, texts_of, written

# Fixed patterns, by type, in the order in which overlapping finds are settled.
EMAIL = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b")
IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
CARD = re.compile(r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])")
PHONE = re.compile(r"(?<![\d.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\d-])|(?<![\d.-])\+\d{8,14}(?!\d)")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_NAME = r"[^\W\d_](?:[\w-]|['’](?!s\b))*"
_NAMES = rf"({_NAME}(?:[ ]{_NAME}){{0,2}})"
TITLED = re.compile(rf"\b(Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Г-н|Г-жа)\.?[ ]{_NAMES}")
NAMED = re.compile(rf"\b(?:[Mm]y name is|[Nn]ame:|[Cc]ontact:|[Ss]igned,|[Rr]egards,)\s{{1,2}}{_NAMES}")
WORD = re.compile(_NAME)
#: Fixed: titles that tell a gender.
MALE = {"Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н"}
FEMALE = {"Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа"}
#: Fixed: given names that surrogates use, by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Carl David Emil Felix Hugo Ivan Jonas Leo Martin Oscar Paul Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Clara Diana Emma Flora Helen Irene Julia Laura Maria Nora Paula Sarah Teresa Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Кирилл Максим Олег Павел".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Ирина Ксения Мария Ольга Полина".split(),
}
#: Fixed: syllables of surrogate family names, by script.
SYLLABLES = {"latin": "ba be da do fe ga ho ka la le ma mo na no pe ra ri sa te va".split(), "cyrillic": "ба ве га до ка ла ма но па ра са та".split()}
#: Fixed: character ranges a keyed substitution stays inside of.
RANGES = ("az", "AZ", "09", "àö", "øÿ", "ÀÖ", "ØÞ", "ая", "АЯ", "αω", "一鿋", "ぁん", "ァン")
TYPES = ("email", "iban", "ip", "ip6", "ssn", "card", "phone", "given", "family")
#: Attempts at random; those that still collide are matched with what is free in their format, and from WIDER on formats grow.
ROUNDS, WIDER = 8, 1000
#: A format of at most this many surrogates for each of its entities is listed.
LISTED = 16

FOUND = "doc_id long, text string, entities array<struct<type:string,norm:string,start:long,end:long,gender:string>>"
ENTITY = pa.struct([("type", pa.string()), ("norm", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gender", pa.string())])


# --- finding ---------------------------------------------------------------------------------


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def find_people(text: str) -> dict[tuple[int, int], tuple[str, str, str]]:
    """(start, end) of every name of a person to (given or family, normal form, gender by its title)."""
    found: dict[tuple[int, int], tuple[str, str, str]] = {}
    introduced = [(m[2], m.start(2), "m" if m[1] in MALE else "f" if m[1] in FEMALE else "n", 1) for m in TITLED.finditer(text)]
    introduced += [(m[1], m.start(1), "n", 2) for m in NAMED.finditer(text)]
    given, family = set(), set()
    for names, start, gender, least in introduced:
        words = []
        for m in WORD.finditer(names):
            if not m[0][0].isupper():
                break
            words.append(m)
        if len(words) < least:
            continue
        for k, m in enumerate(words):
            kind = "family" if k == len(words) - 1 else "given"
            (family if kind == "family" else given).add(m[0].casefold())
            found[start + m.start(), start + m.end()] = (kind, m[0].casefold(), gender if kind == "given" and k == 0 else "n")
    if found:
        for m in WORD.finditer(text):
            word = m[0].casefold()
            if m.span() not in found and m[0][0].isupper() and (word in family or word in given):
                found[m.span()] = ("family" if word in family else "given", word, "n")
    return found


def find_entities(text: str) -> list[tuple[str, str, int, int, str]]:
    """(type, normal form, start, end, gender), not overlapping, in order.  Positions are code points."""
    found: list[tuple[int, int, str, str, str]] = []

    def add(kind: str, norm: str, start: int, end: int, gender: str = "n") -> None:
        found.append((start, end, kind, norm, gender))

    at = text.find("@")
    while at >= 0:
        # only the word around the @ is looked at; words hold no @, so no part is walked twice
        first = at
        while first and (text[first - 1].isalnum() or text[first - 1] in "_.+%-"):
            first -= 1
        if m := EMAIL.match(text, first):
            add("email", m[0].casefold(), *m.span())
        at = text.find("@", max(at + 1, m.end() if m else 0))
    if any(d in text for d in "0123456789"):
        for m in IBAN.finditer(text):
            add("iban", m[0].replace(" ", ""), *m.span())
        for m in IP.finditer(text):
            if all(int(part) < 256 for part in m[0].split(".")):
                add("ip", ".".join(str(int(part)) for part in m[0].split(".")), *m.span())
        for m in SSN.finditer(text):
            add("ssn", _digits(m[0]), *m.span())
        for m in CARD.finditer(text):
            add("card", _digits(m[0]), *m.span())
        for m in PHONE.finditer(text):
            add("phone", _digits(m[0]), *m.span())
    if "::" in text or text.count(":") > 6:
        for m in IP6.finditer(text):
            if not any(map(str.isdigit, m[0])):
                continue  # a::b is a name in code, more likely
            try:
                add("ip6", ipaddress.IPv6Address(m[0]).exploded, *m.span())
            except ValueError:
                pass  # a time or the like
    for (start, end), what in find_people(text).items():
        add(what[0], what[1], start, end, what[2])
    out, end = [], 0
    for start, stop, kind, norm, gender in sorted(found, key=lambda x: (x[0], TYPES.index(x[2]), -x[1])):
        if start >= end:
            out.append((kind, norm, start, stop, gender))
            end = stop
    return out


# --- drawing ---------------------------------------------------------------------------------


class Keyed:
    """Numbers that follow from the key, the entity and the attempt."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.block, self.pool = key, "\x1f".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.what + b"\x1f%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n


def substituted(text: str, draw: Keyed) -> str:
    """Every letter and digit replaced by one of the same range: case, script and format stay."""
    out = []
    for c in text:
        for low, high in RANGES:
            if low <= c <= high:
                c = chr(ord(low) + draw.below(ord(high) - ord(low) + 1))
                break
        out.append(c)
    return "".join(out)


def _other_domain(domain: str, key: bytes) -> str:
    host, _, top = domain.rpartition(".")
    return substituted(host, Keyed(key, "domain", domain)) + "." + top


def small_class(kind: str, norm: str, key: bytes) -> tuple[str, int] | None:
    """The format that an address's surrogate has to keep, and how many surrogates have it.

    A format is a pattern: letters and digits stand for their range.  Only addresses have formats
    small enough to be full; other types draw from so many that a few attempts always do.
    """
    if kind != "email":
        return None
    local, _, domain = norm.rpartition("@")
    size, pattern = 1, []
    for c in local:
        low, high = next(((a, b) for a, b in RANGES if a <= c <= b), (c, c))
        size *= ord(high) - ord(low) + 1
        pattern.append(low)
    return "".join(pattern) + "@" + _other_domain(domain, key), size


def member(pattern: str, n: int) -> str:
    """The n-th surrogate of a format."""
    local, _, domain = pattern.rpartition("@")
    out = []
    for c in reversed(local):
        low, high = next(((a, b) for a, b in RANGES if a == c), (c, c))
        n, k = divmod(n, ord(high) - ord(low) + 1)
        out.append(chr(ord(low) + k))
    return "".join(reversed(out)) + "@" + domain


def surrogate(kind: str, norm: str, attempt: int, key: bytes, gender: str = "n") -> str:
    """The normal form of the entity's surrogate.  With every attempt there are more to draw from."""
    draw = Keyed(key, kind, norm, str(attempt))
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        # the domain has a surrogate of its own, so that addresses of one host stay together
        if attempt >= WIDER:  # a fuller format has no address left
            local += "".join("a" if local[-1:].isalpha() else "0" for _ in range(1 + (attempt - WIDER) // 4))
        return substituted(local, draw) + "@" + _other_domain(domain, key)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "iban":
        return norm[:2] + substituted(norm[2:], draw)
    if kind == "card":
        body = str(1 + draw.below(9)) + substituted(norm[1:-1], draw)
        # valid check digits stay valid, invalid ones invalid
        fitting = [d for d in "0123456789" if _luhn(body + d) == _luhn(norm)]
        return body + fitting[draw.below(len(fitting))]
    if kind == "phone":
        keep = max(0, len(norm) - 10)
        return norm[:keep] + "".join(str(2 + draw.below(8)) if i in (0, 3) else str(draw.below(10)) for i in range(len(norm) - keep))
    if kind == "ssn":
        return substituted(norm, draw)
    if kind == "ip6":
        return ":".join("".join("0123456789abcdef"[draw.below(16)] for _ in range(4)) for _ in range(8))
    script = "cyrillic" if any("а" <= c <= "я" for c in norm) else "latin" if any("a" <= c <= "z" for c in norm) else ""
    if not script:
        return substituted(norm, draw)
    syllables = lambda n: "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(n))
    if kind == "family":
        return syllables(3 + min(attempt, 3))
    pool = GIVEN[script, gender] if gender in ("m", "f") else GIVEN[script, "m"] + GIVEN[script, "f"]
    return pool[draw.below(len(pool))].casefold() + syllables(min(attempt, 4))


def dressed(kind: str, surface: str, norm: str) -> str:
    """A surrogate's normal form in the format of the text it replaces."""
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(norm)
        return "".join(next(rest, c) if c.isalnum() else c for c in surface)
    if kind == "email":
        if len(norm) == len(surface):
            return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(surface, norm, strict=True))
        return norm
    if kind in ("given", "family"):
        return norm.upper() if len(surface) > 1 and surface.isupper() else norm[:1].upper() + norm[1:]
    if kind == "ip6":
        short = ipaddress.IPv6Address(norm).compressed
        return short.upper() if surface.isupper() else short
    return norm


# --- on Spark --------------------------------------------------------------------------------


def _detected(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            entities = [[{"type": t, "norm": n, "start": s, "end": e, "gender": g} for t, n, s, e, g in find_entities(text)] for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(entities, pa.list_(ENTITY))], ["doc_id", "text", "entities"])

    return rows.mapInArrow(run, FOUND)


def draw_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """type, norm, surrogate for distinct entities (type, norm, gender): surrogates of a type are distinct
    and none is an entity of its type.

    Neither null types nor null norms may occur; an empty table gives none; further columns are not
    looked at.  Of entities that drew the same the one with the smallest norm keeps it.  This always ends.
    """

    def drawn(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("type", "norm", "attempt", "gender")]
                made = [surrogate(t, n, a, key, g) for t, n, a, g in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("type", "norm", "attempt", "gender")), pa.array(made, pa.string())], ["type", "norm", "attempt", "gender", "surrogate"])

        return rows.select("type", "norm", "attempt", "gender").mapInArrow(run, "type string, norm string, attempt int, gender string, surrogate string")

    real = entities.select("type", F.col("norm").alias("surrogate"))
    table = written(drawn(entities.withColumn("attempt", F.lit(0))), "surrogates")
    rounds = 0
    while True:
        first = table.groupBy("type", "surrogate").agg(F.min("norm").alias("first"), F.count("*").alias("n")).filter("n > 1")
        shared = table.join(first, ["type", "surrogate"]).filter("norm <> first").select("type", "norm")
        taken = table.join(real, ["type", "surrogate"], "left_semi").select("type", "norm")
        losers = written(shared.unionByName(taken).distinct(), "surrogate-collisions")
        if not losers.limit(1).count():
            return table.select("type", "norm", "surrogate")
        again, kept = table.join(losers, ["type", "norm"], "left_semi"), table.join(losers, ["type", "norm"], "left_anti")
        rounds += 1
        if rounds == ROUNDS:
            matched = written(_free_surrogates(again, kept, entities, real, key), "surrogates-matched")
            kept = kept.unionByName(matched)
            again = again.join(matched.select("type", "norm"), ["type", "norm"], "left_anti").withColumn("attempt", F.lit(WIDER - 1))
        table = written(kept.unionByName(drawn(again.withColumn("attempt", F.col("attempt") + 1))), "surrogates")


def _free_surrogates(losers: DataFrame, kept: DataFrame, entities: DataFrame, real: DataFrame, key: bytes) -> DataFrame:
    """Rows of losers whose format is nearly full, each with a surrogate that is free: by ranks of keyed hashes on both sides.

    A format is listed only if it has few surrogates for each of its entities (LISTED), so the list
    grows with the entities.  Who gets none here goes on drawing.
    """

    @F.pandas_udf("pattern string, size double")
    def format_of(kinds: pd.Series, norms: pd.Series) -> pd.DataFrame:
        found = [small_class(k, n, key) or (None, 0) for k, n in zip(kinds, norms, strict=True)]
        return pd.DataFrame({"pattern": [p for p, _ in found], "size": [float(min(n, 1 << 62)) for _, n in found]})

    @F.pandas_udf("string")
    def nth(patterns: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([member(p, n) for p, n in zip(patterns, ns, strict=True)], dtype=object)

    shaped = lambda df: df.withColumn("f", format_of("type", "norm")).select(*df.columns, "f.*").filter("pattern IS NOT NULL")
    lost = shaped(losers)
    many = shaped(entities.select("type", "norm")).groupBy("type", "pattern").agg(F.count("*").alias("many"), F.first("size").alias("size"))
    full = written(many.join(lost.select("type", "pattern").distinct(), ["type", "pattern"], "left_semi").filter(F.col("size") <= LISTED * F.col("many")), "full-formats")
    size = F.col("size").cast("long")
    parts = full.select("type", "pattern", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(4096).cast("long"))).alias("first"))
    each = F.explode(F.sequence("first", F.least(F.col("first") + 4096, F.col("size")) - 1)).alias("n")
    listed = parts.repartition("pattern", "first").select("type", "pattern", each).withColumn("surrogate", nth("pattern", "n"))
    free = listed.join(kept.select("type", "surrogate"), ["type", "surrogate"], "left_anti").join(real, ["type", "surrogate"], "left_anti")
    secret = F.lit(hashlib.sha256(key).hexdigest())
    rank = lambda c: F.row_number().over(Window.partitionBy("type", "pattern").orderBy(F.sha2(F.concat(secret, F.col(c)), 256), c))
    takers = lost.join(full.select("type", "pattern"), ["type", "pattern"], "left_semi").withColumn("place", rank("norm")).drop("surrogate")
    offers = free.withColumn("place", rank("surrogate")).select("type", "pattern", "place", "surrogate")
    return takers.join(offers, ["type", "pattern", "place"]).select("type", "norm", "attempt", "gender", "surrogate")


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities, counts by type, spans.

    spans lists type:start:end of what was replaced, in the text as it was.  Null texts count as
    empty, null ids stay, repeated rows give repeated results, an empty table gives no rows and
    further columns are not looked at.  Texts are searched once; only those with entities are joined.
    """
    rows = written(_detected(docs).withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    some = rows.filter(F.size("entities") > 0)
    # joins on the row number and the entity, never on text
    each = some.select("row", F.posexplode("entities").alias("at", "e")).select("row", "at", "e.type", "e.norm", "e.gender")
    vote = lambda g: F.sum((F.col("gender") == g).cast("long"))
    gender = F.when(vote("m") > vote("f"), "m").when(vote("f") > vote("m"), "f").otherwise("n").alias("gender")
    distinct = written(each.groupBy("type", "norm").agg(F.count("*").alias("many"), gender), "pii-entities")
    table = draw_surrogates(distinct, key).join(distinct.select("type", "norm", "many"), ["type", "norm"])
    mapped = join_counted(each, written(table, "surrogate-table"), ["type", "norm"]).select("row", "at", "surrogate")
    lists = mapped.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("surrogates"))
    of = lambda k: F.size(F.filter("entities", lambda e: e["type"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in TYPES]
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["start"], e["end"])), ",").alias("spans")
    n = F.size("entities").cast("long").alias("n_entities")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            out = []
            for text, entities, surrogates in zip(*(batch.column(c).to_pylist() for c in ("text", "entities", "surrogates")), strict=True):
                parts, at = [], 0
                for e, norm in zip(entities, surrogates, strict=True):
                    parts += [text[at : e["start"]], dressed(e["type"], text[e["start"] : e["end"]], norm)]
                    at = e["end"]
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("entities")], ["doc_id", "text", "entities"])

    changed = some.join(lists, "row").select("doc_id", "text", "entities", "surrogates").mapInArrow(run, FOUND)
    untouched = rows.filter(F.size("entities") == 0).select("doc_id", "text", "entities")
    return changed.unionByName(untouched).select("doc_id", "text", n, *counts, spans)
