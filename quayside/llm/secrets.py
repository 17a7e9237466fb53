"""Secret scanning with corpus-wide ownership frequency.

Candidates are found in every text by pattern.  Their hashes are then counted over the whole
corpus by distinct owners and repositories: a value that many owners or very many repositories
carry is a copied example, a rarer one that looks random is taken for a live credential.  Random
is what is likelier by chance than by the pairs of letters of the corpus's own words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_counted, slices, texts_of, written

# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Without one of these (lower case) a text has no assignment.
KEYWORDS = ("passw", "secret", "token", "api")
ASSIGN_MIN, ACCESS_MIN = 8, 16
# Fixed patterns of further providers' keys: a literal that must occur, and the whole pattern.
PROVIDERS = (
    ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("sk-", re.compile(r"\bsk-[A-Za-z0-9_-]{20,}")),
    ("xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")),
)
PLACEHOLDERS = ("example", "changeme", "placeholder", "dummy", "sample", "redacted", "your", "xxxx", "1234567", "abcdef0")
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "provider", "live", "example")

SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
CANDIDATE = pa.struct([("hash", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("random", pa.bool_())])
SCANNED = "doc_id long, owner string, repository string, spans array<struct<start:long,kind:int,end:long>>, candidates array<struct<hash:binary,start:long,end:long,random:boolean>>"


class LetterPairs:
    """How surprising a value is after what the corpus's words look like.

    counts[x, y]: how often a character of class y follows one of class x in the corpus's words without
    digits; classes are 0 for what parts words, 1 to 26 for letters in either case, 27 for digits, 28
    for other letters.  Words with digits are what is judged, so how digits follow is fixed: DIGIT_STARTS
    after a letter, DIGIT_STAYS after a digit.
    """

    CLASSES = 29
    DIGIT_STARTS, DIGIT_STAYS = 0.02, 0.5
    OF = np.zeros(256, np.uint8)

    def __init__(self, counts: np.ndarray):
        pairs = counts.astype(float)
        single = pairs.sum(axis=0) + 1.0
        single /= single.sum()
        rows = pairs.sum(axis=1, keepdims=True)
        # a fifth of the weight is that of the character alone, so a pair that the corpus lacks is rare, not impossible
        share = 0.8 * np.divide(pairs, rows, out=np.broadcast_to(single, pairs.shape).copy(), where=rows > 0) + 0.2 * single
        share[:, 27], share[27], share[27, 27] = self.DIGIT_STARTS / 10, (1 - self.DIGIT_STAYS) * single, self.DIGIT_STAYS / 10
        self.bits = -np.log2(share)

    @classmethod
    def classes(cls, text: str) -> np.ndarray:
        return cls.OF[np.frombuffer(text.lower().encode("latin-1", "replace"), np.uint8)]

    @classmethod
    def plain(cls, text: str) -> np.ndarray:
        """The classes of a text's characters, words with digits taken out."""
        found = cls.classes(text)
        inside = found > 0
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if len(starts):
            numbered = np.add.reduceat(found == 27, starts, dtype=np.int64) > 0
            found[starts[0] :][np.repeat(numbered, np.diff(starts, append=len(found)))] = 0
        return found

    def bits_for_chance(self, value: str) -> float:
        """The log likelihood ratio, in bits, of characters drawn evenly from the value's own alphabet against the corpus's words."""
        found = self.classes(value)
        inside = (found[1:] > 0) & (found[:-1] > 0)
        letters, digits = found[(found > 0) & (found != 27)], (found == 27).any()
        size = (0 if not len(letters) else 6 if letters.max() <= 6 else 26) + 10 * bool(digits)
        return float((self.bits[found[:-1], found[1:]][inside] - np.log2(max(size, 2))).sum())


LetterPairs.OF[ord("a") : ord("z") + 1] = np.arange(1, 27)
LetterPairs.OF[ord("0") : ord("9") + 1] = 27
LetterPairs.OF[0xDF:0x100] = 28
LetterPairs.OF[0xF7] = 0


def letter_pairs(docs: DataFrame) -> LetterPairs:
    """Counted over all texts; the driver gets one row per pair of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LetterPairs.CLASSES**2, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                found = LetterPairs.plain(text).astype(np.int64)
                total += np.bincount(found[:-1] * LetterPairs.CLASSES + found[1:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    counts = np.zeros(LetterPairs.CLASSES**2)
    for row in docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[row.pair] = row["n"]
    return LetterPairs(counts.reshape(LetterPairs.CLASSES, -1))


def looks_random(value: str, known: LetterPairs, bits: float = 14.5, entropy: float = 2.5) -> bool:
    """More like chance than like the corpus's words by this many bits, varied enough, and no word that placeholders carry."""
    n = len(value)
    mean = -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0
    low = value.lower()
    return mean >= entropy and not any(word in low for word in PLACEHOLDERS) and known.bits_for_chance(value) >= bits


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans (start, kind, end) of the base and provider patterns, and the values (start, end) in them.

    Positions are code points.  A match of the assignment pattern with a short value is dropped but
    has used up its characters.
    """
    spans, values = [], set()
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_MIN:
                spans.append((m.start(), 0, m.end()))
                values.add(m.span(2))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_MIN:
                spans.append((m.start(), 1, m.end()))
                values.add(m.span())
    for m in HEX.finditer(text):
        spans.append((m.start(), 2, m.end()))
        values.add(m.span())
    for literal, pattern in PROVIDERS:
        if literal in text:
            for m in pattern.finditer(text):
                spans.append((m.start(), 3, m.end()))
                values.add(m.span())
    return sorted(spans), sorted(values)


def scanned(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """doc_id, owner, repository, spans and candidates of every row."""
    known = letter_pairs(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, candidates = [], []
            for text in texts_of(batch):
                found, values = scan(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                candidates.append([{"hash": hashlib.sha256(text[s:e].encode()).digest()[:16], "start": s, "end": e, "random": looks_random(text[s:e], known)} for s, e in values])
            kept = [batch.column(c) for c in ("doc_id", "owner", "repository")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.list_(SPAN)), pa.array(candidates, pa.list_(CANDIDATE))], ["doc_id", "owner", "repository", "spans", "candidates"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), "text")
    return rows.mapInArrow(run, SCANNED)


def _listed(spans) -> F.Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = 3, example_repositories: int = 100) -> DataFrame:
    """One row per document: base counts and digest, all spans, and how many values seem live or copied.

    A value carried by `example_owners` distinct owners or more, or by `example_repositories`
    distinct repositories or more whoever owns them, is a widely copied example.  One that stays
    below both and looks random is owner-specific and taken for live.  Each adds a span over the
    value, base spans stay.  Null texts count as empty, null owners and repositories as unknown
    (they count for nothing), repeated rows give repeated results, an empty table gives no rows and
    further columns are not looked at.
    """
    rows = written(scanned(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "secret-scan")
    found = rows.filter(F.size("candidates") > 0).select("row", "owner", "repository", F.explode("candidates").alias("c")).select("row", "owner", "repository", "c.*")
    found = written(found, "secret-candidates")
    # distinct pairs first, so that a value copied everywhere meets as a few rows per task
    owners = found.filter("owner IS NOT NULL").select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = found.filter("repository IS NOT NULL").select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    spread = found.groupBy("hash").agg(F.count("*").alias("many")).join(owners, "hash", "left").join(repositories, "hash", "left")
    spread = written(spread.select("hash", "many", F.coalesce("owners", F.lit(0)).alias("owners"), F.coalesce("repositories", F.lit(0)).alias("repositories")), "secret-owners")
    copied = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    kind = F.when(copied, KINDS.index("example")).when(F.col("random"), KINDS.index("live"))
    judged = written(join_counted(found, spread, "hash").withColumn("kind", kind).filter("kind IS NOT NULL").select("row", "start", F.col("kind").cast("int").alias("kind"), "end", "owners", "repositories"), "secret-kinds")
    added = judged.groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("added"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    whole = rows.join(added, "row", "left").withColumn("added", F.coalesce("added", none))
    return whole.select(
        "doc_id",
        F.size(of(0)).cast("long").alias("n_assign"),
        F.size(of(1)).cast("long").alias("n_access"),
        F.size(of(2)).cast("long").alias("n_hex"),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.concat("spans", "added")).alias("spans"),
        F.size(F.filter("added", lambda s: s["kind"] == KINDS.index("live"))).cast("long").alias("n_live"),
        F.size(F.filter("added", lambda s: s["kind"] == KINDS.index("example"))).cast("long").alias("n_example"),
        F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce("most_repositories", F.lit(0)).cast("long").alias("most_repositories"),
    )
