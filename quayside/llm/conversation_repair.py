"""Structure of conversations: what is wrong with their turns, and the cheapest repair.

A repaired conversation's roles read: at most one system turn first, then user and assistant in
turn, ending with the assistant; or there is nothing.  Turns are kept, given another role or deleted,
and empty turns are inserted.

The cheapest repair is a choice of the turns that are retained, each with a role.  What stands
between two retained turns is deleted, so a gap costs the difference of two prefix sums of deletions;
the roles on both sides of a gap say which turns have to be inserted there.  Going backwards, the
cheapest completion after a retained turn is a minimum over all later retained turns; a running
minimum for each role of the later turn gives it in constant time.  Of equal costs the audit that is
least decides: it deletes as long as it can, then inserts, then keeps.

On Spark: faults are found by aggregation on digests, so neither a long conversation nor one text
repeated in it meets in a task as rows of text.  The choice is made in tasks that read one short row
per distinct turn of a conversation, sorted.  Texts then pass through the hash of their conversation
as a sorted stream behind the row that holds its audit, one turn at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: What has to be inserted between two retained roles, or none and one.
BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "u"): "a", ("u", "a"): "", ("a", "u"): "", ("a", "a"): "u"}
#: What has to be inserted after the last retained role.
ENDING = {"": "", "s": "ua", "u": "a", "a": ""}
#: For every role, what may come next: role, the insertions before it, and their cost.
NEXT = {q: [(r, "I" * len(between), INSERT * len(between)) for (p, r), between in BETWEEN.items() if p == q] for q in ENDING}
SPACE = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, CUT = range(4)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def cheapest_audit(initials: str, faults: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; of equal costs the audit that is least.

    initials: the first letter of each turn's role, anything else than s, u and a for other roles;
    faults: SOUND, BLANK, DUPLICATE or CUT.  About 40 bytes a turn are held.
    """
    n = len(initials)
    row_after = {q: np.zeros(n + 1, np.int64) for q in ENDING}  # the next retained row, n for none
    role_after = {q: bytearray(n + 1) for q in ENDING}
    rest = dict.fromkeys(ENDING, 0)  # the cheapest completion behind row i - 1, by its role
    # by role, the cheapest later row: deletions before it, its own cost and completion; and how it is retained
    least: dict[str, tuple[int, int, str]] = {}
    for i in range(n, -1, -1):
        for q, ending in ENDING.items():
            cost, row, role, said = DELETE * (n - i) + INSERT * len(ending), n, "", ""  # all that is left is deleted
            for r, inserts, price in NEXT[q]:
                if r in least:
                    total, j, edit = least[r]
                    total += price - DELETE * i
                    # of equals the one that deletes longest, and then says what is less
                    if total < cost or (total == cost and (j > row or (j == row and inserts + edit < said))):
                        cost, row, role, said = total, j, r, inserts + edit
            rest[q], row_after[q][i] = cost, row
            role_after[q][i] = ord(role) if role else 0
        if i and faults[i - 1] in (SOUND, CUT):
            j, own = i - 1, TRUNCATED * (faults[i - 1] == CUT)
            for r in "sua":
                kept = initials[j] == r
                if kept or r != "s":
                    cost = DELETE * j + own + (0 if kept else REROLE) + rest[r]
                    if r not in least or cost < least[r][0]:  # of equals the later row stays
                        least[r] = (cost, j, "K" if kept else "R")
    audit, at, q = [], 0, ""
    while (row := int(row_after[q][at])) < n:
        r = chr(role_after[q][at])
        audit.append("D" * (row - at) + "I" * len(BETWEEN[q, r]) + ("K" if initials[row] == r else "R"))
        at, q = row + 1, r
    audit.append("D" * (n - at) + "I" * len(ENDING[q]))
    return rest[""], "".join(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: turns with faults made by crc32(conv_id:turn) % 20.

    0 drops a turn (no copies), 1 empties its text, 2 takes . ! ? out of it, 3 repeats it (two
    copies), 4 makes it the user's.  A null id or turn is written as one space, a null role or text is one.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies")
    )


def _described(turns: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and digest of the text: how many copies, and what is wrong with the text by itself."""
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)
    short = turns.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), fault.alias("fault"), "copies")
    distinct = short.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("fault").alias("fault"))
    # the first turn that says it; nulls come first
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = short.filter("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(order).alias("o")).select("conv_id", F.col("o.turn").alias("turn"), "role", "digest", F.lit(True).alias("is_first"))
    a, b = distinct.alias("a"), firsts.alias("b")
    same = F.lit(True)
    for c in ("conv_id", "turn", "role", "digest"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))  # both sides have one row of it
    return a.join(b, same, "left").select("a.*", F.coalesce("b.is_first", F.lit(False)).alias("is_first"))


def _sorted_by_conversation(rows: DataFrame, *before: str) -> DataFrame:
    order = [*before, "turn", "role", "digest"]
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *(F.col(c).asc_nulls_first() for c in order))


class _Conversation:
    """What the stream of a conversation's turns has shown so far."""

    def __init__(self, key):
        self.key, self.initials, self.faults, self.turns, self.low, self.high, self.last = key, [], bytearray(), 0, None, None, None

    def add(self, turn, role: str, copies: int, fault: int, first: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.last:
            self.turns, self.low, self.high, self.last = self.turns + 1, turn if self.low is None else self.low, turn, turn
        self.initials.append(role[:1] if role[:1] in ("s", "u", "a") else "?")
        self.initials.append(self.initials[-1] * (copies - 1))
        again = BLANK if fault == BLANK else DUPLICATE
        self.faults.append(fault if first else again)
        self.faults.extend(bytes([again]) * (copies - 1))

    def report(self) -> tuple:
        initials = "".join(self.initials)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        good = sum(initials.count(pair) for pair in ("su", "ua", "au"))  # a pair of two letters can't overlap itself
        cost, audit = cheapest_audit(initials, bytes(self.faults))
        illegal = max(0, len(initials) - 1) - good
        return self.key, gaps, self.faults.count(BLANK), self.faults.count(DUPLICATE), self.faults.count(CUT), illegal, cost, audit


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row per conversation.

    turns: conv_id, turn, role, text, copies (how often a row stands there; 0: it is gone, but its
    conversation counts).  No turns are left: zeros and an empty audit.
    """
    kind = turns.schema["conv_id"].dataType
    order = _sorted_by_conversation(_described(turns)).select("conv_id", "turn", "role", "copies", "fault", "is_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out() -> pa.RecordBatch:
            names = ["conv_id", *COUNTS, "audit"]
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.string())], names)

        for batch in batches:
            key_type = batch.column("conv_id").type
            for key, *row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if now is None or now.key != key:
                    if now:
                        done.append(now.report())
                    now = _Conversation(key)
                now.add(*row)
            if len(done) > 500:
                yield out()
        if now:
            done.append(now.report())
            yield out()

    return order.mapInArrow(run, f"conv_id {kind.simpleString()}, {', '.join(c + ' long' for c in COUNTS)}, audit string")


def repair(turns: DataFrame) -> DataFrame:
    """Conversations as one stream each: the report (place -1, see `audits`), and behind it the repaired turns.

    conv_id, place, role, text, edit (K, R or I), and of the report its counts and audit.  Rows stay in
    this order within a partition.  Turns of one number are taken by role and digest; rows equal in all
    stand together.  Null ids are one conversation, null turns come first, an empty table gives no rows.
    """
    small_batches(turns.sparkSession)
    report = audits(turns)
    rows = turns.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "text", "copies").filter("copies > 0")
    both = report.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = _sorted_by_conversation(both, "kind").select("conv_id", "kind", "role", "text", "copies", *COUNTS, "audit")
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, role, ends = "", 0, 0, "", 0

        def insert() -> Iterator[tuple]:
            nonlocal at, place, role
            while at < len(audit) and audit[at] == "I":
                role = "a" if role == "u" else "u"
                yield place, ROLES[role], "", "I"
                at, place = at + 1, place + 1

        def edits(said: str, text: str, copies: int) -> Iterator[tuple]:
            nonlocal at, place, role
            for _ in range(copies):
                yield from insert()
                edit, at = audit[at], at + 1
                if edit != "D":
                    role = said[:1] if edit == "K" else "a" if role == "u" else "u"
                    yield place, said if edit == "K" else ROLES[role], text, edit
                    place += 1
                if at == ends:  # no row follows, what is left is inserted
                    yield from insert()

        for batch in batches:
            out: list[tuple] = []
            reports = batch.select(["conv_id", *COUNTS, "audit"])
            kinds = batch.column("kind").to_pylist()
            said, texts, copies = (batch.column(c).to_pylist() for c in ("role", "text", "copies"))
            source: list[int] = []
            for k, kind in enumerate(kinds):
                if kind == 0:
                    audit, at, place, role = batch.column("audit")[k].as_py(), 0, 0, ""
                    ends = len(audit.rstrip("I"))
                    found = [(-1, None, None, None)]
                else:
                    found = list(edits(said[k], texts[k], copies[k]))
                out += found
                source += [k] * len(found)
            if out:
                taken = reports.take(pa.array(source))
                is_report = pa.array([row[0] < 0 for row in out])
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("conv_id"), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:]), *(pc.if_else(is_report, taken.column(c), None) for c in (*COUNTS, "audit"))],
                    ["conv_id", "place", "role", "text", "edit", *COUNTS, "audit"],
                )

    return stream.mapInArrow(run, f"conv_id {id_type}, place long, role string, text string, edit string, {', '.join(c + ' long' for c in COUNTS)}, audit string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit of the repaired conversations."""
    return repair(turns).filter("place >= 0").select("conv_id", "place", "role", "text", "edit")


def repair_digests(turns: DataFrame) -> DataFrame:
    """The report of every conversation, with the SHA-256 of its repaired turns: role:text, a line each."""
    stream = repair(turns)
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, hashed = None, None
        names = ["conv_id", *COUNTS, "audit"]
        for batch in batches:
            done: list[tuple] = []
            for k, (place, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "role", "text")), strict=True)):
                if place < 0:
                    if report:
                        done.append((*report, hashed.hexdigest()))
                    report, hashed = tuple(batch.column(c)[k].as_py() for c in names), hashlib.sha256()
                else:
                    hashed.update(("\n" * (place > 0) + f"{role}:{text}").encode())
            yield _digest_rows(done, batch.schema.field("conv_id").type)
            id_of = batch.schema.field("conv_id").type
        if report:
            yield _digest_rows([(*report, hashed.hexdigest())], id_of)

    return stream.mapInArrow(run, f"conv_id {id_type}, {', '.join(c + ' long' for c in COUNTS)}, audit string, repaired_sha256 string")


def _digest_rows(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [key_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])
