"""Cheapest edits that give a conversation the roles `(s?(ua)+)?`, and the conversation after them.

Rows stand by turn (null first), then role, then SHA-256 of role and text. The audit is a string with a letter for each
edit in order: K keeps a row, R gives it the role user or assistant, D deletes it, I inserts an empty row before it or at
the end. Of audits of equal cost the ASCII-least is taken. D comes before I, so an insert never stands before a deleted
row, and each row's part of an audit is its inserts and its own letter; parts of equal rows are never prefixes of each
other. So the least audit up to a row depends on the state of the roles there alone.

An audit in the making is a node that knows its row's part and the audit that it continues, so all audits share their
beginnings. Nodes hold their ancestors at distances of powers of two and a rolling hash of all parts. Two audits of equal
cost are compared where they first part: by a search over those ancestors' hashes, whose result is verified part by part.

At scale: rows without texts are sorted by ranges over all tasks, so a long conversation is in many of them, and packed
into blocks of BLOCK rows. A block that holds a whole conversation has its audit; for parts of one, it gives the least
audit from each state to each other. These are joined along the conversation by the same search, a step for each block.
Texts are shuffled once, to hash a conversation as it streams by: SHA-256 of one text is one task's work.

Null roles and texts are one space, null turns and null ids are a turn and a conversation. Rows that are equal
stay rows, the later ones duplicates. Columns other than the four are not read. No rows give no conversations.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

BLOCK = 4096  # rows without texts that a block holds
ROWS_PER_TASK = 500_000
SHORT = 24  # kinds of a conversation of so many rows are looked up before they are worked out
INSERT, DELETE, REROLE, CUT_OFF = 5, 2, 1, 5
WHITE = " \t\n\v\f\r"
_PRIME, _BASE = (1 << 61) - 1, 0x1B3F6A5D2C497E1

#: States: no row yet, after the system row, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_START = ((EMPTY, 0),)
_ALL = tuple((s, s) for s in range(4))
#: An initial leads from a state to the next one.
_NEXT = {(EMPTY, "s"): SYSTEM, **{(s, "u"): USER for s in (EMPTY, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
_TAIL = {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
#: A row's kind: the index of its initial, and 4 if it must be deleted, and 8 if it is cut off.
INITIALS = ("", "s", "u", "a")
MUST_GO, IS_CUT = 4, 8
_LEGAL = {"su", "ua", "au"}


def turn_of(state: int) -> int:
    """The state after an insert, or a row given the role that fits."""
    return ASSISTANT if state == USER else USER


@functools.cache
def moves(kind: int) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, part of the audit) for a row of this kind: the least part for each two states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = CUT_OFF if kind & IS_CUT else 0
    for start in range(4):
        state = start
        for inserts in range(3):
            edits = [] if inserts else [(state, DELETE, "D")]
            if not kind & MUST_GO:
                edits.append((turn_of(state), REROLE + extra, "R"))
                kept = _NEXT.get((state, INITIALS[kind & 3]))
                edits += [(kept, extra, "K")] if kept is not None else []
            for end, cost, letter in edits:
                found = (cost + INSERT * inserts, "I" * inserts + letter)
                best[start, end] = min(found, best.get((start, end), found))
            state = turn_of(state)
    return tuple((a, b, *found) for (a, b), found in best.items())


class Audits:
    """Audits as linked nodes; node n continues parent[n] by part[n]."""

    def __init__(self):
        self.part, self.hash, self.up = [""], [0], [[]]

    def extended(self, node: int, part: str) -> int:
        up = [node]
        while len(up) <= len(self.up[up[-1]]):
            up.append(self.up[up[-1]][len(up) - 1])
        self.part.append(part)
        self.hash.append((self.hash[node] * _BASE + int.from_bytes(part.encode(), "big") + 1) % _PRIME)
        self.up.append(up)
        return len(self.part) - 1

    def parting(self, a: int, b: int) -> tuple[int, int] | None:
        """The nodes, at one distance from the root, where two audits of as many parts first part; None for equal ones."""
        x, y = a, b
        if self.hash[a] != self.hash[b]:
            for j in range(len(self.up[a]) - 1, -1, -1):
                if j < len(self.up[x]) and self.hash[self.up[x][j]] != self.hash[self.up[y][j]]:
                    x, y = self.up[x][j], self.up[y][j]
        found = (x, y) if self.part[x] != self.part[y] else None
        while x != y:  # parts under equal hashes are equal, or else the hash lies
            if self.part[x] != self.part[y]:
                found = (x, y)
            if not self.up[x]:
                break
            x, y = self.up[x][0], self.up[y][0]
        return found

    def before(self, a: int, part: str, b: int, other: str) -> bool:
        """Whether audit a and then part is less than audit b and then other."""
        at = self.parting(a, b) if a != b else None
        return self.part[at[0]] < self.part[at[1]] if at else part < other

    def text(self, node: int) -> str:
        found = []
        while self.up[node]:
            found.append(self.part[node])
            node = self.up[node][0]
        return "".join(reversed(found))

    def advance(self, front: dict[int, tuple[int, int]], steps) -> dict[int, tuple[int, int]]:
        """(cost, node) by state after one more row, or after a part of the conversation."""
        best: dict[int, tuple[int, int, str]] = {}
        for start, end, cost, part in steps:
            if start in front:
                total, node = front[start][0] + cost, front[start][1]
                old = best.get(end)
                if old is None or total < old[0] or total == old[0] and self.before(node, part, old[1], old[2]):
                    best[end] = (total, node, part)
        return {end: (cost, self.extended(node, part)) for end, (cost, node, part) in best.items()}

    def finished(self, front: dict[int, tuple[int, int]]) -> tuple[int, str]:
        """Cost and audit of the whole conversation, with the inserts that it still needs."""
        best = None
        for state, (cost, node) in front.items():
            total, tail = cost + INSERT * len(_TAIL[state]), _TAIL[state]
            if best is None or total < best[0] or total == best[0] and self.before(node, tail, best[1], best[2]):
                best = (total, node, tail)
        return best[0], self.text(best[1]) + best[2]


def whole_audit(kinds: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation of rows of these kinds."""
    return _known(kinds) if len(kinds) <= SHORT else _worked_out(kinds)


def _worked_out(kinds: bytes) -> tuple[int, str]:
    audits, front = Audits(), {EMPTY: (0, 0)}
    for kind in kinds:
        front = audits.advance(front, moves(kind))
    return audits.finished(front)


_known = functools.lru_cache(1 << 16)(_worked_out)


def part_audits(kinds: bytes) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) over a part of a conversation, for each two states."""
    found = []
    for start in range(4):
        audits, front = Audits(), {start: (0, 0)}
        for kind in kinds:
            front = audits.advance(front, moves(kind))
        found += [(start, end, cost, audits.text(node)) for end, (cost, node) in front.items()]
    return found


def kinds_of(role: Column, text: Column) -> tuple[Column, Column]:
    """A row's kind, blank ones to be deleted, and whether it is blank."""
    ended = F.rtrim(text, F.lit(WHITE))
    blank = ended == ""
    initial = F.when(role.startswith("s"), 1).when(role.startswith("u"), 2).when(role.startswith("a"), 3).otherwise(0)
    cut = ~(ended.endswith(".") | ended.endswith("!") | ended.endswith("?"))
    return initial + F.when(blank, MUST_GO).when(cut, IS_CUT).otherwise(0), blank


def _in_order(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), digest.alias("digest"))


_ORDER = ("turn", "role", "digest")
_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_RUN = "whole boolean, block bigint, first int, last int, low bigint, high bigint, turns bigint, steps array<struct<start: int, end: int, cost: bigint, audit: string>>"
_LONGEST = (1 << 63) - 1


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, _LONGEST)


def _run(block: int, kinds: bytes, blank: list[bool], turns: list, whole: bool) -> dict:
    """What a part of one conversation within a block comes to."""
    initials = [INITIALS[k & 3] for k in kinds]
    known = [t for t in turns if t is not None]
    low, high, distinct = (known[0], known[-1], 1 + sum(a != b for a, b in zip(known, known[1:]))) if known else (None, None, 0)
    out = {
        "blank": sum(blank), "duplicate": sum(bool(k & MUST_GO) for k in kinds) - sum(blank), "truncated": sum(bool(k & IS_CUT) for k in kinds),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), "whole": whole, "block": block, "first": kinds[0] & 3, "last": kinds[-1] & 3,
        "low": low, "high": high, "turns": distinct, "gaps": _gaps(low, high, distinct), "cost": None, "audit": None, "steps": None,
    }
    if whole:
        out["cost"], out["audit"] = whole_audit(kinds)
    else:
        out["steps"] = [dict(zip(("start", "end", "cost", "audit"), s, strict=True)) for s in part_audits(kinds)]
    return out


def _blocks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                yield _block(block, rows.values)

    def _block(block: int, rows: pa.StructArray) -> pa.RecordBatch:
        place, kind, known = (rows.field(n).to_pylist() for n in ("row", "kind", "known"))
        own = sorted((i for i, k in enumerate(kind) if k is not None), key=place.__getitem__)
        first = {p for p, k in zip(place, kind, strict=True) if k is None}  # marks of rows that are the first of their kind
        conv, turn = (rows.field(n).take(pa.array(own)).to_pylist() for n in ("conv_id", "turn"))
        blank = [known[i] for i in own]
        kinds = bytes(kind[i] if blank[at] or place[i] in first else kind[i] & 3 | MUST_GO for at, i in enumerate(own))
        starts = [0, *(i for i in range(1, len(own)) if conv[i] != conv[i - 1]), len(own)]
        out = []
        for n, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            inside = 0 < n < len(starts) - 2
            out.append({"conv_id": conv[a]} | _run(block, kinds[a:b], blank[a:b], turn[a:b], inside))
        return pa.RecordBatch.from_pylist(out, schema)

    return run


def _joined(schema: pa.Schema):
    """Parts of conversations, each one's in their order, to whole conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for part in batch.to_pylist():
                if now is None or now["conv_id"] != part["conv_id"]:
                    done += [ended(now)] if now else []
                    now = part | {"audits": Audits(), "front": {EMPTY: (0, 0)}}
                else:
                    add(now, part)
                now["front"] = now["audits"].advance(now["front"], [(s["start"], s["end"], s["cost"], s["audit"]) for s in part["steps"]])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now:
            yield pa.RecordBatch.from_pylist([ended(now)], schema)

    def add(now: dict, part: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            now[name] += part[name]
        now["illegal"] += INITIALS[now["last"]] + INITIALS[part["first"]] not in _LEGAL
        if part["low"] is not None:
            now["turns"] += part["turns"] - (now["high"] == part["low"])
            now["low"], now["high"] = part["low"] if now["low"] is None else now["low"], part["high"]
        now["last"] = part["last"]

    def ended(now: dict) -> dict:
        cost, audit = now["audits"].finished(now["front"])
        return {n: now[n] for n in schema.names if n in now} | {"gaps": _gaps(now["low"], now["high"], now["turns"]), "cost": cost, "audit": audit}

    return run


def audits(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation.

    A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated (it doesn't
    end in . ! or ?). gaps are turns missing between the least and the largest; illegal counts neighbours whose roles
    begin with other than su, ua or au. Rerole costs 1, a delete 2, an insert 5, and a truncated row that stays 5."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = conversations.sparkSession
    storage.small_batches(spark)
    rows = _in_order(conversations)
    kind, blank = kinds_of(F.col("role"), F.col("text"))
    slim = storage.materialize(rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "digest", kind.alias("kind"), blank.alias("blank")), "repair-rows")
    files = storage.tasks(spark, slim.count(), ROWS_PER_TASK)
    ordered = storage.materialize(slim.repartitionByRange(files, "conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER), "repair-order")
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint")
    placed = ordered.select("*", (file * (1 << 40) + F.col("_metadata.row_index")).alias("row"))
    firsts = placed.where(~F.col("blank")).groupBy("conv_id", "digest").agg(F.min("row").alias("row"))
    own = placed.select("row", "conv_id", "turn", "kind", F.col("blank").alias("known"))
    marks = firsts.select("row", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "kind", "known")])
    block = F.floor(F.col("row") / BLOCK).cast("bigint").alias("block")
    packed = own.unionByName(marks).groupBy(block).agg(F.collect_list(F.struct("row", "conv_id", "turn", "kind", "known")).alias("rows"))
    ids = conversations.select("conv_id").schema
    out = _schema(spark, ids, f"{_COUNTS}, {_RUN}")
    runs = storage.materialize(packed.mapInArrow(_blocks(to_arrow_schema(out)), out), "repair-runs")
    named = _schema(spark, ids, _COUNTS)
    parts = runs.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    joined = parts.mapInArrow(_joined(to_arrow_schema(named)), named)
    return runs.where("whole").select(*named.names).unionByName(joined)


def _schema(spark, ids, more: str):
    fields = spark.createDataFrame([], more).schema.fields
    kind = type(ids)([*ids.fields, *fields])
    kind[0].nullable = True
    return kind


def _edited(schema: pa.Schema):
    """Rows of each conversation in order, after one row with its audit, to the rows that the edits leave."""
    role_of = {USER: "user", ASSISTANT: "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, letter, at, state = None, "", 0, 0, EMPTY
        out: list[dict] = []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal at
            out.append({"conv_id": conv, "at": at, "edit": edit, "role": role, "text": text})
            at += 1

        def inserts() -> None:
            nonlocal letter, state
            while letter < len(audit) and audit[letter] == "I":
                state, letter = turn_of(state), letter + 1
                put("I", role_of[state], "")

        for batch in batches:
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    inserts()
                    conv, audit, letter, at, state = row["conv_id"], row["audit"], 0, 0, EMPTY
                    continue
                inserts()
                edit, letter = audit[letter], letter + 1
                if edit == "K":
                    state = _NEXT[state, row["role"][:1]]
                    put("K", row["role"], row["text"])
                elif edit == "R":
                    state = turn_of(state)
                    put("R", role_of[state], row["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        inserts()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, at (from 0), edit, role and text of the rows after the edits of `found` (conv_id, audit), each conversation's in one task and in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    storage.small_batches(conversations.sparkSession)
    rows = _in_order(conversations).select("*", F.lit(None).cast("string").alias("audit"))
    first = found.select("conv_id", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "digest")], "audit")
    streams = first.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER)
    out = _schema(conversations.sparkSession, conversations.select("conv_id").schema, "at bigint, edit string, role string, text string")
    return streams.select("conv_id", "role", "text", "audit").mapInArrow(_edited(to_arrow_schema(out)), out)


def _hashed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hasher = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["at"] == 0:
                    done += [{"conv_id": conv, "repaired_sha256": hasher.hexdigest()}] if hasher else []
                    conv, hasher = row["conv_id"], hashlib.sha256()
                else:
                    hasher.update(b"\n")
                hasher.update(f"{row['role']}:{row['text']}".encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if hasher:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": hasher.hexdigest()}], schema)

    return run


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of `role:text` of all rows with newlines between them; rows as `repaired` gives them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = _schema(rows.sparkSession, rows.select("conv_id").schema, "repaired_sha256 string")
    return rows.mapInArrow(_hashed(to_arrow_schema(out)), out)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of `conv_id:turn`, modulo 20: 0 dropped, 1 emptied, 2 without . ! and ?, 3 twice, 4 by a user."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(key[0], F.lit(":"), key[1])) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").withColumn("fault", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("fault")


def audited(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Audits of `rows` and the digests of what they leave, for each conv_id of `conversations`; zeros and empty ones without rows."""
    found = storage.materialize(audits(rows), "repair-audits")
    hashes = digests(repaired(rows, found)).withColumnRenamed("conv_id", "_of")
    ids = conversations.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = found.withColumnRenamed("conv_id", "_id")
    every = ids.join(found, ids.conv_id.eqNullSafe(found["_id"]), "left")
    return every.join(hashes, every.conv_id.eqNullSafe(hashes["_of"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
