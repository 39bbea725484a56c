"""Repair of the turn structure of conversations by depth-first branch-and-bound.

A conversation is a list of rows in order of turn. Edits keep a row, set its role to user or assistant, delete it, or insert an empty turn, at the costs
below; the roles must end up as an optional system turn and then pairs of user and assistant, or as nothing at all. :func:`repair` searches the edits with
an explicit stack. A node is a prefix of edits: its cost, its audit (the edits' initials in order), how many rows it has used and what the last
role was. The cheapest child comes first, so the first dive yields an incumbent; a node is left if its cost and a lower bound for the rest of the rows exceed the
incumbent's cost, or equal it with an audit that sorts later, or if the dominance table knows a better prefix for the same rows and last role. The stack
running empty proves the incumbent. Of two prefixes of equal cost at one node neither is the beginning of the other, so the table may compare audits.

How it is spread: rows are range-partitioned by conversation and turn, so a conversation with a third of all rows is many partitions. Each partition
streams its rows into blocks of ``BLOCK`` bytes, one for each row, without texts. A conversation of one block is searched at once; the blocks of a longer one are searched
in parallel for every last role before and after them, and a stream over its blocks adds them up. Texts meet the edits in a stream sorted by conversation,
which holds one audit (a letter for each edit) and a batch of rows at a time. A hash of a whole conversation is one pass over its text by
definition; that and the one audit are all that grows with a single conversation.

Defined results: rows of equal turn are in order of role, then of a hash of role and text; a null turn comes first; a null conversation is one like any
other; a null role or text is one space; a role counts by its first character, an empty one fits nowhere; a row is blank without a character other than white space,
else a duplicate if role and text came before, else truncated if its last such character is none of ``. ! ?``; a conversation without rows has no
result of :func:`plans`; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import common

#: Costs of edits; keeping is free. A truncated row that is not deleted costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a block.
BLOCK = 512

#: A row as a byte: its role's initial, then what is wrong with it.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
BLANK, DUPLICATE, CUT = 4, 8, 16
ROLE, FORCED = 3, BLANK | DUPLICATE
#: What the last role was.
NOTHING, AFTER_SYSTEM, ASKED, ANSWERED = range(4)
COMPLETE = (NOTHING, ANSWERED)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
NEXT = {NOTHING: ASKED, AFTER_SYSTEM: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}  # by an inserted or a changed role
FITS = {  # (last role, role of a kept row) -> last role
    (NOTHING, SYSTEM): AFTER_SYSTEM,
    (NOTHING, USER): ASKED,
    (AFTER_SYSTEM, USER): ASKED,
    (ANSWERED, USER): ASKED,
    (ASKED, ASSISTANT): ANSWERED,
}


def bounds(codes: bytes) -> list[int]:
    """The least that the rows from each place on can cost: each row by itself, and two more for each of the disjoint pairs of
    neighbours (but for rows that must go) whose roles cannot follow each other."""
    out, total, following = [0] * (len(codes) + 1), 0, None
    for i in range(len(codes) - 1, -1, -1):
        code = codes[i]
        role = code & ROLE
        if code & FORCED:
            total += DELETE
        else:
            alone = TRUNCATED if code & CUT else 0
            total += min(DELETE, alone + REROLE) if role == OTHER else alone
            if role == OTHER:
                following = None
            elif following is not None and (role, following) not in LEGAL:
                total += min(REROLE, INSERT, DELETE - TRUNCATED)
                following = None
            else:
                following = role
        out[i] = total
    return out


def repair(codes: bytes, entry: int = NOTHING, exits: tuple[int, ...] = COMPLETE) -> tuple[int, str, int] | None:
    """The least cost and, of its audits, the first in order of characters, and the last role; None if no edits lead to ``exits``."""
    n, least = len(codes), bounds(codes)
    known: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(n + 1)]  # the dominance table: the best prefix of each node
    known[0][entry] = (0, "")
    stack, best, last_role = [(0, "", 0, entry)], None, None
    while stack:
        cost, audit, at, last = stack.pop()
        if known[at][last] != (cost, audit):
            continue
        if best is not None and (cost + least[at] > best[0] or cost + least[at] == best[0] and audit > best[1][: len(audit)]):
            continue
        if at == n and last in exits and (best is None or (cost, audit) < best):
            best, last_role = (cost, audit), last
        children = [(cost + INSERT + least[at], cost + INSERT, audit + "I", at, NEXT[last])]
        if at < n:
            code, rest = codes[at], least[at + 1]
            children.append((cost + DELETE + rest, cost + DELETE, audit + "D", at + 1, last))
            if not code & FORCED:
                paid = cost + (TRUNCATED if code & CUT else 0)
                after = FITS.get((last, code & ROLE))
                if after is not None:
                    children.append((paid + rest, paid, audit + "K", at + 1, after))
                children.append((paid + REROLE + rest, paid + REROLE, audit + "R", at + 1, NEXT[last]))
        children.sort(reverse=True)
        for _, cost, audit, at, last in children:
            before = known[at][last]
            if before is None or (cost, audit) < before:
                known[at][last] = (cost, audit)
                stack.append((cost, audit, at, last))
    return None if best is None else (*best, last_role)


def ways(codes: bytes, whole: bool) -> list[tuple[int, int, int, str]]:
    """``(before, after, cost, audit)``: of a whole conversation its repair, of a block the best edits from and to each last role."""
    if whole:
        cost, audit, last = repair(codes)
        return [(NOTHING, last, cost, audit)]
    found = ((before, after, repair(codes, before, (after,))) for before in range(4) for after in range(4))
    return [(before, after, best[0], best[1]) for before, after, best in found if best]


def damage(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with the faults that a hash of key and turn picks for a row of twenty each: the row is gone, its text is empty, its sentence ends are gone, it is
    there twice, its role is user."""
    plain, old = common.guarded(conversations)
    name = F.concat(*(F.coalesce(c, F.lit(" ")) for c in (old[key].cast("string"), F.lit(":"), old[turn].cast("string"))))
    fault = F.crc32(name) % 20
    said = F.coalesce(old[text], F.lit(" "))
    new_text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    new_role = F.when(fault == 4, "user").otherwise(F.coalesce(old[role], F.lit(" ")))
    copies = plain.filter(fault != 0).withColumn("copy", F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return copies.select(*common.restored(old, {role: new_role, text: new_text}))


def _keyed(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, has, turn, role, h1, h2, text)``: the columns that order a conversation, and its text."""
    plain, old = common.guarded(rows)
    named, said = F.coalesce(old[role].cast("string"), F.lit(" ")), F.coalesce(old[text].cast("string"), F.lit(" "))
    return plain.select(
        old[key].alias("conv"), old[turn].isNotNull().alias("has"), old[turn].cast("long").alias("turn"), named.alias("role"),
        F.xxhash64(named, said).alias("h1"), F.xxhash64(F.lit("row"), named, said).alias("h2"), said.alias("text"),
    )


ORDER = ["conv", "has", "turn", "role", "h1", "h2"]


def _coded(text: Column, role: Column) -> Column:
    """The byte of a row, but for duplicates."""
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    wrong = F.when(~text.rlike(common.WORD), BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0)
    return (place + wrong).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks of codes; a row equal to the one before it is a duplicate, as is one whose role and text came at an earlier turn."""
    schema, number = None, 0
    before: tuple | None = None
    conv, codes, first, turns = None, bytearray(), None, []

    def block() -> pa.RecordBatch:
        low, high = (turns[0], turns[-1]) if turns else (None, None)
        row = [*first, number, bytes(codes), low, high, len(turns)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema, strict=True)], names=[*ORDER, "number", "codes", "low", "high", "turns"])

    for batch in batches:
        schema = schema or [batch.schema.field(c).type for c in ORDER] + [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = [batch.column(c).to_pylist() for c in ORDER]
        for row in zip(*columns, batch.column("code").to_pylist(), batch.column("later").to_pylist(), strict=True):
            place, code, later = row[:6], row[6], row[7]
            if codes and (place[0] != conv or len(codes) >= BLOCK):
                yield block()
                number += 1
                codes, turns = bytearray(), []
            if not codes:
                conv, first = place[0], place
            if not code & BLANK and (later or place == before):
                code = code & ROLE | DUPLICATE
            if place[1] and (not turns or turns[-1] != place[2]):
                turns.append(place[2])
            codes.append(code)
            before = place
    if codes:
        yield block()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each conversation, in order, added up to its report."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kind = None
    conv, state, counts, low, high, turns, last = None, None, None, None, None, 0, None

    def report() -> pa.RecordBatch:
        cost, audit = min(state[s] for s in COMPLETE if s in state)
        gaps = 0 if low is None else high - low + 1 - turns
        row = [conv, gaps, *counts, cost, audit]
        return pa.RecordBatch.from_arrays([pa.array([v], kind if i == 0 else pa.int64() if i < 7 else pa.string()) for i, v in enumerate(row)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv").type
        columns = [batch.column(c).to_pylist() for c in ("conv", "codes", "low", "high", "turns", "ways")]
        for name, codes, first_turn, last_turn, n, found in zip(*columns, strict=True):
            if state is None or name != conv:
                if state is not None:
                    yield report()
                conv, state, counts, low, high, turns, last = name, {NOTHING: (0, "")}, [0, 0, 0, 0], None, None, 0, None
            roles = [c & ROLE for c in codes]
            if last is not None:
                roles.insert(0, last)
            for i, bit in enumerate((BLANK, DUPLICATE, CUT)):
                counts[i] += sum(1 for c in codes if c & bit)
            counts[3] += sum(1 for pair in zip(roles, roles[1:], strict=False) if pair not in LEGAL)
            last = roles[-1]
            if n:
                turns += n - (high == first_turn)
                low, high = first_turn if low is None else low, last_turn
            after: dict[int, tuple[int, str]] = {}
            for way in found:
                if way["before"] in state:
                    cost, audit = state[way["before"]]
                    total = (cost + way["cost"], audit + way["audit"])
                    if way["after"] not in after or total < after[way["after"]]:
                        after[way["after"]] = total
            state = after
    if state is not None:
        yield report()


def plans(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Of each conversation of ``rows``: what is wrong with it (``gaps, blank, duplicate, truncated, illegal``), and ``cost`` and ``audit`` of its repair."""
    keyed = _keyed(rows, key, turn, role, text)
    narrow = keyed.select(*ORDER, _coded(F.col("text"), F.col("role")).alias("code"))
    first = F.min(F.struct("has", "turn"))
    repeated = narrow.groupBy("conv", "h1", "h2").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = repeated.select(F.col("conv").alias("conv2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    same = F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    later = F.coalesce(F.struct("has", "turn") > F.col("first"), F.lit(False))
    marked = narrow.join(repeated, same, "left").select(*ORDER, "code", later.alias("later"))
    of = keyed.schema["conv"].dataType.simpleString()
    schema = f"conv {of}, has boolean, turn long, role string, h1 long, h2 long, number long, codes binary, low long, high long, turns long"
    ranged = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    blocks = common.written(ranged.mapInArrow(_blocks, schema), "blocks")
    several = blocks.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv").alias("conv2"), F.lit(True).alias("several"))

    @F.udf("array<struct<before: int, after: int, cost: int, audit: string>>", useArrow=True)
    def searched(codes: bytes, whole: bool) -> list[tuple[int, int, int, str]]:
        return ways(codes, whole)

    split = blocks.join(several, F.col("conv").eqNullSafe(F.col("conv2")), "left")
    found = split.withColumn("ways", searched("codes", F.col("several").isNull()))
    added = found.select(*ORDER, "number", "codes", "low", "high", "turns", "ways").repartition("conv").sortWithinPartitions(*ORDER, "number")
    report = f"conv {of}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return added.mapInArrow(_added, report).withColumnRenamed("conv", key)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each conversation, its audit (None if it has no plan) and then its rows after the edits: ``(conversation, audit, None)`` and
    ``(conversation, turn, role, text, edit)`` in order. A conversation's audit comes before its rows."""
    names = {USER: "user", ASSISTANT: "assistant"}
    conv, audit, at, placed, odd, open_ = None, "", 0, 0, 0, False

    def inserted() -> Iterator[tuple]:
        nonlocal at, placed
        while at < len(audit) and audit[at] == "I":
            yield conv, None, names[USER if (placed - odd) % 2 == 0 else ASSISTANT], "", "I"
            at, placed = at + 1, placed + 1

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "kind", "turn", "role", "text", "audit")]
        for name, kind, turn, role, text, planned in zip(*columns, strict=True):
            if not open_ or name != conv:
                if open_:
                    yield from inserted()
                conv, audit, at, placed, odd, open_ = name, "", 0, 0, 0, True
                yield conv, planned if kind == PLAN else None, None
            if kind == PLAN:
                audit = planned
                odd = (len(audit) - audit.count("D")) % 2
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                if edit == "R":
                    role = names[USER if (placed - odd) % 2 == 0 else ASSISTANT]
                placed += 1
                yield conv, turn, role, text, edit
    if open_:
        yield from inserted()


PLAN, ROW = 0, 1


def _meeting(rows: DataFrame, planned: DataFrame, key: str, turn: str, role: str, text: str) -> tuple[DataFrame, str]:
    """Rows, each conversation's after its audit, in partitions by conversation; and the type of the key."""
    keyed = _keyed(rows, key, turn, role, text).withColumn("kind", F.lit(ROW))
    heads = planned.select(F.col(key).alias("conv"), F.lit(PLAN).alias("kind"), "audit")
    both = keyed.unionByName(heads, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", *ORDER[1:]), keyed.schema["conv"].dataType.simpleString()


def repaired(rows: DataFrame, planned: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of the repaired conversations: ``position`` from 0, ``turn`` (null where inserted), role, text, and the ``edit`` that each comes from."""
    both, of = _meeting(rows, planned, key, turn, role, text)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        kept, convs, at, kind = [], [], 0, pa.int64()

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(convs, kind), *columns], names=["conv", *schema.names])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        for row in _edited(seen()):
            if len(row) == 3:
                at = 0
                continue
            convs.append(row[0])
            kept.append((at, *row[1:]))
            at += 1
            if len(kept) >= 4096:
                yield batch_of()
                kept, convs = [], []
        if kept:
            yield batch_of()

    schema = f"conv {of}, position long, turn long, role string, text string, edit string"
    return both.mapInArrow(edit, schema).toDF(key, "position", "turn", "role", "text", "edit")


def digests(rows: DataFrame, planned: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``planned`` with ``repaired_sha256``: the hash of the repaired conversation's ``role:text`` lines."""
    both, of = _meeting(rows, planned, key, turn, role, text)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, hashes, kind, state, first = [], [], pa.int64(), None, True

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        for row in _edited(seen()):
            if len(row) == 3:
                if state is not None:
                    hashes.append(state.hexdigest())
                convs.append(row[0])
                state, first = hashlib.sha256(), True
                continue
            state.update(("" if first else "\n").encode() + f"{row[2]}:{row[3]}".encode())
            first = False
        if state is not None:
            hashes.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(hashes)], names=["conv", "repaired_sha256"])

    found = both.mapInArrow(digest, f"conv {of}, repaired_sha256 string")
    return planned.join(found, planned[key].eqNullSafe(found["conv"])).drop("conv")


def op13_conversation_repair(spark: SparkSession, directory: str) -> DataFrame:
    conversations = common.table(spark, directory, "conversations")
    rows = damage(conversations)
    planned = common.written(plans(rows), "plans")
    found = digests(rows, planned).withColumnRenamed("conv_id", "conv")
    every = conversations.select("conv_id").distinct()
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id",
        *counted,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
