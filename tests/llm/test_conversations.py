import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import conversations as c

DATA = "/root/testdata/sf0.001"
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
WORD = re.compile(r"[^\x20\x09-\x0D]")


def judged(rows):
    """The first fault of each row, by plain rules."""
    out, seen = [], set()
    for role, text in rows:
        words = WORD.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """``(cost, audit, repaired)`` by growing all edits, one row at a time, with the best one kept for each string of roles that can still become legal."""
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    best = {"": (0, "", ())}

    def put(to, last, new, value):
        if (last, new) in legal and (new not in to or value[:2] < to[new][:2]):
            to[new] = value

    def grown(now):
        for _ in range(2):  # two inserts in a row at most: more can be left out
            for last, (cost, audit, text) in list(now.items()):
                for new in ("user", "assistant"):
                    put(now, last, new[0], (cost + 2, audit + "I", (*text, (new, ""))))
        return now

    best = grown(best)
    for (role, text), fault in zip(rows, faults, strict=True):
        to = {}
        for last, (cost, audit, kept) in best.items():
            deleted = (cost + 3, audit + "D", kept)
            if last not in to or deleted[:2] < to[last][:2]:
                to[last] = deleted
            if fault not in ("blank", "duplicate"):
                paid = cost + (fault == "truncated")
                put(to, last, role[:1], (paid, audit + "K", (*kept, (role, text))))
                for new in ("user", "assistant"):
                    put(to, last, new[0], (paid + 2, audit + "R", (*kept, (new, text))))
        best = grown(to)
    return min((v for k, v in best.items() if k in ("", "a")), key=lambda v: v[:2])


def every_edit(codes):
    """The best edits among all, for a few rows."""
    options = []
    for gap in range(len(codes) + 1):
        options.append(["", "I", "II"])
        if gap < len(codes):
            options.append(["D"] if codes[gap] & c.FORCED else ["D", "K", "R"])
    best = None
    for pick in itertools.product(*options):
        audit = "".join(pick)
        cost, states, at = 0, {""}, 0
        for edit in audit:
            cost += COST[edit]
            code = codes[at] if edit != "I" else 0
            at += edit != "I"
            if edit in "KR":
                cost += bool(code & c.CUT)
            if edit == "K":
                states = {s + "sua?"[code & c.ROLE] for s in states}
            elif edit in "RI":
                states = {s + r for s in states for r in "ua"}
        if any(re.fullmatch(r"(s?(ua)+)?", s) for s in states) and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


def random_codes(pick, n):
    return bytes(pick.randrange(4 if pick.random() < 0.2 else 3) | pick.choice([0, 0, 0, c.BLANK, c.DUPLICATE, c.CUT]) for _ in range(n))


def test_search_against_all_edits():
    pick = random.Random(1)
    for n in (0, 1, 2, 3, 4):
        for _ in range(3 if n == 4 else 20):
            codes = random_codes(pick, n)
            assert c.repair(codes)[:2] == every_edit(codes), list(codes)


def test_search_on_long_and_bad_conversations():
    pick = random.Random(2)
    for codes in [random_codes(pick, 300), bytes([1] * 200), bytes([1, 2] * 200), bytes([2, 1] * 100), bytes([0] * 150), bytes([3] * 100), bytes([1, 1, 2, 2] * 60)]:
        rows = [(["system", "user", "assistant", "tool"][x & 3], "") for x in codes]
        faults = ["blank" if x & c.BLANK else "duplicate" if x & c.DUPLICATE else "truncated" if x & c.CUT else "" for x in codes]
        assert c.repair(codes)[:2] == cheapest(rows, faults)[:2]
        bound = c.bounds(codes)
        assert bound[0] <= c.repair(codes)[0] and bound[-1] == 0


def expected(rows):
    """The result of a whole query, by plain Python, for ``(conv, turn, role, text)``."""
    kept, everyone = defaultdict(list), set()
    for conv, turn, role, text in rows:
        everyone.add(conv)
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept[conv] += [(turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    out = {}
    for conv in everyone:
        mine = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in mine if t is not None]
        faults = judged([r[1:] for r in mine])
        cost, audit, repaired = cheapest([r[1:] for r in mine], faults)
        pairs = zip(mine, mine[1:], strict=False)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_against_plain_python(spark):
    source = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = expected([tuple(r) for r in source.select("conv_id", "turn", "role", "text").collect()])
    got = {r["conv_id"]: tuple(r[n] for n in COLUMNS) for r in c.op13_conversation_repair(spark, DATA).collect()}
    assert got == want


ODD = [
    (1, None, "user", "hello."), (1, None, None, None), (1, 3, "tool", "x"), (1, 3, "", "y."), (1, 9, "assistant", " \t\n"), (2, 0, "system", "be kind."),
    (2, 1, "user", "hi"), (2, 2, "assistant", "ho!"), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, 2, "assistant", "b."), (3, None, None, None),
]


@pytest.fixture
def served(spark, tmp_path):
    def of(rows):
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        frame.select("*", F.lit(1).alias("has"), F.lit(2).alias("kind"), F.lit(3).alias("conv"), F.lit(4).alias("AUDIT")).write.parquet(f"{tmp_path}/conversations.parquet")
        return {r["conv_id"]: tuple(r[n] for n in COLUMNS) for r in c.op13_conversation_repair(spark, str(tmp_path)).collect()}

    return of


def test_nulls_empty_texts_and_ties(served):
    got, want = served(ODD), expected(ODD)
    assert got == want and set(got) == {1, 2, 3, None}


def test_no_rows(served):
    assert served([]) == {}


def test_one_conversation_with_most_rows_is_searched_in_blocks(served, monkeypatch):
    pick, rows = random.Random(3), []
    for turn in range(700):
        rows.append((7, turn, pick.choice(["user", "assistant", "assistant", "user", "system"]), pick.choice(["one.", "two!", f"t{turn}.", f"u{turn}"])))
    rows += [(8, t, "user", f"{t}?") for t in range(9)]
    monkeypatch.setattr(c, "BLOCK", 16)
    assert served(rows) == expected(rows)


def test_rows_of_repaired_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "assistant", "d.")], "conv_id long, turn long, role string, text string")
    planned = c.plans(rows)
    assert {(r["conv_id"], r["cost"], r["audit"]) for r in planned.collect()} == {(1, 2, "KIKK"), (2, 2, "IK")}
    got = sorted(map(tuple, c.repaired(rows, planned).collect()))
    assert got == [
        (1, 0, 0, "user", "a.", "K"), (1, 1, None, "assistant", "", "I"), (1, 2, 1, "user", "b.", "K"), (1, 3, 2, "assistant", "c.", "K"),
        (2, 0, None, "user", "", "I"), (2, 1, 0, "assistant", "d.", "K"),
    ]
