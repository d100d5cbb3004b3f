"""The agenda against all short edit sequences, spans against whole strings, and the query against a plain loop over conversations."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barflow.llm import repair
from barflow.llm.queries import op13

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def all_repairs(codes):
    """(cost, audit) of every legal result with at most two insertions in a place."""
    fills = [""] + ["".join(f) for n in (1, 2) for f in itertools.product("ua", repeat=n)]
    places = []
    for c in codes:
        initial, fault = repair.CODES[c]
        extra = fault == "truncated"
        options = [(3, "D", "")]
        if fault in ("none", "truncated"):
            options += [(0 + extra, "K", initial), (2 + extra, "R", "u"), (2 + extra, "R", "a")]
        places.append([(2 * len(f) + cost, "I" * len(f) + e, f + out) for f in fills for cost, e, out in options])
    places.append([(2 * len(f), "I" * len(f), f) for f in fills])
    for combo in itertools.product(*places):
        if LEGAL.match("".join(o for _, _, o in combo)):
            yield sum(c for c, _, _ in combo), "".join(e for _, e, _ in combo)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_strings_against_all_edits(n):
    for codes in itertools.product(repair.CODES, repeat=n):
        assert repair.repair("".join(codes)) == min(all_repairs(codes))


def test_three_rows_against_all_edits():
    rng = random.Random(4)
    for _ in range(25):
        codes = "".join(rng.choice("abcdefgijm") for _ in range(3))
        assert repair.repair(codes) == min(all_repairs(codes))


def relaxed(codes):
    """The lightest repair by relaxing all states row by row until nothing changes."""
    best = {0: (0, "")}

    def inserts(d):
        changed = True
        while changed:
            changed = False
            for q, (c, a) in list(d.items()):
                role, to = repair.FILL[q]
                if to not in d or (c + 2, a + "I") < d[to]:
                    d[to], changed = (c + 2, a + "I"), True
        return d

    for code in codes:
        initial, fault = repair.CODES[code]
        new = {}
        for q, (c, a) in inserts(best).items():
            ways = [(q, c + 3, "D")]
            if fault in ("none", "truncated"):
                extra = fault == "truncated"
                ways.append((repair.FILL[q][1], c + 2 + extra, "R"))
                if (q, initial) in repair.NEXT:
                    ways.append((repair.NEXT[q, initial], c + extra, "K"))
            for to, cost, e in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost, a + e))
        best = new
    return min(w for q, w in inserts(best).items() if q in (0, 3))


@pytest.mark.parametrize("n", [5, 63, 64, 65, 300, 1000])
def test_blocks_and_parts_equal_whole_strings(n):
    rng = random.Random(n)
    for _ in range(3):
        codes = "".join(rng.choice("aabbbcccdefgijmn") for _ in range(n))
        want = relaxed(codes)
        assert repair.repair(codes) == want
        cut = rng.randrange(n)
        assert repair._whole(repair.compose(repair.span(codes[:cut]), repair.span(codes[cut:]))) == want


def plain(rows):
    """The contract over a list of (conv, turn, role, text), one conversation at a time."""
    shown = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        role, text = shown(role), shown(text)
        h = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role = "user" if h == 4 else role
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        convs.setdefault(conv, []).extend([(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    out = {}
    for conv, kept in convs.items():
        digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        codes, seen, counts = "", set(), dict.fromkeys(("none", "truncated", "blank", "duplicate"), 0)
        for _, role, text in kept:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none"
            seen.add((role, text))
            counts[fault] += 1
            codes += chr(97 + ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + 4 * repair.FAULTS.index(fault))
        initials = [r[1][:1] for r in kept]
        turns = {r[0] for r in kept} - {None}
        cost, audit = relaxed(codes)
        lines, state, at = [], 0, 0
        for e in audit:
            if e == "I":
                role, state = repair.FILL[state]
                lines.append(f"{role}:")
                continue
            _, role, text = kept[at]
            at += 1
            if e == "K":
                state = repair.NEXT[state, role[0]]
            elif e == "R":
                role, state = repair.FILL[state]
            if e != "D":
                lines.append(f"{role}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, path):
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13(spark, str(path)).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == plain(rows) and len(got) == len({r[0] for r in rows})


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_on_the_given_table(spark):
    check(spark, SF)


def test_query_on_odd_rows_and_a_long_conversation(spark, tmp_path):
    rng = random.Random(9)
    texts = ["Yes.", "No!", "Why?", "so", "", " \n", None, "Ünï。", "a." * 9000, "x\x0b"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "a", "s"]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, 0, 1, 2, 3, 7, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(150)]
    rows += [(77, i // 2, rng.choice(["user", "assistant"]), f"line {i % 50}" + rng.choice([".", ""])) for i in range(700)]  # most of the rows
    rows += [(i, 0, "user", "Hi.") for i in range(100, 140)] + [(5, None, None, None), (6, 1, "user", "Hi.")] + rows[:10]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "copies", "code", "audit", "verdict", "spans")})
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    check(spark, tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, tmp_path)
        parts = repair._summaries(repair._narrow(repair.damaged(df)), "bigint", "bigint")
        assert parts.where("conv_id = 77").count() > 1  # the long conversation is split over tasks
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert op13(spark, str(tmp_path)).count() == 0
