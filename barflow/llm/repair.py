"""Conversation structure repair: the lightest derivation of a legal conversation, found on an agenda.

A conversation is a string of row codes: the class of the role's initial (``s``, ``u``, ``a`` or any other) and the row's fault.  The repair
is a derivation of weighted deductions over items: ``(p, i, q)`` says that the first i rows of a block are repaired on a way from state p of the
automaton of ``(s?(ua)+)?`` to state q.  Weights are pairs (cost, audit), where the audit spells the edits; they are compared by cost, then as ASCII
text.  Adding an edit never makes a weight less, and of two audits over the same rows at equal cost neither is a prefix of the
other (an insertion has a cost), so all deductions are monotone superior functions: an item popped from the agenda has its final weight, and a search ends as
soon as its goal is popped.  Long strings are cut into blocks of ``BLOCK`` rows; spans over blocks are put together by deductions with two
antecedents, pairwise, so weights stay as long as what they describe.

Rows reach Python in order, a range of (conversation, turn) in each task, as Arrow batches: a conversation over many tasks is summarised by each (a
weight for every pair of states), and the summaries are composed.  Texts pass through one hash of their conversation, a row at a time (SHA-256
has no parallel form); no task holds the rows or texts of a conversation.  What grows with it is its audit, which is a column of the result.

Defined results: null roles and texts are one space, null turns come first and count for no gap, a null conv_id is a conversation of its own.  Rows of one turn are
ordered by a digest of their role and text, so equal rows stand together.  Conversations without rows have zeros and an empty audit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import SPACE, kind, settle

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
# Added for a truncated row that is not deleted.
TRUNCATED = 1
# States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row.  The class of initials that each state takes next.
START, STATES, ENDS = 0, (0, 1, 2, 3), (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FILL = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
LEGAL = {"su", "ua", "au"}

# A row code is a letter: class of the initial + 4 * fault.
CLASSES, FAULTS = "suax", ("none", "truncated", "blank", "duplicate")
CODES = {chr(97 + c + 4 * f): (CLASSES[c], FAULTS[f]) for f in range(4) for c in range(4)}
BLOCK = 64
# The greatest long: a wider gap is told as this one.
MOST = 2**63 - 1
# Distinct code strings whose repair a worker remembers (a cache; it never changes a result).
REMEMBERED = 50_000

Weight = tuple[int, str]


def lightest(axioms: list[tuple[Weight, tuple]], consequences: Callable, goal: Callable[[tuple], bool] | None = None) -> dict[tuple, Weight]:
    """Final weights of all items up to the first goal, by Knuth's agenda.

    ``consequences(item, weight, final)`` gives the deductions that ``item`` completes with final items, as ``(item, weight)``.
    """
    agenda, final = [(weight, item) for weight, item in axioms], {}
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if goal is not None and goal(item):
            break
        for other, heavier in consequences(item, weight, final):
            if other not in final:
                heapq.heappush(agenda, (heavier, other))
    return final


def _edits(codes: str) -> Callable:
    """Deductions with one antecedent: one edit at the next row, or an insertion before it."""

    def consequences(item: tuple, weight: Weight, final: dict) -> Iterator[tuple[tuple, Weight]]:
        p, i, q = item
        cost, audit = weight
        yield (p, i, FILL[q][1]), (cost + COST[INSERT], audit + INSERT)
        if i == len(codes):
            return
        initial, fault = CODES[codes[i]]
        yield (p, i + 1, q), (cost + COST[DELETE], audit + DELETE)
        if fault in ("blank", "duplicate"):
            return
        more = cost + (TRUNCATED if fault == "truncated" else 0)
        if (q, initial) in NEXT:
            yield (p, i + 1, NEXT[q, initial]), (more + COST[KEEP], audit + KEEP)
        yield (p, i + 1, FILL[q][1]), (more + COST[REROLE], audit + REROLE)

    return consequences


def _joined(item: tuple, weight: Weight, final: dict) -> Iterator[tuple[tuple, Weight]]:
    """Deductions with two antecedents: neighbouring spans that meet in a state.  Items are (side, p, q)."""
    side, p, q = item
    for r in STATES if side in "lr" else ():
        other = ("r", q, r) if side == "l" else ("l", r, p)
        if other in final:
            (a, left), (b, right) = (weight, final[other]) if side == "l" else (final[other], weight)
            yield (("both", p, r) if side == "l" else ("both", r, q)), (a + b, left + right)


Span = dict[tuple[int, int], Weight]


def compose(left: Span, right: Span) -> Span:
    """Weights of two neighbouring spans taken together, for all pairs of states."""
    axioms = [(w, ("l", *k)) for k, w in left.items()] + [(w, ("r", *k)) for k, w in right.items()]
    return {(p, q): w for (side, p, q), w in lightest(axioms, _joined).items() if side == "both"}


def span(codes: str, starts: tuple[int, ...] = STATES) -> Span:
    """Lightest weight of a string of row codes for every way from a start state to a state."""
    n = min(len(codes), BLOCK)
    final = lightest([((0, ""), (p, 0, p)) for p in starts], _edits(codes[:n]))
    parts = [{(p, q): w for (p, i, q), w in final.items() if i == n}]
    if n < len(codes):
        parts += [span(codes[at : at + BLOCK]) for at in range(n, len(codes), BLOCK)]
    while len(parts) > 1:
        parts = [compose(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _whole(found: Span) -> Weight:
    return min(w for (p, q), w in found.items() if p == START and q in ENDS)


def repair(codes: str) -> Weight:
    """(cost, audit) of the lightest repair of a whole conversation."""
    if len(codes) > BLOCK:
        return _whole(span(codes, (START,)))
    n = len(codes)
    goal = lambda item: item[1] == n and item[2] in ENDS
    final = lightest([((0, ""), (START, 0, START))], _edits(codes), goal)
    return next(w for item, w in final.items() if goal(item))


# --- rows ------------------------------------------------------------------------------------------


def damaged(df: DataFrame, every: int = 20) -> DataFrame:
    """``conv_id, turn, role, text, copies``: the rows after damage; dropped rows have no copies."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = df.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "utf-8")).alias("_h"))
    kind_ = F.col("_h") % every
    return d.select(
        "conv_id", "turn", F.when(kind_ == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind_ == 1, "").when(kind_ == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind_ == 0, 0).when(kind_ == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def digest() -> Column:
    """128 bits that stand for a role and text (the role's length keeps them apart)."""
    return F.unhex(F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), "utf-8")))


def _code() -> Column:
    """Class of the role's initial and the row's own fault (blank or truncated) as a number, see ``CODES``."""
    initial = F.substring("role", 1, 1)
    group = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", 2).when(F.substring(body, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    return (group + 4 * fault).cast("int")


def _narrow(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, code, copies, first``: equal rows of a turn as one; ``first`` marks the turn in which a role and text are first seen."""
    d = rows.select("conv_id", "turn", digest().alias("digest"), _code().alias("code"), "copies")
    d = d.groupBy("conv_id", "turn", "digest", "code").agg(F.sum("copies").alias("copies"))
    d = settle(d, "repair-rows")
    seen = d.where("copies > 0").groupBy(F.col("conv_id").alias("_c"), F.col("digest").alias("_d")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d"))
    return d.join(seen, same, "left").select("conv_id", "turn", "digest", "code", "copies", F.col("turn").eqNullSafe(F.col("_first.turn")).alias("first"))


_SPANS = "array<struct<p:int,q:int,cost:bigint,audit:string>>"
_STATS = ["blank", "duplicate", "truncated", "illegal", "turns", "rows"]


class _Part:
    """A task's rows of one conversation, taken in order."""

    def __init__(self, conv, turn, digest_: bytes):
        self.at = (conv, turn, digest_)
        self.codes: list[str] = []
        self.count = dict.fromkeys(_STATS, 0)
        self.low = self.high = None

    def take(self, turn, code: int, copies: int, first: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.count["turns"] += 1
        group, fault = code % 4, code // 4
        again = group + 12 if fault != 2 else code  # blank comes before duplicate
        codes = chr(97 + (code if first else again)) + chr(97 + again) * (copies - 1)
        last = CODES[self.codes[-1][-1]][0] if self.codes else None
        inner = CODES[codes[0]][0]
        self.count["illegal"] += (last is not None and last + inner not in LEGAL) + (copies - 1)  # equal initials are never legal
        self.codes.append(codes)
        self.count["rows"] += copies
        for c, n in ((codes[0], 1), (codes[-1], copies - 1)):
            name = CODES[c][1]
            if name != "none":
                self.count[name] += n


def _summaries(rows: DataFrame, conv_type: str, turn_type: str) -> DataFrame:
    """One row for each conversation and task that met it: counts, edges, and its spans."""
    names = ["conv_id", "at_turn", "at_digest", *_STATS, "low", "high", "first_class", "last_class", "spans"]
    schema = f"conv_id {conv_type}, at_turn {turn_type}, at_digest binary, " + ", ".join(f"{c} bigint" for c in _STATS) + f", low {turn_type}, high {turn_type}, first_class string, last_class string, spans {_SPANS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(REMEMBERED)(repair)

        def told(parts: list[tuple[_Part, bool]], types) -> pa.RecordBatch:
            out = {n: [] for n in names}
            for part, whole in parts:
                codes = "".join(part.codes)
                if whole:
                    found = {(START, 3): known(codes) if len(codes) <= BLOCK else repair(codes)}
                else:
                    found = span(codes)
                ends = (CODES[codes[0]][0], CODES[codes[-1]][0]) if codes else (None, None)
                row = (*part.at, *part.count.values(), part.low, part.high, *ends, [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in found.items()])
                for n, v in zip(names, row):
                    out[n].append(v)
            spans = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            types = [types[0], types[1], pa.binary(), *[pa.int64()] * len(_STATS), types[1], types[1], pa.string(), pa.string(), spans]
            return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names)

        # the first and the last conversation of a task may have rows in other tasks
        now, begun, ready, types = None, True, [], None
        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(1).type]
            for conv, turn, digest_, code, copies, first in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or conv != now.at[0]:
                    if now is not None:
                        ready.append((now, not begun))
                        begun = False
                    now = _Part(conv, turn, digest_)
                now.take(turn, code, copies, first)
            if len(ready) >= 1000:
                yield told(ready, types)
                ready = []
        if now is not None:
            yield told([*ready, (now, False)], types)

    order = ["conv_id", "turn", "digest"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "code", "copies", "first").mapInArrow(run, schema)


def _verdicts(parts: DataFrame, conv_type: str) -> DataFrame:
    """One row a conversation from its summaries in order."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = f"conv_id {conv_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, ready, conv_arrow = None, None, [], None

        def closed() -> dict:
            cost, audit = _whole(found)
            width = 0 if now["low"] is None else min(now["high"] - now["low"] + 1 - now["turns"], MOST)
            return {"conv_id": now["conv_id"], "gaps": width, **{c: now[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}

        def told() -> pa.RecordBatch:
            types = [conv_arrow, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in ready], t) for n, t in zip(names, types)], names)

        for batch in batches:
            conv_arrow = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                spans = {(s["p"], s["q"]): (s["cost"], s["audit"]) for s in row["spans"]}
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        ready.append(closed())
                    now, found = row, spans
                    continue
                found = compose(found, spans)
                shared = now["high"] is not None and now["high"] == row["low"]
                edge = now["rows"] and row["rows"] and now["last_class"] + row["first_class"] not in LEGAL
                for c in _STATS:
                    now[c] += row[c]
                now["turns"] -= shared
                now["illegal"] += bool(edge)
                now["low"] = row["low"] if now["low"] is None else now["low"]
                now["high"] = now["high"] if row["high"] is None else row["high"]
                now["last_class"] = row["last_class"] or now["last_class"]
            if len(ready) >= 1000:
                yield told()
                ready = []
        if now is not None:
            ready.append(closed())
            yield told()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "at_turn", "at_digest").mapInArrow(run, schema)


def _rewritten(rows: DataFrame, verdicts: DataFrame, conv_type: str, turn_type: str) -> DataFrame:
    """``verdicts`` with the SHA-256 of the repaired rows: each conversation's verdict, then its rows in order, pass through one hash."""
    heads = [c for c in verdicts.columns if c != "conv_id"]
    texts = rows.where("copies > 0").select("conv_id", "turn", digest().alias("digest"), "role", "text", "copies")
    stack = verdicts.select("conv_id", F.struct(*heads).alias("verdict")).unionByName(texts, allowMissingColumns=True)
    ordered = stack.repartition("conv_id").sortWithinPartitions("conv_id", F.col("verdict").isNull(), "turn", "digest").select("conv_id", "verdict", "role", "text", "copies")
    names = ["conv_id", "verdict", "repaired_sha256"]
    schema = f"conv_id {conv_type}, verdict {verdicts.select(F.struct(*heads).alias('v')).schema['v'].dataType.simpleString()}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, head, ready, types = None, None, [], None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in ready], t) for k, t in enumerate([*types, pa.string()])], names)

        for batch in batches:
            types = [batch.schema.field("conv_id").type, batch.schema.field("verdict").type]
            for conv, verdict, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if verdict is not None:
                    if writer is not None:
                        ready.append((*head, writer.close()))
                    writer, head = Writer(verdict["audit"]), (conv, verdict)
                else:
                    for _ in range(copies):
                        writer.row(role, text)
            if len(ready) >= 1000:
                yield told()
                ready = []
        if writer is not None:
            ready.append((*head, writer.close()))
            yield told()

    return ordered.mapInArrow(run, schema).select("conv_id", "verdict.*", "repaired_sha256")


class Writer:
    """Applies an audit to rows given in order, and hashes what is left."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            role, self.state = FILL[self.state]
            self._write(role, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == KEEP:
            self.state = NEXT[self.state, role[0]]
            self._write(role, text)
        elif edit == REROLE:
            role, self.state = FILL[self.state]
            self._write(role, text)

    def close(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every conversation of ``conv_id, turn, role, text, copies``.

    A row with zero copies only tells that its conversation exists.
    """
    conv, turn = kind(rows, "conv_id"), kind(rows, "turn")
    verdicts = _verdicts(_summaries(_narrow(rows), conv, turn), conv)
    return _rewritten(rows, verdicts, conv, turn)
