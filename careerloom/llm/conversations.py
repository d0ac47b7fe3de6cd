"""Repair of conversations: the cheapest edits that make turns alternate, with their audit string.

A conversation is read turn by turn. What may come next depends on four states: nothing yet, a system turn, a user turn,
an assistant turn. A macro edit is a run of inserted turns and what happens to the turn after it. Its initials (``I`` up to twice, then ``D``, ``K`` or ``R``)
end with the only letter that is not ``I``, so no code is the start of another, and edits in the order of their codes
are audit strings in their order. After each turn, a state keeps its cost and the rank of its audit string among the four
states; strings are never built before the cheapest way is read back over the parents.

A block of turns is, for what comes before and after it, a cost and a rank for each pair of states. So a conversation of any
length is worked on in blocks: their tables are made apart, combined in order, and each block is then solved between its two states.
"""

from __future__ import annotations

import array
import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Turns and text bytes of a block at most; one longer text is a block of its own.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Costs of a changed role, a deleted turn, an inserted turn, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_BLANK = " \t\n\v\f\r"
_STATES, _FAR = 4, 1 << 50
_ROLES = {"u": "user", "a": "assistant"}
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_CODES = sorted("I" * k + x for k, x in product(range(3), "DKR"))
#: What is inserted at the end, by state.
_TAIL = ("", "ua", "a", "")


def _tables() -> tuple[np.ndarray, np.ndarray, dict]:
    """Cost, code and macro edit of the best way from state to state, by a turn's class: 3 * initial + fault."""
    cost, code, macro = np.full((12, _STATES, _STATES), _FAR, np.int64), np.zeros((12, _STATES, _STATES), np.int64), {}
    for at, first in enumerate(("s", "u", "a", "")):
        for fault in range(3):
            for f, k in product(range(_STATES), range(3)):
                g, put = f, ""
                for _ in range(k):
                    role = "a" if g == 2 else "u"
                    g, put = _NEXT[g, role], put + role
                stay = TRUNCATED * (fault == 2)
                ways = [("D", None, g, DELETE)]
                if fault != 1:
                    ways += [(x, role, _NEXT.get((g, role or first)), c + stay) for x, role, c in (("K", None, 0), ("R", "u", REROLE), ("R", "a", REROLE))]
                for x, role, to, c in ways:
                    if to is None:
                        continue
                    way = INSERT * k + c, _CODES.index("I" * k + x)
                    if way < (cost[3 * at + fault, f, to], code[3 * at + fault, f, to]):
                        cost[3 * at + fault, f, to], code[3 * at + fault, f, to] = way
                        macro[3 * at + fault, f, to] = put, x, role
    return cost, code, macro


_COST, _CODE, _MACRO = _tables()


def forward(classes: list[np.ndarray], cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Costs and ranks of the four states after all turns of each lane, and each layer's parents. Lanes come longest first."""
    cost, rank, parents = cost.copy(), rank.copy(), []
    lengths = np.array([len(c) for c in classes])
    turns = np.zeros((len(classes), lengths[0] if len(lengths) else 0), np.int64)
    for row, c in zip(turns, classes, strict=True):
        row[: len(c)] = c
    for i in range(turns.shape[1]):
        m = int(np.searchsorted(-lengths, -i, "left"))  # lanes that have a turn i
        kind = turns[:m, i]
        total = cost[:m, :, None] + _COST[kind]
        best = (total * _STATES + rank[:m, :, None]).argmin(1)
        to = np.arange(_STATES)
        cost[:m] = np.minimum(np.take_along_axis(total, best[:, None, :], 1)[:, 0], _FAR)
        order = np.take_along_axis(rank[:m], best, 1) * len(_CODES) + _CODE[kind[:, None], best, to]
        order[cost[:m] >= _FAR] = 1 << 20
        rank[:m] = order.argsort(1, kind="stable").argsort(1, kind="stable")
        parents.append(best.astype(np.int8))
    return cost, rank, parents


def backward(lengths: list[int], parents: list[np.ndarray], last: np.ndarray) -> np.ndarray:
    """States before and after each turn: ``[lane, i]`` is the state before turn i, ``[lane, length]`` the given last one."""
    out = np.zeros((len(lengths), len(parents) + 1), np.int8)
    now = last.astype(np.int64)
    out[np.arange(len(lengths)), lengths] = now
    for i in range(len(parents) - 1, -1, -1):
        m = len(parents[i])
        now[:m] = parents[i][np.arange(m), now[:m]]
        out[:m, i] = now[:m]
    return out


def _start(n: int, entry=None) -> tuple[np.ndarray, np.ndarray]:
    cost = np.full((n, _STATES), _FAR, np.int64)
    cost[np.arange(n), 0 if entry is None else entry] = 0
    return cost, np.tile(np.arange(_STATES), (n, 1))


def ending(cost, rank) -> tuple[int, int]:
    """The last state of the cheapest way, and its cost with what is inserted after it."""
    c, _, t = min((int(cost[t]) + INSERT * len(_TAIL[t]), int(rank[t]), t) for t in range(_STATES))
    return t, c


class Turns:
    """Turns in order, with what each lacks. ``first``: places that are the first of their role and text, where turns before are elsewhere."""

    def __init__(self, turns: list, roles: list[str], texts: list[str], first: set[int] | None = None) -> None:
        self.turns, self.roles, self.texts = turns, roles, texts
        seen: set = set()
        faults, initials = [], []
        for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
            said = text.rstrip(_BLANK)
            repeated = i not in first if first is not None else (role, text) in seen
            if first is None:
                seen.add((role, text))
            # counts blank, duplicate, truncated as 1, 2, 3
            faults.append(1 if not said else 2 if repeated else 3 if said[-1] not in ".!?" else 0)
            initials.append(role[:1])
        self.faults = np.array(faults, np.int64)
        self.classes = np.array([3 * ("sua".find(x) if x and x in "sua" else 3) for x in initials], np.int64) + np.array([0, 1, 1, 2])[self.faults]
        self.counts = [int((self.faults == k).sum()) for k in (1, 2, 3)]
        self.illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        self.ends = (initials[0], initials[-1]) if initials else (None, None)
        known = [t for t in turns if t is not None]
        self.span = (min(known), max(known), len(set(known))) if known else (None, None, 0)

    def repaired(self, states, tail: str = "") -> tuple[str, list[str]]:
        """Audit string and lines ``role:text`` of the edits between the states."""
        audit, lines = [], []
        for i, kind in enumerate(self.classes.tolist()):
            put, x, role = _MACRO[kind, int(states[i]), int(states[i + 1])]
            audit.append("I" * len(put) + x)
            lines += [f"{_ROLES[r]}:" for r in put]
            if x != "D":
                lines.append(f"{_ROLES[role] if role else self.roles[i]}:{self.texts[i]}")
        return "".join(audit) + "I" * len(tail), lines + [f"{_ROLES[r]}:" for r in tail]


def solved(convs: list[Turns]) -> list[tuple]:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of whole conversations."""
    order = sorted(range(len(convs)), key=lambda k: -len(convs[k].classes))
    lanes = [convs[k].classes for k in order]
    cost, rank, parents = forward(lanes, *_start(len(lanes)))
    ends = [ending(c, r) for c, r in zip(cost, rank, strict=True)]
    states = backward([len(x) for x in lanes], parents, np.array([t for t, _ in ends], np.int64))
    out: list = [None] * len(convs)
    for k, way, (t, c) in zip(order, states, ends, strict=True):
        conv = convs[k]
        audit, lines = conv.repaired(way, _TAIL[t])
        low, high, n = conv.span
        out[k] = (high - low + 1 - n if n else 0, *conv.counts, conv.illegal, c, audit, hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest())
    return out


_RESULT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
_ROWS = [("turns", "array<bigint>"), ("roles", "array<string>"), ("texts", "array<string>")]


def _schema(kind: T.DataType, *fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields]])


def _sent(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    shape = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)


def _blocks(schema: T.StructType):
    """Rows in order to solved conversations, and blocks of those that other partitions may have turns of or that have several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq, done, size = 0, [], 0
        rows: list[tuple] = []
        conv, held, started, cut = None, 0, False, True  # the first conversation may have begun in another partition

        def block() -> tuple:
            nonlocal seq
            seq += 1
            return (conv, (part << 32) + seq, *[None] * len(_RESULT), *([r[k] for r in rows] for k in range(3)))

        for batch in batches:
            for c, turn, role, text, present in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not started or c != conv:
                    if started and cut:
                        yield _sent([block()], schema)
                    elif started:
                        done.append((conv, rows))
                        size += held
                        if size >= BLOCK_BYTES or len(done) >= BLOCK:
                            yield whole(done)
                            done, size = [], 0
                    cut = not started
                    conv, rows, held, started = c, [], 0, True
                if present:
                    rows.append((turn, role, text))
                    held += len(text) + 32
                    if len(rows) >= BLOCK or held >= BLOCK_BYTES:
                        yield _sent([block()], schema)
                        rows, held, cut = [], 0, True
        if done:
            yield whole(done)
        if started:  # the last conversation may go on in another partition
            yield _sent([block()], schema)

    def whole(convs: list) -> pa.RecordBatch:
        got = solved([Turns(*([r[k] for r in rows] for k in range(3))) for _, rows in convs])
        return _sent([(c, 0, *g, None, None, None) for (c, _), g in zip(convs, got, strict=True)], schema)

    return run


def _turns(batch: pa.RecordBatch) -> Iterator[tuple[dict, Turns]]:
    for r in batch.to_pylist():
        yield r, Turns(r["turns"], r["roles"], r["texts"], set(r["first"] or []))


def _summaries(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, t in _turns(batch):
                # a lane for each state that the block may be entered in
                cost, rank, _ = forward([t.classes] * _STATES, *_start(_STATES, np.arange(_STATES)))
                yield _sent([(r["conv_id"], r["block"], cost.ravel().tolist(), rank.ravel().tolist(), *t.counts, t.illegal, *t.ends, *t.span)], schema)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows with whether each is the first of its conversation."""
    before: tuple = ()
    for batch in batches:
        for r in batch.to_pylist():
            yield before != (r["conv_id"],), r
            before = (r["conv_id"],)


def _walked(schema: T.StructType):
    """Tables of blocks, in order, to the states between which each block is solved; the last block's row has the totals.

    Of a conversation, four parents and an id are kept for each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ids, back, total = None, array.array("q"), bytearray(), []
        cost, rank, end, high = np.array([]), np.array([]), None, None

        def whole() -> Iterator[pa.RecordBatch]:
            t, c = ending(cost, rank)
            gaps, *counts, illegal = total
            out = [(conv, b, None, None, None, *[None] * 6) for b in ids]
            for k in range(len(ids) - 1, -1, -1):
                f = back[_STATES * k + t]
                last = k == len(ids) - 1
                out[k] = (conv, ids[k], f, t, _TAIL[t] if last else "", *((gaps, *counts, illegal, c) if last else [None] * 6))
                t = f
            for k in range(0, len(out), BLOCK):
                yield _sent(out[k : k + BLOCK], schema)

        for new, r in _grouped(batches):
            if new:
                if ids:
                    yield from whole()
                conv, ids, back, total = r["conv_id"], array.array("q"), bytearray(), [0] * 5
                (cost,), (rank,) = _start(1)
                end, high = None, None
            ways, ranks = np.array(r["costs"]).reshape(_STATES, _STATES), np.array(r["ranks"]).reshape(_STATES, _STATES)
            both = cost[:, None] + ways
            best = (both * _STATES + rank[:, None]).argmin(0)
            to = np.arange(_STATES)
            order = rank[best] * _STATES + ranks[best, to]
            cost = np.minimum(both[best, to], _FAR)
            order[cost >= _FAR] = 1 << 20
            rank = order.argsort(kind="stable").argsort(kind="stable")
            back += best.astype(np.uint8).tobytes()
            ids.append(r["block"])
            for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
                total[k + 1] += r[name]
            if r["starts"] is not None:
                total[4] += end is not None and end + r["starts"] not in ("su", "ua", "au")
                end = r["ends"]
            if r["low"] is not None:
                # gaps: turns missing within the block, and between it and the block before
                total[0] += r["high"] - r["low"] + 1 - r["distinct"] + (max(0, r["low"] - high - 1) if high is not None else 0)
                high = r["high"]
        if ids:
            yield from whole()

    return run


def _parts(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, t in _turns(batch):
                _, _, parents = forward([t.classes], *_start(1, r["entry"]))
                (states,) = backward([len(t.classes)], parents, np.array([r["leave"]]))
                audit, lines = t.repaired(states, r["tail"])
                yield _sent([(r["conv_id"], r["block"], audit, "\n".join(lines) if lines else None, *(r[n] for n, _ in _RESULT[:6]))], schema)

    return run


def _joined(schema: T.StructType):
    """Parts in order to results: the hash runs over the parts, so one part is held at a time, and the audit string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit: list[str] = []
        told, said = hashlib.sha256(), False
        for new, r in _grouped(batches):
            if new:
                audit, told, said = [], hashlib.sha256(), False
            audit.append(r["audit"])
            if r["lines"] is not None:
                told.update((("\n" if said else "") + r["lines"]).encode("utf-8", "surrogatepass"))
                said = True
            if r["cost"] is not None:
                yield _sent([(r["conv_id"], *(r[n] for n, _ in _RESULT[:6]), "".join(audit), told.hexdigest())], schema)

    return run


def repair(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, a row for each conversation.

    ``rows(conv_id, turn, role, text)``, other columns are left alone. Rows that are not ``present`` keep their conversation in the result and
    count for nothing; a conversation without others has zeros, an empty audit and the hash of nothing. Null roles and texts count as one
    space; null ids are one conversation; null turns come first and leave no gaps. Turns of one number are in the order of
    role, the text's first 64 characters, then a hash of the text; repeated rows stand side by side. An empty table gives no rows.

    Rows are sorted into ranges, so a long conversation lies in many tasks. Conversations whole within one range and
    one block are solved there; of all others, blocks are summarised apart, combined in order, and solved apart.
    The combining task reads a row for each block; the SHA-256 and the audit string of one conversation are read and
    written in order, a block at a time.
    """
    kind = rows.schema["conv_id"].dataType
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    placed = rows.select("conv_id", F.when(there, F.col("turn").cast("long")).alias("turn"), F.when(there, space("role")).alias("role"), F.when(there, space("text")).alias("text"), there.alias("present"), F.monotonically_increasing_id().alias("_row"))
    # the row's number parts rows that are equal in all else
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "_row"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    blocks = written(ordered.mapInArrow(_blocks(s := _schema(kind, ("block", "long"), *_RESULT, *_ROWS)), s), "conversation-blocks")
    result = [n for n, _ in _RESULT]
    closed = blocks.where(F.col("roles").isNull()).select("conv_id", *result)
    opened = blocks.where(F.col("roles").isNotNull()).select("conv_id", "block", "turns", "roles", "texts")
    # the first place of each role and text, by digest, so that no text is a key
    digest = F.sha2(F.concat(F.length("x.roles").cast("string"), F.lit(":"), F.col("x.roles"), F.col("x.texts")), 256)
    said = opened.select("conv_id", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "x")).select("conv_id", "block", "at", digest.alias("digest"))
    first = said.groupBy("conv_id", "digest").agg(F.min(F.struct("block", "at")).alias("f")).groupBy(F.col("f.block").alias("block")).agg(F.collect_list("f.at").alias("first"))
    opened = opened.join(first, "block", "left")
    tables = _schema(kind, ("block", "long"), ("costs", "array<bigint>"), ("ranks", "array<bigint>"), *[(n, "long") for n in ("blank", "duplicate", "truncated", "illegal")], ("starts", "string"), ("ends", "string"), *[(n, "long") for n in ("low", "high", "distinct")])
    walk = _schema(kind, ("block", "long"), ("entry", "long"), ("leave", "long"), ("tail", "string"), *_RESULT[:6])
    pieces = _schema(kind, ("block", "long"), ("audit", "string"), ("lines", "string"), *_RESULT[:6])
    walked = opened.mapInArrow(_summaries(tables), tables).repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_walked(walk), walk)
    parts = opened.join(walked.drop("conv_id"), "block").mapInArrow(_parts(pieces), pieces)
    final = _schema(kind, *_RESULT)
    return closed.union(parts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_joined(final), final))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults planted by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's.

    Nulls count as one space. Dropped rows stay, with ``present`` false.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("_n"))
    return out.select("*", F.explode(F.sequence(F.lit(1), "_n")).alias("_copy")).drop("_n", "_copy")
