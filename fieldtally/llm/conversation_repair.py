"""Repair of conversations to the role order ``(s?(ua)+)?`` by cheapest edits, the least audit among them by prefix doubling.

Faults of rows are found by joins on narrow rows and reduced to one byte a row, in order, per conversation. A cost DP runs over
places and four states (nothing yet, after system, after user, after assistant): Keep is free, Rerole costs 1, Delete 2, Insert
5, a kept truncated row 5 more; blank and repeated rows must go. Cost vectors relative to their least value are few, so each
step is one look into a table that grows as vectors turn up.

Arcs on cheapest paths are the nodes that get ranked: by one letter of audit, then by 2, 4, 8, ... letters, each time from the
rank of the arc and the rank of the arc its pointer leads to; pointers double with the ranks. A letter leaves a state by one
arc only, so the least continuation of a length has one end. The least arc at the start and the doubled pointers give the
whole audit. Long conversations are ranked in blocks of rows, from the state in which the block before ended.

The edits then meet the rows again in one sorted stream per conversation, of which one row is held at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHITE = " \t\n\x0b\x0c\r"
_LETTERS = b"DIKR"
_NEXT = (2, 2, 3, 2)  # state after an inserted or changed row: user, user, assistant, user
_KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # state, role class -> state
_FAR = 1 << 40
_ROLE = {2: b"user", 3: b"assistant"}
BLANK, DUPLICATE, TRUNCATED = 4, 8, 12  # a row's code is its fault plus its role class: system, user, assistant, other


class Steps:
    """Cost vectors, relative to their least cost, and the steps between them, numbered as they turn up."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.step: list[list[tuple[int, int, int] | None]] = []  # by vector and code: vector before, cost, kind
        self.kinds: list[np.ndarray] = []  # by kind: state x letter -> 4 * rows ahead + state, or -1
        last, _ = self._add((0, _FAR, _FAR, 0))
        self.end = last
        self.sink = self._kind([[-1] * 4] * 4)
        self.final = self._kind([[-1] * 4, [-1, 2, -1, -1], [-1, 3, -1, -1], [-1] * 4])

    def _kind(self, arcs: list[list[int]]) -> int:
        self.kinds.append(np.array(arcs, np.int64))
        return len(self.kinds) - 1

    def _add(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """Number and least cost of a vector, after inserts at its place."""
        best = list(costs)
        for _ in range(3):
            best = [min(c, 5 + best[_NEXT[s]]) for s, c in enumerate(best)]
        least = min(best)
        vector = tuple(c - least for c in best)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.step.append([None] * 16)
        return self.number[vector], least

    def make(self, after: int, code: int) -> tuple[int, int, int]:
        """Vector before a row with ``code``, what it costs more than the one after it, and the kind of its cheapest arcs."""
        fault, role, costs = code & 12, code & 3, self.vectors[after]
        more = 5 if fault == TRUNCATED else 0
        ways = []
        for s in range(4):
            row = [(2 + costs[s], 4 + s), None, None, None]
            if fault not in (BLANK, DUPLICATE):
                if (s, role) in _KEEP:
                    row[2] = (more + costs[_KEEP[s, role]], 4 + _KEEP[s, role])
                row[3] = (1 + more + costs[_NEXT[s]], 4 + _NEXT[s])
            ways.append(row)
        before, least = self._add(tuple(min(w[0] for w in row if w) for row in ways))
        whole = [c + least for c in self.vectors[before]]
        for s in range(4):
            ways[s][1] = (5 + whole[_NEXT[s]], _NEXT[s])
        arcs = [[w[1] if w and w[0] == whole[s] else -1 for w in row] for s, row in enumerate(ways)]
        found = (before, least, self._kind(arcs))
        self.step[after][code] = found
        return found

    def solve(self, codes: bytes) -> tuple[int, np.ndarray]:
        """Least cost from the start, and the kind of every place's arcs, the end's last."""
        kinds, vector, cost = np.empty(len(codes) + 1, np.int32), self.end, 0
        kinds[-1] = self.final
        step = self.step
        for i in range(len(codes) - 1, -1, -1):
            found = step[vector][codes[i]] or self.make(vector, codes[i])
            vector, more, kinds[i] = found
            cost += more
        return cost + self.vectors[vector][0], kinds


def least_audits(kinds: np.ndarray, table: np.ndarray, places: np.ndarray, states: np.ndarray) -> list[tuple[bytes, int]]:
    """Least audit from each start (place, state) and the node (4 * place + state) at which it ends.

    ``kinds`` are the arcs of the places of one or more conversations side by side. Arcs are ranked by audits of 1, 2, 4, ...
    letters; an arc without successor is followed by the end, which ranks first and follows itself.
    """
    targets = table[kinds]  # place, state, letter
    place, state, letter = np.nonzero(targets >= 0)
    source = 4 * place + state
    to = 4 * place + targets[place, state, letter]
    count = len(source)
    first = np.searchsorted(source, np.arange(4 * len(kinds) + 1))
    rank = np.r_[letter + 1, 0]
    pointer = np.r_[np.where(first[to] < first[to + 1], first[to], count), count]  # the successor of least rank, by one letter
    doubled = [pointer]
    while (pointer[:-1] != count).any():
        rank = np.unique(rank * (count + 2) + rank[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
        doubled.append(pointer)
    starts = 4 * places + states
    path = np.full((len(starts), 1), count)
    for row, node in zip(path, starts):
        a, b = first[node], first[node + 1]
        if a < b:
            row[0] = a + int(np.argmin(rank[a:b]))
    for pointer in doubled:
        path = np.concatenate([path, pointer[path]], 1)
    letters = np.r_[np.frombuffer(_LETTERS, np.uint8)[letter], 0].astype(np.uint8)
    out = []
    for row, node in zip(path, starts):
        n = int(np.argmax(row == count))
        out.append((letters[row[:n]].tobytes(), int(to[row[n - 1]]) if n else int(node)))
    return out


def audits(conversations: list[bytes], steps: Steps, block: int = 16_384, beside: int = 40_000) -> list[tuple[int, bytes]]:
    """Cost and least audit of each conversation's codes; ``beside`` rows at most are ranked at a time, in blocks if longer."""
    solved = [steps.solve(codes) for codes in conversations]
    table = np.stack(steps.kinds)
    out: list[tuple[int, bytes]] = [(0, b"")] * len(conversations)
    order = sorted(range(len(conversations)), key=lambda i: len(conversations[i]))
    group: list[int] = []
    held = 0

    def flush() -> None:
        starts = np.cumsum([0] + [len(solved[i][1]) for i in group])[:-1]
        found = least_audits(np.concatenate([solved[i][1] for i in group]), table, starts, np.zeros(len(group), np.int64))
        for i, (audit, _) in zip(group, found):
            out[i] = (solved[i][0], audit)

    for i in order:
        cost, kinds = solved[i]
        if len(kinds) > block:
            parts, state = [], 0
            for start in range(0, len(kinds), block):
                part = kinds[start : start + block + 1]
                if start + block + 1 < len(kinds):
                    part = np.r_[part[:-1], np.int32(steps.sink)]
                (audit, node), *_ = least_audits(part, table, np.zeros(1, np.int64), np.array([state]))
                parts.append(audit)
                state = node & 3
                if start + block + 1 >= len(kinds):
                    break
            out[i] = (cost, b"".join(parts))
            continue
        if group and (held + len(kinds) > beside or len(kinds) > 2 * len(solved[group[0]][1]) + 8):
            flush()
            group, held = [], 0
        group.append(i)
        held += len(kinds)
    if group:
        flush()
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of each conversation's rows in a batch, in order; parts are numbered as the range partitions are."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, turns = batch.column("conv_id"), batch.column("turn").to_pylist()
        n, code, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "code", "first"))
        known = ids.to_pylist()
        edges = [0] + [i for i in range(1, len(known)) if known[i] != known[i - 1]] + [len(known)]
        again = np.where(code & 12 == BLANK, code, (code & 3) | DUPLICATE)
        rows = {c: [] for c in ("conv_id", "part", "number", "codes", "turns", "first_turn", "last_turn")}
        for a, b in zip(edges, edges[1:]):
            codes = np.repeat(again[a:b], n[a:b]).astype(np.uint8)
            at = np.cumsum(n[a:b]) - n[a:b]
            whole = (n[a:b] > 0) & first[a:b]
            codes[at[whole]] = code[a:b][whole]
            mine = [t for t, k in zip(turns[a:b], n[a:b]) if t is not None and k]
            values = (known[a], part, number, codes.tobytes(), len(set(mine)), mine[0] if mine else None, mine[-1] if mine else None)
            for column, value in zip(rows.values(), values):
                column.append(value)
            number += 1
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))


def _solver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = Steps()
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True
    for batch in batches:
        conversations, columns = [], {c: [] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")}
        for segments in batch.column("segments").to_pylist():
            codes = b"".join(s["codes"] for s in segments)
            conversations.append(codes)
            row = np.frombuffer(codes, np.uint8)
            faults = np.bincount(row >> 2, minlength=4)
            with_turn = [s for s in segments if s["first_turn"] is not None]
            distinct = sum(s["turns"] for s in with_turn)
            distinct -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(with_turn, with_turn[1:]))
            span = with_turn[-1]["last_turn"] - with_turn[0]["first_turn"] + 1 if with_turn else 0
            columns["gaps"].append(span - distinct)
            for name, value in zip(("blank", "duplicate", "truncated"), faults[1:]):
                columns[name].append(int(value))
            columns["illegal"].append(int((~legal[row[:-1] & 3, row[1:] & 3]).sum()))
        found = audits(conversations, steps)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                *(pa.array(v, pa.int64()) for v in columns.values()),
                pa.array([c for c, _ in found], pa.int64()),
                pa.array([a.decode() for _, a in found], pa.string()),
            ],
            names=["conv_id", *columns, "cost", "audit"],
        )


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _prepared(rows: DataFrame, copies: Column) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    count = F.coalesce(copies.cast("long"), F.lit(0))
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), count.alias("n"),
    )
    named = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return plain.withColumn("digest", F.substring(F.unhex(F.sha2(named, 256)), 1, 16))


def _with_faults(prepared: DataFrame) -> DataFrame:
    """Narrow rows ``conv_id, turn, digest, code, n, first``: equal rows as one, ``first`` if none stands before it."""
    initial = F.left(F.col("role"), F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    body = F.rtrim(F.col("text"), F.lit(_WHITE))
    fault = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    there = F.col("n") > 0
    narrow = prepared.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("digest")).alias("digest"),
        F.when(there, fault + role).otherwise(0).alias("code"), F.when(there, F.col("n")).otherwise(0).alias("n"),
    )
    narrow = narrow.groupBy("conv_id", "turn", "digest", "code").agg(F.sum("n").alias("n"))
    earliest = narrow.where("n > 0").groupBy("conv_id", "digest").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("without")
    )
    firsts = earliest.select(
        F.col("conv_id").alias("c"), F.when(~F.col("without"), F.col("least")).alias("t"), F.col("digest").alias("d"), F.lit(True).alias("first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & F.col("digest").eqNullSafe(F.col("d"))
    joined = narrow.join(firsts, same, "left")
    return joined.select("conv_id", "turn", "digest", "code", "n", F.coalesce("first", F.lit(False)).alias("first"))


def _edits(prepared: DataFrame) -> DataFrame:
    """``conv_id``, the counts of the report, ``cost`` and ``audit`` of every conversation."""
    ordered = _with_faults(prepared).repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    segments = ordered.mapInArrow(
        _segments, "conv_id long, part int, number long, codes binary, turns long, first_turn long, last_turn long"
    )
    segment = F.struct("part", "number", "codes", "turns", "first_turn", "last_turn")
    folded = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(segment)).alias("segments"))
    return folded.mapInArrow(_solver, "conv_id long, " + ", ".join(f"{c} long" for c in _REPORT) + ", audit string")


class Repair:
    """Reads a conversation's rows in order beside its audit; ``message`` gets every role and text that the repair leaves."""

    def __init__(self, audit: str, message: Callable[[bytes, bytes, str], None]):
        self.audit, self.at, self.state, self.message = audit, 0, 0, message

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = _NEXT[self.state]
            self.message(_ROLE[self.state], b"", "I")
            self.at += 1

    def row(self, role: bytes, text: bytes) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEEP[self.state, b"sua".index(role[:1])]
            self.message(role, text, edit)
        elif edit == "R":
            self.state = _NEXT[self.state]
            self.message(_ROLE[self.state], text, edit)

    def close(self) -> None:
        self._insert()


def _stream(rows: DataFrame, copies: Column) -> DataFrame:
    """Every conversation's edits, and behind them its rows in order, in one task."""
    prepared = _prepared(rows, copies)
    edits = _edits(prepared)
    empty = {c: F.lit(None).cast("long").alias(c) for c in ("turn", "n")}
    heads = edits.select(
        "conv_id", empty["turn"], F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), empty["n"], *_REPORT, "audit",
    )
    bodies = prepared.where("n > 0").select(
        "conv_id", "turn", "digest", "role", "text", "n", *(F.lit(None).cast("long").alias(c) for c in _REPORT),
        F.lit(None).cast("string").alias("audit"),
    )
    both = heads.unionByName(bodies).withColumn("body", F.col("audit").isNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "body", "turn", "digest")


def _walk(batches: Iterator[pa.RecordBatch], begin: Callable, close: Callable, after: Callable) -> Iterator[pa.RecordBatch]:
    """Calls ``begin(head)`` -> Repair, feeds its rows, calls ``close`` behind the last one; ``after`` gives a batch to emit."""
    repair = None
    for batch in batches:
        body, n = batch.column("body").to_pylist(), batch.column("n").to_pylist()
        roles, texts = (batch.column(c).cast(pa.binary()) for c in ("role", "text"))
        for i, is_row in enumerate(body):
            if is_row:
                for _ in range(n[i]):
                    repair.row(roles[i].as_py(), texts[i].as_py())
                continue
            if repair is not None:
                repair.close()
                close()
            repair = begin({c: batch.column(c)[i].as_py() for c in ("conv_id", *_REPORT, "audit")})
        out = after()
        if out is not None:
            yield out
    if repair is not None:
        repair.close()
        close()
        out = after()
        if out is not None:
            yield out


def _reporter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    heads, digest, done = [], [None, 0], []

    def message(role: bytes, text: bytes, edit: str) -> None:
        digest[0].update((b"\n" if digest[1] else b"") + role + b":")
        digest[0].update(text)
        digest[1] += 1

    def begin(head: dict) -> Repair:
        heads.append(head)
        digest[:] = hashlib.sha256(), 0
        return Repair(head["audit"], message)

    def close() -> None:
        done.append({**heads.pop(), "repaired_sha256": digest[0].hexdigest()})

    def after() -> pa.RecordBatch | None:
        if not done:
            return None
        names = ("conv_id", *_REPORT)
        out = pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in done], pa.int64()) for c in names]
            + [pa.array([r[c] for r in done], pa.string()) for c in ("audit", "repaired_sha256")],
            names=[*names, "audit", "repaired_sha256"],
        )
        done.clear()
        return out

    yield from _walk(batches, begin, close, after)


def _messenger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, rows = [None, 0], []

    def message(role: bytes, text: bytes, edit: str) -> None:
        rows.append((current[0], current[1], role.decode(), text.decode(), edit))
        current[1] += 1

    def begin(head: dict) -> Repair:
        current[:] = head["conv_id"], 0
        return Repair(head["audit"], message)

    def after() -> pa.RecordBatch | None:
        if not rows:
            return None
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["conv_id", "place", "role", "text", "edit"]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        rows.clear()
        return out

    yield from _walk(batches, begin, lambda: None, after)


def repair_report(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """One row per ``conv_id`` of ``conv_id, turn, role, text``: counts of faults, cost, audit and digest of the repaired rows.

    Rows stand in order of ``turn``, missing turns first, ties in order of a digest of role and text. ``copies`` says how
    often a row stands there (default once); a conversation whose rows all have 0 is reported as empty: zeros, an empty audit,
    the digest of nothing. NULL roles and texts count as one space, a NULL ``conv_id`` is a conversation, roles that begin with
    none of s, u, a must be changed or deleted. Other columns, of any name, are not looked at; no rows give no rows.
    """
    kind = "conv_id long, " + ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string"
    return _stream(rows, F.lit(1) if copies is None else copies).mapInArrow(_reporter, kind)


def repaired(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id, place, role, text, edit`` (I inserted, K kept, R given another role)."""
    kind = "conv_id long, place long, role string, text string, edit string"
    return _stream(rows, F.lit(1) if copies is None else copies).mapInArrow(_messenger, kind)
