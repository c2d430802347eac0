"""Chat formatting with minimum-cost role repair.

A legal chat may begin with a system turn, then alternates user and assistant turns, and ends with
an assistant turn. For each turn of a conversation, in the order of its number, the repair keeps
the role or relabels it, and appends the turn, merges it into the turn before, or puts an empty
turn of the missing role before it; an empty assistant turn may close the chat. A dynamic program
over the automaton's states (nothing yet, system, user, assistant) finds the cheapest repair;
of equally cheap ones, the first in the order append, merge, insert, each with the roles system,
user, assistant, decided from the last turn backwards. The repaired sequence is then rendered.

Turns are range-partitioned by conversation and turn, so a conversation of any length is cut into
segments of bounded size. A segment is a min-plus matrix (state before to state after); the
matrices of conversations with several segments are multiplied in one small group, which gives
each segment its first and last state, and the segments are traced independently. A task never
holds more than a segment's roles: texts stay in Spark, and each turn's piece is put together there.

Defined results: a null or unknown role must be relabelled; a null text is rendered as empty; in
texts ``<|`` becomes ``< |``, so that no text can open or close a turn; a
null turn number comes first, and of equal numbers the order is by role, text and arrival; rows
with a null conversation form one conversation. Every row is a turn: repeated rows are repeated
turns, in which merging applies. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import written

# Roles and states, legal moves, and the costs of repairs.
ROLES = ["system", "user", "assistant"]
START = 3
LEGAL = {(START, 0), (START, 1), (0, 1), (1, 2), (2, 1)}
MERGE, RELABEL, INSERT = 1, 5, 3
OPEN, CLOSE, JOIN = "<|im_start|>", "<|im_end|>\n", "\n\n"

SEGMENT_ROWS = 50_000
_FAR = 1 << 40


def _moves() -> list[tuple[int, int, int, str, int]]:
    """(state, new state, cost without relabelling, action, inserted role or -1), by preference."""
    out = []
    for action in ("append", "merge", "insert"):
        for new in range(3):
            for state in range(4):
                if action == "append" and (state, new) in LEGAL:
                    out.append((state, new, 0, action, -1))
                if action == "merge" and state == new:
                    out.append((state, new, MERGE, action, -1))
                if action == "insert":
                    out += [(state, new, INSERT, action, between) for between in range(3) if (state, between) in LEGAL and (between, new) in LEGAL]
    return out


MOVES = _moves()
#: Cost of ending in a state.
END = {0: 2 * INSERT, 1: INSERT, 2: 0, START: 2 * INSERT}


def _role(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else -1


def _table(role: int) -> list[list[tuple[int, int]]]:
    """For each new state, the (state before, cost) of each move by preference."""
    return [[(m[0], m[2] + (0 if m[1] == role else RELABEL)) for m in MOVES if m[1] == new] for new in range(3)]


_TABLES = {role: _table(role) for role in (-1, 0, 1, 2)}


def forward(roles: list[int], before: list[int]) -> list[list[int]]:
    """Least cost of each state after each turn, from the costs of the states before."""
    out = [before]
    for role in roles:
        old = out[-1]
        out.append([min(old[s] + c for s, c in moves) for moves in _TABLES[role]] + [_FAR])
    return out


def trace(roles: list[int], costs: list[list[int]], last: int) -> tuple[list[tuple], int]:
    """The moves that reach the last state at least cost, and the state before the first turn."""
    out, state = [], last
    for k in range(len(roles) - 1, -1, -1):
        for m in MOVES:
            cost = m[2] + (0 if m[1] == roles[k] else RELABEL)
            if m[1] == state and costs[k][m[0]] + cost == costs[k + 1][state]:
                out.append((m, cost))
                state = m[0]
                break
    return out[::-1], state


def _matrix(roles: list[int]) -> list[int]:
    """Least costs, state before (rows) by state after, of a segment."""
    return [c for s in range(4) for c in forward(roles, [0 if t == s else _FAR for t in range(4)])[-1]]


def _spans(table: pa.Table) -> Iterator[tuple[int, int]]:
    conv = table["dense"].to_numpy()
    edges = np.flatnonzero(np.append(True, conv[1:] != conv[:-1])).tolist() if len(conv) else []
    yield from zip(edges, [*edges[1:], len(conv)], strict=True)


def _segments(group: pa.Table) -> pa.Table:
    """The first and last conversation of a segment may go on elsewhere: their matrices."""
    group = group.sort_by("pos")
    roles, spans = [_role(r) for r in group["role"].to_pylist()], list(_spans(group))
    ends = [spans[0], spans[-1]] if len(spans) > 1 else spans
    return pa.table({"dense": [group["dense"][s].as_py() for s, _ in ends], "seg": pa.array([group["seg"][s].as_py() for s, _ in ends], pa.int32()), "costs": pa.array([_matrix(roles[s:e]) for s, e in ends], pa.list_(pa.int64()))})


def _chain(group: pa.Table) -> pa.Table:
    """The states at the ends of each segment of one conversation, on its cheapest way."""
    group = group.sort_by("seg")
    matrices = [np.array(x, np.int64).reshape(4, 4) for x in group["costs"].to_pylist()]
    costs = [np.array([_FAR, _FAR, _FAR, 0], np.int64)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), _FAR))
    state = min(range(3), key=lambda s: (costs[-1][s] + END[s], s))
    first, last = [], []
    for k in range(len(matrices) - 1, -1, -1):
        last.append(state)
        state = int(np.argmin(costs[k] + matrices[k][:, state]))
        first.append(state)
    n = len(matrices)
    return pa.table({"dense": group["dense"], "seg": group["seg"], "first": pa.array(first[::-1], pa.int32()), "last": pa.array(last[::-1], pa.int32()), "final": [k == n - 1 for k in range(n)]})


def _repair(_key, turns: pa.Table, ends: pa.Table) -> pa.Table:
    turns = turns.sort_by("pos")
    known = {d: (f, t, z) for d, f, t, z in zip(*(ends[c].to_pylist() for c in ("dense", "first", "last", "final")), strict=True)}
    dense = turns["dense"].to_pylist()
    roles = [_role(r) for r in turns["role"].to_pylist()]
    out = {c: [] for c in ("new_role", "action", "inserted_before", "inserted_after", "cost", "before", "after")}
    for s, e in _spans(turns):
        first, last, final = known.get(dense[s], (START, None, True))
        costs = forward(roles[s:e], [0 if t == first else _FAR for t in range(4)])
        last = min(range(3), key=lambda x: (costs[-1][x] + END[x], x)) if last is None else last
        moves, _ = trace(roles[s:e], costs, last)
        for k, ((before, new, _, action, between), cost) in enumerate(moves):
            end = final and k == len(moves) - 1
            after = {1: ["assistant"], 0: ["user", "assistant"], 2: []}[new] if end else []
            closed = "" if before == START else CLOSE
            empty = f"{OPEN}{ROLES[between]}\n{CLOSE}" if between >= 0 else ""
            out["before"].append(JOIN if action == "merge" else f"{closed}{empty}{OPEN}{ROLES[new]}\n")
            out["after"].append(CLOSE + "".join(f"{OPEN}{r}\n{CLOSE}" for r in after) if end else "")
            out["new_role"].append(ROLES[new])
            out["action"].append(action)
            out["inserted_before"].append(ROLES[between] if between >= 0 else None)
            out["inserted_after"].append(",".join(after) or None)
            out["cost"].append(cost + (INSERT * len(after)))
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    own = turns.select(["pos"])
    for (name, values), kind in zip(out.items(), kinds, strict=True):
        own = own.append_column(name, pa.array(values, kind))
    return own


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn: ``conv``, ``turn``, ``pos`` (the order of rows), ``role``, ``new_role``,
    ``action``, ``inserted_before``, ``inserted_after``, ``cost`` and ``rendered``. A conversation's
    ``rendered`` pieces, joined in the order of ``pos``, are its text; its costs add up to the
    least cost of a repair."""
    rows = turns.select(*[F.col(f"`{c}`").alias(a) for c, a in ((conv, "conv"), (turn, "turn"), (role, "role"), (text, "text"))])
    rows = written(rows.withColumn("arrival", F.monotonically_increasing_id()), "chat-turns")
    n = max(1, -(-rows.count() // SEGMENT_ROWS))
    dense = F.xxhash64(F.col("conv").isNull(), "conv")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("arrival")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = written(dealt.select("conv", "turn", "role", "text", dense.alias("dense"), F.spark_partition_id().alias("seg"), F.monotonically_increasing_id().alias("pos")), "chat-segments")
    matrices = dealt.select("dense", "role", "seg", "pos").groupBy("seg").applyInArrow(_segments, "dense long, seg int, costs array<long>")
    matrices = written(matrices, "chat-matrices")
    several = matrices.groupBy("dense").agg(F.count("*").alias("k")).filter("k > 1").select("dense")
    ends = matrices.join(several, "dense").groupBy("dense").applyInArrow(_chain, "dense long, seg int, first int, last int, final boolean")
    schema = "pos long, new_role string, action string, inserted_before string, inserted_after string, cost long, before string, after string"
    moves = dealt.select("dense", "role", "seg", "pos").groupBy("seg").cogroup(ends.groupBy("seg")).applyInArrow(_repair, schema)
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    out = dealt.join(moves, "pos").withColumn("rendered", F.concat("before", safe, "after"))
    return out.select("conv", "turn", "pos", "role", "new_role", "action", "inserted_before", "inserted_after", "cost", "rendered")


def rendered(repaired: DataFrame) -> DataFrame:
    """(conv, rendered) of each conversation: its pieces in order. A conversation is one value here."""
    pieces = F.array_sort(F.collect_list(F.struct("pos", "rendered")))
    return repaired.groupBy("conv").agg(F.array_join(F.transform(pieces, lambda x: x["rendered"]), "").alias("rendered"), F.sum("cost").alias("cost"))
