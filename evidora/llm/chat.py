"""Chat formatting with minimum-cost role repair.

Legal conversations: an optional system turn, then user and assistant in turn, from user to assistant. Each turn
is kept, relabelled to another role, or merged into the turn before it; an empty turn may be put before
it or at the end. Costs are those of ``COSTS``. Dynamic programming over the automaton finds the
cheapest repair, with ties to the earlier entry of a fixed order of moves.

A conversation of any length is repaired in parts: rows are sorted by conversation and turn over range
partitions, so a hot conversation covers several. The part of a conversation in one partition is a
min-plus matrix over the automaton's states (cheapest way from each state to each state); only the
first and last parts of a partition go to the driver, at most two small matrices a partition, where
the states at the seams are found. Then each partition walks its own parts between their states.

Rendering: a row per source turn, and per inserted turn, with the text it adds; joined in order
the rows of a conversation give its rendered text. A merged run of any length is never gathered.

Null roles and roles other than the three count as unknown and must be relabelled; null texts are empty; a null
conv_id is a conversation of its own; null turns come first; equal turns are ordered by role and a hash of the text,
repeated rows stay. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import shared_dir
from evidora.session import table

STATES = ("start", "system", "user", "assistant")
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: keep 0; merging is cheap, as no word is lost; relabelling says something untrue; an empty turn invents one.
COSTS = {"merge": 2, "relabel": 3, "insert": 4, "unknown": 1}
INF = 1 << 60

#: A move: (state before, state after, what happens, role, roles of empty turns put before).
Move = tuple[int, int, str, str, tuple[str, ...]]


def _paths() -> list[Move]:
    moves: list[Move] = []
    for before, state in enumerate(STATES):
        if state != "start":
            moves.append((before, before, "merge", state, ()))
        for role in ("system", "user", "assistant"):
            if role in LEGAL[state]:
                moves.append((before, STATES.index(role), "take", role, ()))
            for between in LEGAL[state]:
                if role in LEGAL[between]:
                    moves.append((before, STATES.index(role), "take", role, (between,)))
    return moves


MOVES = _paths()


def cost(move: Move, role: str | None) -> int:
    _, _, kind, to, empty = move
    total = COSTS["insert"] * len(empty)
    if kind == "merge":
        return total + COSTS["merge"] + (COSTS["relabel"] if role in STATES[1:] and role != to else 0 if role == to else COSTS["unknown"])
    return total + (0 if role == to else COSTS["relabel"] if role in STATES[1:] else COSTS["unknown"])


TABLE = {role: [(m[0], m[1], cost(m, role)) for m in MOVES] for role in (*STATES[1:], None)}


def end_cost(state: int) -> int:
    """What it takes to end: an empty assistant turn after user (and a user turn before that, after system)."""
    return {"assistant": 0, "start": 0, "user": COSTS["insert"], "system": 2 * COSTS["insert"]}[STATES[state]]


def known(role: str | None) -> str | None:
    return role if role in STATES[1:] else None


def advance(costs: list[int], role: str | None) -> list[int]:
    after = [INF] * 4
    for a, b, c in TABLE[role]:
        if costs[a] + c < after[b]:
            after[b] = costs[a] + c
    return after


def matrix(roles: Iterator[str | None] | list[str | None]) -> list[list[int]]:
    """Cheapest cost from each state to each state over the turns."""
    rows = [[0 if i == j else INF for j in range(4)] for i in range(4)]
    for role in roles:
        rows = [advance(r, known(role)) for r in rows]
    return rows


def walk(roles: list[str | None], first: int, last: int) -> list[Move]:
    """The cheapest moves from state to state; ties go to the earlier move from the end on."""
    costs = [[0 if s == first else INF for s in range(4)]]
    for role in roles:
        costs.append(advance(costs[-1], known(role)))
    moves: list[Move] = []
    state = last
    for k in range(len(roles) - 1, -1, -1):
        role = known(roles[k])
        at = next(i for i, (a, b, c) in enumerate(TABLE[role]) if b == state and costs[k][a] + c == costs[k + 1][state] < INF)
        moves.append(MOVES[at])
        state = MOVES[at][0]
    return moves[::-1]


def best_end(costs: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + end_cost(s), s))


def seams(parts: list[list[list[int]]]) -> list[tuple[int, int]]:
    """States before and after each part of one conversation, from the parts' matrices."""
    costs = [[0, INF, INF, INF]]
    for part in parts:
        costs.append([min(costs[-1][a] + part[a][b] for a in range(4)) for b in range(4)])
    state, out = best_end(costs[-1]), []
    for k in range(len(parts) - 1, -1, -1):
        before = next(a for a in range(4) if costs[k][a] + parts[k][a][state] == costs[k + 1][state])
        out.append((before, state))
        state = before
    return out[::-1]


def render(role: str, text: str, action: str) -> str:
    """What a turn adds to the rendered conversation."""
    return f"\n{text}" if action == "merge" else f"<|end|>\n<|{role}|>\n{text}" if action != "first" else f"<|{role}|>\n{text}"


OUT = "conv_id long, part int, pos long, turn long, role string, action string, rendered string"
_OUT = [("conv_id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("rendered", pa.string())]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """(conv_id, rows (turn, role, text)) for each conversation's part of a partition."""
    own: list[tuple] = []
    name: int | None = None
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own and conv != name:
                yield name, own
                own = []
            name = conv
            own.append(tuple(row))
    if own:
        yield name, own


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last part of a partition, as matrices of the roles alone."""
    partition = TaskContext.get().partitionId()
    rows, name, current, n = [], None, None, 0
    for batch in batches:
        for conv, role in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if current is None or conv != name:
                if current is not None and n == 1:
                    rows.append((partition, 0, name, sum(current, [])))
                name, current, n = conv, matrix([]), n + 1
            current = [advance(r, known(role)) for r in current]
    if current is not None:
        rows.append((partition, n - 1, name, sum(current, [])))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["partition", "nth", "conv_id", "costs"])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of OUT. part and pos give the order within a conversation."""
    spark = turns.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    source = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # a hash of the text goes into the key, so that a hot (conversation, turn) is cut as well
    key = ["conv_id", "turn", "role", F.xxhash64("text")]
    # both passes below must see the same partitions in the same order, so they are kept
    kept = source.repartitionByRange(*key).sortWithinPartitions(*key).checkpoint()
    edges = kept.select("conv_id", "role").mapInArrow(_edges, "partition int, nth long, conv_id long, costs array<long>").collect()
    states = _seam_states(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        rows: list[tuple] = []
        for nth, (conv, own) in enumerate(_parts(batches)):
            roles = [r for _, r, _ in own]
            seam = states.get((partition, nth))
            if seam is None:
                first, last, ends = 0, best_end(matrix(roles)[0]), True
            else:
                first, last, ends = seam
            rows += _rendered(conv, partition, own, walk(roles, first, last), last, ends)
            if len(rows) >= 4096:
                yield _out(rows)
                rows = []
        if rows:
            yield _out(rows)

    return kept.select("conv_id", "turn", "role", "text").mapInArrow(run, OUT)


def _seam_states(edges: list) -> dict[tuple[int, int], tuple[int, int, bool]]:
    """(partition, nth part) -> (state before, state after, whether the conversation ends there)."""
    out: dict[tuple[int, int], tuple[int, int, bool]] = {}
    chain: list = []

    def close() -> None:
        found = seams([[list(e.costs[4 * a : 4 * a + 4]) for a in range(4)] for e in chain])
        for k, (e, (a, b)) in enumerate(zip(chain, found, strict=True)):
            out[e.partition, e.nth] = (a, b, k == len(chain) - 1)

    for e in sorted(edges, key=lambda e: (e.partition, e.nth)):
        if chain and (e.conv_id != chain[-1].conv_id or e.partition == chain[-1].partition):
            close()
            chain = []
        chain.append(e)
    if chain:
        close()
    return out


def _rendered(conv: int | None, part: int, own: list[tuple], moves: list[Move], last: int, ends: bool) -> list[tuple]:
    rows: list[tuple] = []

    def add(turn: int | None, role: str, action: str, text: str, opens: bool) -> None:
        rows.append((conv, part, len(rows), turn, role, action, render(role, text, "first" if opens else action)))

    for (turn, role, text), (before, _, kind, to, empty) in zip(own, moves, strict=True):
        for k, e in enumerate(empty):
            add(None, e, "insert", "", before == 0 and k == 0)
        action = "merge" if kind == "merge" else "keep" if role == to else "relabel"
        add(turn, to, action, text or "", before == 0 and not empty)
    if ends:
        for e in {"system": ("user", "assistant"), "user": ("assistant",)}.get(STATES[last], ()):
            add(None, e, "insert", "", False)
        conv_id, part, pos, turn, role, action, text = rows[-1]
        rows[-1] = (conv_id, part, pos, turn, role, action, text + "<|end|>\n")
    return rows


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _OUT, strict=True)], names=[n for n, _ in _OUT])


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fragment with a digest of its text."""
    found = repair(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "part", "pos", "turn", "role", "action", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


QUERIES = {"op9_chat": op9_chat}
