"""Conversation structure repair by layers of states for each cost.

Grammar of role initials: ``(s?(ua)+)?``. A row is kept (0), given the role user or assistant (2), or deleted (3; blank
and duplicate rows must be); an empty user or assistant turn may be inserted anywhere (2); a truncated row that isn't
deleted adds 1. In each state of the automaton only one of user and assistant is legal, so the letters D, I, K, R of the
edits determine the repair.

Layers: for each turn, and for each cost from the least on, a bitset of the grammar's states from which the turns to come
can be repaired at that cost. A row takes the bitsets of the turn after it to those of its own by shifts (keep, rerole,
delete, insert). Costs of two states of a turn differ by 5 at most (an insertion joins user and assistant, a deletion
stands for a kept system turn), so ``LAYERS`` bitsets above a turn's least cost hold all, packed into one integer, and a
step is one look-up; a conversation takes time linear in its rows, whatever its cost. The first layer whose bitset has
the start state gives the cost. The trace goes forward from there and takes the first letter in ASCII order that the
bitsets allow, which gives the least audit.

A conversation of any length: rows, without texts, are sorted by conversation and turn over range partitions, so that a
hot conversation covers several. A part of a conversation in a partition is reduced to its cost from each state to each
state and, for each first state, the order of the audits by last state; only the first and last part of a partition go to the
driver, where the states at the seams follow. Audits of one part are never prefixes of each other, since an
insertion belongs to the row it stands before, so that parts may be compared one by one. Then each partition
traces its own parts. Texts are joined to the kept rows alone, and a conversation's digest is taken as a stream in order; as
SHA-256 is a chain, one task reads the texts of one conversation, a batch at a time, and its audit is one value by contract.

Edge cases: null roles and texts are one space; a null conv_id is a conversation like any other; null turns come first; equal turns
are ordered by role and a hash of role and text; equal rows are counted before they are dealt. Roles other than those of the
grammar must be changed or deleted. Gaps beyond the range of long are held at its end. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import shared_dir, written
from evidora.session import table

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or changed turn, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
LAYERS = 7
INF = 1 << 60
#: Cost to end from each state.
END = (0, 2 * INSERT, INSERT, 0)


def _keep(initial: str, state: int) -> int | None:
    """The state after a kept row."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial in ("u", "a"):
        return NEXT[state] if ROLES[state][0] == initial else None
    return None


def _before(after: int, to: tuple[int | None, ...]) -> int:
    """The states that a move takes into the bitset ``after``."""
    return sum(1 << s for s in range(4) if to[s] is not None and after >> to[s] & 1)


def pack(costs: tuple[int, ...] | list[int]) -> tuple[int, int]:
    """(bitsets of a turn, least cost): bitset d has the states of cost least + d or less."""
    least = min(costs)
    return sum(sum(1 << s for s in range(4) if costs[s] <= least + d) << 4 * d for d in range(LAYERS)), least


def cost_of(layers: int, least: int, state: int) -> int:
    return next((least + d for d in range(LAYERS) if layers >> 4 * d + state & 1), INF)


@cache
def step(layers: int, initial: str, fault: str) -> tuple[int, int]:
    """(bitsets before a row, by how much the least cost grows), from the bitsets after it. Faults: '', blank, duplicate, truncated."""
    at = lambda d: layers >> 4 * min(d, LAYERS - 1) & 15 if d >= 0 else 0
    kept = tuple(_keep(initial, s) for s in range(4))
    more = TRUNCATED if fault == "truncated" else 0
    found: list[int] = []
    for d in range(2 * LAYERS):
        bits = at(d - DELETE)
        if fault not in ("blank", "duplicate"):
            bits |= _before(at(d - more), kept) | _before(at(d - more - REROLE), NEXT)
        if d >= INSERT:
            bits |= _before(found[d - INSERT], NEXT)
        found.append(bits)
    grown = next(d for d, bits in enumerate(found) if bits)
    return sum(found[min(grown + d, 2 * LAYERS - 1)] << 4 * d for d in range(LAYERS)), grown


#: A run of equal rows: initial, fault, how many; above one only for rows that must be deleted, before another such row.
Row = tuple[str, str, int]


def layered(rows: list[Row], after: tuple[int, int]) -> list[tuple[int, int]]:
    """(bitsets, least cost) before each run and after the last."""
    out = [after]
    layers, least = after
    for initial, fault, n in reversed(rows):
        layers, grown = step(layers, initial, fault)
        least += grown + DELETE * (n - 1)
        out.append((layers, least))
    return out[::-1]


def trace(rows: list[Row], turns: list[tuple[int, int]], state: int, last: bool) -> tuple[list[str], int]:
    """(least audit by runs, state after it) from ``state`` on; with ``last``, insertions at the end belong to it."""
    audit: list[str] = []
    cost = cost_of(*turns[0], state)
    k = 0
    while k < len(rows) or last and cost:
        if k < len(rows):
            initial, fault, n = rows[k]
            more = TRUNCATED if fault == "truncated" else 0
            if cost_of(*turns[k + 1], state) + DELETE * n == cost:
                audit.append("D" * n)
                cost, k = cost - DELETE * n, k + 1
                continue
        if cost_of(*turns[k], NEXT[state]) + INSERT == cost:
            audit.append("I")
            state, cost = NEXT[state], cost - INSERT
            continue
        kept = _keep(initial, state)
        if kept is not None and cost_of(*turns[k + 1], kept) + more == cost:
            audit.append("K")
            state, cost, k = kept, cost - more, k + 1
        else:
            audit.append("R")
            state, cost, k = NEXT[state], cost - more - REROLE, k + 1
    return audit, state


def summary(rows: list[Row]) -> tuple[list[int], list[int]]:
    """Of a part: the least cost from each state to each state, and for each pair the rank of its audit among those of its first state."""
    costs, audits = [[INF] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
    for to in range(4):
        turns = layered(rows, pack([0 if s == to else INF for s in range(4)]))
        for state in range(4):
            costs[state][to] = cost_of(*turns[0], state)
            if costs[state][to] < INF:
                audits[state][to] = "".join(trace(rows, turns, state, False)[0])
    ranks = [[sorted(own).index(x) for x in own] for own in audits]
    return sum(costs, []), sum(ranks, [])


def seams(parts: list[tuple[list[int], list[int]]]) -> list[tuple[int, list[int]]]:
    """(state before, costs after) of each part of a conversation, from its parts' summaries."""
    after = [list(END)]
    for costs, _ in reversed(parts):
        after.append([min(costs[4 * s + t] + after[-1][t] for t in range(4)) for s in range(4)])
    after.reverse()
    state, out = START, []
    for k, (costs, ranks) in enumerate(parts):
        out.append((state, after[k + 1]))
        ways = [(costs[4 * state + t] + after[k + 1][t], ranks[4 * state + t], t) for t in range(4)]
        state = min(ways)[2]
    return out


def coded(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, n, k1, k2, fault): the fault is blank, truncated or ''. Rows of n = 0 stand for conversations alone."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("n")
    )
    own = F.btrim("text", F.lit(SPACE))
    fault = F.when(own == "", "blank").when(~F.right(own, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    # hashing passes over nulls, so that nulls get a mark of their own
    key = [F.col("conv").isNull(), "conv", "role", "text"]
    return rows.select("*", F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit(1), *key).alias("k2"), fault.alias("fault"))


def ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, k1, k2, fault, n, again) sorted over range partitions; again: role and text were seen at an earlier turn.
    n equal rows are one. Rows of no copies are one for each conversation."""
    there = rows.filter("n > 0").groupBy("conv", "turn", "role", "k1", "k2", "fault").agg(F.sum("n").alias("n"))
    seen = there.groupBy("k1", "k2").agg(F.min(F.struct("turn")).alias("first"))
    earlier = F.when(F.col("first.turn").isNull(), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first.turn"))
    marked = there.join(seen, ["k1", "k2"]).select("conv", "turn", "role", "k1", "k2", "fault", "n", earlier.alias("again"))
    gone = rows.filter("n = 0").select("conv").distinct()
    none = {"turn": "long", "role": "string", "k1": "long", "k2": "long", "fault": "string"}
    every = marked.unionByName(gone.select("conv", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.lit(0).cast("long").alias("n"), F.lit(False).alias("again")))
    order = ["conv", "turn", "role", "k1", "k2"]
    return every.repartitionByRange(*order).sortWithinPartitions(*order)


class Part:
    """What of one conversation lies in one partition."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.rows: list[Row] = []
        self.source: list[tuple[str, int, int]] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.first: int | None = None
        self.last: int | None = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: str, k1: int, k2: int, fault: str, n: int, again: bool) -> None:
        initial = role[:1]
        later = "blank" if fault == "blank" else "duplicate"
        runs = [(later if again else fault, 1), (later, n - 2), (later, 1 if n > 1 else 0)]
        for own, m in runs:
            if m > 0:
                self.faults[own] += m
                pairs = m - 1 + bool(self.rows and self.rows[-1][0] + initial not in LEGAL)
                self.illegal += pairs
                self.rows.append((initial, own, m))
                self.source.append((role, k1, k2))
        if n and turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    part = None
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part is None or conv != part.conv:
                if part:
                    yield part
                part = Part(conv)
            if row[-2]:
                part.add(*row)
    if part:
        yield part


EDGES = "partition int, nth long, conv long, costs array<long>, ranks array<int>, n long, head string, tail string, first_turn long, last_turn long"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last part of a partition."""
    own = TaskContext.get().partitionId()
    rows: list[dict] = []

    def note(nth: int, part: Part) -> None:
        costs, ranks = summary(part.rows)
        ends = (part.rows[0][0], part.rows[-1][0]) if part.rows else (None, None)
        rows.append(dict(zip("partition nth conv costs ranks n head tail first_turn last_turn".split(), (own, nth, part.conv, costs, ranks, len(part.rows), *ends, part.first, part.last), strict=True)))

    nth, last = -1, None
    for nth, last in enumerate(parts(batches)):
        if nth == 0:
            note(0, last)
    if nth > 0 and last is not None:
        note(nth, last)
    kinds = [("partition", pa.int32()), ("nth", pa.int64()), ("conv", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("n", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def _joined(edges: list) -> dict[tuple[int, int], tuple[int, list[int], bool, bool, str | None, int | None]]:
    """For each first and last part: the state before it, the costs after it, whether it is the conversation's first and last, and the initial and
    the turn before it."""
    out: dict[tuple[int, int], tuple] = {}

    def close(chain: list) -> None:
        if not chain:
            return
        # parts without rows change nothing
        found = seams([([0 if a == b else INF for a in range(4) for b in range(4)], [0] * 16) if not e.n else (list(e.costs), list(e.ranks)) for e in chain])
        initial, turn = None, None
        for k, (e, (state, after)) in enumerate(zip(chain, found, strict=True)):
            out[e.partition, e.nth] = (state, after, k == 0, k == len(chain) - 1, initial, turn)
            initial, turn = (e.tail if e.n else initial), (e.last_turn if e.last_turn is not None else turn)

    chain: list = []
    for e in sorted(edges, key=lambda e: (e.partition, e.nth)):
        if chain and (e.conv != chain[-1].conv or e.partition == chain[-1].partition):
            close(chain)
            chain = []
        chain.append(e)
    close(chain)
    return out


#: Rows with an audit tell of a part, the others of a turn that stays.
STEPS = "conv long, part int, pos long, role string, k1 long, k2 long, audit string, cost long, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, distinct_turns long"
_STEPS = [("conv", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("role", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("audit", pa.string())]
_STEPS += [(c, pa.int64()) for c in "cost blank duplicate truncated illegal first_turn last_turn distinct_turns".split()]


def _decided(part: Part, state: int, after: list[int], last: bool, before: str | None, turn: int | None, own: int, pos: int) -> list[dict]:
    """A part's row and those of the turns that stay."""
    turns = layered(part.rows, pack(after))
    audit, _ = trace(part.rows, turns, state, last)
    rows: list[dict] = []
    k = cost = 0
    for letters in audit:
        letter = letters[0]
        if letter == "I":
            rows.append({"conv": part.conv, "part": own, "pos": pos + len(rows) + 1, "role": ROLES[state]})
            state, cost = NEXT[state], cost + INSERT
            continue
        initial, fault, _ = part.rows[k]
        role, k1, k2 = part.source[k]
        k += 1
        if letter == "D":
            cost += DELETE * len(letters)
            continue
        cost += (TRUNCATED if fault == "truncated" else 0) + (REROLE if letter == "R" else 0)
        role, state = (ROLES[state], NEXT[state]) if letter == "R" else (role, _keep(initial, state))
        rows.append({"conv": part.conv, "part": own, "pos": pos + len(rows) + 1, "role": role, "k1": k1, "k2": k2})
    illegal = part.illegal + bool(before is not None and part.rows and before + part.rows[0][0] not in LEGAL)
    told = {c: part.faults[c] for c in ("blank", "duplicate", "truncated")}
    # a turn that the part before ended with is not counted again
    distinct = part.distinct - (part.first is not None and part.first == turn)
    return [{"conv": part.conv, "part": own, "pos": pos, "audit": "".join(audit), "cost": cost, **told, "illegal": illegal, "first_turn": part.first, "last_turn": part.last, "distinct_turns": distinct}, *rows]


def steps(sorted_rows: DataFrame) -> DataFrame:
    """Rows of STEPS. sorted_rows must keep its partitions and their order, as a checkpoint does."""
    narrow = sorted_rows.select("conv", "turn", "role", "k1", "k2", "fault", "n", "again")
    joined = _joined(narrow.mapInArrow(_edges, EDGES).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        rows: list[dict] = []
        pos = 0
        for nth, part in enumerate(parts(batches)):
            state, after, _, last, before, turn = joined.get((own, nth), (START, list(END), True, True, None, None))
            found = _decided(part, state, after, last, before, turn, own, pos)
            pos += len(found)
            rows += found
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_STEPS))
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_STEPS))

    return narrow.mapInArrow(run, STEPS)


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OUT = [("conv_id", pa.int64())] + [(c, pa.int64()) for c in "gaps blank duplicate truncated illegal cost".split()] + [("audit", pa.string()), ("repaired_sha256", pa.string())]


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, whose rows come in order; its text is hashed as it passes."""
    rows: list[dict] = []
    own: dict | None = None

    def close() -> None:
        least, most = own["first_turn"], own["last_turn"]
        gaps = 0 if least is None else min(most - least + 1 - own["distinct_turns"], (1 << 63) - 1)
        rows.append({"conv_id": own["conv"], "gaps": gaps, "audit": "".join(own["audit"]), "repaired_sha256": own["sha"].hexdigest()} | {c: own[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")})

    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = dict(zip(names, values, strict=True))
            if own is None or own["conv"] != row["conv"]:
                if own:
                    close()
                own = {"conv": row["conv"], "audit": [], "sha": hashlib.sha256(), "any": False, "first_turn": None, "last_turn": None, "distinct_turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
            if row["audit"] is None:
                own["sha"].update(("\n" * own["any"] + f"{row['role']}:{row['text'] or ''}").encode())
                own["any"] = True
                continue
            own["audit"].append(row["audit"])
            for c in ("blank", "duplicate", "truncated", "illegal", "cost", "distinct_turns"):
                own[c] += row[c]
            if row["first_turn"] is not None:
                own["first_turn"] = row["first_turn"] if own["first_turn"] is None else own["first_turn"]
                own["last_turn"] = row["last_turn"]
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_OUT))
            rows.clear()
    if own:
        close()
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_OUT))


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """Rows of STEPS with ``text``: a row for each part of a conversation (audit, cost, counts) and one for each turn of the repaired conversation.
    conv, part and pos order them. copies: how often a row counts; 0 leaves its conversation alone."""
    spark = turns.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    rows = coded(turns, conv_col, turn_col, role_col, text_col, copies)
    # both passes must see the same partitions in the same order
    found = written(steps(ordered(rows).checkpoint()), "repair-steps")
    # a text that stays is the only one of its role and text in the conversation
    texts = rows.filter("n > 0 AND fault <> 'blank'").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    kept = found.filter("k1 IS NOT NULL").join(texts, ["k1", "k2"])
    return kept.unionByName(found.filter("k1 IS NULL").withColumn("text", F.lit(None).cast("string")))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """Rows of OUT, one for each conversation."""
    every = repaired_turns(turns, conv_col, turn_col, role_col, text_col, copies)
    names = [c.split()[0] for c in STEPS.split(", ") if c.split()[0] not in ("part", "pos", "k1", "k2")]
    return every.repartition("conv").sortWithinPartitions("conv", "part", "pos").select(*names, "text").mapInArrow(_told, OUT)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """conversations with faults that a checksum of (conv_id, turn) chooses, and how often each row counts."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows, F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damaged(table(spark, sf_dir, "conversations"))
    return repair(rows, copies=copies)


def _crc_table() -> str:
    inner = "SELECT i, i AS c FROM range(256) AS t(i)"
    for _ in range(8):
        inner = f"SELECT i, xor(c >> 1, 3988292384 * (c & 1)) AS c FROM ({inner})"
    return f"SELECT list(c ORDER BY i) AS crcs FROM ({inner})"


def _oracle() -> str:
    """Recursion from the last row on; for each state the cheapest way to the end, as (cost, audit, text)."""
    blank = "length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) = 0"
    end = "right(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"
    row = lambda cost, letter, role, text, rest: f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 't': {role} || ':' || {text} || chr(10) || {rest}.t}}"

    def plain(s: int) -> str:
        """Ways through the row without an insertion before it."""
        to, name = NEXT[s], ROLES[s]
        keeps = [f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND r.role[1] = '{name[0]}' THEN {row('more', 'K', 'r.role', 'r.text', f'b.s{to}')} END"]
        if s == START:
            keeps.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND r.role[1] = 's' THEN {row('more', 'K', 'r.role', 'r.text', 'b.s1')} END")
        rerole = f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {row('more + 2', 'R', f"'{name}'", 'r.text', f'b.s{to}')} END"
        delete = f"{{'c': 3 + b.s{s}.c, 'a': 'D' || b.s{s}.a, 't': b.s{s}.t}}"
        return f"list_sort(list_filter([{', '.join([*keeps, rerole, delete])}], lambda x: x IS NOT NULL))[1]"

    def inserted(s: int) -> str:
        ways, now, letters, text = [f"p{s}"], s, "", ""
        for n in (1, 2):
            letters, text, now = letters + "I", text + f"'{ROLES[now]}:' || chr(10) || ", NEXT[now]
            ways.append(f"{{'c': {2 * n} + p{now}.c, 'a': '{letters}' || p{now}.a, 't': {text}p{now}.t}}")
        return f"list_sort([{', '.join(ways)}])[1]"

    starts = ", ".join(
        f"{{'c': {END[s]}::BIGINT, 'a': '{'I' * (END[s] // 2)}', 't': {x}}} AS s{s}" for s, x in enumerate(("''", "'user:' || chr(10) || 'assistant:' || chr(10)", "'assistant:' || chr(10)", "''"))
    )
    return f"""
WITH RECURSIVE crc AS ({_crc_table()}),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
d AS (SELECT c.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1]))) % 20 AS k FROM c, crc),
e AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE k <> 0),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM p),
f AS (SELECT *, CASE WHEN {blank} THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN {end} NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
r AS MATERIALIZED (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS more FROM f),
h AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
b AS (SELECT conv_id, n AS i, {starts} FROM h
  UNION ALL
  SELECT conv_id, i, {', '.join(f'{inserted(s)} AS s{s}' for s in range(4))} FROM (
    SELECT b.conv_id, b.i - 1 AS i, {', '.join(f'{plain(s)} AS p{s}' for s in range(4))} FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i)),
z AS (SELECT conv_id, s0 FROM b WHERE i = 0)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(CASE WHEN s0.t IS NULL OR s0.t = '' THEN '' ELSE left(s0.t, length(s0.t) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""


SQL = {"op12_structure_repair": _oracle()}
QUERIES = {"op12_structure_repair": op12_structure_repair}
