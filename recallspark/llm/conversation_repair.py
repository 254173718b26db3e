"""Conversation structure repair over the graph of optimal edits.

A node is (rows consumed, state of the role pattern); arcs keep, rerole or delete the next row, or
insert an empty turn. Minimum costs from the start and to the end mark the tight arcs, those of some
cheapest repair: cost before + arc + cost after = cost of the whole. The set of nodes reached by the
letters so far starts at the first node and moves along the least letter of its tight arcs.

Conversations may be of any size. Rows are sorted by range, so a long conversation spreads over
tasks, each of which cuts its rows into blocks of bounded size. Conversations that lie inside one
block are repaired there. For the others, and for those at the ends of a task's rows, each block
becomes a matrix of least costs between states; a pass forward and a pass backward over matrices
(one row for some thousand turns) give the costs at each block's ends, and blocks are traversed
apart. Only a digest over a whole conversation, which ``report`` makes, reads its text in one task, as a stream.

Defined results: null roles and texts are one space, so such rows are blank; in ``damaged`` a null id
or turn is written as one space; rows without conv_id are one conversation with a null id; turns order
rows, nulls first, ties by role, then by the text's first 100 characters, then by its hash; equal rows stand
side by side; a role's initial is its first character, none for the empty role; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.common import SPACES
from recallspark.plans.scratch import Scratch
from recallspark.plans.shipping import ensure_on_executors

#: Costs of edits and of a truncated row that stays, and the modulus of damage.
RETAG, DELETE, INSERT, CUT = 2, 3, 2, 1
DAMAGE = 20
#: The pattern of role initials, `(s?(ua)+)?`, as steps from its states; those at which it may end.
STEPS: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 60
#: Rows and bytes of a block at most (a single row may be longer).
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20

STATES = range(len(STEPS))
Costs = tuple[int, ...]


def _inserting() -> list[Costs]:
    """Least cost of inserted turns between states."""
    cost = [[0 if s == t else FAR for t in STATES] for s in STATES]
    for _ in STATES:
        for s in STATES:
            for initial in ROLES:
                if (t := STEPS[s].get(initial)) is not None:
                    for r in STATES:
                        cost[r][t] = min(cost[r][t], cost[r][s] + INSERT)
    return [tuple(row) for row in cost]


INSERTING = _inserting()


@lru_cache(maxsize=64)
def consuming(symbol: str) -> dict[int, tuple[tuple[str, int, int, str], ...]]:
    """Arcs (letter, cost, next state, initial of a changed role) that use up a row, by state.

    Symbols are the initial of the row's role, or x for any other; upper case marks a truncated row, F one that must go.
    """
    out = {}
    for s in STATES:
        arcs = [("D", DELETE, s, "")]
        if symbol != "F":
            stay = CUT if symbol.isupper() else 0
            if (t := STEPS[s].get(symbol.lower())) is not None:
                arcs.append(("K", stay, t, ""))
            arcs += [("R", RETAG + stay, STEPS[s][r], r) for r in ROLES if r in STEPS[s]]
        out[s] = tuple(arcs)
    return out


def _forward(costs: Costs, symbol: str) -> Costs:
    """Costs of the nodes after a row, from those of the nodes before it."""
    at, out = after_inserts(costs), [FAR] * len(STATES)
    for s, arcs in consuming(symbol).items():
        for _, cost, t, _ in arcs:
            out[t] = min(out[t], at[s] + cost)
    return tuple(out)


def after_inserts(costs: Costs) -> Costs:
    return tuple(min(FAR, *(costs[s] + INSERTING[s][t] for s in STATES)) for t in STATES)


def _backward(costs: Costs, symbol: str) -> Costs:
    """Costs to the end of the nodes before a row, from those of the nodes after it."""
    own = [min(cost + costs[t] for _, cost, t, _ in consuming(symbol)[s]) for s in STATES]
    return tuple(min(INSERTING[s][t] + own[t] for t in STATES) for s in STATES)


START: Costs = tuple(0 if s == 0 else FAR for s in STATES)
#: Costs to the end when all rows are used up: turns may still be inserted.
FINISH: Costs = tuple(min(INSERTING[s][t] for t in ENDS) for s in STATES)


def matrix(symbols: str) -> list[Costs]:
    """Least costs from each state before a block to each state after it."""
    rows = [tuple(0 if s == t else FAR for t in STATES) for s in STATES]
    for symbol in symbols:
        rows = [_forward(row, symbol) for row in rows]
    return rows


def traverse(symbols: str, entry: int, before: Costs, after: Costs, last: bool) -> tuple[str, str, int]:
    """Letters, initials of the roles they make (a space where none) and the state at the end.

    ``before`` and ``after``: least costs from the conversation's start to the states before the
    block, and from those after it to the conversation's end. Turns behind the rows are inserted in
    the ``last`` block only; elsewhere they belong to the next one.
    """
    ahead, behind = [before], [after]
    for symbol in symbols:
        ahead.append(_forward(ahead[-1], symbol))
    for symbol in reversed(symbols):
        behind.append(_backward(behind[-1], symbol))
    ahead = [after_inserts(costs) for costs in ahead]
    behind.reverse()
    if not symbols and not last:
        return "", "", entry
    best = min(a + b for a, b in zip(ahead[0], behind[0]))
    # letters so far are equal for all nodes of the set; each keeps one path that spells them
    reached: dict[int, tuple | None] = {entry: None}
    i, n = 0, len(symbols)
    while i < n or last:
        least, moves = "Z", {}
        for s, path in reached.items():
            arcs = [(letter, cost, t, initial, 1) for letter, cost, t, initial in consuming(symbols[i])[s]] if i < n else []
            arcs += [("I", INSERT, STEPS[s][r], r, 0) for r in ROLES if r in STEPS[s]]
            for letter, cost, t, initial, used in arcs:
                if letter <= least and ahead[i][s] + cost + behind[i + used][t] == best:
                    if letter < least:
                        least, moves = letter, {}
                    moves.setdefault(t, (path, letter, initial))
        if not moves:
            break
        reached = moves
        i += least != "I"
    state, path = min(reached.items(), key=lambda x: x[0])
    letters, made = [], []
    while path:
        path, letter, initial = path
        letters.append(letter)
        made.append(initial or " ")
    return "".join(reversed(letters)), "".join(reversed(made)), state


@lru_cache(maxsize=200_000)
def _solved(symbols: str) -> tuple[int, str, str]:
    """Least cost, letters and made roles of a short conversation; many share their symbols."""
    return _solve(symbols)


def _solve(symbols: str) -> tuple[int, str, str]:
    costs = START
    for symbol in symbols:
        costs = _forward(costs, symbol)
    letters, made, _ = traverse(symbols, 0, START, FINISH, True)
    return min(a + b for a, b in zip(costs, FINISH)), letters, made


def solve(symbols: str) -> tuple[int, str, str]:
    return _solved(symbols) if len(symbols) <= 32 else _solve(symbols)


def judged(roles: list[str], texts: list[str], seen: frozenset[int] = frozenset()) -> tuple[str, int, int, int]:
    """Symbols of rows and counts of blank, duplicate and truncated ones; rows in ``seen`` occur in an earlier block."""
    known: set[tuple[str, str]] = set()
    out, blank, duplicate, truncated = [], 0, 0, 0
    for i, row in enumerate(zip(roles, texts)):
        body = row[1].rstrip(SPACES)
        if not body:
            blank += 1
            out.append("F")
        elif row in known or i in seen:
            duplicate += 1
            out.append("F")
        else:
            initial = row[0][:1]
            symbol = initial if initial in ("s", "u", "a") else "x"
            if body[-1] not in ".!?":
                truncated += 1
                symbol = symbol.upper()
            out.append(symbol)
        known.add(row)
    return "".join(out), blank, duplicate, truncated


def illegal_pairs(roles: list[str], previous: str | None = None) -> int:
    """Neighbours whose initials aren't system-user, user-assistant or assistant-user."""
    initials = [r[:1] for r in roles]
    if previous is not None:
        initials.insert(0, previous)
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def edited(letters: str, made: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that edits leave."""
    out, rows = [], iter(zip(roles, texts))
    for letter, initial in zip(letters, made):
        if letter == "I":
            out.append((ROLES[initial], ""))
            continue
        role, text = next(rows)
        if letter == "K":
            out.append((role, text))
        elif letter == "R":
            out.append((ROLES[initial], text))
    return out


def gaps_of(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def damaged(conversations: DataFrame, modulus: int = DAMAGE) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` of rows after damage; dropped rows stay, empty and with no copies."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % modulus
    a = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return a.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PIECE = {"conv_id": pa.int64(), "part": pa.int64(), "seq": pa.int64(), "whole": pa.bool_(), **{c: pa.int64() for c in COUNTS}, "audit": pa.string(), "repaired": pa.list_(TURN)}
RAW = {"turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}
KEY = {k: PIECE[k] for k in ("conv_id", "part", "seq")}
#: What passes over a conversation's blocks: counts, ends of turns and roles, the matrix, and what passes add.
STEP = KEY | {c: pa.int64() for c in COUNTS} | {"low": pa.int64(), "high": pa.int64(), "first": pa.string(), "end": pa.string(), "costs": pa.list_(pa.int64())}
AHEAD = STEP | {"before": pa.list_(pa.int64())}
BEHIND = AHEAD | {"after": pa.list_(pa.int64()), "last": pa.bool_()}
EXITS = BEHIND | {"exits": pa.list_(pa.int64())}
ENTRY = BEHIND | {"entry": pa.int64()}


def _ddl(fields: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>", pa.list_(TURN): "array<struct<role: string, text: string>>"}
    return ", ".join(f"{k} {names[t]}" for k, t in fields.items())


def _batch(rows: list[dict], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(list(fields.items())))


class _Cutter:
    """Turns a task's sorted rows into whole, repaired conversations and into blocks of all others."""

    def __init__(self, part: int, most_rows: int, most_bytes: int):
        self.part, self.seq, self.out, self.size = part, 0, [], 0
        self.most_rows, self.most_bytes = most_rows, most_bytes
        self.open(None, True)

    def open(self, conv: int | None, edge: bool) -> None:
        #: edge: the conversation may have rows in another block.
        self.conv, self.edge = conv, edge
        self.clear()

    def clear(self) -> None:
        self.turns, self.roles, self.texts, self.bytes = [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            if self.turns and (len(self.turns) >= self.most_rows or self.bytes + len(text) > self.most_bytes):
                self.edge = True
                self.block()
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)

    def block(self) -> None:
        row = {"conv_id": self.conv, "part": self.part, "seq": self.seq}
        if self.edge:
            row |= {"whole": False, "turns": self.turns, "roles": self.roles, "texts": self.texts}
        else:
            symbols, blank, duplicate, truncated = judged(self.roles, self.texts)
            cost, letters, made = solve(symbols)
            repaired = [{"role": r, "text": t} for r, t in edited(letters, made, self.roles, self.texts)]
            row |= {"whole": True, "gaps": gaps_of(self.turns), "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal_pairs(self.roles), "cost": cost, "audit": letters, "repaired": repaired}
        self.size += self.bytes + 64
        self.out.append(row)
        self.seq += 1
        self.clear()

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.out and self.size >= least:
            yield _batch(self.out, PIECE | RAW)
            self.out, self.size = [], 0


def _cut(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    cutter, begun = _Cutter(TaskContext.get().partitionId(), most_rows, most_bytes), False
    for rb in batches:
        for conv, *row in zip(*(rb.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
            if not begun:
                cutter.open(conv, True)
                begun = True
            elif conv != cutter.conv:
                cutter.block()
                cutter.open(conv, False)
                yield from cutter.flush(most_bytes)
            cutter.add(*row)
    if begun:
        cutter.edge = True
        cutter.block()
        yield from cutter.flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrences of (role, text) in each block."""
    for rb in batches:
        for row in rb.to_pylist():
            known = {}
            for i, (role, text) in enumerate(zip(row["roles"], row["texts"])):
                known.setdefault(hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), i)
            if known:
                yield _batch([{"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "place": i, "digest": d} for d, i in known.items()], KEY | {"place": pa.int64(), "digest": pa.binary()})


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols, counts and matrix of each block."""
    for rb in batches:
        out = []
        for row in rb.to_pylist():
            symbols, blank, duplicate, truncated = judged(row["roles"], row["texts"], frozenset(row["places"] or ()))
            known = [t for t in row["turns"] if t is not None]
            out.append(
                {k: row[k] for k in KEY}
                | {"gaps": gaps_of(known), "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal_pairs(row["roles"]), "cost": 0}
                | {"low": min(known, default=None), "high": max(known, default=None), "first": row["roles"][0][:1] if row["roles"] else None, "end": row["roles"][-1][:1] if row["roles"] else None}
                | {"costs": [c for costs in matrix(symbols) for c in costs], "symbols": symbols}
            )
        yield _batch(out, STEP | {"symbols": pa.string()})


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows in order, each with whether it is the first of its conversation."""
    last = object()
    for rb in batches:
        for row in rb.to_pylist():
            yield row["conv_id"] != last, row
            last = row["conv_id"]


def _chunks(rows: Iterator[dict], fields: dict[str, pa.DataType], size: int = 1000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append({k: row[k] for k in fields})
        if len(out) == size:
            yield _batch(out, fields)
            out = []
    if out:
        yield _batch(out, fields)


def _pass_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the costs before each block, and what lies between it and the block before to its counts."""

    def rows():
        for new, row in _conversations(batches):
            if new:
                before, high, end = START, None, None
            row["before"] = list(before)
            m = row["costs"]
            n = len(STATES)
            before = tuple(min(FAR, *(before[s] + m[s * n + t] for s in STATES)) for t in STATES)
            if row["low"] is not None:
                if high is not None:  # turns rise, so at most the one at the edge is shared
                    row["gaps"] += row["low"] - high - (row["low"] != high)
                high = row["high"]
            if row["first"] is not None:
                if end is not None:
                    row["illegal"] += end + row["first"] not in ("su", "ua", "au")
                end = row["end"]
            yield row

    return _chunks(rows(), AHEAD)


def _pass_backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the costs after each block; rows come last block first."""

    def rows():
        for new, row in _conversations(batches):
            if new:
                after = FINISH
            row["after"], row["last"] = list(after), new
            m, n = row["costs"], len(STATES)
            # turns between blocks are inserted in the later one, whose matrix holds them
            after = tuple(min(FAR, *(m[s * n + t] + after[t] for t in STATES)) for s in STATES)
            yield row

    return _chunks(rows(), BEHIND)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the state at which a traversal from each state of an optimal path ends, else -1."""

    def rows():
        for _, row in _conversations(batches):
            before, after, m, n = row["before"], row["after"], row["costs"], len(STATES)
            through = [before[s] + min(m[s * n + t] + after[t] for t in STATES) for s in STATES]
            best = min(through)
            row["exits"] = [traverse(row["symbols"], s, tuple(before), tuple(after), row["last"])[2] if through[s] == best else -1 for s in STATES]
            yield row

    return _chunks(rows(), EXITS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the state before each block and the block's cost."""

    def rows():
        for new, row in _conversations(batches):
            state = 0 if new else state
            row["entry"], row["cost"] = state, 0
            exit_ = row["exits"][state]
            m, n, last = row["costs"], len(STATES), row["last"]
            row["cost"] = min(m[state * n + t] + FINISH[t] for t in STATES) if last else m[state * n + exit_]
            state = exit_
            yield row

    return _chunks(rows(), ENTRY)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and turns of each block."""
    for rb in batches:
        for row in rb.to_pylist():
            letters, made, _ = traverse(row["symbols"], row["entry"], tuple(row["before"]), tuple(row["after"]), row["last"])
            repaired = [{"role": r, "text": t} for r, t in edited(letters, made, row["roles"], row["texts"])]
            yield _batch([{k: row[k] for k in (*KEY, *COUNTS)} | {"whole": False, "audit": letters, "repaired": repaired}], PIECE)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Cheapest repairs, in pieces: whole conversations, and blocks (part, seq) of those that lie in several.

    ``rows``: conv_id, turn, role, text and, if there, copies. Columns: conv_id, part, seq, whole, the
    counts gaps, blank, duplicate, truncated, illegal and cost (of a block: its share, so they add up), audit and repaired, the turns left.
    """
    spark = rows.sparkSession
    ensure_on_executors(spark)
    scratch = Scratch.of(spark)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), copies.alias("copies"))
    # the last key spreads equal rows over ranges
    order = ["conv_id", "turn", "role", F.substring("text", 1, 100), F.xxhash64("text"), "mark"]
    marked = rows.withColumn("mark", F.monotonically_increasing_id())
    pieces = scratch.save(marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("mark").mapInArrow(lambda batches: _cut(batches, block_rows, block_bytes), _ddl(PIECE | RAW)))
    blocks = pieces.where(~F.col("whole")).select(*KEY, *RAW)
    firsts = scratch.save(blocks.mapInArrow(_digests, _ddl(KEY | {"place": pa.int64(), "digest": pa.binary()})))
    home = firsts.groupBy(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none"), "digest").agg(F.min(F.struct("part", "seq")).alias("home"))
    again = firsts.withColumn("c", F.coalesce("conv_id", F.lit(0))).withColumn("none", F.col("conv_id").isNull()).join(home, ["c", "none", "digest"]).where(F.struct("part", "seq") != F.col("home"))
    seen = again.groupBy("part", "seq").agg(F.collect_list("place").alias("places"))  # at most a block's rows
    steps = scratch.save(blocks.join(seen, ["part", "seq"], "left").select(*KEY, *RAW, "places").mapInArrow(_steps, _ddl(STEP | {"symbols": pa.string()})))
    by_conv = steps.select(*STEP).repartition("conv_id")
    ahead = by_conv.sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_pass_forward, _ddl(AHEAD))
    behind = ahead.sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(_pass_backward, _ddl(BEHIND))
    exits = behind.join(steps.select("part", "seq", "symbols"), ["part", "seq"]).select(*BEHIND, "symbols").mapInArrow(_exits, _ddl(EXITS))
    entries = exits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_entries, _ddl(ENTRY))
    known = scratch.save(entries.join(steps.select("part", "seq", "symbols"), ["part", "seq"]))
    several = known.join(blocks.select("part", "seq", "roles", "texts"), ["part", "seq"]).mapInArrow(_pieces, _ddl(PIECE))
    return pieces.where("whole").select(*PIECE).unionByName(several)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations in order, as one row each: counts, letters and the digest of the turns."""
    fields = {"conv_id": pa.int64(), **{c: pa.int64() for c in COUNTS}, "audit": pa.string(), "repaired_sha256": pa.string()}

    def done():
        return total | {"audit": "".join(letters), "repaired_sha256": digest.hexdigest()}

    def rows():
        nonlocal total, letters, digest
        for new, row in _conversations(batches):
            if new:
                if total is not None:
                    yield done()
                total, letters, digest, some = {"conv_id": row["conv_id"]} | dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False
            for c in COUNTS:
                total[c] += row[c]
            letters.append(row["audit"])
            for turn in row["repaired"]:
                digest.update(("\n" * some + f"{turn['role']}:{turn['text']}").encode())
                some = True
        if total is not None:
            yield done()

    total = letters = digest = None
    return _chunks(rows(), fields)


def report(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, counts, audit and the sha256 of its ``role:text`` lines."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = pieces.where("whole").select("conv_id", *COUNTS, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    ordered = pieces.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    schema = ", ".join(["conv_id long", *(f"{c} long" for c in COUNTS), "audit string", "repaired_sha256 string"])
    return whole.unionByName(ordered.mapInArrow(_joined, schema))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return report(repair(rows)).select("conv_id", *COUNTS[:5], "cost", "audit", "repaired_sha256")


def _oracle() -> str:
    """Damage by crc32, faults by windows, and the cheapest letters to each state, row by row, in one recursion."""
    ws, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    steps = ", ".join(f"({s}, '{r}', {t})" for s in STATES for r, t in STEPS[s].items())
    names = ", ".join(f"('{r}', '{name}')" for r, name in ROLES.items())
    return rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)),
         lambda acc, b: list_reduce(range(8), lambda c, j: xor(c >> 1, 3988292384 * (c & 1)), xor(acc, b)), 4294967295), 4294967295) % {DAMAGE} AS kind FROM src
), damaged AS (
  SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{word}') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN regexp_extract(text, '({word}){ws}*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(role[1:1]) OVER (PARTITION BY g ORDER BY i) || role[1:1] AS pair FROM numbered
), counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY g
), step(s, r, t) AS (VALUES {steps}
), made(r, name) AS (VALUES {names}
), once AS (
  SELECT s, t, name FROM step JOIN made USING (r)
), ins AS (
  SELECT s, s AS t, 0 AS cost, '' AS a, '' AS o FROM (SELECT DISTINCT s FROM step)
  UNION ALL SELECT s, t, {INSERT}, 'I', name || ':' || chr(10) FROM once
  UNION ALL SELECT x.s, y.t, {2 * INSERT}, 'II', x.name || ':' || chr(10) || y.name || ':' || chr(10) FROM once x JOIN once y ON y.s = x.t
), arc AS (
  SELECT g, i, s, s AS t, {DELETE} AS cost, 'D' AS a, '' AS o FROM judged, (SELECT DISTINCT s FROM step)
  UNION ALL SELECT g, i, s, t, CASE WHEN fault = 'truncated' THEN {CUT} ELSE 0 END, 'K', role || ':' || text || chr(10) FROM judged JOIN step ON r = role[1:1] WHERE fault IN ('', 'truncated')
  UNION ALL SELECT g, i, s, t, {RETAG} + CASE WHEN fault = 'truncated' THEN {CUT} ELSE 0 END, 'R', name || ':' || text || chr(10) FROM judged, once WHERE fault IN ('', 'truncated')
), path(g, i, s, c, a, o) AS (
  SELECT g, CAST(0 AS BIGINT), 0, 0, '', '' FROM counts
  UNION ALL
  SELECT g, i, t, min(c), arg_min(a, k), arg_min(o, k) FROM (
    SELECT p.g AS g, r.i AS i, r.t AS t, p.c + n.cost + r.cost AS c, p.a || n.a || r.a AS a, p.o || n.o || r.o AS o, printf('%09d', p.c + n.cost + r.cost) || p.a || n.a || r.a AS k
    FROM path p JOIN ins n ON n.s = p.s JOIN arc r ON r.g = p.g AND r.i = p.i + 1 AND r.s = n.t
  ) GROUP BY g, i, t
), ended AS (
  SELECT p.g AS g, p.c + n.cost AS c, p.a || n.a AS a, p.o || n.o AS o FROM path p JOIN counts q ON q.g = p.g AND q.n = p.i JOIN ins n ON n.s = p.s WHERE n.t IN {ENDS}
), best AS (
  SELECT g, min(c) AS cost, arg_min(a, printf('%09d', c) || a) AS audit, arg_min(o, printf('%09d', c) || a) AS o FROM ended GROUP BY g
)
SELECT c.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(CASE WHEN coalesce(o, '') = '' THEN '' ELSE o[1:length(o)-1] END) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM src) c LEFT JOIN counts USING (g) LEFT JOIN best USING (g)"""


ORACLE_SQL = _oracle()
