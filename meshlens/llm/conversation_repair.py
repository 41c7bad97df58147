"""Repair of conversations by error-correcting Earley parsing.

A weighted grammar says which orders of roles are right; besides its terminals, which a row of that role meets for
nothing, there are productions that delete a row, give it another role, or insert one. The chart's items retain their
least (cost, audit), and the completed chart yields the repair.

Rows are read from the last to the first, so that an audit grows at its front: of two audits that grow by the same edit
the lesser stays the lesser, so keeping one for each item is enough. The grammar is left-recursive for this direction,
so that every item begins at the chart's first column and a column needs the one before it only. Columns that are equal
but for a common cost share one entry of a table, and reading a row is one look-up in it; the table stays small.

A conversation is a stream through one task, in both directions, whatever its length: reading keeps a column's number,
and every row takes along what its column decided; a second pass follows the decisions from the first row on.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}  # what a row can be given or inserted as, by the terminal

#: (s?(ua)+)?, read from its end: a nonterminal only stands first in a rule.
RULES = [("Goal", ()), ("Goal", ("Pairs",)), ("Goal", ("Headed",)), ("Headed", ("Pairs", "s")), ("Pairs", ("Half", "u")), ("Half", ("a",)), ("Half", ("Pairs", "a"))]
NONTERMINALS = {left for left, _ in RULES}
ITEMS = [(r, dot) for r, (_, right) in enumerate(RULES) for dot in range(len(right) + 1)]
#: Whole pairs, and the items that permit nothing which whole pairs don't: where these cost more, they are left out.
PAIRS, NARROWER = (1, 1), ((0, 0), (2, 1), (5, 0))


def _waits(item: tuple[int, int]) -> bool:
    """Whether a later row or the end can still move the item: it is behind a nonterminal or before a terminal."""
    left, right = RULES[item[0]]
    return left == "Goal" and item[1] == len(right) or item[1] < len(right) and right[item[1]] not in NONTERMINALS


class Chart:
    """Columns of the chart, each once: a column is a tuple of (item, cost above the least, rank of its audit)."""

    def __init__(self):
        self.columns: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.read: dict[tuple, tuple[int, int, str]] = {}
        predicted = {item: (0, ("", 0), (), -1) for item in ITEMS if item[1] == 0}
        self.first, self.first_cost, self.first_decisions = self._enter(predicted)

    def _closed(self, column: dict) -> dict:
        """Completed items move on what waits for them, and insertions move an item over its terminal, until nothing gets better."""
        todo = list(column)
        while todo:
            item = todo.pop()
            cost, (edits, rank), path, before = column[item]
            left, right = RULES[item[0]]
            if item[1] == len(right):
                moves = [((r, 1), (cost, (edits, rank), path, before)) for r, (_, other) in enumerate(RULES) if other[:1] == (left,)]
            elif right[item[1]] in ROLES:
                moves = [((item[0], item[1] + 1), (cost + COST[INSERT], (INSERT + edits, rank), ((INSERT, right[item[1]]), *path), before))]
            else:
                moves = []
            for to, new in moves:
                if to not in column or new[:2] < column[to][:2]:
                    column[to] = new
                    todo.append(to)
        return column

    def _enter(self, column: dict) -> tuple[int, int, str]:
        """(number, least cost, decisions) of a column; decisions: for each item its edits, in order, and the item of the
        column before that it follows."""
        column = {item: c for item, c in self._closed(column).items() if _waits(item)}
        if PAIRS in column:
            column = {item: c for item, c in column.items() if item not in NARROWER or c[0] <= column[PAIRS][0]}
        least = min(c[0] for c in column.values())
        ranks = {key: i for i, key in enumerate(sorted({c[1] for c in column.values()}))}
        shape = tuple((item, column[item][0] - least, ranks[column[item][1]]) for item in sorted(column))
        if shape not in self.number:
            self.number[shape] = len(self.columns)
            self.columns.append(shape)
        decisions = json.dumps({ITEMS.index(item): [column[item][2], column[item][3]] for item in sorted(column)}, separators=(",", ":"))
        return self.number[shape], least, decisions

    def step(self, number: int, initial: str, gone: bool, extra: int) -> tuple[int, int, str]:
        """Read a row: (next column's number, cost added, decisions). gone: it must be deleted; extra: what keeping it costs more."""
        symbol = (number, initial, gone, extra)
        if symbol not in self.read:
            new: dict = {}

            def offer(item, cost, edit, path, before, rank):
                candidate = (cost, (edit, rank), path, before)
                if item not in new or candidate[:2] < new[item][:2]:
                    new[item] = candidate

            for item, cost, rank in self.columns[number]:
                right, before = RULES[item[0]][1], ITEMS.index(item)
                offer(item, cost + COST[DELETE], DELETE, ((DELETE, ""),), before, rank)
                if not gone and item[1] < len(right):
                    terminal = right[item[1]]
                    edit = KEEP if terminal == initial else REROLE if terminal in ROLES else None
                    if edit:
                        offer((item[0], item[1] + 1), cost + COST[edit] + extra, edit, ((edit, terminal),), before, rank)
            self.read[symbol] = self._enter(new)
        return self.read[symbol]

    def goal(self, number: int) -> tuple[int, int]:
        """(item, cost above the column's least) of the best whole parse."""
        ends = [(cost, rank, ITEMS.index(item)) for item, cost, rank in self.columns[number] if RULES[item[0]][0] == "Goal" and item[1] == len(RULES[item[0]][1])]
        cost, _, item = min(ends)
        return item, cost


@functools.cache
def chart() -> Chart:
    return Chart()


def faults(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, pos, final, fault, illegal, fresh): pos from 1 within the conversation by turn (null first), then role,
    then text, final at the last one; fault the first of blank, duplicate and truncated that holds; illegal, whether the initials of the role
    before and of this one aren't su, ua or au; fresh, whether the turn is a new one. Null roles and texts are one space."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    rows = rows.withColumn("hash", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    seen = rows.groupBy(F.struct("conv", "hash").alias("same")).agg(F.min(place).alias("first"))  # one short row for each text of a conversation
    rows = rows.withColumn("same", F.struct("conv", "hash")).join(seen, "same")
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumns({"pos": F.row_number().over(order), "last": F.lag(F.struct("turn", "hash", F.substring("role", 1, 1).alias("initial"))).over(order)})
    told = F.col("last").isNotNull()
    same_turn = told & F.col("last.turn").eqNullSafe(F.col("turn"))
    repeated = (F.col("first") < place) | (same_turn & (F.col("last.hash") == F.col("hash")))
    last_char = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(last_char == "", "blank").when(repeated, "duplicate").when(~last_char.isin(".", "!", "?"), "truncated")
    illegal = told & ~F.concat("last.initial", F.substring("role", 1, 1)).isin("su", "ua", "au")
    return rows.select("conv", "turn", "role", "text", "pos", F.lead("pos").over(order).isNull().alias("final"), fault.alias("fault"), illegal.alias("illegal"), (F.col("turn").isNotNull() & ~same_turn).alias("fresh"))


def _read_backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what each row's column decided, the best whole parse if the row is a conversation's first, and its cost."""
    c, number, cost = chart(), 0, 0
    fresh = True
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for pos, role, fault in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("pos", "role", "fault"))):
            if fresh:
                number, cost = c.first, c.first_cost
            number, added, decisions = c.step(number, role[:1], fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0)
            cost += added
            item, above = c.goal(number)
            for column, value in zip(out, (decisions, item, cost + above)):
                column.append(value)
            fresh = pos == 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], names=[*batch.schema.names, "decisions", "goal", "cost"])


_loads = functools.lru_cache(1 << 16)(json.loads)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row an edit, by following the decisions from a conversation's first row on."""
    ends, item, place = json.loads(chart().first_decisions), 0, 0
    for batch in batches:
        value = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        own, at, edits, roles, places = [], [], [], [], []
        for i, (pos, role, final, goal, decisions) in enumerate(zip(*(value[c].to_pylist() for c in ("pos", "role", "final", "goal", "decisions")))):
            if pos == 1:
                item, place = goal, 0
            path, item = _loads(decisions)[str(item)]
            for edit, to in [*path, *(ends[str(item)][0] if final else ())]:
                place += 1
                own.append(i)
                at.append(None if edit == INSERT else i)
                edits.append(edit)
                roles.append(ROLES[to] if edit in (INSERT, REROLE) else role)
                places.append(place)
        rows, own = pa.array(at, pa.int32()), pa.array(own, pa.int32())
        text = value["text"].take(rows).fill_null("")
        yield pa.RecordBatch.from_arrays(
            [value["conv"].take(own), pa.array(places, pa.int32()), pa.array(edits, pa.string()), pa.array(roles, pa.string()), text, value["turn"].take(rows), value["role"].take(rows), value["fault"].take(rows), value["illegal"].take(rows), value["fresh"].take(rows), value["cost"].take(own)],
            names=["conv", "place", "edit", "role", "text", "turn", "old_role", "fault", "illegal", "fresh", "cost"],
        )


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row an edit: conv, place (from 1), edit (K, R, D or I), the repaired role and text, and of the row behind it its
    turn, old_role, fault, illegal and fresh (see faults), all null for an inserted row. cost is the conversation's at place 1.

    The edits are the cheapest that make the roles' initials (s?(ua)+)?: keeping is free, a row made user or assistant costs
    3, a deleted one 4, an inserted one (of empty text) 3, and a truncated row that stays 3 more; blank and duplicate rows
    must go. Of equally cheap edits those whose letters come first in the alphabet are taken. Null roles and texts are one
    space, null conversations are one conversation, null turns come first; rows of the same turn are read by role, then by text, and equal
    rows are duplicates. Other columns are left out. An empty table gives an empty result; a conversation whose rows all go gives rows of D alone.
    """
    rows = faults(turns, conv, turn, role, text)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    of = lambda names: ", ".join(f"{c} {kinds[c]}" for c in names)
    read = rows.sortWithinPartitions("conv", F.desc("pos")).mapInArrow(_read_backward, of(rows.columns) + ", decisions string, goal int, cost long")
    return read.sortWithinPartitions("conv", "pos").mapInArrow(_follow, f"{of(['conv'])}, place int, edit string, role string, text string, {of(['turn'])}, old_role string, fault string, illegal boolean, fresh boolean, cost long")


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's digest from its edits in order: one hash state and the audit are all that is held."""
    columns = ("conv", "place", "edit", "role", "text", "turn", "fault", "illegal", "fresh", "cost")
    held: dict | None = None

    def result() -> dict:
        turns = [t for t in held["turns"] if t is not None]
        return {
            "conv": held["conv"], "gaps": max(turns) - min(turns) + 1 - held["fresh"] if turns else 0, **{f: held[f] for f in ("blank", "duplicate", "truncated", "illegal", "cost")},
            "audit": "".join(held["audit"]), "repaired_sha256": held["hash"].hexdigest(),
        }

    for batch in batches:
        done = []
        for conv, place, edit, role, text, turn, fault, illegal, fresh, cost in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)):
            if place == 1:
                if held is not None:
                    done.append(result())
                held = {"conv": conv, "turns": (None, None), "fresh": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": cost, "audit": [], "hash": hashlib.sha256(), "rows": 0}
            held["audit"].append(edit)
            if edit != DELETE:
                held["hash"].update(("\n" * (held["rows"] > 0) + f"{role}:{text}").encode())
                held["rows"] += 1
            if fault:
                held[fault] += 1
            held["illegal"] += bool(illegal)
            if turn is not None:
                low, high = held["turns"]
                held["turns"] = (turn if low is None else min(low, turn), turn if high is None else max(high, turn))
                held["fresh"] += bool(fresh)
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([(n, batch.schema.field("conv").type if n == "conv" else pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in done[0]]))
        kind = batch.schema.field("conv").type
    if held is not None:
        one = result()
        yield pa.RecordBatch.from_pylist([one], pa.schema([(n, kind if n == "conv" else pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in one]))


def digest(edits: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation in repair's result."""
    kind = edits.schema["conv"].dataType.simpleString()
    ordered = edits.repartition("conv").sortWithinPartitions("conv", "place")
    return ordered.mapInArrow(_sum_up, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
