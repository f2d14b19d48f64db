"""Repair of conversation structure as a shortest path with scalar big-integer weights.

A conversation's rows must give role initials ``(s?(ua)+)?``. Edits: Keep, Rerole (to user or assistant), Delete, Insert (a turn without text). The cheapest
edits win, and among them those whose letters, in order, are least in ASCII. Both are one whole number: the high digits are the cost, and below
them each place of the audit has a digit of fixed width, Delete 1, Insert 2, Keep 3, Rerole 4, and 0 after its end. A node of the graph is a row, a state of the grammar and the
number of inserts so far, which together say the place of the next letter, so the weight of an edge is its cost and its letter's digit there. The least sum of
weights to the end then decides everything: cost and audit are read from its digits.

Inserted turns: deleting the partner of an inserted turn in its pair, and at worst the system row before, is a repair too. Where an insert costs more than two deletes no
cheapest repair has one and the graph needs no such nodes; else deleting all rows bounds their number.

Rows are shuffled once, by conversation, and sorted; tasks read them as a stream and hold four nodes: the number so far and the state of the digest of the repaired text
so far. No conversation is held in memory, though its rows are read in order by one task, as its one digest demands.

Defined results: a null role or text is one space, as is a null id or turn in the digest that chooses damage; rows without an id are one conversation; null turns come first and
equal turns are ordered by role and text; repeated rows are rows of their own; a role without any sign cannot be kept; texts of any length count whole; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.llm.common import prepared

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")

#: Digits of the audit's letters, three bits each; 0 ends it.
LETTERS = ("", "D", "I", "K", "R")
BITS = 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow in each state: initial and next state.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The role that a Rerole or an Insert gives in each state.
MADE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@dataclass(frozen=True)
class Costs:
    """Costs of edits; ``truncated`` is added for a truncated row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def most_inserts(self, rows: int) -> int:
        """A bound on the inserts of a cheapest repair."""
        return 0 if self.insert > 2 * self.delete else rows * self.delete // self.insert


class Path:
    """Least weights from the start to all nodes of one row, with the digest of the repaired text on that way."""

    def __init__(self, rows: int, costs: Costs) -> None:
        self.costs, self.room = costs, costs.most_inserts(rows)
        self.width, self.row = rows + self.room, 0
        # (state, inserts): (weight, digest, whether any turn was written)
        self.nodes = {(START, 0): (0, hashlib.sha256(), False)}
        self._insert()

    def _weight(self, cost: int, letter: str, place: int) -> int:
        return (cost << BITS * self.width) + (LETTERS.index(letter) << BITS * (self.width - 1 - place))

    @staticmethod
    def _written(node, weight: int, turn: str):
        digest = node[1].copy()
        digest.update(("\n" + turn if node[2] else turn).encode())
        return weight, digest, True

    def _insert(self) -> None:
        for used in range(self.room):
            for state in range(4):
                node = self.nodes.get((state, used))
                if node:
                    role = MADE[state]
                    goal = NEXT[state][role[0]], used + 1
                    weight = node[0] + self._weight(self.costs.insert, "I", self.row + used)
                    if goal not in self.nodes or weight < self.nodes[goal][0]:
                        self.nodes[goal] = self._written(node, weight, f"{role}:")

    def add(self, role: str, text: str, fault: int) -> None:
        """The next row."""
        best: dict[tuple[int, int], tuple[int, tuple, str | None]] = {}

        def edge(node, goal, cost: int, letter: str, turn: str | None) -> None:
            weight = node[0] + self._weight(cost, letter, self.row + goal[1])
            if goal not in best or weight < best[goal][0]:
                best[goal] = weight, node, turn

        extra = self.costs.truncated if fault == TRUNCATED else 0
        for (state, used), node in self.nodes.items():
            edge(node, (state, used), self.costs.delete, "D", None)
            if fault in (BLANK, DUPLICATE):
                continue
            kept = NEXT[state].get(role[:1])
            if kept is not None:
                edge(node, (kept, used), extra, "K", f"{role}:{text}")
            made = MADE[state]
            edge(node, (NEXT[state][made[0]], used), self.costs.rerole + extra, "R", f"{made}:{text}")
        self.nodes = {g: (w, n[1], n[2]) if t is None else self._written(n, w, t) for g, (w, n, t) in best.items()}
        self.row += 1
        self._insert()

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair."""
        weight, digest, _ = min((n for (state, _), n in self.nodes.items() if state in (START, ASSISTANT)), key=lambda n: n[0])
        digits = (weight >> BITS * (self.width - 1 - i) & 7 for i in range(self.width))
        return weight >> BITS * self.width, "".join(LETTERS[d] for d in digits), digest.hexdigest()


def damage(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """``(conv_id, turn, role, text, gone)``: rows damaged by the CRC-32 of ``conv_id:turn``. A dropped row stays as a mark with ``gone``, so that its
    conversation is known."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % kinds
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 0, None).when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 0, None).when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault`` (0, BLANK, DUPLICATE or TRUNCATED) and ``n_rows`` of the conversation, sorted within partitions that hold whole conversations.

    The one shuffle is by conversation. A row is a duplicate of an earlier one by the digest of role and text.
    """
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    seen = Window.partitionBy("conv_id", "gone", "digest").orderBy(F.col("turn").asc_nulls_first())
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (
        F.when(F.col("gone"), 0)
        .when(trimmed == "", BLANK)
        .when(F.col("earlier") > 0, DUPLICATE)
        .when(~F.right(trimmed, F.lit(1)).isin(*ENDS), TRUNCATED)
        .otherwise(0)
    )
    flagged = rows.withColumn("digest", digest).repartition("conv_id").withColumn("earlier", F.row_number().over(seen) - 1)
    flagged = flagged.withColumns({"fault": fault, "n_rows": F.count_if(~F.col("gone")).over(Window.partitionBy("conv_id"))})
    return flagged.drop("digest", "earlier").sortWithinPartitions("conv_id", *_order())


def _decide(costs: Costs):
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    class Summary:
        def __init__(self, conv, rows: int) -> None:
            self.conv, self.path = conv, Path(rows, costs)
            self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
            self.low = self.high = None
            self.turns = 0

        def add(self, turn, role: str, text: str, fault: int) -> None:
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1
            if self.before is not None:
                self.illegal += self.before + role[:1] not in LEGAL
            self.before = role[:1]
            self.faults[fault] += 1
            self.path.add(role, text, fault)

        def row(self) -> tuple:
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            cost, audit, digest = self.path.end()
            return self.conv, gaps, *self.faults[1:], self.illegal, cost, audit, digest

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv, turn, role, text, gone, fault, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now:
                        done.append(now.row())
                    now = Summary(conv, n)
                if not gone:
                    now.add(turn, role, text, fault)
            if done:
                yield table(done)
        if now:
            yield table([now.row()])

    return run


def decide(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of :func:`damage`'s kind of rows: counts of faults, cost and audit of the repair, and the digest of the repaired text."""
    prepared(rows.sparkSession)
    schema = ", ".join([*(f"{n} bigint" for n in ("conv_id", *COUNTS)), "audit string", "repaired_sha256 string"])
    flagged = faults(rows).select("conv_id", "turn", "role", "text", "gone", "fault", "n_rows")
    return flagged.mapInArrow(_decide(costs), schema)


def repaired(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The repaired turns ``(conv_id, place, role, text)`` that an audit gives, place counting from 0.

    Letters meet their rows by the row's number in its conversation. After a kept system turn roles alternate, so a turn's place says what role a Rerole or Insert gives.
    """
    at = rows.filter(~F.col("gone")).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*_order())))
    letters = decisions.select("conv_id", F.posexplode(F.split("audit", "")).alias("p", "letter")).filter("letter <> ''")
    by_place = Window.partitionBy("conv_id").orderBy("p")
    letters = letters.withColumn("n", F.when(F.col("letter") != "I", F.count_if(F.col("letter") != "I").over(by_place)))
    left, right = letters.filter("letter <> 'D'").alias("l"), at.alias("r")
    met = left.join(right, F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.n") == F.col("r.n")), "left")
    turns = met.select("l.conv_id", "p", "letter", "role", F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(by_place) - 1
    opened = F.max(((F.col("place") == 0) & (F.col("letter") == "K") & F.col("role").startswith("s")).cast("int")).over(Window.partitionBy("conv_id"))
    made = F.when((F.col("place") - F.col("opened")) % 2 == 0, "user").otherwise("assistant")
    turns = turns.withColumn("place", place).withColumn("opened", opened)
    return turns.select("conv_id", "place", F.when(F.col("letter") == "K", F.col("role")).otherwise(made).alias("role"), "text")
