"""Conversation structure repair: weighted finite-state composition and its shortest path.

The rows of a conversation are an input acceptor, one arc a row; an edit transducer keeps, re-roles or deletes a row or inserts an empty
turn; a role grammar accepts the output. Their composition is built lazily, one layer of arcs for each pair of a row's symbol and the
costs behind it, and is acyclic, since its states go by rows and, within a row, by the inserted turns. Weights are pairs of a cost and a label
string, compared in this order. In string order a prefix comes before what it begins, so weights are only monotone under labels put in front: the
topological pass goes from the last row to the first. From a state each label has one arc at most (checked), so costs to the end are all
that is carried: where costs tie, the first unlike label decides, and the least label is taken.

Rows are dealt out by conversation and sorted; both passes, backwards over costs and forwards over the chosen arcs, read them as a stream and hold one
conversation's states, hash and labels, never its rows or texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
FAULTS = ("blank", "duplicate", "truncated")


@dataclass(frozen=True)
class Grammar:
    """An acceptor of role initials; ``made`` are the roles that an edit may give."""

    begin: str = "begin"
    accepting: tuple[str, ...] = ("begin", "answered")
    steps: tuple[tuple[str, str, str], ...] = (
        ("begin", "s", "primed"),
        ("begin", "u", "asked"),
        ("primed", "u", "asked"),
        ("asked", "a", "answered"),
        ("answered", "u", "asked"),
    )
    made: tuple[str, ...] = ("user", "assistant")

    @cached_property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.begin, *self.accepting, *(x for a, _, b in self.steps for x in (a, b))]))

    @cached_property
    def moves(self) -> list[dict[str, int]]:
        """For each state the next one by initial."""
        at = self.states.index
        return [{i: at(b) for a, i, b in self.steps if a == q} for q in self.states]

    @cached_property
    def given(self) -> list[tuple[str, int] | None]:
        """For each state the role that an edit gives there, and the next state."""
        each = [[(r, m[r[:1]]) for r in self.made if r[:1] in m] for m in self.moves]
        if any(len(x) > 1 for x in each):
            raise ValueError("two roles can be made in one state: their edits would have one label")
        return [x[0] if x else None for x in each]


@dataclass(frozen=True)
class Costs:
    """Positive costs of edits; ``truncated`` is added for each such row that stays."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


#: What leads from a state over a row (or over the end): labels, the roles of the turns put out (None: the row's own), the next state, cost.
Way = tuple[str, tuple[str | None, ...], int, int]


class Lattice:
    """The composed machine, layer by layer."""

    def __init__(self, grammar: Grammar, costs: Costs):
        self.g, self.c = grammar, costs
        self.n = len(grammar.states)
        self.accepts = [q in grammar.accepting for q in grammar.states]
        self.layer: Callable[[str, str | None, tuple], tuple[tuple, tuple[Way, ...]]] = lru_cache(1 << 14)(self._layer)

    def consuming(self, q: int, initial: str, fault: str | None, after: tuple) -> list[tuple[float, str, str | None, int]]:
        """Arcs over a row from grammar state ``q``: cost to the end, label, role, next state."""
        out = [(self.c.delete + after[q], DELETE, "", q)]
        if fault not in ("blank", "duplicate"):
            more = self.c.truncated if fault == "truncated" else 0
            if (to := self.g.moves[q].get(initial)) is not None:
                out.append((more + after[to], KEEP, None, to))
            if made := self.g.given[q]:
                out.append((self.c.rerole + more + after[made[1]], REROLE, *made))
        return out

    def _layer(self, initial: str, fault: str | None, after: tuple) -> tuple[tuple, tuple[Way, ...]]:
        """(costs to the end before the row, by state; the way taken from each state). An insertion costs something, so a best way visits no
        state twice between two rows and inserts no more than states - 1 turns there."""
        best: dict[tuple[int, int], tuple[float, str, str | None, int]] = {}
        for k in range(self.n - 1, -1, -1):
            for q in range(self.n):
                arcs = self.consuming(q, initial, fault, after) if fault != "end" else [(0 if self.accepts[q] else math.inf, "", "", q)]
                if k < self.n - 1 and (made := self.g.given[q]):
                    arcs.append((self.c.insert + best[k + 1, made[1]][0], INSERT, *made))
                best[k, q] = min(arcs, key=lambda a: a[:2])
        ways = []
        for q in range(self.n):
            labels, roles, k, at = "", [], 0, q
            while True:
                _, label, role, to = best[k, at]
                labels, at, k = labels + label, to, k + 1
                if role != "":
                    roles.append(role)
                if label != INSERT:
                    break
            ways.append((labels, tuple(roles), at, best[0, q][0]))
        return tuple(best[0, q][0] for q in range(self.n)), tuple(ways)

    def end(self) -> tuple[tuple, tuple[Way, ...]]:
        return self.layer("", "end", ())

    def before(self, initial: str, fault: str | None, after: tuple) -> tuple[tuple, tuple[Way, ...]]:
        """``layer`` with costs counted from the least of ``after``: few tuples of them occur, whatever the length."""
        least = min(after)
        return self.layer(initial, fault, tuple(x - least for x in after))


def same(a: object, b: object) -> bool:
    return a == b or a != a and b != b


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null role or text: one space), times (the how-manieth row of its role and text), initial, fault."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).repartition("conv_id")
    bare = F.rtrim("text", F.lit(WHITE))
    t = t.withColumn("times", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")))
    fault = F.when(bare == "", "blank").when(F.col("times") > 1, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    return t.select("*", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def repair_conversations(turns: DataFrame, grammar: Grammar | None = None, costs: Costs | None = None) -> DataFrame:
    """A row for each row of ``turns``: conv_id, turn, role, text, fault (null, or the first of blank, duplicate, truncated), illegal (its initial may not
    follow the former row's), new_turn (a turn not null and unlike the former row's), edits (labels up to its own, at the last row also those behind),
    cost, place (turns put out before, from 0), repaired (array<struct<role, text>> put out), and at a conversation's last row audit (all labels) and
    repaired_sha256 (of all ``role:text`` put out, joined by line ends); these are null elsewhere.

    Rows go by turn (null first), then role and text, so ties and repeated rows have one order; of repeated rows the first is no duplicate. Null role and
    text are one space. Null conv_ids form one conversation. A text of any length is read once and hashed as it passes; an empty text is blank.
    An empty table gives an empty one; other columns of ``turns``, whatever their names, are left out. A conversation is one task's stream, as its order demands.
    """
    g, c = grammar or Grammar(), costs or Costs()
    Lattice(g, c).end()  # a grammar that can't be used is an error here
    faulty = with_faults(turns)
    later = [F.col("conv_id").desc(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("times").desc()]
    plan = T.StructType([*faulty.schema.fields, T.StructField("ways", T.ArrayType(T.IntegerType())), T.StructField("last", T.BooleanType())])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each row the costs behind it (differences), from the last row to the first."""
        lattice, former, first = Lattice(g, c), None, True
        costs_after: tuple = ()
        for b in batches:
            behind, lasts = [], []
            for conv, initial, fault in zip(b["conv_id"].to_pylist(), b["initial"].to_pylist(), b["fault"].to_pylist(), strict=True):
                new = first or not same(conv, former)
                if new:
                    costs_after = lattice.end()[0]
                least = min(costs_after)
                behind.append([int(x - least) for x in costs_after])
                lasts.append(new)
                costs_after = lattice.before(initial, fault, costs_after)[0]
                former, first = conv, False
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(behind, pa.list_(pa.int32())), pa.array(lasts, pa.bool_())], [*b.schema.names, "ways", "last"])

    legal = frozenset(i + j for q, m in zip(g.states, g.moves, strict=True) for j, to in m.items() for i in {x for a, x, b in g.steps if b == q})
    out_fields = [("illegal", "boolean"), ("new_turn", "boolean"), ("edits", "string"), ("cost", "bigint"), ("place", "bigint"), ("repaired", "array<struct<role:string,text:string>>"), ("audit", "string"), ("repaired_sha256", "string")]
    own = ["conv_id", "turn", "role", "text", "fault"]
    result = T.StructType([*[faulty.schema[x] for x in own], *[T.StructField(n, T.DataType.fromDDL(k)) for n, k in out_fields]])
    kinds = [pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string(), pa.string()]

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chosen way over each row, from the first to the last."""
        lattice, begin = Lattice(g, c), g.states.index(g.begin)
        state, place, digest, audit, former, turn_before, new = begin, 0, hashlib.sha256(), [], "", None, True
        for b in batches:
            out: list[list] = [[] for _ in out_fields]
            for turn, role, text, initial, fault, behind, last in zip(*(b[x].to_pylist() for x in ("turn", "role", "text", "initial", "fault", "ways", "last")), strict=True):
                if new:
                    state, place, digest, audit, former, turn_before, new = begin, 0, hashlib.sha256(), [], None, None, False
                illegal = former is not None and former + initial not in legal
                labels, roles, state, _ = lattice.layer(initial, fault, tuple(behind))[1][state]
                said = [(role, text) if r is None else (r, text if label == REROLE else "") for r, label in zip(roles, labels.replace(DELETE, ""), strict=True)]
                if last:
                    rest, roles, state, _ = lattice.end()[1][state]
                    labels, said = labels + rest, said + [(r, "") for r in roles]
                cost = sum({REROLE: c.rerole, DELETE: c.delete, INSERT: c.insert}.get(x, 0) for x in labels)
                cost += c.truncated * (fault == "truncated" and DELETE not in labels)
                for i, (r, t) in enumerate(said):
                    digest.update(f"{chr(10) if place + i else ''}{r}:{t}".encode("utf-8", "surrogatepass"))
                audit.append(labels)
                row = (illegal, turn is not None and turn != turn_before, labels, cost, place, [{"role": r, "text": t} for r, t in said], "".join(audit) if last else None, digest.hexdigest() if last else None)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
                place, former, turn_before, new = place + len(said), initial, turn, last
            yield pa.RecordBatch.from_arrays([*[b[x] for x in own], *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], [*own, *[n for n, _ in out_fields]])

    planned = faulty.sortWithinPartitions(*later).mapInArrow(backwards, plan)
    earlier = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("times").asc()]
    return planned.sortWithinPartitions(*earlier).mapInArrow(forwards, result)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """conv_id, turn (gapless from 0), role, text: the repaired conversations of ``repair_conversations``."""
    each = repaired.select("conv_id", "place", F.posexplode("repaired").alias("i", "said"))
    return each.select("conv_id", (F.col("place") + F.col("i")).alias("turn"), "said.role", "said.text")


def audited(repaired: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair_conversations``: conv_id, gaps (turns missing between the least and the largest, null turns apart; 0
    if all are null), blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    is_fault = [F.count_if(F.col("fault") == x).alias(x) for x in FAULTS]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("long").alias("gaps")
    return repaired.groupBy("conv_id").agg(gaps, *is_fault, F.count_if("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.max("audit").alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults of the repair's own test: null role and text are one space, and crc32 of ``conv_id:turn`` (null: one space)
    modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's."""

    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    t = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return t.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")
