"""Chat formatting with DataFrame functions only: a role state machine, a declarative template, loss-flagged segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``opening`` and ``closing`` mark a turn. Texts and roles are escaped so that ``mark``, which begins
    every control string, can't occur inside them. ``steps`` maps (state, role) to the next state."""

    opening: str = "<|im_start|>"
    header_end: str = "\n"
    closing: str = "<|im_end|>\n"
    mark: str = "<|"
    learned: tuple[str, ...] = ("assistant",)
    begin: str = "begin"
    accepting: tuple[str, ...] = ("answered",)
    steps: tuple[tuple[str, str, str], ...] = (
        ("begin", "system", "primed"),
        ("begin", "user", "asked"),
        ("primed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )


def escaped(c: Column, t: Template, header: bool = False) -> Column:
    """``~`` becomes ``~0`` and the mark's last sign ``~2``; in a header the line end becomes ``~1``."""
    c = F.replace(c, F.lit("~"), F.lit("~0"))
    c = F.replace(c, F.lit(t.header_end), F.lit("~1")) if header else c
    return F.replace(c, F.lit(t.mark), F.lit(t.mark[:-1] + "~2"))


def unescaped(c: Column, t: Template) -> Column:
    for sign, text in (("~2", t.mark[-1]), ("~1", t.header_end), ("~0", "~")):
        c = F.replace(c, F.lit(sign), F.lit(text))
    return c


def format_chats(turns: DataFrame, t: Template | None = None) -> DataFrame:
    """conv_id, formatted, segments (text, loss), n_turns, state, valid, for each conversation.

    Rows go by turn (null first), then role and text, so ties and repeated rows have one order. Null text is
    empty, null role the empty role. The machine's state after the last turn is ``state``, or
    ``stuck at <i>`` where turn i (from 0) has no step; ``valid`` is true in an accepting state.
    Invalid conversations are formatted all the same. Null conv_ids form one conversation. Other columns are ignored.
    """
    t = t or Template()
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    step = F.create_map(*[F.lit(x) for a, role, b in t.steps for x in (f"{a}\n{role}", b)])

    def move(s: Column, x: Column) -> Column:
        to = F.try_element_at(step, F.concat(s["state"], F.lit("\n"), x["role"]))
        stuck = s["state"].startswith("stuck at ")
        state = F.when(stuck, s["state"]).otherwise(F.coalesce(to, F.concat(F.lit("stuck at "), s["i"].cast("string"))))
        return F.struct(state.alias("state"), (s["i"] + 1).alias("i"))

    state = F.aggregate("turns", F.struct(F.lit(t.begin).alias("state"), F.lit(0).alias("i")), move)["state"]

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.opening), escaped(x["role"], t, header=True), F.lit(t.header_end))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escaped(x["text"], t), x["role"].isin(*t.learned)), part(F.lit(t.closing), F.lit(False)))

    out = chats.select("conv_id", F.size("turns").alias("n_turns"), state.alias("state"), F.flatten(F.transform("turns", segments)).alias("segments"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", formatted.alias("formatted"), "segments", "n_turns", "state", F.col("state").isin(*t.accepting).alias("valid"))


def read_turns(formatted: Column, t: Template | None = None) -> Column:
    """array<struct<role, text>> parsed from a formatted string."""
    t = t or Template()
    pieces = F.filter(F.split(formatted, r"\Q" + t.opening + r"\E"), lambda _, i: i > 0)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, t.header_end, 1)
        text = F.substr(p, F.length(role) + 1 + len(t.header_end), F.length(p) - F.length(role) - len(t.header_end) - len(t.closing))
        return F.struct(unescaped(role, t).alias("role"), unescaped(text, t).alias("text"))

    return F.transform(pieces, turn)


def read_learned(segments: Column, t: Template | None = None) -> Column:
    """The unescaped text under the loss flags, in order, nothing between."""
    t = t or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
