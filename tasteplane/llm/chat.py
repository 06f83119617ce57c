"""Chat formatting: a role automaton checks turn order; a declarative template emits segments with loss flags.

All of it is built-in column functions. A template gives the text before and after each
role's turn, and which roles are trained on. Control strings of the template inside a text
are escaped so that no text can open or close a turn: every backslash is doubled and a
backslash is put after the first character of each control string. ``unescaped`` undoes both.

Edge cases: null text is empty; a null or unknown role is formatted with the template's
``other`` marks, carries no loss and makes the conversation invalid; turns are ordered by
(turn, role, text), so ties and repeated rows have one defined order and repeated rows stay;
conversations with null ids form one conversation; an empty table gives no rows; very long
texts are formatted whole; other columns are ignored, whatever their names. A conversation's text is one value of its result row by contract, so
its turns meet in one task; hot texts or turns that occur in many conversations do not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: text before and after a turn of each role
    marks: dict[str, tuple[str, str]]
    other: tuple[str, str]
    control: tuple[str, ...]
    trained: frozenset[str]
    start: str = "start"
    #: allowed (state, role): the next state is the role
    moves: frozenset[tuple[str, str]] = field(default_factory=frozenset)
    final: frozenset[str] = field(default_factory=frozenset)


INSTRUCT = Template(
    marks={"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")},
    other=("<s>[TURN] ", " [/TURN]"),
    control=("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]"),
    trained=frozenset({"assistant"}),
    moves=frozenset({("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}),
    final=frozenset({"assistant"}),
)


def escaped(text: Column, template: Template = INSTRUCT) -> Column:
    """Reversible: after it no control string occurs in the text."""
    rest = "|".join(sorted({re.escape(c[1:]) for c in template.control}, key=len, reverse=True))
    first = "".join(sorted({re.escape(c[0]) for c in template.control}))
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"([{first}])(?=(?:{rest}))", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _by_role(role: Column, template: Template, side: int) -> Column:
    out = F.lit(template.other[side])
    for name, pair in template.marks.items():
        out = F.when(role == name, F.lit(pair[side])).otherwise(out)
    return out


def _states(turns: Column, template: Template) -> Column:
    """Run the automaton: state, and position of the first turn that breaks the order (null if none)."""

    def step(acc: Column, t: Column) -> Column:
        move = F.concat_ws(">", acc["state"], t["role"])
        ok = acc["broken"].isNull() & t["role"].isNotNull() & move.isin(*[f"{a}>{b}" for a, b in sorted(template.moves)])
        return F.struct(
            F.when(ok, t["role"]).otherwise(acc["state"]).alias("state"),
            F.when(ok | acc["broken"].isNotNull(), acc["broken"]).otherwise(acc["at"]).alias("broken"),
            (acc["at"] + 1).alias("at"),
        )

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("broken"), F.lit(0).alias("at"))
    return F.aggregate(turns, begin, step)


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation: conv_id, segments (text, role, turn, loss), formatted, valid, broken_at.

    Each turn gives three segments: its opening mark, its escaped text, its closing mark; only
    the middle one of a trained role carries loss.
    """
    role, text = F.col("role"), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", role, text.alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        part = lambda s, kind, loss: F.struct(s.alias("text"), t["role"].alias("role"), F.lit(kind).alias("kind"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            part(_by_role(t["role"], template, 0), "open", no),
            part(escaped(t["text"], template), "text", F.coalesce(t["role"].isin(*sorted(template.trained)), no)),
            part(_by_role(t["role"], template, 1), "close", no),
        )

    out = turns.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), _states(F.col("turns"), template).alias("s"))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        (F.col("s.broken").isNull() & F.col("s.state").isin(*sorted(template.final))).alias("valid"),
        F.col("s.broken").alias("broken_at"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Recover turns and trained text from the segments: the digests of the contract."""
    texts = F.filter("segments", lambda x: x["kind"] == "text")
    turns = F.array_join(F.transform(texts, lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\n"), unescaped(x["text"]), F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescaped(x["text"])), "")
    return formatted.select(
        "conv_id",
        F.size(texts).cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("broken_at").cast("long").alias("broken_at"),
    )
