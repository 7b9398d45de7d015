"""Chat formatting in DataFrame operations alone.

A finite-state machine over roles checks the order of turns; a declarative template gives the text before and after
each turn; the output is text segments, each with a flag that says whether it counts for the loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked. `before` holds {role} once. What texts and roles hold is escaped so that "<|" never stands
    there, and roles hold no line break. Templates whose marks a text could still make up, by itself or with a mark
    beside it, are refused: `before` and `after` begin with "<|" and hold no other, neither is the other's
    beginning, what follows the role has a line break, and no mark ends in "<"."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a role without an entry is out of order.
    machine: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    #: States in which a conversation may end.
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        opening, *closing = self.before.split("{role}")
        told_apart = not opening.startswith(self.after) and not self.after.startswith(opening)
        begun = opening.startswith("<|") and self.after.startswith("<|") and "<|" not in opening[2:] + " " + self.after[2:]
        if len(closing) != 1 or not (told_apart and begun and "\n" in closing[0] and "<|" not in closing[0]) or any(m.endswith("<") for m in (opening, *closing, self.after)):
            raise ValueError(f"a text could hold the marks {self.before!r} and {self.after!r}")


CHAT = Template()
#: Turns whose roles are folded in one go.
BLOCK = 4096


def escape(text: Column) -> Column:
    """No control mark can begin in the result: between "<" and "|", with any backslashes there, goes one more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def turns(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, at (order of the turns), role, text: null roles and texts are empty strings. Turns of the same
    number come in order of role, then text."""
    own = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return own.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))


def _states(template: Template) -> list[str]:
    """States of the machine, the start first and a dead one last."""
    named = ["start", *template.machine, *(n for nexts in template.machine.values() for n in nexts.values())]
    return [*dict.fromkeys(named), ""]


def ordered(own: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, in_order: whether the machine, led by the roles of all turns in order, ends in a final state.

    The machine runs over blocks of BLOCK turns from each of its states at once, then over the blocks' outcomes, so
    that no more than a block's roles, or a number for each block, is in one place.
    """
    states = _states(template)
    at = {s: i for i, s in enumerate(states)}
    dead = len(states) - 1
    roles = sorted({r for nexts in template.machine.values() for r in nexts})
    # table[role][state] -> state, as one array; roles that the machine doesn't know lead to the dead state
    table = [at.get(template.machine.get(s, {}).get(r, ""), dead) for r in [*roles, None] for s in states]
    table = F.array(*map(F.lit, table))
    code = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(roles)], F.lit(len(roles)))
    step = lambda state, role: F.get(table, role * len(states) + state)
    coded = own.select("conv_id", "at", F.floor(F.col("at") / BLOCK).alias("block"), code.alias("code"))
    blocks = coded.groupBy("conv_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes"))
    ends = F.transform(F.array(*[F.lit(i) for i in range(len(states))]), lambda s: F.aggregate("codes", s, step))
    blocks = blocks.select("conv_id", "block", ends.alias("ends"))
    whole = blocks.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "ends"))), lambda x: x["ends"]).alias("ends"))
    last = F.aggregate("ends", F.lit(0), lambda state, e: F.get(e, state))
    return whole.select("conv_id", last.isin(*[at[s] for s in template.final if s in at]).alias("in_order"))


def segments(rows: DataFrame, template: Template = CHAT, **columns: str) -> DataFrame:
    """conv_id, at, part (0 before, 1 text, 2 after), segment, loss, in_order: the formatted output as rows.

    in_order is a conversation's: whether the template's machine takes its roles from the start to a final state.
    Conversations out of order are formatted all the same and carry the flag. Null roles and texts are empty; null
    conversation ids are one conversation; rows that repeat are turns of their own; an empty table gives no rows; other
    columns are not read.
    """
    own = turns(rows, **columns)
    opening, closing = template.before.split("{role}")
    before = F.concat(F.lit(opening), escape(F.replace(F.replace("role", F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))), F.lit(closing))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), before.alias("segment"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("part"), escape(F.col("text")).alias("segment"), F.col("role").isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(2).alias("part"), F.lit(template.after).alias("segment"), F.lit(False).alias("loss")),
    )
    order = ordered(own, template).withColumnRenamed("conv_id", "c")
    flagged = own.join(order, F.col("conv_id").eqNullSafe(F.col("c")))
    return flagged.select("conv_id", "at", "in_order", F.inline(parts)).select("conv_id", "at", "part", "segment", "loss", "in_order")


def formatted(parts: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array<struct<start, end>>, code points), in_order: one row per conversation,
    which is then held whole; segments are joined in order."""
    listed = F.array_sort(F.collect_list(F.struct("at", "part", "segment", "loss")))
    own = parts.groupBy("conv_id").agg(listed.alias("s"), F.min("in_order").alias("in_order"))
    ends = parts.groupBy("conv_id", "at").agg(F.sum(F.length("segment")).cast("long").alias("n"), F.max(F.when(F.col("part") == 0, F.length("segment"))).cast("long").alias("head"), F.max(F.when(F.col("part") == 1, F.length("segment"))).cast("long").alias("body"), F.max("loss").alias("loss"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("at")) - F.col("n")
    ends = ends.select("conv_id", "at", "loss", (before + F.col("head")).alias("start"), (before + F.col("head") + F.col("body")).alias("end"))
    spans = ends.where("loss").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("loss_spans"))
    joined = own.select("conv_id", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("formatted"), "in_order")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.join(spans.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", "formatted", F.coalesce("loss_spans", none).alias("loss_spans"), "in_order")


def read_back(text: Column, template: Template = CHAT) -> Column:
    """array<struct<role, text>> of a formatted conversation, from its marks alone."""
    opening, closing = template.before.split("{role}")
    pieces = F.split(text, "\\Q" + opening + "\\E", -1)
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        cut = F.instr(p, closing)
        role = F.substr(p, F.lit(1), cut - 1)
        role = F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        body = F.substr(p, cut + len(closing), F.length(p) - cut + 1 - len(closing) - len(template.after))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def digest(chats: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, in_order, from the formatted texts."""
    back = chats.withColumn("turns", read_back(F.col("formatted"), template)).withColumn("masked", F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("masked", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "in_order")
