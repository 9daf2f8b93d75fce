"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

Turns are formatted in blocks of a conversation and the blocks are joined afterwards, so that only a few
rows of a long conversation meet in one place; the machine's transitions compose over blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Turns of one block.
BLOCK = 256


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles bear loss, and which role may follow in which state.

    A turn is opening + label + between + text + closing. In texts, the escape sign is doubled and each
    control string is broken by it after its first sign, so that control strings stand only where the
    template puts them. A role without a label is written as `other` and the role, escaped.
    """

    opening: str = "### "
    between: str = ": "
    closing: str = "</turn>\n"
    control: tuple[str, ...] = ("### ", "</turn>")
    escape: str = "\\"
    other: str = "="
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    states: tuple[str, ...] = ("start", "ready", "asked", "answered", "error")
    moves: tuple[tuple[str, str, str], ...] = (("start", "system", "ready"), ("start", "user", "asked"), ("ready", "user", "asked"), ("asked", "assistant", "answered"), ("answered", "user", "asked"))

    def escaped(self, text: Column, *more: str) -> Column:
        text = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        for c in (*self.control, *more):
            text = F.replace(text, F.lit(c), F.lit(c[0] + self.escape + c[1:]))
        return text

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\Q" + self.escape + r"\E(.)", "$1")

    def label(self, role: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in self.labels.items() for x in pair])
        return F.coalesce(known[role], F.concat(F.lit(self.other), self.escaped(role, self.between)))

    def role(self, label: Column) -> Column:
        known = F.create_map(*[F.lit(x) for role, name in self.labels.items() for x in (name, role)])
        return F.coalesce(known[label], self.unescaped(F.substring(label, len(self.other) + 1, 2**31 - 1)))


def format_chats(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row for each conversation: id, n_turns, segments (array of text and loss flag), formatted, state, valid.

    Turns stand in the order of turn, then role, then text; a null turn comes first, a null role or text counts as
    empty, and a null conversation id is a conversation of its own. Repeated rows are turns of their own. `state` is
    where the machine over roles ends and `valid` is false after a role that may not follow; such conversations
    are formatted all the same. An empty table gives an empty result; other columns are ignored.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("_conv"), F.floor(F.col(turn_col) / BLOCK).alias("_block"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("_turn"))
    number = {s: i for i, s in enumerate(template.states)}
    error = number["error"]
    moves = F.create_map(*[F.lit(x) for a, r, b in template.moves for x in (f"{number[a]} {r}", number[b])])
    every = F.array(*[F.lit(i) for i in range(len(template.states))])

    def step(states: Column, turn: Column) -> Column:
        return F.transform(states, lambda s: F.coalesce(moves[F.concat_ws(" ", s.cast("string"), turn["role"])], F.lit(error)))

    def segments(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(template.opening), template.label(t["role"]), F.lit(template.between)).alias("text"), F.lit(False).alias("loss")),
            F.struct(template.escaped(t["text"]).alias("text"), t["role"].isin(*template.loss).alias("loss")),
            F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
        )

    blocks = rows.groupBy("_conv", "_block").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    blocks = blocks.select("_conv", F.struct("_block", F.size("_turns").alias("n"), F.aggregate("_turns", every, step).alias("moves"), F.flatten(F.transform("_turns", segments)).alias("segments")).alias("_b"))
    whole = blocks.groupBy("_conv").agg(F.array_sort(F.collect_list("_b"), lambda a, b: F.when(a["_block"].eqNullSafe(b["_block"]), 0).when(a["_block"].isNull() | (a["_block"] < b["_block"]), -1).otherwise(1)).alias("_bs"))
    state = F.aggregate("_bs", F.lit(0), lambda s, b: F.get(b["moves"], s))
    out = whole.select("_conv", F.aggregate("_bs", F.lit(0).cast("long"), lambda s, b: s + b["n"]).alias("n_turns"), F.flatten(F.transform("_bs", lambda b: b["segments"])).alias("segments"), state.alias("_state"))
    names = F.array(*[F.lit(s) for s in template.states])
    return out.select(F.col("_conv").alias(conv_col), "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.get(names, F.col("_state")).alias("state"), (F.col("_state") != error).alias("valid"))


def read_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Read formatted conversations back: columns `turns` (array of role and text) and `loss_text` are added."""
    pieces = F.split("formatted", r"\Q" + template.closing + r"\E")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.locate(template.between, piece)
        label = F.substring(piece, F.lit(len(template.opening) + 1), at - len(template.opening) - 1)
        return F.struct(template.role(label).alias("role"), template.unescaped(F.substring(piece, at + len(template.between), F.lit(2**31 - 1))).alias("text"))

    marked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"]))
    return chats.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(marked, "")})


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    read = read_chats(format_chats(rows.unionByName(more)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(spoken).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "state")


ORACLE = {
    "op9_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), marked AS (
            SELECT *, length(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>')) + length(role) + 14 AS chars,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
            FROM said
        ), flagged AS (
            SELECT *, CASE WHEN role = 'system' THEN before IS NOT NULL WHEN role = 'user' THEN before = 'user'
                           WHEN role = 'assistant' THEN before IS NULL OR before <> 'user' ELSE true END AS wrong FROM marked
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars, NOT bool_or(coalesce(wrong, false)) AS valid,
               CASE WHEN bool_or(coalesce(wrong, false)) THEN 'error' WHEN last(role ORDER BY turn, role, text) = 'system' THEN 'ready'
                    WHEN last(role ORDER BY turn, role, text) = 'user' THEN 'asked' ELSE 'answered' END AS state
        FROM flagged GROUP BY conv_id
    """
}
QUERIES = {"op9_chat_format": op9_chat_format}
