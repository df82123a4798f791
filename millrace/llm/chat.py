"""Chat formatting by a finite-state machine over roles and a declarative template. DataFrame functions only.

Texts and roles cannot form a marker of the template: where a marker's first character is followed by its
second, perhaps after escape characters, or ends the text, one escape character is put between (``<|`` becomes
``<\\|``, and ``<\\|`` gets one more). No marker has the escape character in second place, so none is left, and
taking one away restores the text. This is derived from the template, whatever its markers. In roles, ``%``
and the first character of what ends a role are percent-encoded as well.

A conversation's turns are one string in the end, so one task holds them: a row of the output is as large
as its conversation. No other grouping takes place.

Defined cases: a null text or role is empty. Turns are ordered by turn, then role, then text; a null turn
comes first; repeated rows are turns of their own. Turns in an order that the machine refuses are
formatted all the same and marked by ``valid`` and ``first_bad_turn``; ``complete`` says whether the last turn
is one to end with. Extra columns are not read. A template whose markers can't be told apart raises ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers around a turn, the character that escapes them, the roles under the loss mask, and the machine: state -> role -> next state."""

    start: str = "<|im_start|>"
    role_end: str = "\n"
    end: str = "<|im_end|>\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    first: str = "begin"
    accepting: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant"},
        }
    )

    def __post_init__(self) -> None:
        markers = (self.start, self.role_end, self.end)
        if min(len(self.start), len(self.end)) < 2 or not self.role_end or len(self.escape) != 1 or any(self.escape in m[:2] for m in markers) or self.role_end[0] == "%":
            raise ValueError("start and end need two characters, role_end one; none may begin with the escape character or have it in second place, nor can role_end begin with %")
        if any(m.endswith(self.start[:k]) for m in markers for k in range(1, len(self.start) + (m != self.start))):
            raise ValueError("the end of a marker is the beginning of start")


CHATML = Template()
REFUSED = "refused"


def _literal(marker: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in "_ \n<>" else c for c in marker)


def _danger(template: Template, escaped: bool) -> str:
    """A marker's first character (with one escape character after it, if ``escaped``) that escape characters and the second, or the end, follow."""
    e = _literal(template.escape)
    heads = sorted({m[:2] for m in (template.start, template.end)})
    return "|".join(f"({_literal(c)}){e * escaped}(?={e}*+(?:{_literal(x)}|\\z))" for c, x in heads)


def _groups(template: Template) -> str:
    return "".join(f"${k + 1}" for k in range(len({m[:2] for m in (template.start, template.end)})))


def escape(text: Column, template: Template = CHATML) -> Column:
    return F.regexp_replace(text, F.lit(_danger(template, False)), F.lit(_groups(template) + _literal(template.escape)))


def unescape(text: Column, template: Template = CHATML) -> Column:
    return F.regexp_replace(text, F.lit(_danger(template, True)), F.lit(_groups(template)))


def _encoded(c: str) -> str:
    return "".join(f"%{b:02X}" for b in c.encode("utf-8"))


def _role_out(role: Column, template: Template) -> Column:
    c = template.role_end[0]
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(c), F.lit(_encoded(c))), template)


def _role_in(role: Column, template: Template) -> Column:
    c = template.role_end[0]
    return F.replace(F.replace(unescape(role, template), F.lit(_encoded(c)), F.lit(c)), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, segments (array of role, text, loss), formatted, valid, complete, first_bad_turn, end_state."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    steps = F.create_map(*[F.lit(x) for state, to in template.moves.items() for role, after in to.items() for x in (f"{state}>{role}", after)])
    begin = F.struct(F.lit(template.first).alias("state"), F.lit(0).alias("seen"), F.lit(-1).alias("bad"))

    def move(acc: Column, t: Column) -> Column:
        after = F.coalesce(F.try_element_at(steps, F.concat(acc["state"], F.lit(">"), t["role"])), F.lit(REFUSED))
        bad = F.when((acc["bad"] < 0) & (after == REFUSED), acc["seen"]).otherwise(acc["bad"])
        return F.struct(after.alias("state"), (acc["seen"] + 1).alias("seen"), bad.alias("bad"))

    def segments(t: Column) -> Column:
        parts = [
            (F.concat(F.lit(template.start), _role_out(t["role"], template), F.lit(template.role_end)), F.lit(False)),
            (escape(t["text"], template), t["role"].isin(*template.loss_roles)),
            (F.lit(template.end), F.lit(False)),
        ]
        return F.array(*[F.struct(_role_out(t["role"], template).alias("role"), text.alias("text"), loss.alias("loss")) for text, loss in parts])

    chats = chats.withColumn("segments", F.flatten(F.transform("_turns", segments))).withColumn("_end", F.aggregate("_turns", begin, move))
    return chats.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("_end.bad") < 0).alias("valid"),
        F.col("_end.state").isin(*template.accepting).alias("complete"),
        F.when(F.col("_end.bad") >= 0, F.col("_end.bad")).alias("first_bad_turn"),
        F.col("_end.state").alias("end_state"),
    )


def read_back(chats: DataFrame, template: Template = CHATML, formatted_col: str = "formatted") -> DataFrame:
    """Adds ``turns``: array of (role, text), parsed from the formatted string alone."""
    pieces = F.filter(F.split(F.col(formatted_col), _literal(template.start), -1), lambda _, i: i > 0)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.role_end, 1)
        at = F.length(role) + len(template.role_end)
        text = F.substring(piece, at + 1, F.length(piece) - at - len(template.end))
        return F.struct(_role_in(role, template).alias("role"), unescape(text, template).alias("text"))

    return chats.withColumn("turns", F.transform(pieces, turn))


def loss_segments(chats: DataFrame) -> DataFrame:
    """One row per segment: conv_id, segment (from 0), role, text, loss."""
    return chats.select("conv_id", F.posexplode("segments").alias("segment", "_s")).select("conv_id", "segment", "_s.role", "_s.text", "_s.loss")


def chat_digests(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Format, read back from the output, and digest what was read."""
    back = read_back(format_chats(turns, template), template)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    back = back.withColumn("_loss", loss)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "complete",
        "first_bad_turn",
    )
