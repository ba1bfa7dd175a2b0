"""Chat formatting from a declarative template, in DataFrame expressions only.

A finite-state machine over the roles checks the order of turns. The template gives each role
a mark before and after its text, and says whether the text counts in the loss. Texts are
escaped reversibly, so that no mark can stand inside one: a backslash is doubled, and one is
put after the first character of anything that would read as a mark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks and loss flag by role; other roles are written out between ``role_open`` and ``role_close``.

    ``moves`` maps a state and a role to the next state; "start" comes first, ``ends`` are the
    states in which a conversation may end. The first character of a mark may stand nowhere
    else in any mark: then marks cannot overlap, and escaping is exact.
    """

    roles: dict[str, tuple[str, str, bool]]
    role_open: str = "[ROLE]"
    role_close: str = "[:]"
    role_end: str = "[/ROLE]"
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    ends: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        firsts = {m[0] for m in self.marks}
        if any(len(m) < 2 or "\\" in m or firsts & set(m[1:]) for m in self.marks):
            raise ValueError("a mark needs two characters, no backslash, and no mark's first character inside")
        opens = [r[0] for r in self.roles.values()] + [self.role_open]
        if len(set(opens)) < len(opens):
            raise ValueError("roles must open with different marks")

    @property
    def marks(self) -> list[str]:
        return [*dict.fromkeys([m for r in self.roles.values() for m in r[:2]] + [self.role_open, self.role_close, self.role_end])]


INSTRUCT = Template(
    roles={"system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False), "assistant": ("[ANS]", "</s>", True)},
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    ends=("assistant",),
)


def _quote(text: str) -> str:
    """``text`` as a regular expression that Java reads literally."""
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def escape(text: Column, template: Template) -> Column:
    marks = "|".join(f"{_quote(m[0])}(?={_quote(m[1:])})" for m in template.marks)
    return F.regexp_replace(text, rf"(\\|{marks})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _pick(role: Column, template: Template, at: int, other: Column) -> Column:
    out = other
    for name, row in template.roles.items():
        out = F.when(role == name, F.lit(row[at])).otherwise(out)
    return out


def check_turns(roles: Column, template: Template) -> Column:
    """``struct<state, bad>``: the machine's last state and the first turn it refused (-1: none).

    After a refused turn the machine stays in its state, so that one stray turn is one fault.
    """
    def move(acc: Column, turn: Column) -> Column:
        to = F.lit(None).cast("string")
        for (state, role), after in template.moves.items():
            to = F.when((acc["state"] == state) & (turn["role"] == role), F.lit(after)).otherwise(to)
        bad = F.when((acc["bad"] < 0) & to.isNull(), turn["at"]).otherwise(acc["bad"])
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), bad.alias("bad"))

    turns = F.transform(roles, lambda r, i: F.struct(F.coalesce(r, F.lit("")).alias("role"), i.alias("at")))
    return F.aggregate(turns, F.struct(F.lit("start").alias("state"), F.lit(-1).alias("bad")), move)


def format_conversations(turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: ``conv_id, segments, formatted, valid, bad_turn``.

    ``segments`` is ``array<struct<text, loss>>`` in order (mark, escaped text, mark for each
    turn); ``formatted`` joins their texts. Rows go by turn, then role, then text; a null turn
    comes first; repeated rows are repeated turns. A null text is empty, a null role is the role
    of empty name; roles the template does not name are written out. ``valid`` says that the
    machine refused no turn and ended in an end state; invalid conversations are formatted all
    the same. Rows of a null conversation id form one conversation; other columns are not read;
    no rows give no rows. A conversation is one row, as its text is one string.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), text.alias("text")).alias("row"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    def segments(row: Column) -> Column:
        role = row["role"]
        opened = _pick(role, template, 0, F.concat(F.lit(template.role_open), escape(role, template), F.lit(template.role_close)))
        loss = F.lit(False)
        for name, (_, _, counts) in template.roles.items():
            loss = F.when(role == name, F.lit(counts)).otherwise(loss)
        return F.array(
            F.struct(opened.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(row["text"], template).alias("text"), loss.alias("loss")),
            F.struct(_pick(role, template, 1, F.lit(template.role_end)).alias("text"), F.lit(False).alias("loss")),
        )

    convs = convs.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), check_turns(F.transform("turns", lambda r: r["role"]), template).alias("end"))
    return convs.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        ((F.col("end.bad") < 0) & F.col("end.state").isin(list(template.ends))).alias("valid"),
        F.col("end.bad").alias("bad_turn"),
    )


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """Turns of a formatted conversation, ``array<struct<role, text>>``: the inverse of formatting."""
    opens = "|".join([*(_quote(r[0]) for r in template.roles.values()), rf"{_quote(template.role_open)}.*?{_quote(template.role_close)}"])
    ends = "|".join([*dict.fromkeys(_quote(r[1]) for r in template.roles.values()), _quote(template.role_end)])
    pattern = F.lit(rf"(?s)({opens})(.*?)(?:{ends})")

    def role(mark: Column) -> Column:
        named = unescape(F.regexp_extract(mark, rf"(?s)^{_quote(template.role_open)}(.*){_quote(template.role_close)}$", 1))
        out = named
        for name, (opened, _, _) in template.roles.items():
            out = F.when(mark == opened, F.lit(name)).otherwise(out)
        return out

    return F.zip_with(
        F.regexp_extract_all(formatted, pattern, F.lit(1)),
        F.regexp_extract_all(formatted, pattern, F.lit(2)),
        lambda mark, text: F.struct(role(mark).alias("role"), unescape(text).alias("text")),
    )


def loss_text(segments: Column) -> Column:
    """All text that counts in the loss, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
