"""Chat formatting: a finite-state machine over roles and segments with loss flags.

A template is data: the markers and the loss flag of each role, the code of each control string, and
the transitions of the role machine. Control strings inside texts are replaced by codes that hold no
control string, and the escape character itself by a code, so every text comes back exactly.

Everything is DataFrame expressions. A conversation is one training example and becomes one row, so
its turns meet in one task; conversations are spread by their id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Declarative description of a chat format.

    roles: markers and loss flag by role. other: markers of any other role, whose name is written
    between `other_name` markers. transitions: (state, role) -> state; what is missing is an error.
    final: states in which a conversation may end. escape: the escape character.
    """

    roles: dict[str, Role]
    other: Role
    other_name: tuple[str, str]
    transitions: dict[tuple[str, str], str]
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    extra_controls: tuple[str, ...] = field(default=())

    def controls(self) -> list[str]:
        """All control strings, longest first."""
        found = {m for r in [*self.roles.values(), self.other] for m in (r.open, r.close) if m}
        return sorted(found | set(self.other_name) | set(self.extra_controls), key=lambda m: (-len(m), m))


#: Instruction format: only what the assistant says is trained on.
INSTRUCT = Template(
    roles={
        "system": Role("<<SYS>>", "<</SYS>>"),
        "user": Role("[INST]", "[/INST]"),
        "assistant": Role("<s>", "</s>", loss=True),
    },
    other=Role("[TURN]", "[/TURN]"),
    other_name=("[ROLE]", "[/ROLE]"),
    transitions={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
)


def _codes(template: Template) -> list[tuple[str, str]]:
    """(control string, its code), in the order of escaping."""
    return [(m, template.escape + chr(ord("a") + i)) for i, m in enumerate(template.controls())]


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit(template.escape), F.lit(template.escape + "_"))
    for control, code in _codes(template):
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescape(text: Column, template: Template) -> Column:
    """Inverse of escape: every escape character is followed by its own code letter, so no code straddles another."""
    out = text
    for control, code in _codes(template):
        out = F.replace(out, F.lit(code), F.lit(control))
    return F.replace(out, F.lit(template.escape + "_"), F.lit(template.escape))


def _by_role(template: Template, role: Column, pick) -> Column:
    out = None
    for name, r in template.roles.items():
        out = F.when(role == name, F.lit(pick(r))) if out is None else out.when(role == name, F.lit(pick(r)))
    return out.otherwise(F.lit(pick(template.other)))


def format_chats(turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, n_turns, valid, first_error, segments, formatted.

    segments is array<struct<text, loss>>, markers and texts in order; formatted is their
    concatenation. valid tells whether the role machine accepted the whole conversation, first_error
    is the 0-based position of the first turn that it refused (null if none; an ending in a state
    that isn't final has the position after the last). Refused conversations are formatted all the
    same, so nothing is lost. Null texts are empty, a null role is the empty role; rows with the same
    turn come in the order of role and text, null turns first, and repeated rows are turns of their
    own. Rows with a null conv_id are one conversation, so one row; give them ids of their own if there are
    many. Very long texts are one segment, formatted as a whole. No rows give no rows. Other columns aren't read.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = role.isin(*template.roles)
    head = F.when(known, F.lit("")).otherwise(F.concat(F.lit(template.other_name[0]), escape(role, template), F.lit(template.other_name[1])))
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            text.alias("raw"),
            F.concat(_by_role(template, role, lambda r: r.open), head).alias("open"),
            escape(text, template).alias("body"),
            _by_role(template, role, lambda r: r.close).alias("close"),
            _by_role(template, role, lambda r: r.loss).alias("loss"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    moves = F.create_map(*[F.lit(x) for (state, name), to in template.transitions.items() for x in (f"{state}>{name}", to)])
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error"))

    def step(s: Column, t: Column) -> Column:
        to = F.element_at(moves, F.concat(s["state"], F.lit(">"), t["role"]))
        # After a refused turn the machine stands where that role would have taken it.
        state = F.coalesce(to, F.when(t["role"].isin(*template.roles), t["role"]), s["state"])
        return F.struct(state.alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["error"], F.when(to.isNull(), s["at"])).alias("error"))

    def end(s: Column) -> Column:
        return F.coalesce(s["error"], F.when(~s["state"].isin(*template.final), s["at"]))

    segments = F.flatten(
        F.transform(
            "ts",
            lambda t: F.array(
                F.struct(t["open"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
                F.struct(t["close"].alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = convs.select("conv", F.size("ts").cast("long").alias("n_turns"), F.aggregate("ts", start, step, end).alias("first_error"), segments.alias("segments"))
    return out.select(
        F.col("conv").alias(conv_col),
        "n_turns",
        F.col("first_error").isNull().alias("valid"),
        "first_error",
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
    )


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|/" else c for c in s)


def parse_chats(formatted: Column, template: Template = INSTRUCT) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    opens = [r.open for r in template.roles.values()] + [template.other.open]
    closes = [r.close for r in template.roles.values()] + [template.other.close]
    turn = f"(?s)(?:{'|'.join(map(_quoted, opens))}).*?(?:{'|'.join(map(_quoted, closes))})"

    def inner(m: Column, r: Role) -> Column:
        return F.substring(m, F.lit(len(r.open) + 1), F.length(m) - len(r.open) - len(r.close))

    def back(m: Column) -> Column:
        out = None
        for name, r in template.roles.items():
            value = F.struct(F.lit(name).alias("role"), unescape(inner(m, r), template).alias("text"))
            out = F.when(m.startswith(r.open), value) if out is None else out.when(m.startswith(r.open), value)
        body = inner(m, template.other)
        name = F.substring_index(F.substring_index(body, template.other_name[1], 1), template.other_name[0], -1)
        text = F.substring(body, F.length(F.substring_index(body, template.other_name[1], 1)) + len(template.other_name[1]) + 1, F.length(body))
        return out.otherwise(F.struct(unescape(name, template).alias("role"), unescape(text, template).alias("text")))

    return F.transform(F.regexp_extract_all(formatted, F.lit(turn), F.lit(0)), back)


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)))
