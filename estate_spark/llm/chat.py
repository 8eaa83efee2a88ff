"""Chat formatting: roles checked by a finite-state machine, turns written by a template.

A template is data: for each role the pieces of a turn (literals, the escaped text, the
escaped role name), each with a loss flag; the control strings; the escape character; and
the allowed role transitions. ``segments`` emits the pieces of every conversation in order
with their loss flags, ``formatted`` is their concatenation, and ``read_turns`` gets the
turns back from it. Escaping doubles the escape character and puts one behind the first
character of every control string, so no control string survives inside a text, and
removing one escape character before any character undoes it.

Defined results: a null text or role is empty; roles without pieces of their own use the
``None`` entry, which carries the role's name; turns order by (turn, role, text), null turns
first, repeated rows stay repeated; rows of a null conv_id form one conversation; an invalid
order is formatted all the same and reported in ``valid`` / ``first_error``; an empty table
gives an empty result; other columns are ignored. A conversation is one output string, so
its own rows meet in one row; nothing else does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, ROLE = object(), object()


@dataclass(frozen=True)
class Template:
    pieces: dict                 # role or None -> [(literal | TEXT | ROLE, loss)]
    controls: tuple[str, ...]    # each starts with '<' or '[' and has no other such character
    transitions: dict            # state -> {role: next state}; the first state is "start"
    accepting: tuple[str, ...]
    escape: str = "\\"
    bos: str = "<s>"


INSTRUCT = Template(
    pieces={
        "system": [("[SYS] ", False), (TEXT, False), (" [/SYS]\n", False)],
        "user": [("[INST] ", False), (TEXT, False), (" [/INST]\n", False)],
        "assistant": [("[OUT] ", False), (TEXT, True), (" [/OUT]</s>\n", False)],
        None: [("[ROLE] ", False), (ROLE, False), (" [/ROLE] ", False), (TEXT, False), (" [/END]\n", False)],
    },
    controls=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[/OUT]",
              "[ROLE]", "[/ROLE]", "[/END]"),
    transitions={
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    accepting=("answered",),
)


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " \n" else c for c in text)


def escaped(col: Column, t: Template = INSTRUCT) -> Column:
    doubled = F.replace(F.coalesce(col, F.lit("")), F.lit(t.escape), F.lit(t.escape * 2))
    rest: dict[str, list[str]] = {}
    for c in t.controls:
        rest.setdefault(c[0], []).append(_quoted(c[1:]))
    for first, tails in rest.items():
        doubled = F.regexp_replace(doubled, f"{_quoted(first)}(?={'|'.join(tails)})", f"{first}{_quoted(t.escape)}")
    return doubled


def unescaped(col: Column, t: Template = INSTRUCT) -> Column:
    return F.regexp_replace(col, f"(?s){_quoted(t.escape)}(.)", "$1")


def _segments(turn: Column, t: Template) -> Column:
    def of(pieces: list) -> Column:
        return F.array(*[F.struct(
            (F.lit(p) if isinstance(p, str) else escaped(turn["text"] if p is TEXT else turn["role"], t)).alias("text"),
            F.lit(loss).alias("loss")) for p, loss in pieces])

    out = of(t.pieces[None])
    for role, pieces in t.pieces.items():
        if role is not None:
            out = F.when(turn["role"] == role, of(pieces)).otherwise(out)
    return out


def _checked(turns: Column, t: Template) -> Column:
    """struct(state, at, first_error): the machine run over the roles; it stops moving at the
    first role its state doesn't allow, whose 1-based position is first_error."""
    moves = {f"{s}>{r}": n for s, to in t.transitions.items() for r, n in to.items()}
    table = F.create_map(*[F.lit(x) for pair in moves.items() for x in pair])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("first_error"))

    def step(s: Column, turn: Column) -> Column:
        to = F.try_element_at(table, F.concat(s["state"], F.lit(">"), turn["role"]))
        at = s["at"] + 1
        return F.struct(F.coalesce(to, s["state"]).alias("state"), at.alias("at"),
                        F.coalesce(s["first_error"], F.when(to.isNull(), at)).alias("first_error"))

    return F.aggregate(turns, start, step)


def format_conversations(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, valid, first_error, segments, formatted, n_turns."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.withColumn("_check", _checked(F.col("turns"), template))
    segments = F.concat(F.array(F.struct(F.lit(template.bos).alias("text"), F.lit(False).alias("loss"))),
                        F.flatten(F.transform("turns", lambda x: _segments(x, template))))
    convs = convs.withColumn("segments", segments)
    accepted = reduce(Column.__or__, [F.col("_check.state") == s for s in template.accepting])
    return convs.select(
        "conv_id", (F.col("_check.first_error").isNull() & accepted).alias("valid"),
        F.col("_check.first_error").alias("first_error"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.size("turns").cast("bigint").alias("n_turns"))


def read_turns(formatted: Column, t: Template = INSTRUCT) -> Column:
    """array of struct(role, text) parsed from a formatted conversation. Each turn is found by
    its own markers; literals can't occur in escaped texts, so the shortest match is the turn."""
    def pattern(pieces: list, capture: bool) -> str:
        return "".join(_quoted(p) if isinstance(p, str) else "(.*?)" if capture else ".*?" for p, _ in pieces)

    named = [r for r in t.pieces if r is not None]
    turns = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(pattern(p, False) for p in t.pieces.values())), F.lit(0))

    def parsed(turn: Column) -> Column:
        role_at = [i for i, p in enumerate(x for x, _ in t.pieces[None] if not isinstance(x, str)) if p is ROLE][0] + 1
        other = "(?s)" + pattern(t.pieces[None], True)
        role = unescaped(F.regexp_extract(turn, other, role_at), t)
        text = F.regexp_extract(turn, other, 3 - role_at)
        for r in named:
            first = t.pieces[r][0][0]
            role = F.when(turn.startswith(first), F.lit(r)).otherwise(role)
            text = F.when(turn.startswith(first), F.regexp_extract(turn, "(?s)" + pattern(t.pieces[r], True), 1)).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text, t).alias("text"))

    return F.transform(turns, parsed)


def loss_text(segments: Column, t: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped segment by segment."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
