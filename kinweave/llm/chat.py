"""Chat formatting: a finite-state machine over roles, segments with loss flags, native plans only.

The template is data: control strings, which roles may follow which, and which parts of a turn
carry loss. Control strings inside texts are escaped with a backslash, so that the formatted
text splits back into its turns without loss."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import fresh


@dataclass(frozen=True)
class Template:
    """start + role + mid + text + end for each turn. `follows` has the states that each role may come
    after ('' is the start); `loss_roles` are the roles whose texts carry loss."""

    start: str = "<|im_start|>"
    mid: str = "\n"
    end: str = "<|im_end|>\n"
    marker: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "system": ("",),
            "user": ("", "system", "assistant", "tool"),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(col: Column, template: Template = CHATML, line: bool = False) -> Column:
    """Backslashes double; a backslash splits the marker; with `line`, new lines become \\n."""
    out = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit(template.marker), F.lit(template.marker[0] + "\\" + template.marker[1:]))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def unescape(col: Column, template: Template = CHATML, line: bool = False) -> Column:
    """The inverse: what lies between doubled backslashes is free of them."""

    def plain(part: Column) -> Column:
        out = F.replace(part, F.lit(template.marker[0] + "\\" + template.marker[1:]), F.lit(template.marker))
        return F.replace(out, F.lit("\\n"), F.lit("\n")) if line else out

    return F.array_join(F.transform(F.split(col, r"\\\\", -1), plain), "\\")


def _machine(roles: Column, template: Template) -> Column:
    """Runs the machine over an array of roles: true if every step is allowed and the end is final."""
    steps = F.array(*[F.lit(f"{before}\n{role}") for role, befores in template.follows.items() for before in befores])
    reject = "\n"

    def step(state: Column, role: Column) -> Column:
        return F.when(F.array_contains(steps, F.concat(state, F.lit("\n"), role)), role).otherwise(F.lit(reject))

    return F.aggregate(roles, F.lit(""), step).isin(*template.final)


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = CHATML
) -> DataFrame:
    """One row per conversation: conv, n_turns, valid, segments (array of text and loss), formatted.

    Turns are ordered by turn, ties by role and text; repeated rows are turns of their own. Null
    roles and texts are empty; a null turn comes first; a null conv is a conversation. A row is
    invalid, not lost, if its roles break the machine. Other columns of the input are ignored. An empty table
    stays empty; long texts are formatted whole.
    A conversation is one value of the result, so its rows meet in one task."""
    turn_struct = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(turn_struct)).alias("turns"))
    segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))

    def of_turn(x: Column) -> Column:
        head = F.concat(F.lit(template.start), escape(x.r, template, line=True), F.lit(template.mid))
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(x.x, template), x.r.isin(*template.loss_roles)),
            segment(F.lit(template.end), F.lit(False)),
        )

    made = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _machine(F.transform("turns", lambda x: x.r), template).alias("valid"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
    )
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def parse_chats(formatted: DataFrame, column: str = "formatted", template: Template = CHATML) -> DataFrame:
    """Append `parsed`, the turns (role, text) read back from the formatted text. Null or empty: no turns."""
    (name,) = fresh(formatted.columns, "parsed")
    quoted = lambda s: r"\Q" + s + r"\E"
    body = F.split(F.col(column), quoted(template.end), -1)
    # What follows the last end mark is empty.
    turns = F.filter(body, lambda t: t.startswith(template.start))
    first = F.lit(len(template.start) + 1)

    def of(t: Column) -> Column:
        at = F.instr(t, template.mid)
        return F.struct(
            unescape(F.substr(t, first, at - first), template, line=True).alias("role"),
            unescape(F.substr(t, at + len(template.mid)), template).alias("text"),
        )

    return formatted.withColumn(name, F.coalesce(F.transform(turns, of), F.array().cast("array<struct<role:string,text:string>>")))


def digests(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Counts and digests, all read back from `formatted` and `segments`."""
    back = parse_chats(formatted, "formatted", template)
    parsed = back.columns[-1]
    turns = F.array_join(F.transform(parsed, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text, template)), "")
    out = back.select(
        "conv_id", "valid", F.size(parsed).cast("long").alias("n_turns"), turns.alias("turns"), lost.alias("lost"), F.char_length("formatted").cast("long").alias("formatted_chars")
    )
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
