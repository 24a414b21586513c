"""Chat formatting: a finite-state machine over roles and a declarative template.

`format_turns` gives one row per turn with its formatted text, the character spans of its
segments and their loss flags, and whether the state machine accepts the turn where it
stands. `read_back` parses those texts again, checks and hashes them. Both stream: rows
are dealt by conversation and sorted, and a conversation's state is a few numbers, so one
very long conversation needs no more memory than a short one.

Null texts count as empty, null roles as the empty role, null conversations as one
conversation of their own. Null turns come first; equal turns are ordered by role and
text, so repeated rows are repeated turns. Unknown roles are formatted with the generic
template and rejected by the state machine. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


#: The template: what stands before and after the text of a role, and whether the text is learnt from.
TEMPLATE = {
    "system": Turn("<<SYS>> ", " <</SYS>>\n"),
    "user": Turn("[INST] ", " [/INST]\n"),
    "assistant": Turn("[OUT] ", " </s>\n", loss=True),
}
#: Any other role: its name is written, escaped, behind the mark.
OTHER_BEFORE, OTHER_MIDDLE, OTHER_AFTER = "[ROLE] ", " [TEXT] ", " [/ROLE]\n"
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "</s>", "<s>", "[ROLE]", "[TEXT]", "[/ROLE]")
#: Which roles may follow which state; the state is the last role, "" at the start.
FOLLOWS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Doubles each backslash and puts one behind the first character of each control string."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def segments(role: str, text: str) -> list[tuple[str, bool]]:
    """(text, loss flag) of a turn's segments, in order."""
    turn = TEMPLATE.get(role)
    if turn:
        return [(turn.before, False), (escape(text), turn.loss), (turn.after, False)]
    return [(OTHER_BEFORE + escape(role) + OTHER_MIDDLE, False), (escape(text), False), (OTHER_AFTER, False)]


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    for role, turn in TEMPLATE.items():
        if formatted.startswith(turn.before) and formatted.endswith(turn.after):
            return role, unescape(formatted[len(turn.before) : len(formatted) - len(turn.after)])
    if not (formatted.startswith(OTHER_BEFORE) and formatted.endswith(OTHER_AFTER)):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len(OTHER_BEFORE) : len(formatted) - len(OTHER_AFTER)].partition(OTHER_MIDDLE)
    return unescape(role), unescape(text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, segments (array of start, stop, loss) and valid, sorted by turn within each conversation's partition."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartition("conv_id").sortWithinPartitions(*order)

    def run(batches):
        conv, state, first = None, "", True
        for batch in batches:
            formatted, cut, valid = [], [], []
            for c, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if first or c != conv:
                    conv, state, first = c, "", False
                parts, at, spans = segments(role, text), 0, []
                for part, loss in parts:
                    spans.append({"start": at, "stop": at + len(part), "loss": loss})
                    at += len(part)
                formatted.append("".join(p for p, _ in parts))
                cut.append(spans)
                valid.append(role in FOLLOWS.get(state, ()))
                state = role if role and role in FOLLOWS else state
            yield {"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "formatted": formatted, "segments": cut, "valid": valid}

    return arrow_map(dealt, run, "conv_id long, turn long, formatted string, segments array<struct<start:int,stop:int,loss:boolean>>, valid boolean")


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation, from what format_turns returns (still dealt and sorted by conversation)."""

    def run(batches):
        conv, open_, n = None, False, 0

        def row():
            return {"conv_id": [conv], "n_turns": [n], "turns_sha256": [turns_.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss_.hexdigest()], "formatted_chars": [total], "valid": [valid]}

        for batch in batches:
            done: list[dict] = []
            for c, formatted, spans, ok in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "segments", "valid")), strict=True):
                if not open_ or c != conv:
                    if open_:
                        done.append(row())
                    conv, open_, n, chars, total, valid = c, True, 0, 0, 0, True
                    turns_, loss_ = hashlib.sha256(), hashlib.sha256()
                role, text = parse(formatted)
                turns_.update(f"{role}\n{text}\n".encode())
                for s in spans:
                    if s["loss"]:
                        learnt = unescape(formatted[s["start"] : s["stop"]])
                        loss_.update(learnt.encode())
                        chars += len(learnt)
                n, total, valid = n + 1, total + len(formatted), valid and ok
            if done:
                yield {k: [d[k][0] for d in done] for k in done[0]}
        if open_:
            yield row()

    return arrow_map(turns, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
