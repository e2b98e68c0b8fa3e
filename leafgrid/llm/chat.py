"""Chat formatting: turns are located by rendering growing conversations with a template that is a black box."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: What marks a turn's beginning and its end, and the sign that takes their meaning away inside texts.
BEGIN, END, ESCAPE = "### ", " </turn>\n", "\\"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:|\n")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:|\n)", re.DOTALL)
_HEAD = re.compile(r"### ((?:[^\\:\n]|\\(?:\\|###|</turn>|:|\n))*): ")
_NEXT = re.compile(r"\\(?:\\|###|</turn>)| </turn>\n")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class GrowingTemplate:
    """A template that writes turn after turn: called with the turns of a conversation, it renders those anew that its last call
    didn't have, and keeps the rest. It holds one output."""

    def __init__(self, turn: Callable[[str, str], str]):
        self.turn, self.turns, self.ends, self.out = turn, [], [0], ""

    def __call__(self, turns: list[Turn]) -> str:
        known = len(self.turns)
        if self.turns != turns[:known]:
            known = next(i for i in range(known) if i >= len(turns) or self.turns[i] != turns[i]) if self.turns[:-1] != turns[: known - 1] else known - 1
        pieces = [self.turn(role, text) for role, text in turns[known:]]
        self.out = "".join([self.out[: self.ends[known]], *pieces])
        self.ends = self.ends[: known + 1]
        for piece in pieces:
            self.ends.append(self.ends[-1] + len(piece))
        self.turns = list(turns)
        return self.out


def plain_turn(role: str, text: str) -> str:
    """``### role: text </turn>`` on a line; control strings inside are escaped by a backslash."""
    return f"{BEGIN}{_ROLE_CONTROL.sub(lambda m: ESCAPE + m[0], role)}: {escape(text)}{END}"


def plain_template(turns: list[Turn]) -> str:
    """plain_turn for each turn, one after the other."""
    return "".join(plain_turn(role, text) for role, text in turns)


def read_back(output: str) -> list[Turn]:
    """The turns of what plain_template wrote; ValueError where it doesn't fit."""
    turns, at = [], 0
    while at < len(output):
        head = _HEAD.match(output, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        end = head.end()
        while True:  # the next end mark that no escape precedes
            mark = _NEXT.search(output, end)
            if not mark:
                raise ValueError(f"no end of the turn at {at}")
            end = mark.end()
            if mark[0] == END:
                break
        turns.append((unescape(head[1]), unescape(output[head.end() : mark.start()])))
        at = end
    return turns


def locate(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """The output, each turn's span and its text's span in it, and the turns at which the template rewrites history.

    Successive prefixes of the conversation are rendered. Where an output doesn't begin with the one before, the
    template has rewritten history at that turn; the turn's span then begins where the two first differ. Within a
    turn, the text lies where renderings with two different one-letter texts differ. Nothing of the template but
    its outputs is used.
    """
    spans, rewrites, before = [], [], template([])
    for k, (role, _) in enumerate(turns):
        head = turns[:k]
        zero, one, out = template([*head, (role, "0")]), template([*head, (role, "1")]), template(turns[: k + 1])
        # What all of them begin with needs no other look: this turn's own part is what is left.
        same = len(before) if out.startswith(before) and zero.startswith(before) and one.startswith(before) else 0
        begin = len(before)
        if not same and not out.startswith(before):
            rewrites.append(k)
            begin = _common(before, out, 0)
        first = _common(zero, one, same)
        tail = len(zero) - first - 1
        if out[same:first] != zero[same:first] or tail > len(out) - first or out[len(out) - tail :] != zero[first + 1 :]:
            raise ValueError(f"the template treats the text of turn {k} in no separable way")
        spans.append((begin, len(out), first, len(out) - tail))
        before = out
    return before, spans, rewrites


def _common(a: str, b: str, known: int) -> int:
    """The length of the longest common beginning, of which ``known`` characters are known; by doubling steps, then by halves."""
    low, most, step = known, min(len(a), len(b)), 64
    while low < most and a[low : low + step] == b[low : low + step]:
        low, step = min(most, low + step), step * 2
    high = min(most, low + step)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def format_conversations(conversations: DataFrame, template: Template | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, spans, rewrites.

    ``spans`` has for each turn its role, where it begins and ends in ``formatted``, where its text begins and ends, and
    whether it is under the loss mask (roles in ``learn``). ``rewrites`` lists turns at which the template changed what it
    had written before; spans of earlier turns do not hold then.

    Turns are ordered by turn, then role and text, nulls first; repeated rows are turns of their own. Null roles and texts
    count as empty. A row without conv_id is a conversation of its own, for nothing says that such rows belong together. A
    conversation is the unit of work and is held in memory with its output. Successive prefixes are rendered, so a template that
    renders all turns anew takes time quadratic in them; the default keeps what it has rendered (GrowingTemplate). Extra columns are left out; an empty table gives an empty table.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", F.struct("turn", "role", "text").alias("turn"))
    known = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    every = known.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("turn").alias("turns")))
    grouped = every.select("conv_id", F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))).alias("turns"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, rows in zip(pdf["conv_id"], pdf["turns"], strict=True):
                said = [(r["role"], r["text"]) for r in rows]
                formatted, spans, rewrites = locate(template or GrowingTemplate(plain_turn), said)
                out.append((conv, len(said), formatted, [{"role": r, "begin": a, "end": b, "text_begin": c, "text_end": d, "learn": r in learn} for (r, _), (a, b, c, d) in zip(said, spans, strict=True)], rewrites))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "formatted", "spans", "rewrites"]).astype({"conv_id": object})

    span = "array<struct<role:string,begin:long,end:long,text_begin:long,text_end:long,learn:boolean>>"
    return grouped.mapInPandas(render, f"conv_id {kind}, n_turns long, formatted string, spans {span}, rewrites array<int>")
