"""Chat formatting by rendering a black-box template again for each further turn.

A template is a function from a list of (role, text) to a string; nothing else is known
about it. The turns of a conversation are rendered as prefixes, one turn longer each
time, and consecutive outputs are compared: what an output adds to the one before is the
span of its turn. If an output does not begin with the one before, the template has
rewritten history; the row then says from which turn on. The text inside a span is
located by rendering the turn with two other texts: what stays the same at both ends is
the frame.

Turns are handled in the order of (turn, role, text), one conversation after another. For
`REACH` turns a prefix holds all turns before; from then on it starts at the last `CONTEXT` turns and
grows to `REACH` again. What was put together that way is compared with one rendering of the
whole conversation; if they differ, or if history was rewritten, all prefixes are rendered
in full and all spans are located anew in the last one. So the pieces of a conversation always are its
full rendering, whatever the template, and rewriting is found however far back it reaches, unless a later
turn restores what an earlier one changed beyond the reach. Every conversation is held whole, however
long it is: a black box has to be given all of its turns.

A null text or role counts as empty; a null turn comes first; rows with a null
conversation id form one conversation. Rows that repeat are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]
REACH, CONTEXT = 32, 2

#: The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))


def escape(text: str) -> str:
    """A backslash before each backslash and inside each control string."""
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def instruct(turns: list[Turn]) -> str:
    """The template: user and assistant turns by marks of their own, other roles by name."""
    out = ["<s>"]
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body}</s>")
        else:
            out.append("[ROLE] " + escape(role).replace("\n", "\\n") + f"\n{body} [/ROLE]")
    return "".join(out)


def read_instruct(piece: str) -> Turn:
    """The turn in a span of that template."""
    piece = piece.removeprefix("<s>")
    if piece.startswith("[INST] "):
        return "user", unescape(piece[7:-8])
    if piece.startswith("[ROLE] "):
        role, _, body = piece[7:-8].partition("\n")
        return unescape(role), unescape(body)
    return "assistant", unescape(piece[1:-4])


@dataclass
class Span:
    """start and end: of the turn in the output; text_start and text_end: of its text there."""
    start: int
    end: int
    text_start: int
    text_end: int
    piece: str
    rewritten_from: int | None      # first turn that this turn's output changed


def shared(a: str, b: str) -> int:
    """Characters that both begin with."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Incremental:
    """Renders one conversation turn by turn."""

    def __init__(self, render: Render):
        self.render = render
        self.turns: list[Turn] = []
        self.before = ""                # output for self.turns
        self.spans: list[int] = []      # where the turns in self.turns end, in self.before
        self.length = 0                 # characters of the whole conversation so far
        self.position = 0

    def _frame(self, role: str, base: int, piece: str) -> tuple[int, int]:
        """Characters of a turn's span before and after its text."""
        a = self.render([*self.turns, (role, "q")])[base:]
        b = self.render([*self.turns, (role, "zz")])[base:]
        head = shared(a, b)
        tail = shared(a[head:][::-1], b[head:][::-1])
        return (head, tail) if head + tail <= len(piece) else (0, 0)

    def add(self, role: str, text: str) -> Span:
        if len(self.turns) >= REACH:
            self.turns = self.turns[-CONTEXT:]
            self.before = self.render(self.turns)
            ends = [len(self.render(self.turns[:i + 1])) for i in range(len(self.turns))]
            self.spans = ends
        out = self.render([*self.turns, (role, text)])
        base, changed = len(self.before), None
        kept = shared(self.before, out)
        if kept < base:
            first = next((i for i, e in enumerate(self.spans) if e > kept), len(self.spans))
            changed, base = self.position - len(self.turns) + first, kept
        piece = out[base:]
        if not self.turns:
            piece = out
            base = 0
        head, tail = self._frame(role, base, piece) if changed is None else (0, 0)
        start = self.length - (len(self.before) - base if changed is not None else 0)
        end = start + len(piece)
        self.turns.append((role, text))
        self.before = out
        self.spans = [min(e, base) for e in self.spans] + [len(out)]
        self.length, self.position = end, self.position + 1
        return Span(start, end, start + head, end - tail, piece, changed)


def _located(render: Render, turns: list[Turn]) -> list[Span]:
    """The spans in the rendering of all turns, from full prefixes.

    A turn's text is what changes when the turn says something else. Where no later prefix changed what
    came before, a turn ends where its own prefix did; else it ends as far behind its text
    as at its own prefix, but before the next text.
    """
    def text_of(i: int, upto: int) -> tuple[int, int] | None:
        """Characters before and after the text of a turn in the rendering of so many; None: it is not there."""
        a, b = (render([*turns[:i], (turns[i][0], text), *turns[i + 1:upto]]) for text in ("q", "zz"))
        head = shared(a, b)
        return None if a == b else (head, shared(a[head:][::-1], b[head:][::-1]))

    def changed(out: str, kept: int, ends: list[int]) -> int:
        """The first turn of a rendering that ends behind the place up to which it was kept."""
        lo, hi = 0, len(ends) - 1
        while lo < hi:
            mid = at = (lo + hi) // 2
            end = ends[at]
            while end < 0 and at < hi:      # where it lies has changed before
                found = text_of(at, len(ends))
                end = len(out) - found[1] + own[at] if found else -1
                if found and found[0] <= kept < end:
                    return at
                at += end < 0
            if end < 0 or end > kept:
                hi = mid
            else:
                lo = at + 1
        return lo

    before, ends, changes, own = "", [], [], []
    for k in range(1, len(turns) + 1):
        out = render(turns[:k])
        kept = shared(before, out)
        if kept < len(before):
            changes.append(changed(before, kept, ends))
            ends = [e if e <= kept else -1 for e in ends]
        else:
            changes.append(None)
        ends.append(len(out))
        tail = text_of(k - 1, k)
        own.append(tail[1] if tail else 0)
        before = out
    whole, places = before, []
    for i in range(len(turns)):
        found = text_of(i, len(turns))
        places.append((found[0], len(whole) - found[1]) if found and sum(found) <= len(whole) else None)
    spans, at = [], 0
    for i in range(len(turns)):
        following = next((p[0] for p in places[i + 1:] if p), len(whole))
        last = i + 1 == len(turns)
        if last:
            end = len(whole)
        elif ends[i] >= 0:
            end = ends[i]
        else:
            end = min(places[i][1] + own[i], following) if places[i] else at
        end = max(at, end)
        start, stop = places[i] if places[i] else (end, end)
        start = min(max(start, at), end)
        spans.append(Span(at, end, start, min(max(stop, start), end), whole[at:end], changes[i]))
        at = end
    return spans


def render_spans(render: Render, turns: list[Turn]) -> list[Span]:
    """The span of each turn in the rendering of all of them."""
    state = Incremental(render)
    spans = [state.add(*turn) for turn in turns]
    if any(s.rewritten_from is not None for s in spans):
        return _located(render, turns)
    if len(turns) > REACH and "".join(s.piece for s in spans) != render(turns):
        return _located(render, turns)
    return spans


TURNS = ("position long, role string, piece string, start long, end long, text_start long, text_end long, "
         "loss boolean, rewritten_from long, verified boolean")


def format_turns(conversations: DataFrame, render: Render = instruct, loss_roles: tuple[str, ...] = ("assistant",),
                 conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: its place in the conversation and its span in the formatted output.

    piece is the output inside the span; loss marks the turns whose text counts for
    training; rewritten_from is the first turn that this one's rendering changed, null for
    templates that only append; verified says that the pieces are the rendering of the whole conversation.
    Rows of a conversation stay together, in order, within a partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    kind = conversations.schema[conv].dataType.simpleString()
    schema = f"conv {kind}, {TURNS}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def row(c, position: int, r: str, s: Span, verified: bool):
        return (c, position, r, s.piece, s.start, s.end, s.text_start, s.text_end, r in loss_roles, s.rewritten_from, verified)

    def whole(conv, turns: list[Turn]):
        for i, (turn, span) in enumerate(zip(turns, render_spans(render, turns), strict=True)):
            yield row(conv, i, turn[0], span, True)

    def rows(turns: Iterator[tuple[object, str, str]]):
        last, held = object(), []
        for c, r, t in turns:
            if c != last:
                yield from whole(last, held)
                last, held = c, []
            held.append((r, t))
        yield from whole(last, held)

    def run(batches: Iterator[pa.RecordBatch]):
        given = ((c, r or "", t or "") for batch in batches for c, r, t in zip(
            *(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True))
        for some in batched(rows(given), 2048):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), arrow, strict=True)],
                                             schema=arrow)

    ordered = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                                   F.col(text).alias("text")) \
        .repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv)


DIGEST = ("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "history_rewritten boolean")


def digest(turns: DataFrame, read: Callable[[str], Turn] = read_instruct, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from the spans that format_turns gave, which must
    come straight from it. Hashes run along the rows, so no conversation is gathered."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = f"conv {turns.schema[conv].dataType.simpleString()}, {DIGEST}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]):
        now = None      # conversation, turns, hash, loss characters, loss hash, end, rewritten

        def row():
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)],
                                              schema=arrow)
        for batch in batches:
            done = []
            for c, piece, loss, end, changed in zip(*(batch.column(k).to_pylist() for k in
                                                      ("conv", "piece", "loss", "end", "rewritten_from")), strict=True):
                if now is None or now[0] != c:
                    if now:
                        done.append(row())
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                role, text = read(piece)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5], now[6] = end, now[6] or changed is not None
            if done:
                yield made(done)
        if now:
            yield made([row()])

    return turns.withColumnRenamed(conv, "conv").mapInArrow(run, schema).withColumnRenamed("conv", conv)
