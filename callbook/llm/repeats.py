"""Periodic runs of words: a suffix automaton whose link tree is accessed as a link-cut tree.

A run is a stretch of words with smallest period q and at least max(least, 4 q) words that
cannot be made longer on either side. The suffix automaton of a text names its repeated
parts; the suffix links form a tree in which the path of a prefix holds all its endings.
Words are appended one after the other, and each accesses its path: every preferred path
met on the way is a segment of endings with one last occurrence, and afterwards the whole
path has the new one. For a segment with last end e and longest ending L, met at end i, the
words from e - L to i have the period i - e. It is a square if i - e <= L; four periods
are there if 3 (i - e) <= L, and then i - e is the smallest period and e - L the true
start. A run is met at each of its later ends, so its last end is the longest.

Every word of a run occurs four times in it. So words that a stretch holds less often
cannot be part of one and cut the text before the automaton is built, again within the
stretches until nothing changes; prose leaves little, and memory follows the longest
stretch, not the text.

Null and empty texts, and texts of white space only, have no words and no runs. Texts of any
length go through whole; time grows by n log n. Rows that repeat are treated each, null
keys are kept, an empty table gives an empty table, other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import map_batches

#: Periods that a run holds at least, and its least number of words.
PERIODS, LEAST = 4, 6


def words_of(key: object, text: str) -> list[bytes]:
    """The words between ASCII white space."""
    return text.encode().split()


def stretches(words: list[bytes], least: int = LEAST) -> Iterator[tuple[int, list[bytes]]]:
    """(start, words) of the parts that can hold a run."""
    flagged = re.compile(b"\x01{%d,}" % least)
    todo = [(0, words)]
    while todo:
        start, part = todo.pop()
        count = Counter(part)
        often = {w for w, n in count.items() if n >= PERIODS}
        if len(often) == len(count):
            if part:
                yield start, part
            continue
        for found in flagged.finditer(bytes(map(often.__contains__, part))):
            todo.append((start + found.start(), part[found.start():found.end()]))


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest lengths and suffix links of the states, and the state of each prefix. State 0 is the root."""
    length, link, step, prefix, last = [0], [-1], [{}], [], 0
    for n, c in enumerate(symbols, 1):
        now, p = len(length), last
        length.append(n)
        link.append(0)
        step.append({})
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        prefix.append(now)
        last = now
    return length, link, prefix


class Paths:
    """The link tree as preferred paths, each a splay tree ordered by depth.

    All states of a preferred path have the same last occurrence; `end` holds it at the
    root of the splay tree. State numbers are raised by one, 0 is none.
    """

    def __init__(self, link: list[int]):
        n = len(link) + 1
        self.up = array("q", [0] + [p + 1 for p in link])      # parent in the splay tree, or above the path
        self.upper, self.lower = array("q", bytes(8 * n)), array("q", bytes(8 * n))
        self.end = array("q", bytes(8 * n))

    def _splay(self, x: int) -> None:
        up, upper, lower = self.up, self.upper, self.lower
        y = up[x]
        if not y or (upper[y] != x and lower[y] != x):
            return
        while True:
            y = up[x]
            if not y or (upper[y] != x and lower[y] != x):
                return
            z = up[y]
            inner = z and (upper[z] == y or lower[z] == y)
            if inner:       # zig-zig turns the parent first, zig-zag the state twice
                turns = (y, x) if (upper[y] == x) == (upper[z] == y) else (x, x)
            else:
                turns = (x,)
                self.end[x] = self.end[y]
            for t in turns:
                p = up[t]
                g = up[p]
                if upper[p] == t:
                    child = upper[p] = lower[t]
                    lower[t] = p
                else:
                    child = lower[p] = upper[t]
                    upper[t] = p
                if child:
                    up[child] = p
                if g:
                    if upper[g] == p:
                        upper[g] = t
                    elif lower[g] == p:
                        lower[g] = t
                up[p], up[t] = t, g
            # An inner pair ends below z's old parent; its root's end moves when x becomes the root.
            if inner and (not up[x] or (upper[up[x]] != x and lower[up[x]] != x)):
                self.end[x] = self.end[z]
                return

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """(state, last end) of the lowest state of each segment above; then all have this end."""
        up, lower, ends = self.up, self.lower, self.end
        x, below, met = state + 1, 0, []
        while x:
            self._splay(x)
            old = ends[x]
            met.append((x - 1, old))
            if lower[x]:
                ends[lower[x]] = old
            lower[x] = below
            below = x
            x = up[x]
        self._splay(state + 1)
        ends[state + 1] = end
        return met


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    runs = []
    for first, part in stretches(words, least):
        number: dict[bytes, int] = {}
        length, link, prefix = automaton([number.setdefault(w, len(number)) for w in part])
        paths, found = Paths(link), {}
        for end, state in enumerate(prefix, 1):
            for met, last in paths.access(state, end):
                period = end - last
                if last and (PERIODS - 1) * period <= length[met]:
                    found[last - length[met], period] = end
        runs += [(first + start, end - start, period) for (start, period), end in found.items()
                 if end - start >= max(least, PERIODS * period)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in runs:
        keep[start + period:start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, keep, strict=True) if k] if runs else words)


RUNS = "n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST,
         words: Callable[[object, str], list[bytes]] = words_of) -> DataFrame:
    """key, n_words, runs (by start, then period; word numbers from 0), collapsed (the text without
    the repeated periods). `words` makes the words of a row from its key and text."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch):
            counts, runs, left = [], [], []
            for k, value in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                given = words(k, value or "")
                met = runs_of(given, least)
                counts.append(len(given))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in met])
                left.append(collapse(given, met).decode())
            return {"key": batch.column("key"), "n_words": counts, "runs": runs, "collapsed": left}
        return step

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(narrow, f"key {kind}, {RUNS}", "text", make).withColumnRenamed("key", key)
