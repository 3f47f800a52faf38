"""Byte-level BPE: encoding by replaying the merges over a table of words, and decoding.

The texts of a slice are cut into pieces by the tokenizer's pattern. The distinct
pieces form a word table, held as one array of symbols with links to the neighbours.
An inverted index leads from the rank of a mergeable pair to all its positions in all
words; merges are replayed in the order of their ranks over the whole table at once,
and a merge touches its own position and the two pairs next to it, nothing else.
Words already worked out by a worker are remembered, so each is replayed about once a
worker, however often it occurs.

Null and empty texts have no ids. Any bytes can be encoded, decoding gives them back.
Rows that repeat are encoded each; the order of rows does not matter.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import map_batches, texts

#: Words that a worker remembers; beyond it, it starts anew. Memory only, never results.
REMEMBERED = 300_000
#: Text that is cut into pieces at once.
SLICE = 3 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


class MergeReplay:
    """Ids of byte strings under the given ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # For each id, the ids that may stand left or right of it, and the merged ids.
        left: dict[int, list[tuple[int, int]]] = {}
        right: dict[int, list[tuple[int, int]]] = {}
        for word, merged in ranks.items():
            for i in range(1, len(word)):
                a = ranks.get(word[:i])
                if a is not None and (b := ranks.get(word[i:])) is not None:
                    left.setdefault(b, []).append((a, merged))
                    right.setdefault(a, []).append((b, merged))
        self.left = {k: self._sorted(v) for k, v in left.items()}
        self.right = {k: self._sorted(v) for k, v in right.items()}
        self.bytes = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.bytes[a, b] = ranks.get(bytes([a, b]), -1)

    @staticmethod
    def _sorted(found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        found.sort()
        return np.array([x for x, _ in found]), np.array([m for _, m in found])

    @staticmethod
    def _merged(partners, symbols: np.ndarray) -> np.ndarray:
        """What each symbol makes with the id whose partners are given; -1: nothing."""
        if partners is None:
            return np.full(len(symbols), -1)
        ids, ranks = partners
        at = np.searchsorted(ids, symbols)
        at[at == len(ids)] = 0
        return np.where(ids[at] == symbols, ranks[at], -1)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of every piece. Pieces that are words of the vocabulary are one id."""
        ranks, out, todo = self.ranks, [], []
        for piece in pieces:
            rank = ranks.get(piece)
            if rank is None and piece:
                todo.append(len(out))
            out.append(np.array([] if rank is None else [rank], "<u4"))
        for i, ids in zip(todo, self._replay([pieces[i] for i in todo]), strict=True):
            out[i] = ids
        return out

    def _replay(self, pieces: list[bytes]) -> list[np.ndarray]:
        if not pieces:
            return []
        # All words in one array; -1 stands between them, -2 marks symbols merged into their left.
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes + 1) - sizes
        n = int(sizes.sum() + len(sizes) + 1)
        word = np.zeros(n, np.int64)
        word[starts] = 1
        word = np.cumsum(word)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        filled = np.ones(n, bool)
        filled[0] = filled[starts + sizes] = False
        symbols = np.full(n, -1, np.int64)
        symbols[filled] = self.base[raw]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        bytes_at = np.full(n, -1)
        bytes_at[filled] = raw
        pair = np.full(n, -1, np.int64)         # rank of the pair that starts here
        both = np.flatnonzero(filled[:-1] & filled[1:])
        pair[both] = self.bytes[bytes_at[both], bytes_at[both + 1]]
        index: dict[int, list[np.ndarray]] = {}  # rank -> positions of such pairs, some outdated
        queue: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            edges = np.flatnonzero(np.diff(ranks)) + 1
            for rank, some in zip(ranks[np.r_[0, edges]].tolist(), np.split(places, edges), strict=True):
                if rank in index:
                    index[rank].append(some)
                else:
                    index[rank] = [some]
                    heappush(queue, rank)

        known = np.flatnonzero(pair >= 0)
        if len(known):
            add(pair[known], known)
        while queue:
            rank = heappop(queue)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = np.unique(at[pair[at] == rank])
            if not len(at):
                continue
            # The leftmost of each word now; the others after any lower rank that it brings.
            first = np.r_[True, np.diff(word[at]) != 0]
            if not first.all():
                index[rank] = [at[~first]]
                heappush(queue, rank)
                at = at[first]
            gone = after[at]
            beyond = after[gone]
            symbols[at], symbols[gone], pair[gone] = rank, -2, -1
            after[at], before[beyond] = beyond, at
            ahead = before[at]
            pair[at] = r = self._merged(self.right.get(rank), symbols[beyond])
            pair[ahead] = h = np.where(symbols[ahead] < 0, -1, self._merged(self.left.get(rank), symbols[ahead]))
            r_ok, h_ok = r >= 0, h >= 0
            new = np.concatenate((r[r_ok], h[h_ok]))
            if len(new):
                add(new, np.concatenate((at[r_ok], ahead[h_ok])))
        kept = symbols != -2
        ends = np.flatnonzero(symbols[kept] == -1)
        ids = symbols[kept].astype("<u4")
        return [ids[a + 1:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


@lru_cache(maxsize=2)
def replay_of(path: str) -> MergeReplay:
    """One for each worker process."""
    return MergeReplay(read_ranks(path))


@lru_cache(maxsize=2)
def memory_of(path: str, pattern: str) -> dict[str, bytes]:
    """Pieces that the worker process has worked out, in this task or one before."""
    return {}


@lru_cache(maxsize=2)
def words_of(path: str) -> list[bytes]:
    """The word of each id."""
    ranks = read_ranks(path)
    words = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    return words


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """key, ids: the ids of each text as little-endian unsigned 32-bit integers."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        replay = replay_of(ranks_path)
        cut = regex.compile(pattern).findall
        known = memory_of(ranks_path, pattern)

        def step(batch: pa.RecordBatch):
            cuts = [cut(x) for x in texts(batch)]
            new = list({p for pieces in cuts for p in pieces if p not in known})
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list({p for pieces in cuts for p in pieces})
            coded = replay.encode([p.encode() for p in new])
            for p, ids in zip(new, coded, strict=True):
                known[p] = ids.tobytes()
            return {"key": batch.column("key"),
                    "ids": [b"".join([known[p] for p in pieces]) for pieces in cuts]}
        return step

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(narrow, f"key {kind}, ids binary", "text", make, SLICE) \
        .select(F.col("key").alias(key), "ids")


def decode(coded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids, decoded: the bytes that the ids stand for."""
    kind = coded.schema[key].dataType.simpleString()

    def make():
        word_of = words_of(ranks_path).__getitem__

        def step(batch: pa.RecordBatch):
            return {"key": batch.column("key"), "ids": batch.column("ids"),
                    "decoded": [b"".join(map(word_of, np.frombuffer(x or b"", "<u4").tolist()))
                                for x in batch.column("ids").to_pylist()]}
        return step

    narrow = coded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return map_batches(narrow, f"key {kind}, ids binary, decoded binary", "ids", make, SLICE) \
        .select(F.col("key").alias(key), "ids", "decoded")
