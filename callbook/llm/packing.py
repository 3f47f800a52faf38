"""Packing: documents into sequences of bounded length, in their order.

The token streams of a partition's documents are laid end to end, in the order of
their rows. Cuts may fall at the end of a document (free), at the end of a sentence
(a small penalty), or, where a sentence is long, inside it (a larger one). Dynamic
programming chooses the cuts that make padding plus penalties least:

    cost[j] = cut[j] + min over i of cost[i] + pad(p[j] - p[i]),  p[j] - p[i] <= window

As pad(L) = window - L, the minimum over i is one of cost[i] + p[i] over a sliding range,
which a monotone queue holds; lengths that need no padding (powers of two) are looked up
besides. Every sequence also costs a little, so that long ones win ties.

Work goes on in blocks of bounded size: a block's last window stays open and leads the
next block, so only the end of a partition can be short; there, if it saves more than
the cuts cost, the rest is cut into power-of-two lengths.

Null and empty texts count as documents of the end id alone. The order of rows within
a partition is kept; partitions never share a sequence. A document as long as many
windows is cut like any other stream. The same partitions always give the same result,
so a lost task can run again.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import chunks, long_rows

WINDOW = 4096
SENTENCE_CUT, HARD_CUT, PER_SEQUENCE = 8, 64, 4
#: Powers of two from here on are looked up; shorter sequences would be of little use.
SHORTEST = 256
#: Where no sentence ends for this many tokens, cuts inside it are allowed at this distance.
HARD_STEP = 64
#: Tokens of a block.
BLOCK = 1 << 18
#: Words that a worker remembers in each of two generations, unless told otherwise. Memory only, never results.
REMEMBERED = 200_000
#: Text whose words are told apart at once.
SLICE = 2 << 20


def cut_places(ends: np.ndarray, sentences: np.ndarray, total: int,
               step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places where cuts may fall, 0 and total included, and what a cut costs there.

    ends: ends of documents; sentences: ends of sentences; both as places in the stream.
    """
    soft = np.union1d(np.union1d(ends, sentences), [0, total])
    gaps = np.diff(soft)
    wide = np.flatnonzero(gaps > step)
    hard = [np.arange(soft[i] + step, soft[i + 1], step) for i in wide]
    places = np.union1d(soft, np.concatenate(hard)) if hard else soft
    cost = np.full(len(places), HARD_CUT)
    cost[np.isin(places, sentences)] = SENTENCE_CUT
    cost[np.isin(places, ends)] = 0
    cost[[0, -1]] = 0
    return places.astype(np.int64), cost


def best_cuts(places: list[int], cost: list[int], window: int = WINDOW) -> list[int]:
    """Indexes of the places to cut at, the first and the last included.

    Neighbouring places must not be more than `window` apart. The last sequence stays open,
    so it pays no padding: what is left over gathers there.
    """
    at = {p: i for i, p in enumerate(places)}
    powers = [1 << k for k in range(SHORTEST.bit_length() - 1, window.bit_length()) if 1 << k < window]
    least, back = [0], [0]
    queue = deque([(places[0], 0)])     # (cost + place, index), rising from left to right
    if len(places) < 2:
        return [0]
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0][1]] < p - window:
            queue.popleft()
        lowest, i = queue[0]
        value = lowest + window - p
        for length in powers:
            k = at.get(p - length)
            if k is not None and least[k] < value:
                value, i = least[k], k
        value += cost[j] + PER_SEQUENCE
        least.append(value)
        back.append(i)
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = i = len(places) - 1
    while i and places[j] - places[i - 1] <= window:
        i -= 1
    back[j] = min(range(i, j), key=lambda i: (least[i], i))
    cuts = [j]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def tail_lengths(length: int, window: int = WINDOW) -> list[int]:
    """The last, short sequence: whole, or as lengths without padding if that costs less."""
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    padded = 0 if len(parts) == 1 else window - length
    return parts if (len(parts) - 1) * (HARD_CUT + PER_SEQUENCE) < padded else [length]


def pack_stream(stream: Iterator[tuple[object, np.ndarray, np.ndarray]], window: int = WINDOW,
                block: int = BLOCK) -> Iterator[tuple[object, int, np.ndarray, int, int, int]]:
    """(key, start, ids, doc_tokens, sequence, offset) of every piece, in order.

    stream: (key, ids, places of sentence ends) of every document.
    """
    docs: list[list] = []       # key, ids, sentence places, ids already given out
    held, sequence = 0, 0

    def give(lengths: list[int]):
        nonlocal sequence, held
        for length in lengths:
            offset = 0
            while offset < length:
                key, ids, _, done = doc = docs[0]
                n = min(length - offset, len(ids) - done)
                yield key, done, ids[done:done + n], len(ids), sequence, offset
                offset += n
                doc[3] += n
                if doc[3] == len(ids):
                    docs.pop(0)
            held -= length
            sequence += 1

    def lengths_of(last: bool) -> list[int]:
        ends, sentences, at = [], [], 0
        for _, ids, places, done in docs:
            sentences.append(places[places > done] - done + at)
            at += len(ids) - done
            ends.append(at)
        total = min(at, 2 * block)      # of one very long document, so much at once
        ends, sentences = np.array(ends), np.concatenate(sentences)
        places, cost = cut_places(ends[ends <= total], sentences[sentences <= total], total)
        places, cost = places.tolist(), cost.tolist()
        cuts = [places[i] for i in best_cuts(places, cost, window)]
        lengths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        if last and total == at:
            return lengths[:-1] + tail_lengths(lengths[-1], window)
        return lengths[:-1]

    for key, ids, places in stream:
        docs.append([key, ids, places, 0])
        held += len(ids)
        while held >= block:
            yield from give(lengths_of(False))
            if held >= block and len(docs) == 1:
                continue
            break
    while held:
        yield from give(lengths_of(True))


#: Letters that the tokenizer lowers and takes apart as single characters, how it cuts
#: words of them, and the characters by which it names the bytes of a word.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
PLAIN = re.compile(f"[!-~{LETTERS}]+").fullmatch
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+").findall
_NAMED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_NAMES = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_NAMED)))}


class Memory:
    """Ids of words, in one array, by the place of each word."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ends, self.ids = array("q", [0]), array("I")

    def add(self, word: str, ids: bytes) -> int:
        place = self.place[word] = len(self.place)
        self.ids.frombytes(ids)
        self.ends.append(len(self.ids))
        return place

    def of(self, place: int) -> bytes:
        return self.ids[self.ends[place]:self.ends[place + 1]].tobytes()


class WordIds:
    """Ids of texts by a tokenizer whose words never reach over white space.

    The words of many texts are told apart at once, and each distinct word goes through the
    tokenizer once and is remembered: in two generations, so that a full memory loses
    only words that have not been met since it was last full. Words of plain letters are lowered and
    cut as the tokenizer does it and go to its model at once, all others through the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int, remembered: int | None = None):
        import json

        from tokenizers import Tokenizer
        self.tokenizer, self.end_id, self.remembered = Tokenizer.from_file(path), end_id, remembered or REMEMBERED
        self.now, self.before = Memory(), Memory()
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.closes = np.zeros(max(max(vocabulary.values()), end_id) + 1024, bool)
        for word, i in vocabulary.items():
            bare = word.removesuffix("</w>")
            if word != bare and bare and bare[-1] in ".!?" and not any(c.isalnum() for c in bare):
                self.closes[i] = True

    def _part(self, part: str) -> bytes:
        if len(self.parts) >= self.remembered:
            self.parts, self.old_parts = {}, self.parts
        ids = self.old_parts.get(part)
        if ids is None:
            named = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_NAMES)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(named)]).tobytes()
        self.parts[part] = ids
        return ids

    def _learn(self, word: str) -> bytes:
        if PLAIN(word) and "<|" not in word:
            return b"".join([self.parts.get(p) or self._part(p) for p in PARTS(word.lower())])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the memory holds each of some distinct words; new ones are learnt."""
        if len(self.now.place) >= self.remembered:
            self.now, self.before = Memory(), self.now
        now, old = self.now, self.before
        places = [now.place.get(w) for w in words]
        for i, place in enumerate(places):
            if place is None:
                known = old.place.get(words[i])
                places[i] = now.add(words[i], self._learn(words[i]) if known is None else old.of(known))
        return np.array(places, np.int64)

    def many(self, given: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, each followed by the end id, and where each text ends among them."""
        split = pc.ascii_split_whitespace(pc.fill_null(given, ""))
        words, bounds = split.flatten(), split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0      # none between white space and an end
        bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
        coded = words.filter(pa.array(full)).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        places = self._places(distinct)
        ends = np.frombuffer(self.now.ends, np.int64)
        starts, sizes = np.append(ends[places], 0), np.append(ends[places + 1] - ends[places], 1)
        del ends
        # The texts' words with the end, number len(distinct), after each text.
        which = np.insert(coded.indices.to_numpy(), bounds[1:], len(distinct))
        lengths = sizes[which]
        after = np.cumsum(lengths)
        if len(self.now.ids):
            at = np.repeat((starts[which] - after + lengths).astype(np.int32), lengths)
            at += np.arange(len(at), dtype=np.int32)
            ids = np.frombuffer(self.now.ids, np.uint32)[at]
        else:
            ids = np.zeros(len(which), np.uint32)
        text_ends = after[bounds[1:] + np.arange(len(given))] if len(given) else after
        ids[text_ends - 1] = self.end_id
        return ids.astype("<u4", copy=False), text_ends

    def each(self, given: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids with the end id, and the places where sentences end, of each text."""
        ids, ends = self.many(given)
        closes, start = self.closes[ids], 0
        for end in ends.tolist():
            yield ids[start:end], np.flatnonzero(closes[start:end]) + 1
            start = end

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return next(self.each(pa.array([text], pa.string())))


@lru_cache(maxsize=2)
def word_ids(path: str, end_id: int, remembered: int | None = None) -> WordIds:
    """One for each worker process, so that its tasks share what they have learnt."""
    return WordIds(path, end_id, remembered)


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, key: str = "doc_id",
         text: str = "text", window: int = WINDOW, remembered: int | None = None) -> DataFrame:
    """One row per piece: key, start (ids of its document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (ids before it in its sequence). More remembered
    words take memory and save time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = f"key {docs.schema[key].dataType.simpleString()}, {PIECES}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    long_rows(docs.sparkSession)

    def run(batches):
        import os

        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        first = TaskContext.get().partitionId() << 40
        ids_of = word_ids(tokenizer_path, end_id, remembered)

        def stream():
            for part in chunks(batches, "text", SLICE):
                keys = part.column("key").to_pylist()
                for k, found in zip(keys, ids_of.each(part.column("text")), strict=True):
                    yield k, *found

        def batch(rows):
            keys, starts, ids, totals, sequences, offsets = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, arrow.field("key").type), pa.array(starts, pa.int64()),
                 pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids]),
                 pa.array(totals, pa.int64()), pa.array([first + s for s in sequences], pa.int64()),
                 pa.array(offsets, pa.int64())], schema=arrow)

        rows = []
        for piece in pack_stream(stream(), window):
            rows.append(piece)
            if len(rows) >= 2048:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)
        pa.default_memory_pool().release_unused()       # workers live on for other tasks

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")) \
        .mapInArrow(run, schema).withColumnRenamed("key", key)
