"""Collocations: frequent phrases by a two-way FM-index over word ids in every shard.

The words of a task's documents form shards of bounded length. Words that the whole corpus
of their language holds less than `least` times cannot be part of a candidate; they and the
ends of pieces become the separator. Over what is left a shard keeps the Burrows-Wheeler
transforms of its ids and of its ids reversed, sorted by the first `depth` words, as no
phrase is longer. A phrase is an interval in both: words to its right are read from the
reversed transform, words to its left from the other one, each extension narrows one interval
by the LF mapping and the other by the counts of smaller words, and its length is the count.

Words are counted by hash range: a shard sends its words of a range, in order, as one block, and is told
which of them are frequent by their places in it; no word is sent back.

Phrases grow by one word a round, right and left in turn, and a shard extends only phrases
that may be frequent in the corpus. Most extensions are rare, so the shards first sum counts
by hash: sorted hashes and counts of a range of hashes travel as one small block, and a hash that
does not reach `least` rules its phrases out. Collisions only let a few more through. A phrase is
kept if both its parts, without the first and without the last word, are there too; the part that
was not extended is found by its interval, which holds the new one. At the end the exact counts of all
phrases that are left are summed by phrase, and each frequent one is written by one shard,
which knows the counts of its beginnings and ends, as they are frequent and occur in it too.

The shards' transforms are stored in buckets of the shard and never shuffled. Nothing is
gathered by language or by word, and the best of a language are taken in two steps. Stored rows are deleted
once nothing reads them any more.

Null texts are empty, a null language is `und`. Empty texts and texts of separators alone
have no words. Rows that repeat count each; an empty table gives an empty table; other columns
are not read. A text of any length goes through whole; it is cut over shards between pieces,
so memory follows the longest text and the longest piece.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callbook.llm.common import chunks, long_rows, settle, settle_by, texts, unsettle

#: Words of a shard, but for a longer piece.
SHARD_WORDS = 3 << 20
#: Kinds of packed ids and the bytes that follow their first one.
FOLLOWING = ((1, 1), (2, 2), (3, 4))
#: Words in a phrase, at most.
DEPTH = 5
#: Parts that the phrases of a language are ranked in first.
PARTS = 64
#: Words of all shards for each range of hashes.
RANGE_WORDS = 1 << 21

#: What ends a piece, and A-Z, which are lowered.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Stands for the end of a piece; no UTF-8 text holds this byte.
END = b"\xff"
PLAIN = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + b"\n" * len(ENDS))


class Numbers(dict):
    """Numbers of one language's words within a shard; 0 is the end of a piece."""

    def __init__(self, lang: str, names: list[bytes]):
        super().__init__({END: 0})
        self.lang, self.names = lang.encode() + END, names

    def __missing__(self, word: bytes) -> int:
        self.names.append(self.lang + word)
        number = self[word] = len(self.names)
        return number


def words_of(text: str) -> list[bytes]:
    """Lowered words, with END between pieces."""
    return text.encode().translate(PLAIN).replace(b"\n", b" " + END + b" ").split()


def parted(ids: np.ndarray, size: int) -> list[np.ndarray]:
    """An array in parts of at most `size` ids, cut at separators only."""
    parts = []
    while len(ids) > size:
        ends = np.flatnonzero(ids == 0)
        at = np.searchsorted(ends, size)
        if at == 0 and not len(ends):
            break
        cut = ends[max(at - 1, 0)] + 1
        if cut == len(ids):
            break
        parts.append(ids[:cut])
        ids = ids[cut:]
    return [*parts, ids]


def dense(ids: np.ndarray) -> np.ndarray:
    """Without separators that follow one, with one at either end."""
    ids = np.concatenate(([0], ids, [0]))
    return ids[(ids != 0) | np.r_[True, ids[:-1] != 0]]


def packed(ids: np.ndarray) -> bytes:
    """Ids as compressed unsigned 32-bit integers; they are the bulk of what is stored and shuffled.

    A byte an id has its leading bits and how many bytes follow; those come after all of the former.
    """
    ids = np.ascontiguousarray(ids).astype(np.uint32)
    kind = (ids >= 1 << 6).astype(np.uint8) + (ids >= 1 << 14) + (ids >= 1 << 22)
    first = np.where(kind == 3, 192, 64 * kind + (ids >> (8 * kind))).astype(np.uint8)
    rest = [ids[kind == k].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size].T.tobytes() for k, size in FOLLOWING]
    first, rest = (zstandard.ZstdCompressor(level=1).compress(x) for x in (first.tobytes(), b"".join(rest)))
    return len(first).to_bytes(4, "little") + first + rest


def unpacked(cell: pa.Scalar) -> np.ndarray:
    data, reader = cell.as_py(), zstandard.ZstdDecompressor()
    end = 4 + int.from_bytes(data[:4], "little")
    first = np.frombuffer(reader.decompress(data[4:end]), np.uint8)
    rest, start, kind, out = np.frombuffer(reader.decompress(data[end:]), np.uint8), 0, first >> 6, first.astype(np.int64) & 63
    for k, size in FOLLOWING:
        at = np.flatnonzero(kind == k)
        for i, low in enumerate(rest[start:start + size * len(at)].reshape(size, -1)):
            out[at] = (out[at] << 8 * (i == 0) * size) | (low.astype(np.int64) << 8 * i)
        start += size * len(at)
    return out


def packed_names(names: pa.Array) -> bytes:
    """Byte strings, compressed: how many, their lengths, then all bytes. In order they share their beginnings."""
    ends = np.frombuffer(names.buffers()[1], "<i4")[names.offset:names.offset + len(names) + 1] if len(names) else np.zeros(1, "<i4")
    data = names.buffers()[2].to_pybytes()[ends[0]:ends[-1]] if ends[-1] > ends[0] else b""
    return zstandard.ZstdCompressor(level=9).compress(
        np.array([len(names)], "<i4").tobytes() + np.diff(ends).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() + data)


def unpacked_names(cell: pa.Scalar) -> pa.Array:
    data = zstandard.ZstdDecompressor().decompress(cell.as_py())
    n = int(np.frombuffer(data, "<i4", 1)[0])
    lengths = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, 4).reshape(4, n).T).view("<i4").reshape(-1)
    ends = np.concatenate(([0], np.cumsum(lengths))).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data[4 + 4 * n:])])


SHARDS = "shard long, n long, langs array<string>, sizes array<long>, ids binary, names binary, counts binary"
_SHARDS = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())),
                     ("ids", pa.binary()), ("names", pa.binary()), ("counts", pa.binary())])


def shards(docs: DataFrame, lang: str, text: str, size: int) -> DataFrame:
    """A row for each shard: its number of words, also by language, its packed ids, and its words in order (behind their
    language) with their counts. The most frequent word has id 1; equal counts go by the order of the words."""
    long_rows(docs.sparkSession)

    def row(shard, names, ids):
        ids = dense(np.concatenate(ids))
        counts = np.bincount(ids, minlength=len(names) + 1)[1:]
        here = np.flatnonzero(counts)
        words = pa.array([names[i] for i in here.tolist()], pa.binary())
        by = pc.sort_indices(words).to_numpy()
        words, here = words.take(pa.array(by)), here[by]
        counts, number = counts[here], np.zeros(len(names) + 1, np.int64)
        number[here[ranked(counts)] + 1] = np.arange(1, len(here) + 1)
        sizes = {}
        for name, count in zip(words.to_pylist(), counts.tolist(), strict=True):
            language = name[:name.index(END)]
            sizes[language] = sizes.get(language, 0) + count
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(
                ([shard], [int(counts.sum())], [[x.decode() for x in sizes]], [list(sizes.values())], [packed(number[ids])],
                 [packed_names(words)], [packed(counts)]), _SHARDS, strict=True)], schema=_SHARDS)

    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId() << 32
        names, numbers, held, total = [], {}, [], 0
        for batch in chunks(batches, "text"):
            for language, given in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                words = words_of(given)
                if total and total + len(words) > size:
                    yield row(shard, names, held)
                    shard, names, numbers, held, total = shard + 1, [], {}, [], 0
                number = numbers.get(language)
                if number is None:
                    number = numbers[language] = Numbers(language, names)
                ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                parts = parted(ids, size)
                for part in parts[:-1]:     # a long text: its words keep their numbers until the last of its shards is full
                    yield row(shard, names, [*held, [0], part])
                    shard, held = shard + 1, []
                held += [[0], parts[-1]]
                total += len(parts[-1])
        if names:
            yield row(shard, names, held)
        del names, numbers, held

        pa.default_memory_pool().release_unused()       # workers live on for other tasks

    narrow = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, SHARDS)


def ranked(counts: np.ndarray) -> np.ndarray:
    """The places of words by falling count: where the words with ids 1, 2, ... stand in the list."""
    return np.argsort(-counts, kind="stable")


def dealt(names: pa.Array, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of words by the range of their hash, and where each range begins and ends."""
    hashes = np.fromiter(map(zlib.crc32, names.to_pylist()), np.uint64, len(names))
    which = (hashes * np.uint64(ranges)) >> np.uint64(32)
    by = np.argsort(which, kind="stable")
    return by, np.searchsorted(which[by], np.arange(ranges + 1, dtype=np.uint64))


def vocabulary(parts: DataFrame, least: int, ranges: int) -> DataFrame:
    """For each shard and range of hashes its words that are frequent in their language: of (the shard), range, data (their
    places among the shard's words of the range and their ids, both rising by what is given, and their counts in all shards).

    An id is the range and the word's place among the frequent words of the range.
    """
    def deal(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                names, counts = unpacked_names(batch["names"][i]), unpacked(batch["counts"][i])
                by, edges = dealt(names, ranges)
                names, counts = names.take(pa.array(by)), counts[by]
                cells = [(r, packed_names(names.slice(a, b - a)), packed(counts[a:b]))
                         for r, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch["shard"][i].as_py()] * len(cells), pa.int64()),
                     *[pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]],
                    ["shard", "range", "names", "counts"])

    schema = pa.schema([("of", pa.int64()), ("range", pa.int32()), ("data", pa.binary())])

    def add(rows: pa.Table) -> pa.Table:
        each = [unpacked_names(cell) for cell in rows["names"]]
        names = pa.concat_arrays(each).dictionary_encode()
        place = names.indices.to_numpy()
        total = np.bincount(place, np.concatenate([unpacked(cell) for cell in rows["counts"]])).astype(np.int64)
        enough = np.flatnonzero(total >= least)
        ids = np.full(len(total), -1)
        ids[enough[pc.sort_indices(names.dictionary.take(pa.array(enough))).to_numpy()]] = np.arange(len(enough))
        out, at = [], 0
        for shard, some in zip(rows["shard"].to_pylist(), each, strict=True):
            words = place[at:at + len(some)]
            at += len(some)
            kept = np.flatnonzero(ids[words] >= 0)
            if len(kept):
                now, words = total[words[kept]], ids[words[kept]]
                out.append((shard, rows["range"][0].as_py(), packed(np.concatenate(
                    (np.diff(kept, prepend=0), np.diff(words, prepend=0), now & 0xFFFFFFFF, now >> 32)))))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
                                    schema=schema) if out else schema.empty_table()

    sent = parts.select("shard", "names", "counts").where("n > 0").mapInArrow(deal, "shard long, range int, names binary, counts binary")
    return sent.groupBy("range").applyInArrow(add, "of long, range int, data binary")


def order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text by the next `depth` ids; separators follow its end."""
    rank, width = ids.astype(np.int64), 1
    while True:
        step = min(width, depth - width)
        ahead = np.concatenate((rank[step:], np.zeros(step, np.int64)))
        code = rank * (int(rank.max()) + 1) + ahead
        width += step
        if width == depth:
            return np.argsort(code, kind="stable")
        rank = np.unique(code, return_inverse=True)[1].reshape(-1)


def transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """The id before each place, in that order."""
    return ids[order(ids, depth) - 1]


def extend(before: np.ndarray, low: np.ndarray, other: np.ndarray, size: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All extensions of some intervals by one word: owner, word, low, other low, size.

    before: the transform that holds the words to add; low: the intervals in it; other: the same
    phrases' intervals in the other transform.
    """
    mapping = np.empty(len(before), np.int64)
    mapping[np.argsort(before, kind="stable")] = np.arange(len(before))
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    places = np.arange(len(owner)) + (low - starts)[owner]
    alphabet = int(before.max(initial=0)) + 1
    code, first, count = np.unique(owner * alphabet + before[places], return_index=True, return_counts=True)
    own, word = code // alphabet, code % alphabet
    smaller = np.cumsum(count) - count - starts[own]
    kept = word > 0
    return (own[kept], word[kept], mapping[places[first[kept]]], (other[own] + smaller)[kept], count[kept])


def holder(low: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the disjoint intervals holds each wanted place; -1: none."""
    if not len(low):
        return np.full(len(wanted), -1)
    by = np.argsort(low)
    at = by[np.maximum(np.searchsorted(low[by], wanted, "right") - 1, 0)]
    return np.where((low[at] <= wanted) & (wanted < low[at] + size[at]), at, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix of 8-byte ids as one cell."""
    data = np.ascontiguousarray(rows, ">i8")
    offsets = (np.arange(len(data) + 1) * 8 * data.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


INDEX = "shard long, left binary, right binary, counts binary, word_ids binary, totals binary, names binary"


def index(parts: DataFrame, words: DataFrame, depth: int, ranges: int) -> DataFrame:
    """The two transforms of every shard. words: those of :func:`vocabulary`."""
    schema = pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in
                       ("left", "right", "counts", "word_ids", "totals", "names")]])

    def build(text: pa.Table, known: pa.Table) -> pa.Table:
        if not text.num_rows or not known.num_rows:
            return schema.empty_table()
        names, place = unpacked_names(text["names"][0]), ranked(unpacked(text["counts"][0]))
        ids, totals = np.full(len(names), -1), np.zeros(len(names), np.int64)
        by, edges = dealt(names, ranges)
        for which, data in zip(known["range"].to_pylist(), known["data"], strict=True):
            at, word, low, high = unpacked(data).reshape(4, -1)
            at = by[edges[which] + np.cumsum(at)]
            ids[at], totals[at] = (which << 32) + np.cumsum(word), low + (high << 32)
        kept = ids[place] >= 0
        number = np.concatenate(([0], np.where(kept, np.cumsum(kept), 0)))
        place = place[kept]
        now = dense(number[unpacked(text["ids"][0])])
        alone = (now[1:-1] != 0) & (now[:-2] == 0) & (now[2:] == 0)     # a word by itself is no phrase
        now[1:-1][alone] = 0
        now = dense(now)
        return pa.Table.from_arrays(
            [pa.array([text["shard"][0].as_py()]), *[pa.array([x], pa.binary()) for x in (
                packed(transform(now, depth)), packed(transform(now[::-1], depth)),
                *[packed_long(x) for x in (np.bincount(now, minlength=len(place) + 1), ids[place], totals[place])],
                packed_names(names.take(pa.array(place[np.argsort(ids[place])]))))]], schema=schema)

    return parts.select("shard", "ids", "names", "counts").groupBy("shard").cogroup(words.groupBy("of")).applyInArrow(build, INDEX)


def _words_alone(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the intervals of single words begin, in either transform, and their sizes."""
    return (np.cumsum(counts) - counts)[1:], counts[1:]


class Phrases:
    """Phrases of one length in a shard: their intervals and their words, as numbers within the shard."""

    def __init__(self, low: np.ndarray, back: np.ndarray, size: np.ndarray, words: np.ndarray):
        self.low, self.back, self.size, self.words = low, back, size, words

    @classmethod
    def single(cls, counts: np.ndarray) -> Phrases:
        low, size = _words_alone(counts)
        return cls(low, low, size, np.arange(1, len(low) + 1).reshape(-1, 1))

    def only(self, kept: np.ndarray) -> Phrases:
        return Phrases(self.low[kept], self.back[kept], self.size[kept], self.words[kept])

    def pack(self) -> bytes:
        """In the order of the intervals; the first and the last word follow from where they lie."""
        by = np.argsort(self.low)
        return packed(np.concatenate((np.diff(self.low[by], prepend=0), self.back[by], self.size[by],
                                      self.words[by, 1:-1].T.ravel())))

    @classmethod
    def unpack(cls, cell: pa.Scalar, length: int, counts: np.ndarray) -> Phrases:
        rows = unpacked(cell).reshape(1 + length, -1)
        low, back, starts = np.cumsum(rows[0]), rows[1], np.cumsum(counts)
        words = (np.searchsorted(starts, low, "right"), *rows[3:], np.searchsorted(starts, back, "right"))
        return cls(low, back, rows[2], np.column_stack(words))

    def longer(self, before: np.ndarray, right: bool) -> Phrases:
        """The phrases one word longer whose other part is here too; `before` is the transform to read."""
        own, word, new, other, count = extend(before, self.back if right else self.low,
                                              self.low if right else self.back, self.size)
        part = holder(self.back if right else self.low, self.size, new) >= 0
        own, word, new, other, count = (x[part] for x in (own, word, new, other, count))
        words = np.column_stack((self.words[own], word) if right else (word, self.words[own]))
        return Phrases(*((other, new) if right else (new, other)), count, words)

    def hashes(self, word_ids: np.ndarray, bits: int) -> np.ndarray:
        """A hash of each phrase, the same in all shards."""
        out = np.full(len(self.words), 0x9E3779B97F4A7C15, np.uint64)
        ids = word_ids.astype(np.uint64)
        for column in self.words.T:
            out = (out ^ ids[column - 1]) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        return out >> np.uint64(64 - bits)


def _right(words: int) -> bool:
    """The side on which phrases of so many words got their last one."""
    return words % 2 == 0


#: Rows that shards send. Of a range of hashes: the hashes, with their counts, of phrases that have no number of
#: words yet, or the word ids and counts of phrases of so many words. Without a range: the shard's own phrases.
SENT = "shard long, words int, range int, data binary, counts binary"
_SENT = pa.schema([("shard", pa.int64()), ("words", pa.int32()), ("range", pa.int32()), ("data", pa.binary()),
                   ("counts", pa.binary())])


def packed_long(ids: np.ndarray) -> bytes:
    """64-bit ids, low halves before high halves."""
    ids = ids.astype(np.uint64)
    return packed(np.concatenate((ids & np.uint64(0xFFFFFFFF), ids >> np.uint64(32))))


def unpacked_long(cell: pa.Scalar) -> np.ndarray:
    low, high = unpacked(cell).astype(np.uint64).reshape(2, -1)
    return (high << np.uint64(32)) | low


def packed_hashes(hashes: np.ndarray) -> bytes:
    """Rising hashes, as their differences."""
    return packed_long(np.diff(hashes, prepend=np.uint64(0)))


def unpacked_hashes(cell: pa.Scalar) -> np.ndarray:
    return np.cumsum(unpacked_long(cell), dtype=np.uint64)


@dataclass(frozen=True)
class Split:
    """How phrases are told apart by hash: bits of a hash, and equal ranges of hashes."""
    bits: int
    ranges: int

    @classmethod
    def of(cls, words: int) -> Split:
        """One to two hashes for each word of the corpus. Frequent phrases of a length are at most a hundredth as many as the
        words, so about one rare phrase in a hundred shares the hash of one; more bits would be sent for every phrase."""
        return cls(min(56, words.bit_length()), max(1, -(-words // RANGE_WORDS)))


def _ranges(shard: int, phrases: Phrases, word_ids: np.ndarray, split: Split, words: int | None = None) -> list[tuple]:
    """What a shard sends of its phrases for each range of hashes: hashes, or word ids, and counts."""
    hashes = phrases.hashes(word_ids, split.bits)
    if not len(hashes):
        return []
    by = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[by], phrases.size[by]
    coarse = np.uint64(split.bits // 2)
    which = ((hashes >> coarse) * np.uint64(split.ranges)) >> (np.uint64(split.bits) - coarse)
    edges = np.flatnonzero(np.diff(which, prepend=which[:1] + np.uint64(1)))
    out = []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(hashes)], strict=True):
        data = packed_hashes(hashes[a:b]) if words is None else packed_long(word_ids[phrases.words[by[a:b]] - 1].ravel())
        out.append((shard, words, int(which[a]), data, packed(counts[a:b])))
    return out


def _sent(rows: list[tuple]) -> pa.Table:
    pa.default_memory_pool().release_unused()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)],
                                schema=_SENT) if rows else _SENT.empty_table()


def pairs(indexes: DataFrame, split: Split) -> DataFrame:
    """The hashes of all phrases of two words."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = Phrases.single(unpacked_long(batch["counts"][i]).astype(np.int64)).longer(unpacked(batch["right"][i]), True)
                yield from _sent(_ranges(batch["shard"][i].as_py(), found, unpacked_long(batch["word_ids"][i]), split)
                                 ).to_batches()

    return indexes.select("shard", "right", "counts", "word_ids").mapInArrow(run, SENT)


def reached(sent: DataFrame, least: int) -> DataFrame:
    """For each shard and range the hashes that have `least` occurrences over all shards."""
    def add(rows: pa.Table) -> pa.Table:
        parts = [unpacked_hashes(cell) for cell in rows["data"]]
        counts = [unpacked(cell) for cell in rows["counts"]]
        hashes, place = np.unique(np.concatenate(parts), return_inverse=True)
        enough = np.bincount(place.reshape(-1), np.concatenate(counts)) >= least
        out, at = [], 0
        for shard, part in zip(rows["shard"].to_pylist(), parts, strict=True):
            alive = part[enough[place[at:at + len(part)]]]
            at += len(part)
            if len(alive):
                out.append((shard, None, rows["range"][0].as_py(), packed_hashes(np.unique(alive)), None))
        return _sent(out)

    return sent.where("counts IS NOT NULL AND words IS NULL").groupBy("range").applyInArrow(add, SENT)


def grown(indexes: DataFrame, known: DataFrame | None, alive: DataFrame, words: int, depth: int, split: Split) -> DataFrame:
    """The phrases of so many words that may be frequent: their word ids and counts, the shard's own record
    of them, and the hashes of the phrases one word longer."""
    def grow(place: pa.Table, given: pa.Table) -> pa.Table:
        if not place.num_rows or not given.num_rows:
            return _SENT.empty_table()
        shard, word_ids = place["shard"][0].as_py(), unpacked_long(place["word_ids"][0])
        sides = {True: unpacked(place["right"][0]), False: unpacked(place["left"][0])}
        counts = unpacked_long(place["counts"][0]).astype(np.int64)
        shorter, hashes = Phrases.single(counts), []
        for which, data in zip(given["range"].to_pylist(), given["data"], strict=True):
            if which is None:
                shorter = Phrases.unpack(data, words - 1, counts)
            else:
                hashes.append(unpacked_hashes(data))
        if not hashes:
            return _SENT.empty_table()
        now = shorter.longer(sides[_right(words)], _right(words))
        now = now.only(np.isin(now.hashes(word_ids, split.bits), np.concatenate(hashes)))
        out = _ranges(shard, now, word_ids, split, words)
        if words < depth:
            out.append((shard, None, None, now.pack(), None))
            out += _ranges(shard, now.longer(sides[_right(words + 1)], _right(words + 1)), word_ids, split)
        return _sent(out)

    given = alive.select("shard", "range", "data")
    if known is not None:
        given = given.unionByName(known.where("range IS NULL").select("shard", "range", "data"))
    return indexes.select("shard", "left", "right", "counts", "word_ids").groupBy("shard").cogroup(
        given.withColumnRenamed("shard", "of").groupBy("of")).applyInArrow(grow, SENT)


def frequent(known: DataFrame, least: int) -> DataFrame:
    """(of, words, phrase, a): each phrase with its exact count over all shards, if that is enough, and
    the first of its shards. known: rows that hold word ids."""
    schema = pa.schema([("of", pa.int64()), ("words", pa.int32()), ("phrase", pa.binary()), ("a", pa.int64())])

    def add(rows: pa.Table) -> pa.Table:
        words, rows = rows["words"][0].as_py(), rows.sort_by("shard")
        ids = [unpacked_long(cell).reshape(-1, words) for cell in rows["data"]]
        shard = np.repeat(rows["shard"].to_numpy(), [len(x) for x in ids])
        ids, counts = np.concatenate(ids), np.concatenate([unpacked(cell) for cell in rows["counts"]])
        by = np.lexsort(ids.T)
        ids, shard, counts = ids[by], shard[by], counts[by]
        start = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        total = np.add.reduceat(counts, start)
        enough = total >= least
        start, total = start[enough], total[enough]
        return pa.Table.from_arrays([pa.array(shard[start]), pa.array(np.full(len(start), words), pa.int32()),
                                     _binary(ids[start]), pa.array(total)], schema=schema)

    return known.groupBy("words", "range").applyInArrow(add, "of long, words int, phrase binary, a long")


SPELT = "lang string, words array<string>, a long, first long, last long"


def spelt(indexes: DataFrame, phrases: DataFrame) -> DataFrame:
    """The phrases' languages, words and counts, and the counts of their first and last words; each from
    one shard that holds it."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())),
                        *[(c, pa.int64()) for c in ("a", "first", "last")]])

    def spell(place: pa.Table, given: pa.Table) -> pa.Table:
        if not place.num_rows or not given.num_rows:
            return schema.empty_table()
        word_ids, totals = (unpacked_long(place[c][0]).astype(np.int64) for c in ("word_ids", "totals"))
        names, by = unpacked_names(place["names"][0]), np.argsort(word_ids)
        places = [np.searchsorted(word_ids, np.frombuffer(cell, ">i8"), sorter=by) for cell in given["phrase"].to_pylist()]
        found, numbers = [[x.as_py().split(END) for x in names.take(pa.array(n))] for n in places], [by[n] for n in places]
        return pa.Table.from_arrays(
            [pa.array([words[0][0].decode() for words in found], pa.string()),
             pa.array([[word.decode() for _, word in words] for words in found], schema.field("words").type),
             pa.array(given["a"].to_numpy()), pa.array(totals[[n[0] for n in numbers]]),
             pa.array(totals[[n[-1] for n in numbers]])], schema=schema)

    return indexes.select("shard", "word_ids", "totals", "names").groupBy("shard").cogroup(phrases.groupBy("of")).applyInArrow(spell, SPELT)


def cut(phrases: DataFrame) -> DataFrame:
    """Each phrase once for each of its cuts after k words: lang, phrase, size, a, k, left, right, l, r.

    The counts of single words came with the phrases; longer parts are phrases themselves.
    """
    size, k = F.size("words"), F.col("k")
    rows = phrases.select("lang", F.array_join("words", " ").alias("phrase"), size.alias("size"), "a", "words", "first", "last",
                          F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    rows = rows.select("lang", "phrase", "size", "a", "k",
                       F.when(k > 1, F.array_join(F.slice("words", F.lit(1), k), " ")).alias("left"),
                       F.when(k < F.col("size") - 1, F.array_join(F.slice("words", k + 1, F.col("size")), " ")).alias("right"),
                       F.when(k == 1, F.col("first")).alias("l"), F.when(k == F.col("size") - 1, F.col("last")).alias("r"))
    short, long = rows.where("size = 2"), rows.where("size > 2")
    counts = phrases.select("lang", F.array_join("words", " ").alias("part"), F.col("a").alias("f"))
    for part, count in (("left", "l"), ("right", "r")):
        known = counts.withColumnsRenamed({"part": part, "f": f"_{count}"})
        long = long.join(known, ["lang", part], "left").withColumn(count, F.coalesce(count, f"_{count}")).drop(f"_{count}")
    return short.unionByName(long)


def mine(docs: DataFrame, least: int = 100, top: int = 2000, depth: int = DEPTH, lang: str = "lang",
         text: str = "text", size: int = SHARD_WORDS) -> DataFrame:
    """The best `top` phrases of two to `depth` words of each language: lang, rank, phrase, a (its count), l and
    r (counts of the two parts of its weakest cut), n (words of the language), score (1000 a n / (l r), floored).

    A phrase inside a longer one with the same count is left out.
    """
    parts = settle_by(shards(docs, lang, text, size), "shard")
    split = Split.of(parts.agg(F.sum("n")).first()[0] or 0)
    languages = settle(parts.select(F.explode(F.map_from_arrays("langs", "sizes")).alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n")))
    indexes = settle_by(index(parts, vocabulary(parts, least, split.ranges), depth, split.ranges), "shard")
    unsettle(parts)
    sent, found = None, []
    for n in range(2, depth + 1):
        last, sent = sent, settle(grown(indexes, sent, reached(pairs(indexes, split) if sent is None else sent, least), n, depth, split))
        found.append(settle(frequent(sent.where("words IS NOT NULL"), least)))
        if last is not None:
            unsettle(last)
    phrases = settle(spelt(indexes, reduce(DataFrame.unionByName, found)))
    for done in (indexes, sent, *found):
        unsettle(done)
    cuts = settle(cut(phrases))
    edge = F.col("size") > 2
    inner = cuts.where(edge & (F.col("k") == F.col("size") - 1) & (F.col("l") == F.col("a"))).select("lang", F.col("left").alias("phrase")) \
        .unionByName(cuts.where(edge & (F.col("k") == 1) & (F.col("r") == F.col("a"))).select("lang", F.col("right").alias("phrase")))
    score = F.expr("""(CAST(a AS decimal(19,0)) * CAST(n AS decimal(19,0)) * 1000BD)
        div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))""")
    scored = cuts.join(inner, ["lang", "phrase"], "left_anti").join(languages, "lang") \
        .groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("c")) \
        .select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = scored.withColumn("_place", F.row_number().over(W.partitionBy("lang", part).orderBy(*best))) \
        .where(F.col("_place") <= top)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")) \
        .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
