"""Language-model scoring with word classes (Brown): P(text) = prod P(class | class before) P(word | class).

1. Texts become chunk rows: tokens as indexes into the chunk's own words, known by 64-bit
   hash, with their training counts. Chunks are settled, so later steps read the same ones.
2. Counts of all words meet by a shuffle of (word, chunk) rows, one per word and chunk, not
   per token; hot words have as many rows as there are chunks. Counts go back the same way.
3. Words with at least a fixed share of the training tokens are units of their own, which
   bounds their number by the inverse of the share at every size; rarer words
   are tied to one unit for each power of two of their count, unseen ones to the lowest.
4. Exchange clustering: units start in the class of the frequent unit that they stand next
   to most; in each round the gain in likelihood of every move of every unit is worked
   out from its counts next to the classes, and half of the units (by hash) take
   their best move.
5. Scores: transitions are smoothed with the frequencies of the classes, words within
   their class by adding one to each count, an unseen word included.

A null text is empty and has the end token alone. Repeated rows count as often as they
occur. Without training rows all probabilities come from the smoothing. Score and
base are sums over all tokens of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import chunks, remainder, settle, texts

CLASSES, ROUNDS, SHARE = 48, 5, 1e-5
#: Weight of the classes' own frequencies in the transitions.
BACKOFF = 8.0
#: Text of a chunk.
CHUNK = 8 << 20
#: The end token, which no word can be, and its hash as a signed number.
END = b"\n"
END_HASH = int(np.array([xxhash.xxh3_64_intdigest(END)], np.uint64).view(np.int64)[0])


def tokens_of(text: str) -> list[bytes]:
    """Words of a text in ASCII lower case, then the end token."""
    return [*text.encode().lower().split(), END]


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type
                                       else pa.array(c, f.type) for f in schema], schema=schema)


def packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.tobytes(), 1)


def unpacked(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def encoded(docs: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """Chunk rows: chunk, ids, train (by document), trained (tokens to learn from), starts, tokens, words, counts
    (packed numbers; counts are those of the chunk's words in texts to learn from)."""
    schema = (f"chunk long, ids array<{docs.schema[key].dataType.simpleString()}>, train array<boolean>, trained long, "
              "starts binary, tokens binary, words binary, counts binary")
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for part in chunks(batches, "text", CHUNK):
            lists = [tokens_of(t) for t in texts(part)]
            starts = np.cumsum([0, *map(len, lists)])
            coded = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
            tokens = coded.indices.to_numpy().astype(np.int32)
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            used = np.repeat(part.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(starts))
            counts = np.bincount(tokens[used], minlength=len(words)).astype(np.int32)
            yield _batch(arrow, chunk=[number], ids=[part.column("id").to_pylist()], train=[part.column("train").to_pylist()],
                         trained=[int(used.sum())], starts=[packed(starts.astype(np.int64))], tokens=[packed(tokens)],
                         words=[words.tobytes()], counts=[packed(counts)])
            number += 1

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"), train.alias("train")).mapInArrow(run, schema)


#: Rows that a task counts at once.
HELD = 400_000
#: Of one chunk and some of its words: at (their indexes there), c (their counts over all chunks), and word and word_at
#: of the frequent ones. Rows of no chunk (-1) tell about words: word and c of frequent ones, and by power of two the
#: words and tokens of the others.
COUNTED = "chunk long, at binary, c binary, word binary, word_at binary, words array<long>, tokens array<long>"


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """Counts of words over all chunks, packed by chunk. least: the count from which a word is frequent."""
    single, arrow = _arrow("word long, chunk long, place long"), _arrow(COUNTED)

    def words(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for chunk, names, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts")), strict=True):
                names, counts = np.frombuffer(names, np.int64), unpacked(counts, np.int32)
                place = np.arange(len(names)) << 32 | counts
                for lo in range(0, len(names), 1 << 16):
                    w = names[lo:lo + (1 << 16)]
                    yield _batch(single, word=w, chunk=np.full(len(w), chunk), place=place[lo:lo + (1 << 16)])

    def summed(word: np.ndarray, chunk: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """All rows of some words, sorted by word."""
        at, n = (place >> 32).astype(np.int32), place & 0xFFFFFFFF
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        total = np.add.reduceat(n, first)
        c = np.repeat(total, np.diff(np.r_[first, len(word)]))
        own = (c >= least) | (word == END_HASH)
        out = {f.name: [] for f in arrow}

        def add(**values):
            for name in out:
                out[name].append(values.get(name))

        order = np.argsort(chunk, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
            mark = some[own[some]]
            add(chunk=int(chunk[some[0]]), at=packed(at[some]), c=packed(c[some]), word=packed(word[mark]), word_at=packed(at[mark]))
        apart = own[first]
        tied = total[~apart & (total > 0)]
        band = np.floor(np.log2(tied)).astype(int)
        add(chunk=-1, word=packed(word[first][apart]), c=packed(total[apart]), words=np.bincount(band, minlength=64).tolist(),
            tokens=np.bincount(band, tied, minlength=64).astype(np.int64).tolist())
        return _batch(arrow, **out)

    def meet(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            # The rows of a word stay together: only words before the last one can be counted yet.
            if n >= HELD and held[0].column("word")[0] != held[-1].column("word")[-1]:
                word, chunk, place = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in ("word", "chunk", "place"))
                cut = int(np.searchsorted(word, word[-1]))
                yield summed(word[:cut], chunk[:cut], place[:cut])
                held = [pa.RecordBatch.from_arrays([pa.array(x[cut:]) for x in (word, chunk, place)], ["word", "chunk", "place"])]
                n = len(word) - cut
        if n:
            yield summed(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in ("word", "chunk", "place")))

    return rows.select("chunk", "words", "counts").mapInArrow(words, "word long, chunk long, place long") \
        .repartition("word").sortWithinPartitions("word").mapInArrow(meet, COUNTED)


#: Documents of a chunk with the units of their tokens.
UNITS = "starts binary, units binary, known array<long>, logs array<double>"


def with_units(rows: DataFrame, counted: DataFrame, ids: str, names: np.ndarray, bands: int) -> DataFrame:
    """Chunks with units for words. names: the frequent words, whose units follow the bands."""
    held = rows.sparkSession.sparkContext.broadcast((np.sort(names), (np.argsort(names) + bands).astype(np.int32)))

    def run(chunk: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = {"ids": [], "train": [], "starts": [], "units": [], "known": [], "logs": []}
        sorted_names, units_of = held.value
        for r in chunk.itertuples():
            sizes = [unpacked(x, np.int32) for x in words["at"]]
            c = np.zeros(sum(map(len, sizes)), np.int64)
            unit = np.zeros(len(c), np.int32)
            for at, w in zip(sizes, words.itertuples(), strict=True):
                c[at] = unpacked(w.c, np.int64)
                unit[at] = np.minimum(np.floor(np.log2(np.maximum(c[at], 1))), bands - 1)
                unit[unpacked(w.word_at, np.int32)] = units_of[np.searchsorted(sorted_names, unpacked(w.word, np.int64))]
            tokens, starts = unpacked(r.tokens, np.int32), unpacked(r.starts, np.int64)
            out["ids"].append(r.ids)
            out["train"].append(r.train)
            out["starts"].append(r.starts)
            out["units"].append(packed(unit[tokens]))
            out["known"].append(np.add.reduceat((c > 0)[tokens].astype(np.int64), starts[:-1]).tolist())
            out["logs"].append(np.add.reduceat(np.log10(c + 1)[tokens], starts[:-1]).tolist())
        return pd.DataFrame(out)

    return rows.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInPandas(
        run, f"ids {ids}, train array<boolean>, {UNITS}")


def before(units: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The unit before each token; the end token's before the first of a text."""
    out = np.empty_like(units)
    out[1:] = units[:-1]
    out[starts[:-1]] = end
    return out


def bigrams(rows: DataFrame, end: int, total: int) -> DataFrame:
    """pair, n: how often unit b follows unit a in the training texts, with pair = a * total + b."""
    arrow = _arrow("pair long, n long")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for starts, units, train in zip(*(batch.column(c).to_pylist() for c in ("starts", "units", "train")), strict=True):
                starts, units = unpacked(starts, np.int64), unpacked(units, np.int32)
                used = np.repeat(np.array(train, bool), np.diff(starts))
                pairs, n = np.unique(before(units, starts, end)[used].astype(np.int64) * total + units[used], return_counts=True)
                for lo in range(0, len(pairs), 1 << 16):
                    yield _batch(arrow, pair=pairs[lo:lo + (1 << 16)], n=n[lo:lo + (1 << 16)].astype(np.int64))

    return rows.select("starts", "units", "train").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _ends(batch: pa.RecordBatch, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair = batch.column("pair").to_numpy()
    return pair // total, pair % total, batch.column("n").to_numpy()


def xlogx(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)
    return x * np.log(np.where(x > 0, x, 1))


def best_moves(matrix: np.ndarray, now: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The class of each unit that makes the likelihood largest, the others held fixed.

    matrix: counts of class pairs; now: classes of the units; right and left: how often a
    class follows and precedes each unit. The cell of a class with itself is taken as if its
    two changes were apart.
    """
    out = np.empty(len(now), np.int64)
    for lo in range(0, len(now), 128):
        a, r, s = now[lo:lo + 128], right[lo:lo + 128], left[lo:lo + 128]
        i = np.arange(len(a))
        m = np.repeat(matrix[None], len(a), 0)
        m[i, a, :] -= r
        m[i, :, a] -= s
        m = np.maximum(m, 0)
        rows, columns, n, p = m.sum(2), m.sum(1), r.sum(1)[:, None], s.sum(1)[:, None]
        own = xlogx(m)
        gain = (xlogx(m + r[:, None, :]) - own).sum(2) + (xlogx(m + s[:, :, None]) - own).sum(1) \
            - (xlogx(rows + n) - xlogx(rows)) - (xlogx(columns + p) - xlogx(columns))
        best = gain.argmax(1)
        out[lo:lo + 128] = np.where(gain[i, best] > gain[i, a] + 1e-9, best, a)
    return out


def neighbours(pairs: DataFrame, classes, k: int) -> DataFrame:
    """unit, cells: how often each class follows it (cell = class) and precedes it (cell = k + class)."""
    arrow = _arrow("unit int, cell int, n long")

    def run(batches: Iterator[pa.RecordBatch]):
        of = classes.value
        for batch in batches:
            a, b, n = _ends(batch, len(of))
            keys = np.concatenate((a * 2 * k + of[b], b * 2 * k + k + of[a]))
            ok = np.concatenate((of[b] >= 0, of[a] >= 0))
            keys, at = np.unique(keys[ok], return_inverse=True)
            sums = np.bincount(at, np.concatenate((n, n))[ok], len(keys)).astype(np.int64)
            if len(keys):
                yield _batch(arrow, unit=(keys // (2 * k)).astype(np.int32), cell=(keys % (2 * k)).astype(np.int32), n=sums)

    return pairs.mapInArrow(run, "unit int, cell int, n long").groupBy("unit", "cell").agg(F.sum("n").alias("n")) \
        .groupBy("unit").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))     # 2 k cells at most


def _chosen(cells: DataFrame, choose) -> tuple[np.ndarray, np.ndarray]:
    """Units and what `choose(units, counts)` gives for them; a row a unit, so bounded like the units."""
    arrow = _arrow("unit int, choice int")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("cells")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            cell, n = flat.field("cell").to_numpy(), flat.field("n").to_numpy()
            units = batch.column("unit").to_numpy()
            yield _batch(arrow, unit=units, choice=choose(
                units, np.repeat(np.arange(len(units)), sizes), cell, n).astype(np.int32))

    rows = cells.mapInArrow(run, "unit int, choice int").toPandas()
    return rows["unit"].to_numpy(), rows["choice"].to_numpy()


def class_pairs(pairs: DataFrame, classes, k: int) -> np.ndarray:
    """How often class b follows class a; k x k numbers."""
    arrow = _arrow("cell int, n long")

    def run(batches: Iterator[pa.RecordBatch]):
        of, sums = classes.value, np.zeros(k * k)
        for batch in batches:
            a, b, n = _ends(batch, len(of))
            sums += np.bincount(of[a] * k + of[b], n, k * k)
        at = np.flatnonzero(sums)
        if len(at):
            yield _batch(arrow, cell=at.astype(np.int32), n=sums[at].astype(np.int64))

    rows = pairs.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(k * k)
    out[rows["cell"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out.reshape(k, k)


def exchange(pairs: DataFrame, sizes: np.ndarray, k: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit. sizes: training count of each unit."""
    sc, total = pairs.sparkSession.sparkContext, len(sizes)
    seeds = np.argsort(-sizes, kind="stable")[:k]
    classes = np.full(total, -1, np.int64)
    classes[seeds] = np.arange(len(seeds))
    weight = 1 / np.power(np.maximum(sizes[seeds], 1), 0.75)

    def start(units, owner, cell, n):
        counts = np.zeros((len(units), k))
        np.add.at(counts, (owner, cell % k), n)
        counts[:, :len(weight)] *= weight
        return counts.argmax(1)

    units, choice = _chosen(neighbours(pairs, sc.broadcast(classes), k), start)
    first = np.arange(total) % k
    first[units] = choice
    classes = np.where(classes >= 0, classes, first)
    parity = np.array([xxhash.xxh32_intdigest(i.to_bytes(4, "little")) & 1 for i in range(total)])
    for turn in range(rounds):
        held = sc.broadcast(classes)
        matrix = class_pairs(pairs, held, k)

        def move(units, owner, cell, n, held=held, matrix=matrix):
            counts = np.zeros((len(units), 2 * k))
            counts[owner, cell] = n
            return best_moves(matrix, held.value[units], counts[:, :k], counts[:, k:])

        units, choice = _chosen(neighbours(pairs, held, k), move)
        moving = parity[units] == turn % 2
        classes = classes.copy()
        classes[units[moving]] = choice[moving]
    return classes


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", k: int = CLASSES,
          rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """key, trained, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    train: which rows to learn from, as a condition on docs."""
    kind = f"array<{docs.schema[key].dataType.simpleString()}>"
    spark = docs.sparkSession
    rows = settle(encoded(docs, key, text, F.coalesce(train, F.lit(False))))
    n = rows.agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]
    least = max(2, math.ceil(share * n))
    bands = max(least - 1, 1).bit_length()
    counted = settle(word_counts(rows, least))
    # Words with a fixed share of the tokens, at most 1 / share of them, and the end token; a few numbers of the others.
    told = counted.where("chunk < 0").select("word", "c", "words", "tokens").toPandas()
    names = np.concatenate([unpacked(x, np.int64) for x in told["word"]] or [np.zeros(0, np.int64)])
    counts = np.concatenate([unpacked(x, np.int64) for x in told["c"]] or [np.zeros(0, np.int64)])
    order = np.lexsort((names, -counts))
    names, counts = names[order], counts[order]
    total = bands + len(names)
    sizes, words = np.zeros(total), np.ones(total)
    for out, column in ((sizes, "tokens"), (words, "words")):
        out[:bands] = np.sum([x[:bands] for x in told[column]], axis=0) if len(told) else 0
    sizes[bands:] = counts
    v = int(words[:bands].sum() + (counts > 0).sum())
    end = bands + int(np.flatnonzero(names == END_HASH)[0]) if END_HASH in names else 0
    rows = settle(with_units(rows.drop("words", "counts", "trained"), counted.where("chunk >= 0"), kind, names, bands))
    pairs = settle(bigrams(rows, end, total))
    classes = exchange(pairs, sizes, k, rounds)

    matrix = class_pairs(pairs, spark.sparkContext.broadcast(classes), k)
    of_class, kinds = np.bincount(classes, sizes, k), np.bincount(classes, words, k)
    share_of = (of_class + 1) / (of_class.sum() + k)
    steps = np.log10((matrix + BACKOFF * share_of) / (matrix.sum(1, keepdims=True) + BACKOFF))
    # A class gives each of its words its count plus one; the lowest band's has the unseen word besides.
    kinds[classes[0]] += 1
    steps -= np.log10(np.maximum(of_class + kinds, 1))[None, :]
    held = spark.sparkContext.broadcast((classes, steps))
    base = math.log10(n + v + 1)
    schema = f"id {docs.schema[key].dataType.simpleString()}, trained boolean, n_tokens long, n_known long, base_score double, score double"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        of, table = held.value
        for batch in batches:
            for ids, trained, starts, units, known, logs in zip(*(batch.column(c).to_pylist() for c in (
                    "ids", "train", "starts", "units", "known", "logs")), strict=True):
                starts, units, logs = unpacked(starts, np.int64), unpacked(units, np.int32), np.array(logs)
                here = of[units]
                each = table[of[before(units, starts, end)], here]
                length = np.diff(starts)
                yield _batch(arrow, id=ids, trained=trained, n_tokens=length, n_known=known, base_score=logs - length * base,
                             score=logs + np.add.reduceat(each, starts[:-1]))

    return rows.mapInArrow(run, schema).select(
        F.col("id").alias(key), "trained", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        "base_score", "score")


def held_out(key: str = "doc_id") -> Column:
    return remainder(key, 7) == 2
