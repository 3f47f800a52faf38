"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score(x) = sigmoid(b + sum_i w_i x_i + sum_(i<j) <v_i, v_j> x_i x_j), where the pairwise part is
computed in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).

Features: every distinct lower-case word hashed to a bucket, with a damped count scaled by
the text's length; bins of structure statistics of the whole text (lengths, shares of
symbols, capitals, marks, digits, repeated words and lines); and bins of the metadata
columns asked for (n_chars by default). Labels, ids, languages and sources are none.

The model is fitted on a bounded sample: of the labelled rows in use, the `sample` rows with
the smallest hash of the id (all of them, if there are no more). It has a fixed size
(buckets x (rank + 1) floats), which bounds the broadcast. Every text is scored whole.

Null and empty texts have structure features only and get a score like others. Without
labels the score is 0.5; labels that are null are not used, of several labels of an id
the largest counts, and of repeated ids one row is learnt from.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import long_rows, remainder, spare_name

BUCKETS, RANK = 1 << 16, 8
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
EPOCHS, RATE, DECAY, BATCH = 4, 0.08, 1e-5, 64
#: Steps of the fit at least: a small sample is gone through more often.
STEPS = 600
#: Words whose buckets a worker remembers. Memory only, never results.
REMEMBERED = 100_000

#: Bytes that are counted for the structure statistics.
CLASSES = (b"#*$%&|<>", bytes(range(65, 91)), b"!?", b".,;:", b"0123456789", b"()[]{}\"'/\\=_+-@")
_known: dict[bytes, int] = {}


def bucket(word: bytes) -> int:
    if len(_known) > REMEMBERED:
        _known.clear()
    b = _known[word] = zlib.crc32(word) % BUCKETS
    return b


def binned(name: str, value: float, step: float) -> int:
    return zlib.crc32(f"\x00{name}:{math.floor(value / step)}".encode()) % BUCKETS


def features(text: str | None, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a row."""
    raw = (text or "").encode()
    words = raw.lower().split()
    n, size = len(words), max(len(raw), 1)
    counts = Counter(words)
    find, at = _known.get, []
    for w in counts:
        b = find(w)
        at.append(bucket(w) if b is None else b)
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(values):
        values *= 3 / math.sqrt(float(values @ values))
    lines = [x for x in raw.split(b"\n") if x]
    bins = [binned("words", math.log2(n + 1), 1), binned("length", len(raw) / max(n, 1), 0.5),
            binned("distinct", len(counts) / max(n, 1), 0.05),
            binned("top", max(counts.values(), default=0) / max(n, 1), 0.05),
            binned("lines", math.log2(len(lines) + 1), 1),
            binned("same", 1 - len(set(lines)) / max(len(lines), 1), 0.1)]
    for i, some in enumerate(CLASSES):
        bins.append(binned(f"class{i}", math.sqrt((len(raw) - len(raw.translate(None, some))) / size), 0.04))
    for i, value in enumerate(metadata):
        missing = value is None or value != value
        bins.append(binned(f"none{i}", 0, 1) if missing else binned(f"meta{i}", math.log2(1 + max(float(value), 0)), 1))
    return (np.array(at + bins, np.int32),
            np.concatenate((values, np.full(len(bins), 0.6, np.float32))).astype(np.float32))


@dataclass
class Model:
    bias: float
    linear: np.ndarray      # buckets
    factors: np.ndarray     # buckets x rank

    def scores(self, rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        rows = list(rows)
        if not rows:
            return np.zeros(0)
        out = []
        for lo in range(0, len(rows), 256):
            some = rows[lo:lo + 256]
            at, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            starts = np.cumsum([0, *(len(r[0]) for r in some[:-1])])
            out.append(self.raw(at, x, starts)[0])
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30)))

    def raw(self, at, x, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factors[at] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.linear[at] * x, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1), sums, vx


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Adaptive gradient steps on the logistic loss, over shuffled small batches."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(BUCKETS, np.float32), rng.normal(0, 0.03, (BUCKETS, RANK)).astype(np.float32))
    if not len(rows):
        model.factors[:] = 0
        return model
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    model.bias = math.log(share / (1 - share))
    g_linear, g_factors, g_bias = np.full(BUCKETS, 1e-2, np.float32), np.full((BUCKETS, RANK), 1e-2, np.float32), 1e-2
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            pick = order[lo:lo + BATCH]
            some = [rows[i] for i in pick]
            sizes = np.array([len(r[0]) for r in some])
            at, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            raw, sums, vx = model.raw(at, x, np.cumsum(sizes) - sizes)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]).astype(np.float32) / len(pick)
            each = np.repeat(slope, sizes) * x
            of_factors = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            used, where = np.unique(at, return_inverse=True)
            d_linear = np.bincount(where, each, len(used)) + DECAY * model.linear[used]
            d_factors = np.stack([np.bincount(where, of_factors[:, f], len(used)) for f in range(RANK)], 1) \
                + DECAY * model.factors[used]
            g_linear[used] += d_linear ** 2
            g_factors[used] += d_factors ** 2
            g_bias += slope.sum() ** 2
            model.linear[used] -= RATE * d_linear / np.sqrt(g_linear[used])
            model.factors[used] -= RATE * d_factors / np.sqrt(g_factors[used])
            model.bias -= RATE * float(slope.sum()) / math.sqrt(g_bias)
    return model


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, metadata: tuple[str, ...] = ("n_chars",),
          sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model. use: a condition on the key of labels; the other rows are not learnt from."""
    long_rows(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    if use is not None:
        chosen = chosen.where(use)
    # At most `sample` rows, so broadcasting them is bounded.
    chosen = chosen.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("_label")) \
        .orderBy(F.xxhash64("_key"), "_key").limit(sample)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"),
                       *(F.col(m).cast("double").alias(f"_m{i}") for i, m in enumerate(metadata))) \
        .join(F.broadcast(chosen), "_key")

    @F.pandas_udf("struct<at: binary, x: binary>")
    def packed(text: pd.Series, *meta: pd.Series) -> pd.DataFrame:
        found = [features(t, m) for t, *m in zip(text, *meta, strict=True)]
        return pd.DataFrame({"at": [a.tobytes() for a, _ in found], "x": [x.tobytes() for _, x in found]})

    rows = rows.select("_key", "_label", packed("_text", *(f"_m{i}" for i in range(len(metadata)))).alias("_f"))
    found = rows.groupBy("_key").agg(F.max("_label").alias("label"), F.min("_f").alias("f")) \
        .orderBy(F.xxhash64("_key"), "_key").limit(sample).select("label", "f.at", "f.x").toPandas()
    vectors = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for a, x in zip(found["at"], found["x"], strict=True)]
    return fit(vectors, found["label"].to_numpy(float))


def scorer(docs: DataFrame, model: Model, metadata: tuple[str, ...] = ("n_chars",), text: str = "text") -> Column:
    """The score of each row as a column of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series, *meta: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(features(t, tuple(m)) for t, *m in zip(text, *meta, strict=True)), dtype=float)

    return score(F.col(text), *(F.col(m).cast("double") for m in metadata))


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learnt from."""
    return remainder(key, 3) == 1


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every row."""
    metadata = ("n_chars",) if "n_chars" in docs.columns else ()
    model = train(docs, labels, ~held_out(key), metadata, key=key, text=text)
    return docs.select(F.col(key), held_out(key).alias("held_out"), scorer(docs, model, metadata, text).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs predicted to be of quality, with the same columns."""
    metadata = ("n_chars",) if "n_chars" in docs.columns else ()
    model = train(docs, labels, ~held_out(key), metadata, key=key, text=text)
    score = spare_name(docs, "_score")
    return docs.withColumn(score, scorer(docs, model, metadata, text)).where(F.col(score) >= 0.5) \
        .select(*(docs[c] for c in docs.columns))
