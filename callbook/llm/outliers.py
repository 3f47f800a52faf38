"""Quality rules: plain limits, then robust multivariate outliers for each language and source.

Every text gives counts (words, characters, symbols, repeated lines, repeated 5-word
windows) and a vector of transformed shares. Texts that pass the plain limits go into a
minimum-covariance-determinant estimate of their language and source: starting from
medians and median deviations, each concentration step keeps the part of the group with
the smallest Mahalanobis distances and takes mean and covariance from it. A text whose
distance to the final estimate is beyond the chi-square limit is rejected.

A group is never gathered: a step counts and sums by distance bin (group x bin, partly
summed before the shuffle), and what is worked out for a group are a few hundred bins,
however many rows it has. Estimates are a table; Spark broadcasts it if it is small.

A null or empty text has no words, so it fails the plain limits. Null languages or
sources are groups like others. Rows that repeat are judged alike. A variance is never
taken below a floor, so groups that are small or constant reject only what is far off.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import long_rows, settle, spare_name

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Share of a group that an estimate rests on, and concentration steps.
SUPPORT, STEPS = 0.75, 4
#: Share of normal rows that the limit keeps.
CONFIDENCE = 0.999999
#: The vector, and the least standard deviation of each part.
PARTS = ("length", "symbols", "capitals", "marks", "lines", "repeats")
FLOORS = (0.08, 0.08, 0.06, 0.06, 0.12, 0.12)
#: Distances are binned by their logarithm; a power of two has so many bins.
BINS, TOP_BIN = 8, 399
GRID = 256

#: The bytes that are counted.
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
CAPITALS, MARKS = bytes(range(65, 91)), b"!?.,;:@=^~_+/\\()[]{}\"'`-"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{p} double" for p in PARTS)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    mix = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + (h[i:n - width + 1 + i] ^ (h[i:n - width + 1 + i] >> np.uint64(29)))
    order = np.argsort(mix, kind="stable")
    same = mix[order[1:]] == mix[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    twice = np.zeros(len(mix), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str | None) -> tuple:
    """The counts of a text and its vector."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(PARTS)
    count = lambda some: len(raw) - len(raw.translate(None, some))
    chars, symbols = len(text) - count(SPACES), count(SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    repeated, again = repeated_words(words), len(lines) - len(set(lines))
    return (n, chars, symbols, again, repeated, math.log(chars / n), math.sqrt(symbols / n),
            math.sqrt(count(CAPITALS) / chars), math.sqrt(count(MARKS) / chars),
            math.sqrt(again / len(lines)), math.sqrt(repeated / n))


def stats_of(text: Column) -> Column:
    """Counts and vector of a text column, as a struct."""
    @F.pandas_udf(STATS)
    def stats(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(x) for x in text], columns=[*COUNTS, *PARTS])

    # It is deterministic; said not to be, it runs once and not once for each filter that uses it.
    return stats.asNondeterministic()(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def chi_square(p: float, k: float) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    from statistics import NormalDist
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * k))) ** 3


def chi_square_share(x: float, k: float) -> float:
    from statistics import NormalDist
    return NormalDist().cdf(((x / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k)))


K = len(PARTS)
PAIRS = [(i, j) for i in range(K) for j in range(i, K)]
ESTIMATE = "_group string, rows long, " + ", ".join(f"m{i} double" for i in range(K)) + ", " \
    + ", ".join(f"w{i}_{j} double" for i, j in PAIRS)


def group_key(*columns: Column) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns))


def distance(parts: list[Column], prefix: str = "") -> Column:
    """Squared Mahalanobis distance to the joined estimate."""
    off = [x - F.col(f"{prefix}m{i}") for i, x in enumerate(parts)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1 if i == j else 2) * F.col(f"{prefix}w{i}_{j}") * off[i] * off[j]
    return F.greatest(total, F.lit(0.0))


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and median deviations, on a grid so that a group's state is bounded."""
    grid = [F.round(F.col(p) * GRID) / GRID for p in PARTS]
    mid = settle(vectors.groupBy("_group").agg(F.count("*").alias("rows"), *(
        F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(grid))))
    off = vectors.join(mid, "_group").groupBy("_group").agg(*(
        F.percentile(F.round(F.abs(F.col(p) - F.col(f"m{i}")) * GRID) / GRID, F.lit(0.5)).alias(f"s{i}")
        for i, p in enumerate(PARTS)))
    return settle(mid.join(off, "_group").select(
        "_group", "rows", *(f"m{i}" for i in range(K)),
        *((1 / ((1.4826 * F.col(f"s{i}")) ** 2 + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"w{i}_{j}")
          for i, j in PAIRS)))


def _estimate(bins: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of one group from the sums of its distance bins."""
    bins = bins.sort_values("_bin")
    counts = bins["n"].to_numpy(float)
    rows = counts.sum()
    last = int(np.searchsorted(np.cumsum(counts), SUPPORT * rows))
    used = bins.iloc[:last + 1]
    n = used["n"].sum()
    mean = np.array([used[f"a{i}"].sum() / n for i in range(K)])
    cov = np.zeros((K, K))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = used[f"b{i}_{j}"].sum() / n - mean[i] * mean[j]
    share = min(n / rows, 1.0)
    if share < 1:       # what is left of a normal distribution is narrower than the whole
        cov *= share / max(chi_square_share(chi_square(share, K), K + 2), 1e-6)
    # Values around the mean of a group are known to no more than the grid's rounding.
    inverse = np.linalg.inv(cov + np.diag(np.square(FLOORS)))
    return pd.DataFrame([[bins["_group"].iloc[0], int(rows), *mean, *(inverse[i, j] for i, j in PAIRS)]],
                        columns=["_group", "rows", *(f"m{i}" for i in range(K)), *(f"w{i}_{j}" for i, j in PAIRS)])


def estimate(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row per group: mean and inverse covariance. vectors: _group and the parts; settled."""
    found = _start(vectors)
    parts = [F.col(p) for p in PARTS]
    for _ in range(steps):
        bin_of = F.least(F.floor(BINS * F.log2(1 + 64 * distance(parts))), F.lit(TOP_BIN)).cast("int")
        # One key for group and bin: else Spark shuffles by the group alone, and a hot one meets in one task.
        sums = vectors.join(found.drop("rows"), "_group").withColumn("_bin", bin_of) \
            .groupBy(F.concat_ws("\x1e", F.col("_bin").cast("string"), "_group").alias("_cell")).agg(
                F.any_value("_group").alias("_group"), F.any_value("_bin").alias("_bin"), F.count("*").alias("n"), *(F.sum(x).alias(f"a{i}") for i, x in enumerate(parts)),
                *(F.sum(parts[i] * parts[j]).alias(f"b{i}_{j}") for i, j in PAIRS))
        found = settle(sums.groupBy("_group").applyInPandas(_estimate, ESTIMATE))
    return found


def limit(confidence: float = CONFIDENCE) -> float:
    return chi_square(confidence, K)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text",
          by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """key, the counts, the vector, base_failed, distance (null where base_failed) and kept, by row."""
    long_rows(docs.sparkSession)
    rows = settle(docs.select(F.col(key).alias("_key"), group_key(*(F.col(c) for c in by)).alias("_group"),
                              stats_of(F.col(text)).alias("_s")).select("_key", "_group", "_s.*")
                  .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))))
    found = estimate(rows.where(~F.col("base_failed")))
    far = F.when(~F.col("base_failed"), distance([F.col(p) for p in PARTS]))
    # Without an estimate every row of the group has failed the plain limits.
    return rows.join(found.drop("rows"), "_group", "left").select(
        F.col("_key").alias(key), *COUNTS, *PARTS, "base_failed", far.alias("distance"),
        F.coalesce(~F.col("base_failed") & (far <= limit()), F.lit(False)).alias("kept"))


def keep(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs that are kept, with the same columns.

    The vectors alone are settled for the estimates; a second pass over the texts judges
    each row next to its data, so that texts are not shuffled.
    """
    long_rows(docs.sparkSession)
    stats, group = spare_name(docs, "_stats"), spare_name(docs, "_group")
    measured = docs.withColumn(group, group_key(*(F.col(c) for c in by))).withColumn(stats, stats_of(F.col(text)))
    fine = ~base_failed(F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words"))
    found = estimate(settle(measured.where(fine).select(F.col(group).alias("_group"), f"{stats}.*")))
    named = spare_name(docs, "_estimate")
    found = found.select(F.col("_group").alias(group), F.struct(*found.columns[2:]).alias(named))
    far = distance([F.col(f"{stats}.{p}") for p in PARTS], f"{named}.")
    return measured.where(fine).join(found, group).where(far <= limit()).select(*(docs[c] for c in docs.columns))
