"""Exact quantiles and value statistics for groups of any size.

``median`` and ``percentile`` hold a group's values in one aggregation buffer,
which a group with a third of all rows would overflow. Here every value falls
into an order-preserving bin; partial aggregation reduces the rows to bins, the
running count over the bins locates the wanted ranks, and only the rows of the
bins that hold a wanted rank are looked at again: first in thousands of equal
slices between the bin's least and greatest value, then value by value in the one
slice that holds the rank. Bins and slices decide how much work that is, never
the result. So few values that one buffer may hold them all, which their number
tells, are aggregated at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.session import settle, settle_counted

#: Values, over all groups, that one aggregation buffer may hold (about 100 MB).
ONE_BUFFER = 2_000_000
_STEPS = 512        # bins per factor e
_ZOOM = 1e4         # values below 1/_ZOOM share the bins around zero
_SLICES = 4096      # parts of a bin that is looked into


def _bin(value: Column) -> Column:
    """Monotone bin of a double; about 0.2 % wide, near 20,000 bins up to 100,000."""
    size = F.least(F.abs(value), F.lit(1e300))
    return F.floor(F.signum(value) * F.log1p(size * _ZOOM) * _STEPS).cast("bigint")


def _slug(p: float) -> str:
    return "median" if p == 0.5 else f"p{p * 100:g}".replace(".", "_")


def value_stats(df: DataFrame, keys: list[str], value: str = "value",
                probs: tuple[float, ...] = (0.5,), few_keys: bool = False,
                stored: bool = False, one_buffer: int = ONE_BUFFER) -> DataFrame:
    """Per key: n, total, mean, positives, and one exact quantile column per prob.

    NULL values are ignored; a key without values has no row. Quantiles
    interpolate linearly. The columns are called ``median`` for 0.5 and ``p1``,
    ``p99`` and so on. ``few_keys`` states that the keys come from a closed
    list, so the handful of wanted bins may be broadcast.

    The rows are counted, then read up to three times, so keys and value are settled
    first unless ``df`` is ``stored``, a table scan or settled already. The second and
    third reading only happen when a wanted rank is still open. Up to ``one_buffer``
    values need one reading.
    """
    named = dict(zip((f"_g{i}" for i in range(len(keys))), keys))
    rows = df.filter(F.col(value).isNotNull()).select(
        *[F.col(key).alias(g) for g, key in named.items()],
        F.col(value).cast("double").alias("v"))
    if stored:
        count = rows.count()
    else:
        rows, count = settle_counted(rows)
    if count <= one_buffer:
        return _at_once(rows, named, probs)
    rows = rows.withColumn("bin", _bin(F.col("v")))
    keys = list(named)

    hist = rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"),
        F.count_if(F.col("v") > 0).alias("pos"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    whole = Window.partitionBy(*keys)
    placed = hist.select(
        "*", F.coalesce(F.sum("c").over(_before(keys, "bin")), F.lit(0)).alias("before"),
        F.sum("c").over(whole).alias("n"), F.sum("s").over(whole).alias("total"),
        F.sum("pos").over(whole).alias("positives"))
    marks = F.array(*[
        F.struct(F.lit(i).alias("prob"), F.lit(side).alias("side"),
                 rounding(F.lit(p) * (F.col("n") - 1)).cast("bigint").alias("rank"))
        for i, p in enumerate(probs)
        for side, rounding in ((0, F.floor), (1, F.ceil))])
    # One row per wanted rank: a small table that cuts the plan here.
    wanted = settle(_known(placed.select(*keys, "bin", "c", "lo", "hi", "before", "n", "total",
                                         "positives", F.inline(marks))))
    cells = [*keys, "prob", "side"]
    values = wanted.select(*cells, F.col("known").alias("at"), "n", "positives", "total")
    for found in _look_inside(rows, wanted.filter(F.col("known").isNull()), keys, few_keys):
        values = values.unionByName(
            found.select(*cells, F.col("known").alias("at")), allowMissingColumns=True)

    def at(prob: int, side: int) -> Column:
        return F.max(F.when((F.col("prob") == prob) & (F.col("side") == side), F.col("at")))

    out = values.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("total").alias("total"), F.max("positives").alias("positives"),
        *[F.struct(at(i, 0).alias("a"), at(i, 1).alias("b")).alias(f"_q{i}")
          for i in range(len(probs))])
    quantiles = []
    for i, p in enumerate(probs):
        a, b = F.col(f"_q{i}.a"), F.col(f"_q{i}.b")
        place = F.lit(p) * (F.col("n") - 1)
        quantiles.append((a + (b - a) * (place - F.floor(place))).alias(_slug(p)))
    return out.select(*[F.col(g).alias(key) for g, key in named.items()], "n", "total",
                      (F.col("total") / F.col("n")).alias("mean"), "positives", *quantiles)


def _at_once(rows: DataFrame, named: dict[str, str], probs: tuple[float, ...]) -> DataFrame:
    """The statistics of few values, each group in one buffer."""
    stats = rows.groupBy(*named).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"),
        F.count_if(F.col("v") > 0).alias("positives"), F.percentile("v", list(probs)).alias("_q"))
    return stats.select(*[F.col(g).alias(key) for g, key in named.items()], "n", "total", "mean", "positives",
                        *[F.col("_q")[i].alias(_slug(p)) for i, p in enumerate(probs)])


def _look_inside(rows: DataFrame, open_: DataFrame, keys: list[str], few: bool):
    """Values of the ranks that lie strictly inside a bin, in up to two frames.

    The bin is narrowed to a slice of it, then, if need be, the distinct values
    of that slice are put in order.
    """
    if open_.isEmpty():
        return
    of_bin = [*keys, "bin"]
    sliced = _inside(rows, open_.select(*of_bin, "lo", "hi").distinct(), of_bin, few).withColumn(
        "slice", _slice("v", "_lo", "_hi"))
    slices = sliced.groupBy(*of_bin, "slice").agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).withColumn("before", F.coalesce(F.sum("c").over(_before(of_bin, "slice")), F.lit(0)))
    asked = open_.select(*of_bin, "prob", "side", F.col("k").alias("rank"))
    narrowed = settle(_known(_matched(asked, slices, of_bin)))
    yield narrowed.filter(F.col("known").isNotNull())

    still_open = narrowed.filter(F.col("known").isNull())
    if still_open.isEmpty():
        return
    of_slice = [*of_bin, "slice"]
    times = _inside(sliced.select(*of_slice, "v"), still_open.select(*of_slice).distinct(),
                    of_slice, few).groupBy(*of_slice, "v").agg(F.count(F.lit(1)).alias("c"))
    ordered = times.select(
        *of_slice, "c", F.col("v").alias("lo"), F.col("v").alias("hi"),
        F.coalesce(F.sum("c").over(_before(of_slice, "v")), F.lit(0)).alias("before"))
    yield _known(_matched(still_open.select(*of_slice, "prob", "side", F.col("k").alias("rank")),
                          ordered, of_slice))


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _known(df: DataFrame) -> DataFrame:
    """Keep the ranks that fall into their bin, as ``k`` within it. The first and
    last rank of a bin, and all ranks of a one-valued bin, are ``known``."""
    k = F.col("rank") - F.col("before")
    return (
        df.withColumn("k", k).filter((F.col("k") >= 0) & (F.col("k") < F.col("c")))
        .withColumn("known", F.when((F.col("k") == 0) | (F.col("lo") == F.col("hi")), F.col("lo"))
                    .when(F.col("k") == F.col("c") - 1, F.col("hi")))
    )


def _slice(value: str, low: str, high: str) -> Column:
    """Which of _SLICES equal parts of [low, high] a value lies in."""
    v, lo, hi = F.col(value), F.col(low), F.col(high)
    return F.least(F.floor((v - lo) / (hi - lo) * _SLICES), F.lit(_SLICES - 1)).cast("int")


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in df.columns])


def _same(keys: list[str]) -> Column:
    """Equal keys, NULL included; the other side has them with an underscore."""
    on = F.lit(True)
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return on


def _inside(rows: DataFrame, bins: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Rows of the given bins, with the bins' other columns."""
    wanted = _renamed(bins)
    joined = rows.join(F.broadcast(wanted) if few else wanted, _same(keys))
    return joined.drop(*[f"_{k}" for k in keys])


def _matched(asked: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """Each asked rank next to all bins of its key; :func:`_known` keeps its own."""
    other = bins.select(*[F.col(k).alias(f"_{k}") for k in keys],
                        *[c for c in bins.columns if c not in keys])
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))
    return asked.join(other, _same(keys) & inside).drop(*[f"_{k}" for k in keys])
