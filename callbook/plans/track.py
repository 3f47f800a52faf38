"""Reports on the track record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.functions.dates import quarter_start
from callbook.functions.stance import CALL_ORDER, order_key
from callbook.functions.stats import ci_verdict, clip, share_pct, wilson_high, wilson_low
from callbook.functions.text import article_url
from callbook.operators.quantiles import value_stats
from callbook.plans.filters import bullish, directional
from callbook.plans.outcomes import TRACK_HORIZONS
from callbook.plans.study import by_horizon
from callbook.session import settle

# Fixed values.
CLOSED_GROUPS = ("stance", "bucket")
HISTOGRAM_STEP = {"1m": 2, "3m": 4, "6m": 5, "12m": 10}
MIN_QUARTER_CALLS = 30
EVERY_CALL_ROWS, TOP_CALLS = 500, 15
GROWTH_SERIES = {"follow_growth": "Buy every bullish call", "bench_growth": "Benchmark"}


def _scores(calls: DataFrame, group: str) -> DataFrame:
    """value_stats by (group, horizon); horizon "all" only counts the calls."""
    columns = {h: F.col(f"call_{h}") for h in TRACK_HORIZONS}
    long = by_horizon(calls, [group], {"all": F.lit(0.0), **columns})
    return value_stats(long, [group, "horizon"], few_keys=group in CLOSED_GROUPS)


def _measures() -> dict[str, Column]:
    hits, n = F.col("positives"), F.col("n")
    return {"n": n, "hit": share_pct(hits, n), "lo": wilson_low(hits, n),
            "hi": wilson_high(hits, n), "median": F.col("median"), "mean": F.col("mean")}


def scorecard_long(track: DataFrame, group: str = "stance") -> DataFrame:
    """(group, horizon): calls scored, hit %, its interval, median and mean."""
    scores = _scores(track.filter(directional()), group).filter(F.col("horizon") != "all")
    return scores.select(group, "horizon", *[c.alias(m) for m, c in _measures().items()])


def scorecard(track: DataFrame, group: str = "stance") -> DataFrame:
    """One row per group: calls, and n, hit, lo, hi, median, mean at each horizon."""
    def at(horizon: str, value: Column) -> Column:
        return F.max(F.when(F.col("horizon") == horizon, value))

    cells = [
        (F.coalesce(at(h, c), F.lit(0)) if m == "n" else at(h, c)).alias(f"{m}_{h}")
        for h in TRACK_HORIZONS for m, c in _measures().items()]
    return _scores(track.filter(directional()), group).groupBy(group).agg(
        at("all", F.col("n")).alias("calls"), *cells)


def call_types(track: DataFrame, label: str = "3m") -> DataFrame:
    """Scorecard of the call buckets with the interval's verdict at one horizon."""
    rows = scorecard(track, "bucket").filter(
        F.col("bucket").isin(CALL_ORDER) & (F.col(f"n_{label}") > 0))
    return rows.withColumn("verdict", ci_verdict(F.col(f"lo_{label}"), F.col(f"hi_{label}"))
                           ).orderBy(order_key(F.col("bucket"), CALL_ORDER))


def follow_the_calls(track: DataFrame, label: str = "1m") -> DataFrame:
    """Growth of 1 from holding each month's bullish calls, against the benchmark.

    A ticker counts once per month, by its earliest call. The last window runs
    over one row per calendar month.
    """
    h = TRACK_HORIZONS[label]
    ret, bench = F.col(f"ret_{h}"), F.col(f"bench_{h}")
    baskets = (
        track.filter(bullish() & ret.isNotNull() & bench.isNotNull())
        .groupBy(F.trunc("published_day", "MM").alias("month"), "ticker")
        .agg(F.min_by(F.struct(ret.alias("ret"), bench.alias("bench")),
                      F.struct("published_day", "path")).alias("first"))
        .groupBy("month").agg(F.count(F.lit(1)).alias("calls"),
                              F.avg("first.ret").alias("basket"),
                              F.avg("first.bench").alias("bench"))
    )
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return baskets.select(
        "*", F.product(1 + F.col("basket") / 100).over(so_far).alias("follow_growth"),
        F.product(1 + F.col("bench") / 100).over(so_far).alias("bench_growth"))


def growth_series(baskets: DataFrame) -> DataFrame:
    """Long form of the growth lines; ``is_last`` marks each line's end."""
    marked = baskets.withColumn(
        "is_last", F.col("month") == F.max("month").over(Window.partitionBy()))
    long = marked.unpivot(["month", "calls", "is_last"], list(GROWTH_SERIES), "column", "growth")
    name = F.when(F.col("column") == "follow_growth", GROWTH_SERIES["follow_growth"]).otherwise(
        GROWTH_SERIES["bench_growth"])
    return long.select("month", "calls", name.alias("series"), "growth", "is_last")


def basket_summary(baskets: DataFrame) -> DataFrame:
    """Months, mean basket size, months the basket beat the benchmark."""
    return baskets.agg(
        F.count(F.lit(1)).alias("months"), F.avg("calls").alias("mean_calls"),
        F.count_if(F.col("basket") > F.col("bench")).alias("months_ahead"))


def selection_summary(calls: DataFrame, label: str = "3m") -> DataFrame:
    """One row on a selection of calls at one horizon.

    Scored, hit share and interval, median, mean, unpriced and maturing counts,
    and the reading of mean against median.
    """
    # The counts travel along as samples of their own.
    samples = F.array(*[F.struct(F.lit(name).alias("sample"), value.alias("value"))
                        for name, value in (
        ("scored", F.col(f"call_{label}")),
        ("entered", F.when(F.col("entry_date").isNotNull(), 0.0)),
        ("unpriced", F.when(F.col("entry_date").isNull(), 0.0)))])
    stats = value_stats(calls.select(F.inline(samples)), ["sample"], few_keys=True)

    def of(sample: str, column: str) -> Column:
        return F.max(F.when(F.col("sample") == sample, F.col(column)))

    one = stats.agg(
        of("scored", "n").alias("n"), of("scored", "positives").alias("hits"),
        of("scored", "median").alias("median"), of("scored", "mean").alias("mean"),
        F.coalesce(of("unpriced", "n"), F.lit(0)).alias("unpriced"),
        F.coalesce(of("entered", "n"), F.lit(0)).alias("entered"))
    hits, n = F.col("hits"), F.coalesce("n", F.lit(0))
    mean, median = F.col("mean"), F.col("median")
    reading = (
        F.when((mean > 0) & (median < 0), "typical call lost, average gained")
        .when((median > 0) & (mean > 0), "typical call and average gained")
        .when((median < 0) & (mean < 0), "typical call and average lost"))
    return one.select(
        F.lit(label).alias("horizon"), n.alias("scored"), F.coalesce(hits, F.lit(0)).alias("hits"),
        share_pct(hits, n).alias("hit_rate"), wilson_low(hits, n).alias("ci_low"),
        wilson_high(hits, n).alias("ci_high"), "median", "mean", "unpriced",
        (F.col("entered") - n).alias("maturing"), reading.alias("reading"))


def histogram(calls: DataFrame, label: str = "3m") -> DataFrame:
    """Distribution of call returns; the outer bins hold the extreme percent."""
    step = float(HISTOGRAM_STEP[label])
    values = settle(calls.select(F.lit(label).alias("horizon"), F.col(f"call_{label}")
                                 .alias("value")).filter(F.col("value").isNotNull()))
    stats = value_stats(values, ["horizon"], probs=(0.01, 0.99), few_keys=True, stored=True)
    edges = stats.agg(F.struct(
        F.max(F.floor(F.col("p1") / step) * step).alias("lo"),
        F.max(F.ceil(F.col("p99") / step) * step).alias("hi"))).scalar()
    lo, hi = edges["lo"], edges["hi"]
    placed = F.floor((clip(F.col("value"), lo, hi - 1e-9) - lo) / step)
    start = lo + F.col("bin") * step
    return (
        values.filter(hi > lo).select(placed.alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("calls"))
        .select(start.alias("start"), (start + step).alias("end"), "calls",
                F.when(start >= 0, "Call paid").otherwise("Call did not pay").alias("side"))
        .orderBy("start")
    )


def by_quarter(calls: DataFrame, label: str = "3m",
               min_calls: int = MIN_QUARTER_CALLS) -> DataFrame:
    """Calls, median and share right per quarter; thin quarters are hidden."""
    rows = calls.select(quarter_start(F.col("published_day")).alias("quarter"),
                        F.col(f"call_{label}").alias("value"))
    stats = value_stats(rows, ["quarter"], few_keys=True)
    return stats.filter(F.col("n") >= min_calls).select(
        "quarter", F.col("n").alias("calls"), "median",
        share_pct(F.col("positives"), F.col("n")).alias("right_pct")).orderBy("quarter")


def _call_columns(df: DataFrame, base: str, *returns: str) -> DataFrame:
    return df.select("published_day", "ticker", "title", "author", "bucket", *returns, "path",
                     article_url(base, F.col("path")).alias("url"))


def extreme_calls(calls: DataFrame, label: str = "3m", best: bool = True, n: int = TOP_CALLS,
                  base: str = "") -> DataFrame:
    """The n best (or worst) calls at one horizon (T4)."""
    col = f"call_{label}"
    first: Column = F.desc(col) if best else F.asc(col)
    ranked = calls.filter(F.col(col).isNotNull()).orderBy(first, "path", "ticker").limit(n)
    return _call_columns(ranked, base, col)


def every_call(calls: DataFrame, base: str = "", n: int | None = None) -> DataFrame:
    """All calls, newest first; ``n`` for the first page of them (T5)."""
    ordered = calls.orderBy(F.desc("published_day"), "path", "ticker")
    return _call_columns(ordered if n is None else ordered.limit(n), base,
                         *[f"call_{h}" for h in TRACK_HORIZONS])


def author_call_counts(track: DataFrame) -> DataFrame:
    """Directional calls per author, most first."""
    return (track.filter(directional() & F.col("author").isNotNull()).groupBy("author")
            .agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "author"))
