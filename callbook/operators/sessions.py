"""Trading sessions, forward legs and as-of joins.

Prices are keyed by (symbol, date), so a window over one symbol never holds
more rows than there are calendar days, however skewed the coverage is. Events
meet sessions on (symbol, day): a heavily covered symbol is spread over its
days.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.functions.stats import pct_return

#: A price series that starts later than this after an event gives no entry.
MAX_ENTRY_GAP_DAYS = 7


def _by_session():
    """One symbol's sessions in order: at most one row per calendar day."""
    return Window.partitionBy("symbol").orderBy("date")


def _whole_series():
    return _by_session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def price_book(prices: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Sessions with a close as (symbol, date, close, idx), idx counting from 0."""
    rows = prices.filter(F.col("close").isNotNull()).select("symbol", "date", "close")
    if symbols is not None:
        rows = rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return rows.withColumn("idx", F.row_number().over(_by_session()) - 1)


def benchmark_calendar(prices: DataFrame, benchmark: str,
                       horizons: Iterable[int] = ()) -> DataFrame:
    """One row per calendar day: the benchmark's first session on or after it.

    Columns: cal_day, b_date, b_idx, b_close and, per horizon h, b_ret_{h} over
    the benchmark's own next h sessions. It has one row per day between the
    benchmark's first and last session, which bounds the broadcast.
    """
    book = price_book(prices.filter(F.col("symbol") == benchmark))
    prev = F.lag("date").over(_by_session())
    legs = [pct_return(F.col("close"), F.lead("close", h).over(_by_session())).alias(f"b_ret_{h}")
            for h in horizons]
    days = F.sequence(F.coalesce(F.date_add(F.col("prev"), 1), F.col("b_date")), F.col("b_date"))
    return (
        book.select(F.col("date").alias("b_date"), F.col("idx").alias("b_idx"),
                    F.col("close").alias("b_close"), prev.alias("prev"), *legs)
        .withColumn("cal_day", F.explode(days)).drop("prev")
    )


def first_session(prices: DataFrame, benchmark: str | None = None) -> Column:
    """First day with a close, of one symbol or of all, as a scalar subquery;
    NULL when there is none."""
    rows = prices.filter(F.col("close").isNotNull())
    if benchmark is not None:
        rows = rows.filter(F.col("symbol") == benchmark)
    return rows.agg(F.min("date")).scalar()


def on_benchmark(df: DataFrame, calendar: DataFrame, day: Column, prices: DataFrame,
                 benchmark: str) -> DataFrame:
    """Left as-of join of ``day`` onto the benchmark's next session.

    Days before the series snap to its first session; days past its end get NULL.
    """
    start = first_session(prices, benchmark)
    keyed = df.withColumn("_cal", F.when(day.isNotNull(), F.greatest(day, start)))
    cal = calendar.withColumnRenamed("cal_day", "_cal")
    return keyed.join(F.broadcast(cal), "_cal", "left").drop("_cal")


def forward_returns(book: DataFrame, horizons: Iterable[int]) -> DataFrame:
    """Add ret_{h}: the return over the next h sessions, NULL past the end."""
    return book.select("*", *[
        pct_return(F.col("close"), F.lead("close", h).over(_by_session())).alias(f"ret_{h}")
        for h in horizons])


def _bench_leg(i0: Column, c0: Column, i1: Column, c1: Column) -> Column:
    return F.when(i1 > i0, pct_return(c0, c1))


def dated_legs(prices: DataFrame, benchmark: str, *, forward: Iterable[int] = (),
               backward: Iterable[int] = (), to_last: bool = False) -> DataFrame:
    """Stock and benchmark returns over the same dates, one row per session.

    Adds ret_{h}/bench_{h} for the h sessions ahead, back_{h}/bback_{h} for the
    h sessions behind and ret_last/bench_last up to the last session. Both ends
    of a leg are snapped to the benchmark's sessions by date. One window pass
    serves every horizon.
    """
    book = price_book(prices)
    calendar = benchmark_calendar(prices, benchmark).select("cal_day", "b_idx", "b_close")
    sess = on_benchmark(book, calendar, F.col("date"), prices, benchmark)
    close, b_idx, b_close = F.col("close"), F.col("b_idx"), F.col("b_close")
    cols: list[Column] = []
    for h in forward:
        c1, i1, bc1 = (F.lead(c, h).over(_by_session()) for c in ("close", "b_idx", "b_close"))
        cols += [pct_return(close, c1).alias(f"ret_{h}"),
                 _bench_leg(b_idx, b_close, i1, bc1).alias(f"bench_{h}")]
    for h in backward:
        c0, i0, bc0 = (F.lag(c, h).over(_by_session()) for c in ("close", "b_idx", "b_close"))
        cols += [pct_return(c0, close).alias(f"back_{h}"),
                 _bench_leg(i0, bc0, b_idx, b_close).alias(f"bback_{h}")]
    if to_last:
        last_idx, c1, i1, bc1 = (F.last(c).over(_whole_series())
                                 for c in ("idx", "close", "b_idx", "b_close"))
        later = last_idx > F.col("idx")
        cols += [F.when(later, pct_return(close, c1)).alias("ret_last"),
                 F.when(later, _bench_leg(b_idx, b_close, i1, bc1)).alias("bench_last")]
    return sess.select("symbol", "date", "close", "idx", *cols)


def guarded_entries(days: DataFrame, sessions: DataFrame, *, symbol: str = "symbol",
                    day: str = "published_day", max_gap: int = MAX_ENTRY_GAP_DAYS) -> DataFrame:
    """Left join of (symbol, day) rows to the first session within ``max_gap`` days.

    Session columns keep their names, except date -> entry_date and
    close -> entry_close. Rows and sessions of a symbol are walked once, from the latest day back,
    carrying the nearest session seen so far. Sessions that come from a window over their symbol stay
    where they are; only the rows are dealt out to them, so there should be at most a few of each symbol and day.
    """
    named = {"date": "entry_date", "close": "entry_close"}
    others = [c for c in sessions.columns if c != "symbol"]
    # Rows without a symbol meet no session; their day spreads them.
    spread = F.coalesce(symbol, F.col(day).cast("string"))
    marks = days.select("*", spread.alias("_sym"), F.col(day).alias("_day"), F.lit(1).alias("_mark")
                        ).repartition("_sym")
    met = sessions.filter(F.col("symbol").isNotNull() & F.col("date").isNotNull()).select(
        F.col("symbol").alias("_sym"), F.col("date").alias("_day"), F.lit(0).alias("_mark"),
        F.struct(*others).alias("_hit"))
    walk = Window.partitionBy("_sym").orderBy(F.desc("_day"), "_mark").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    near = F.when(F.col(symbol).isNotNull() & (F.col("_next.date") <= F.date_add("_day", max_gap)), F.col("_next"))
    return (
        marks.unionByName(met, allowMissingColumns=True)
        .withColumn("_next", F.last("_hit", ignorenulls=True).over(walk))
        .filter(F.col("_mark") == 1).withColumn("_next", near)
        .select(*days.columns, *[F.col("_next")[c].alias(named.get(c, c)) for c in others]))


def next_session(days: DataFrame, prices: DataFrame) -> DataFrame:
    """Unguarded as-of: first session on or after each (symbol, day).

    Event days and sessions of a symbol are walked once, from the latest day
    back, carrying the nearest session seen so far. Both inputs hold at most
    one row per symbol and day, so one symbol's walk is bounded by the calendar.
    """
    wanted = days.select("symbol", "day").distinct()
    marks = wanted.select("symbol", "day", F.lit(None).cast("struct<date:date,close:double>")
                          .alias("hit"), F.lit(0).alias("kind"))
    sessions = prices.select("symbol", F.col("date").alias("day"),
                             F.struct("date", "close").alias("hit"), F.lit(1).alias("kind"))
    walk = Window.partitionBy("symbol").orderBy(F.desc("day"), F.desc("kind")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        marks.unionByName(sessions)
        .withColumn("next", F.last("hit", ignorenulls=True).over(walk))
        .filter(F.col("kind") == 0)
        .select("symbol", "day", F.col("next.date").alias("entry_date"),
                F.col("next.close").alias("entry_close"))
    )


def latest_close(prices: DataFrame) -> DataFrame:
    """Last stored session of every symbol."""
    return prices.groupBy("symbol").agg(
        F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))
