"""Coverage reports: overview, ticker pages, signals, authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbook.functions.stance import BUCKET_ORDER, order_key, stance_bucket
from callbook.functions.stats import multiple_of, pct_return, spike_status
from callbook.functions.text import article_url, picker_label
from callbook.operators.ordering import newest_per_key, with_previous
from callbook.operators.periods import bucket_by_time
from callbook.operators.quantiles import value_stats
from callbook.operators.sessions import benchmark_calendar, on_benchmark
from callbook.plans.filters import coverage_filter, directional, in_days
from callbook.plans.study import BENCHMARK
from callbook.session import settle

# Fixed values.
TOP_ROWS, PANEL_ROWS = 200, 25
SPIKE_MIN, SPIKE_DAYS, SPIKE_PRIOR_DAYS = 3, 30, 120


def kpis(articles: DataFrame, coverage: DataFrame, start=None, end=None, **toggles) -> DataFrame:
    """One row: articles, covered tickers and authors in the window."""
    arts = in_days(articles, start, end)
    cov = coverage_filter(in_days(coverage, start, end), **toggles)
    tickers = cov.agg(F.count_distinct("ticker")).scalar()
    return arts.agg(F.count(F.lit(1)).alias("articles"),
                    F.count_distinct("author").alias("authors")).select(
        "articles", tickers.alias("tickers"), "authors")


def stance_mix(articles: DataFrame, start=None, end=None) -> DataFrame:
    """Articles per display bucket, in display order."""
    return (in_days(articles, start, end)
            .groupBy(stance_bucket(F.col("stance")).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(order_key(F.col("bucket"), BUCKET_ORDER)))


def bull_bear(articles: DataFrame, start=None, end=None) -> DataFrame:
    """Bullish and bearish totals and their ratio, NULL without bearish ones."""
    bucket = stance_bucket(F.col("stance"))
    return in_days(articles, start, end).agg(
        F.count_if(bucket.isin("Buy", "Buy (question)")).alias("bull"),
        F.count_if(bucket.isin("Sell", "Sell (question)", "Caution")).alias("bear"),
    ).withColumn("bull_per_bear", F.try_divide(F.col("bull").cast("double"), F.col("bear")))


def daily_volume(articles: DataFrame, start=None, end=None) -> DataFrame:
    """(day, articles, net_stance)."""
    return (in_days(articles, start, end).groupBy(F.col("published_day").alias("day"))
            .agg(F.count(F.lit(1)).alias("articles"),
                 F.sum("stance_score").alias("net_stance")))


def volume_by_period(articles: DataFrame, start=None, end=None) -> DataFrame:
    """Coverage volume and net stance at a width that suits the span."""
    return bucket_by_time(daily_volume(articles, start, end)).orderBy("period")


def _with_scores(coverage: DataFrame, articles: DataFrame, *columns: str) -> DataFrame:
    return coverage.join(articles.select("path", "stance_score", *columns), "path")


def top_tickers(coverage: DataFrame, articles: DataFrame, tickers: DataFrame, start=None,
                end=None, n: int | None = TOP_ROWS, **toggles) -> DataFrame:
    """Most covered tickers with first and last day and average stance; all of them without n.

    A path has one day, so the window holds on both sides of the join.
    """
    cov = _with_scores(coverage_filter(in_days(coverage, start, end), **toggles),
                       in_days(articles, start, end))
    top = (
        cov.groupBy("ticker").agg(
            F.count(F.lit(1)).alias("articles"), F.min("published_day").alias("first_covered"),
            F.max("published_day").alias("last_covered"),
            F.round(F.avg("stance_score"), 2).alias("avg_stance"))
    )
    if n is not None:
        top = top.orderBy(F.desc("articles"), "ticker").limit(n)
    # Names are looked up for the listed rows only.
    return top.join(tickers.select("ticker", "name"), "ticker", "left").select(
        "ticker", "name", "articles", "first_covered", "last_covered", "avg_stance"
    ).orderBy(F.desc("articles"), "ticker")


def ticker_options(coverage: DataFrame, tickers: DataFrame, **toggles) -> DataFrame:
    """(ticker, n, name, label), most covered first."""
    counts = coverage_filter(coverage, **toggles).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"))
    return (counts.join(tickers.select("ticker", "name"), "ticker", "left")
            .withColumn("label", picker_label(F.col("ticker"), F.col("name"), F.col("n")))
            .orderBy(F.desc("n"), "ticker"))


def ticker_summary(coverage: DataFrame, articles: DataFrame, **toggles) -> DataFrame:
    """Per ticker: first and last day, days of coverage, articles, average stance."""
    cov = _with_scores(coverage_filter(coverage, **toggles), articles)
    first, last = F.min("published_day"), F.max("published_day")
    return cov.groupBy("ticker").agg(
        first.alias("first_day"), last.alias("last_day"), F.datediff(last, first).alias("days"),
        F.count(F.lit(1)).alias("articles"), F.avg("stance_score").alias("avg_stance"))


def ticker_periods(coverage: DataFrame, articles: DataFrame, **toggles) -> DataFrame:
    """Articles and net stance of every ticker, each at its own period width."""
    cov = _with_scores(coverage_filter(coverage, **toggles), articles)
    daily = cov.groupBy("ticker", F.col("published_day").alias("day")).agg(
        F.count(F.lit(1)).alias("articles"), F.sum("stance_score").alias("net_stance"))
    return bucket_by_time(daily, keys=("ticker",))


def _article_rows(coverage: DataFrame, articles: DataFrame, base: str, *more: str) -> DataFrame:
    joined = coverage.select("ticker", "path", "published_day", "is_primary", *more).join(
        articles.select("path", "title", "author", "stance", "stance_score"), "path")
    return joined.select(
        "ticker", "published_day", "title", "author",
        stance_bucket(F.col("stance")).alias("bucket"), "stance_score",
        F.col("is_primary").alias("primary"), "path",
        article_url(base, F.col("path")).alias("url"), *more)


def ticker_articles(coverage: DataFrame, articles: DataFrame, ticker: str | None = None,
                    base: str = "", **toggles) -> DataFrame:
    """Every article of one ticker (of all, if none is named), newest first."""
    cov = coverage_filter(coverage, **toggles)
    if ticker is not None:
        cov = cov.filter(F.col("ticker") == ticker)
    return _article_rows(cov, articles, base).orderBy(
        "ticker", F.desc("published_day"), "title", "path")


def article_panel(coverage: DataFrame, articles: DataFrame, ticker: str | None = None,
                  n: int = PANEL_ROWS, base: str = "", **toggles) -> DataFrame:
    """The newest n articles of each ticker, with the ticker's total."""
    cov = coverage_filter(coverage, **toggles)
    if ticker is not None:
        cov = cov.filter(F.col("ticker") == ticker)
    totals = cov.groupBy("ticker").agg(F.count(F.lit(1)).alias("total"))
    newest = newest_per_key(_article_rows(cov, articles, base), "ticker",
                            [F.desc("published_day"), F.asc("title"), F.asc("path")], n)
    return newest.join(totals, "ticker")


def ticker_price_history(coverage: DataFrame, tickers: DataFrame, prices: DataFrame,
                         benchmark: str = BENCHMARK, **toggles) -> DataFrame:
    """Per ticker: stock and benchmark return since first coverage, and the gap (Q10).

    Unlike the outcomes there is no limit on how late the first close may be;
    a series needs two closes in the span.
    """
    firsts = coverage_filter(coverage, **toggles).groupBy("ticker").agg(
        F.min("published_day").alias("first_day"))
    symbols = tickers.filter(F.col("price_symbol").isNotNull()).select(
        "ticker", F.col("price_symbol").alias("symbol"))
    tracked = firsts.join(symbols, "ticker", "left")
    series = prices.filter(F.col("close").isNotNull()).select("symbol", "date", "close")
    spans = (
        tracked.join(series, "symbol").filter(F.col("date") >= F.col("first_day"))
        .groupBy("ticker").agg(
            F.count(F.lit(1)).alias("sessions"), F.min_by("close", "date").alias("c0"),
            F.max_by("close", "date").alias("c1"))
    )
    since = F.when(F.col("sessions") > 1, pct_return(F.col("c0"), F.col("c1")))
    calendar = benchmark_calendar(prices, benchmark)
    last = series.filter(F.col("symbol") == benchmark).agg(
        F.max_by(F.struct("date", "close"), "date")).scalar()
    bench = F.when(last["date"] > F.col("b_date"), pct_return(F.col("b_close"), last["close"]))
    return on_benchmark(
        tracked.join(spans, "ticker", "left"), calendar, F.col("first_day"), prices, benchmark
    ).select(
        "ticker", "first_day", "symbol", since.alias("since_first"),
        F.when(F.col("symbol").isNotNull(), bench).alias("bench_since_first"),
    ).withColumn("gap", F.col("since_first") - F.col("bench_since_first"))


def rebased_prices(coverage: DataFrame, tickers: DataFrame, prices: DataFrame,
                   **toggles) -> DataFrame:
    """(ticker, date, close) from each ticker's first coverage on."""
    firsts = coverage_filter(coverage, **toggles).groupBy("ticker").agg(
        F.min("published_day").alias("first_day"))
    symbols = tickers.filter(F.col("price_symbol").isNotNull()).select(
        "ticker", F.col("price_symbol").alias("symbol"))
    return (firsts.join(symbols, "ticker").join(prices.select("symbol", "date", "close"), "symbol")
            .filter(F.col("date") >= F.col("first_day")).select("ticker", "date", "close"))


def stance_flips(coverage: DataFrame, articles: DataFrame, start=None, end=None,
                 n: int | None = TOP_ROWS, base: str = "", **toggles) -> DataFrame:
    """Consecutive directional articles of a ticker whose direction reversed.

    The predecessor is found over all days; the window of days and the limit
    apply afterwards. Titles and authors are looked up for the rows left then.
    """
    cov = coverage_filter(coverage, **toggles).select("ticker", "path", "published_day")
    calls = settle(_with_scores(cov, articles).filter(directional()))
    linked = with_previous(calls, "ticker", "published_day", "path",
                           ["stance_score", "published_day", "path"])
    up, was_up = F.col("stance_score") > 0, F.col("prev.stance_score") > 0
    flips = in_days(linked.filter(F.col("prev").isNotNull() & (up != was_up)), start, end)
    if n is not None:
        flips = flips.orderBy(F.desc("published_day"), "ticker", "path").limit(n)
    earlier = articles.select(F.col("path").alias("prev_path"), F.col("title").alias("prev_title"))
    named = (
        flips.withColumn("prev_path", F.col("prev.path"))
        .join(articles.select("path", "title", "author"), "path").join(earlier, "prev_path"))
    if n is not None:
        named = named.orderBy(F.desc("published_day"), "ticker", "path")
    return named.select(
        "ticker", F.when(up, "turned bullish").otherwise("turned cautious").alias("direction"),
        F.col("prev.published_day").alias("prev_day"), "prev_title",
        F.col("prev.stance_score").alias("prev_score"),
        article_url(base, F.col("prev_path")).alias("prev_url"), "published_day", "title",
        "stance_score", article_url(base, F.col("path")).alias("url"),
        F.datediff("published_day", "prev.published_day").alias("days_between"), "author")


def coverage_spikes(coverage: DataFrame, articles: DataFrame, tickers: DataFrame,
                    n: int | None = TOP_ROWS, **toggles) -> DataFrame:
    """Last 30 days of coverage against the mean 30 days of the 90 before (A10).

    The n busiest tickers, or all. Only the days that count are read: a ticker that
    passes has its latest article among them.
    """
    ref = articles.agg(F.max("published_day")).scalar()
    recent = F.date_sub(ref, SPIKE_DAYS)
    day = F.col("published_day")
    prior = (day <= recent) & (day > F.date_sub(ref, SPIKE_PRIOR_DAYS))
    windows = (SPIKE_PRIOR_DAYS - SPIKE_DAYS) / SPIKE_DAYS
    window = coverage.filter(day > F.date_sub(ref, SPIKE_PRIOR_DAYS))
    if "month" in coverage.columns:
        window = window.filter(
            F.col("month") >= F.date_format(F.date_sub(ref, SPIKE_PRIOR_DAYS), "yyyy-MM"))
    busiest = (
        coverage_filter(window, **toggles).groupBy("ticker").agg(
            F.count_if(day > recent).alias("last_30d"),
            (F.count_if(prior) / F.lit(windows)).alias("prior_avg_30d"),
            F.max(day).alias("latest"))
        .filter(F.col("last_30d") >= SPIKE_MIN)
    )
    if n is not None:
        busiest = busiest.orderBy(F.desc("last_30d"), "ticker").limit(n)
    base = F.col("prior_avg_30d")
    return busiest.join(tickers.select("ticker", "name"), "ticker", "left").select(
        "ticker", "name", spike_status(base).alias("status"), "last_30d", "prior_avg_30d",
        multiple_of(F.col("last_30d"), base).alias("multiple"), "latest",
    ).orderBy(F.desc_nulls_last("multiple"), F.desc("last_30d"), "ticker")


def author_table(articles: DataFrame, coverage: DataFrame, start=None, end=None) -> DataFrame:
    """Per named author: articles, average stance, span, distinct primary tickers.

    Articles are aggregated on their own, so one tagged with three tickers still
    counts once.
    """
    arts = in_days(articles, start, end).filter(F.col("author") != "")
    totals = arts.groupBy("author").agg(
        F.count(F.lit(1)).alias("articles"), F.round(F.avg("stance_score"), 2).alias("avg_stance"),
        F.min("published_day").alias("first_seen"), F.max("published_day").alias("last_seen"))
    primary = coverage_filter(in_days(coverage, start, end), primary_only=True).select(
        "path", "ticker")
    tickers = arts.select("path", "author").join(primary, "path").groupBy("author").agg(
        F.count_distinct("ticker").alias("tickers"))
    return totals.join(tickers, "author", "left").withColumn(
        "tickers", F.coalesce("tickers", F.lit(0))).orderBy(F.desc("articles"), "author")


def author_summary(authors: DataFrame) -> DataFrame:
    """Authors, median articles each and the most prolific one."""
    stats = value_stats(authors.select(F.lit("all").alias("what"),
                                       F.col("articles").cast("double").alias("value")),
                        ["what"], few_keys=True)
    # The most articles; by name when several have as many.
    most = authors.agg(F.min_by("author", F.struct(-F.col("articles"), "author"))).scalar()
    return stats.select(F.col("n").alias("authors"), F.col("median").alias("median_articles"),
                        most.alias("most_prolific"))


def turned_cautious(coverage: DataFrame, articles: DataFrame, pivot, min_articles: int = 20,
                    above: float = 0.3, below: float = -0.1,
                    primary_only: bool = True) -> DataFrame:
    """Tickers bullish before a day and bearish since, biggest turn first."""
    cov = _with_scores(coverage_filter(coverage, primary_only=primary_only), articles)
    pivot_day = F.lit(pivot).cast("date")

    def mean(when: Column) -> Column:
        return F.round(F.avg(F.when(when, F.col("stance_score"))), 2)

    return (
        cov.groupBy("ticker").agg(
            mean(F.col("published_day") < pivot_day).alias("before"),
            mean(F.col("published_day") >= pivot_day).alias("since"),
            F.count(F.lit(1)).alias("articles"))
        .filter((F.col("articles") >= min_articles) & (F.col("before") > above)
                & (F.col("since") < below))
        .orderBy((F.col("before") - F.col("since")).desc(), "ticker")
    )
