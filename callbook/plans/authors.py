"""Author call accuracy against the base rate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.functions.stats import share_pct, wilson_high, wilson_low
from callbook.operators.quantiles import value_stats
from callbook.plans.filters import directional
from callbook.plans.study import BENCHMARK, study_days, study_events
from callbook.session import settle

# Fixed value: fewer calls than this say nothing about an author.
MIN_CALLS = 20


@dataclass
class AuthorScores:
    authors: DataFrame     # one row per author
    base: DataFrame        # one row over all calls
    notes: DataFrame


def measured_calls(events: DataFrame, horizon: int = 21) -> DataFrame:
    """Directional events with a return at the horizon, signed by direction."""
    move = F.col(f"adj_{horizon}d")
    bull = F.col("stance_score") > 0
    return events.filter(move.isNotNull() & directional()).select(
        "author", "ticker", bull.alias("bullish"),
        F.when(bull, move).otherwise(-move).alias("call_return"))


def base_rate(calls: DataFrame, horizon: int = 21) -> DataFrame:
    """All calls together: the rate an author has to beat."""
    right = F.count_if(F.col("call_return") > 0)
    n = F.count(F.lit(1))
    return calls.agg(
        n.alias("calls"), share_pct(right, n).alias("hit_rate"),
        F.count_if("bullish").alias("bullish_calls"),
        F.count_if(~F.col("bullish")).alias("bearish_calls"),
        F.avg("call_return").alias("mean_call_return"),
        F.count_distinct("author").alias("authors"), F.lit(horizon).alias("horizon"))


def score_authors(calls: DataFrame, min_calls: int = MIN_CALLS) -> DataFrame:
    """Accuracy per author with its interval, ranked with enough data first.

    ``calls`` is read several times and should be settled.
    """
    named = calls.filter(F.col("author").isNotNull())
    stats = value_stats(named, ["author"], "call_return", stored=True)
    extra = named.groupBy("author").agg(
        F.count_if("bullish").alias("bulls"), F.count_distinct("ticker").alias("tickers"))
    base = base_rate(calls).select("hit_rate").scalar()
    hits, n = F.col("positives"), F.col("n")
    return stats.join(extra, "author").select(
        "author", n.alias("calls"), hits.alias("hits"), share_pct(hits, n).alias("hit_rate"),
        wilson_low(hits, n).alias("ci_low"), wilson_high(hits, n).alias("ci_high"),
        (share_pct(hits, n) - base).alias("vs_base"), F.col("mean").alias("mean_call_return"),
        F.col("median").alias("median_call_return"),
        share_pct(F.col("bulls"), n).alias("bullish_share"), "tickers",
        (wilson_low(hits, n) > base).alias("beats_base"),
        (n >= min_calls).alias("enough_data"),
    ).orderBy(F.desc("enough_data"), F.desc("hit_rate"), F.desc("calls"), "author")


def leaderboard(authors: DataFrame) -> DataFrame:
    """Authors with enough data; everyone by call count when nobody has."""
    qualified = authors.agg(F.count_if("enough_data")).scalar()
    return authors.filter(F.col("enough_data") | (qualified == 0)).orderBy(
        F.when(qualified > 0, F.col("hit_rate")).desc(), F.desc("calls"), "author")


def author_notes(authors: DataFrame, base: DataFrame, min_calls: int = MIN_CALLS) -> DataFrame:
    """(code, count, text): calls, bullish, bearish and right ones among them, ranked and
    qualified authors."""
    qualified = authors.agg(F.count_if("enough_data")).scalar()
    ranked = authors.agg(F.count(F.lit(1))).scalar()
    right = F.coalesce(F.round(F.col("hit_rate") / 100 * F.col("calls")), F.lit(0))
    cells = {
        "calls": (F.col("calls"), "headlines with a direction that could be measured"),
        "bullish": (F.col("bullish_calls"), "of them bullish"),
        "bearish": (F.col("bearish_calls"), "of them bearish"),
        "right": (right, "of them right, which sets the base rate"),
        "ranked": (ranked, "authors in the ranking"),
        "qualified": (qualified, f"authors with {min_calls} calls or more"),
    }
    return base.select(F.inline(F.array(*[
        F.struct(F.lit(code).alias("code"), n.cast("bigint").alias("count"),
                 F.lit(text).alias("text")) for code, (n, text) in cells.items()])))


def author_scores(coverage: DataFrame, articles: DataFrame, tickers: DataFrame,
                  prices: DataFrame, *, horizon: int = 21, primary_only: bool = True,
                  censor_days: int = 0, min_calls: int = MIN_CALLS,
                  benchmark: str = BENCHMARK) -> AuthorScores:
    days = settle(study_days(coverage, tickers, prices, primary_only=primary_only,
                             censor_days=censor_days, min_articles=1, benchmark=benchmark))
    events = study_events(coverage, articles, days, primary_only=primary_only)
    calls = settle(measured_calls(events, horizon))
    authors, base = settle(score_authors(calls, min_calls)), base_rate(calls, horizon)
    return AuthorScores(authors, base, author_notes(authors, base, min_calls))
