"""Outcomes, track record, event study, timeline and author accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.checks.domain import HOST
from callbook.checks import prelude
from callbook.checks.prelude import pct, r6, share, wilson
from callbook.checks.registry import check, rounded, significant
from callbook.plans import authors as A
from callbook.plans import study as E
from callbook.plans import timeline as L
from callbook.plans import track as T
from callbook.plans.filters import in_days, select_calls
from callbook.plans.outcomes import (
    TRACK_HORIZONS,
    compute_outcomes,
    merge_outcomes,
    outcome_counts,
    returns_since,
)
from callbook.session import settle

MONTHS = list(TRACK_HORIZONS)
_RETURNS = [f"{leg}_{h}" for h in TRACK_HORIZONS.values() for leg in ("ret", "bench")]

# --- Q3, Q5 -------------------------------------------------------------------------
_OUTCOMES = ("SELECT path, ticker, published_day, entry_date, entry_close, "
             + ", ".join(f"{r6(c)} AS {c}" for c in _RETURNS) + " FROM outcomes")


@check("call_outcomes", _OUTCOMES)
def call_outcomes(d):
    return rounded(d.outcomes, *_RETURNS)


@check("outcomes_incremental", _OUTCOMES)
def outcomes_incremental(d):
    """Score the calls before 1998, then everything still open: the same as a full run."""
    early = settle(compute_outcomes(d.coverage.filter(F.col("published_day") < "1998-01-01"),
                                    d.tickers, d.prices))
    rest = settle(compute_outcomes(d.coverage, d.tickers, d.prices, early))
    return rounded(merge_outcomes(early, rest), *_RETURNS)


@check("outcome_counts",
       "SELECT count(*) AS computed, count(entry_date) AS scored FROM outcomes")
def outcome_run_counts(d):
    return outcome_counts(d.outcomes)


_TRACK_COLS = [f"{k}_{m}" for m in MONTHS for k in ("excess", "call")]
_HITS = [f"hit_{m}" for m in MONTHS]


@check("track_record", "SELECT path, ticker, stance, bucket, "
       + ", ".join(f"{r6(c)} AS {c}" for c in _TRACK_COLS) + ", " + ", ".join(_HITS)
       + " FROM track")
def track_record_rows(d):
    return rounded(d.track.select("path", "ticker", "stance", "bucket", *_TRACK_COLS, *_HITS),
                   *_TRACK_COLS)


# --- Q6, A18 --------------------------------------------------------------------------
def _scorecard(group: str) -> str:
    cells = []
    for m in MONTHS:
        c, n = f"call_{m}", f"count(call_{m})"
        hits = f"(count(*) FILTER ({c} > 0))"
        cells += [f"{n} AS n_{m}", f"{r6(share(hits, n))} AS hit_{m}",
                  f"{r6(wilson(hits, n, 'lo'))} AS lo_{m}", f"{r6(wilson(hits, n, 'hi'))} AS hi_{m}",
                  f"{r6(f'median({c})')} AS median_{m}", f"{r6(f'avg({c})')} AS mean_{m}"]
    return (f"SELECT {group}, count(*) AS calls, {', '.join(cells)} FROM track "
            f"WHERE stance_score <> 0 GROUP BY {group}")


_CARD = [f"{k}_{m}" for m in MONTHS for k in ("hit", "lo", "hi", "median", "mean")]


@check("scorecard_by_stance", _scorecard("stance"))
def scorecard_by_stance(d):
    return rounded(T.scorecard(d.track, "stance"), *_CARD)


@check("call_types", f", card AS ({_scorecard('bucket')})" + """
SELECT *, CASE WHEN lo_3m > 50 THEN 'Beats a coin flip' WHEN hi_3m < 50
  THEN 'Worse than a coin flip' ELSE 'Can''t tell' END AS verdict
FROM card WHERE n_3m > 0 AND bucket <> 'No call'""")
def call_types(d):
    return rounded(T.call_types(d.track, "3m"), *_CARD)


# --- Q7, T12, A24 -----------------------------------------------------------------------
_BASKETS = """
, once AS (SELECT DISTINCT ON (date_trunc('month', published_day), ticker)
   CAST(date_trunc('month', published_day) AS DATE) AS month, ticker, ret_21, bench_21
 FROM track WHERE stance_score > 0 AND ret_21 IS NOT NULL AND bench_21 IS NOT NULL
 ORDER BY date_trunc('month', published_day), ticker, published_day, path),
m AS (SELECT month, count(*) AS calls, avg(ret_21) AS basket, avg(bench_21) AS bench
 FROM once GROUP BY month),
baskets AS (SELECT *, product(1 + basket / 100) OVER w AS follow_growth,
   product(1 + bench / 100) OVER w AS bench_growth FROM m
 WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_GROWTH = ("follow_growth", "bench_growth")


@check("follow_the_calls", _BASKETS + f" SELECT month, calls, {r6('basket')} AS basket, "
       f"{r6('bench')} AS bench, "
       + ", ".join(f"{prelude.significant(c)} AS {c}" for c in _GROWTH) + " FROM baskets")
def follow_the_calls(d):
    return significant(rounded(T.follow_the_calls(d.track), "basket", "bench"), *_GROWTH)


@check("growth_series", _BASKETS + f"""
SELECT month, calls, 'Buy every bullish call' AS series, {prelude.significant('follow_growth')} AS growth,
  month = (SELECT max(month) FROM baskets) AS is_last FROM baskets
UNION ALL SELECT month, calls, 'Benchmark', {prelude.significant('bench_growth')},
  month = (SELECT max(month) FROM baskets) FROM baskets""")
def growth_series(d):
    return significant(T.growth_series(T.follow_the_calls(d.track)), "growth")


@check("basket_summary", _BASKETS + f"""
SELECT count(*) AS months, {r6('avg(calls)')} AS mean_calls,
  count(*) FILTER (basket > bench) AS months_ahead FROM baskets""")
def basket_summary(d):
    return rounded(T.basket_summary(T.follow_the_calls(d.track)), "mean_calls")


# --- A20, A21, A22, Q17, T4, T5, A25 -------------------------------------------------------
_SPAN = ("1995-06-01", "2000-12-31")
_IN = f"published_day BETWEEN DATE '{_SPAN[0]}' AND DATE '{_SPAN[1]}'"


def _summary(m: str, where: str) -> str:
    c, n = f"call_{m}", f"count(call_{m})"
    hits = f"(count(*) FILTER ({c} > 0))"
    return f"""
SELECT '{m}' AS horizon, {n} AS scored, {hits} AS hits, {r6(share(hits, n))} AS hit_rate,
 {r6(wilson(hits, n, 'lo'))} AS ci_low, {r6(wilson(hits, n, 'hi'))} AS ci_high,
 {r6(f'median({c})')} AS median, {r6(f'avg({c})')} AS mean,
 count(*) FILTER (entry_date IS NULL) AS unpriced, count(entry_date) - {n} AS maturing,
 CASE WHEN avg({c}) > 0 AND median({c}) < 0 THEN 'typical call lost, average gained'
  WHEN median({c}) > 0 AND avg({c}) > 0 THEN 'typical call and average gained'
  WHEN median({c}) < 0 AND avg({c}) < 0 THEN 'typical call and average lost' END AS reading
FROM track WHERE {_IN} AND {where}"""


_SUMMARY = ("hit_rate", "ci_low", "ci_high", "median", "mean")


@check("summary_all_3m", _summary("3m", "stance_score <> 0"))
def summary_all(d):
    calls = select_calls(in_days(d.track, *_SPAN))
    return rounded(T.selection_summary(calls, "3m"), *_SUMMARY)


@check("summary_bullish_12m", _summary("12m", "stance_score > 0"))
def summary_bullish(d):
    calls = select_calls(in_days(d.track, *_SPAN), "Bullish")
    return rounded(T.selection_summary(calls, "12m"), *_SUMMARY)


@check("summary_bearish_1m", _summary("1m", "stance_score < 0"))
def summary_bearish(d):
    calls = select_calls(in_days(d.track, *_SPAN), "Bearish")
    return rounded(T.selection_summary(calls, "1m"), *_SUMMARY)


@check("call_histogram", """
, scored AS (SELECT call_3m AS v FROM track WHERE stance_score <> 0 AND call_3m IS NOT NULL),
e AS (SELECT floor(quantile_cont(v, 0.01) / 4) * 4 AS lo, ceil(quantile_cont(v, 0.99) / 4) * 4 AS hi
 FROM scored),
b AS (SELECT floor((greatest(lo, least(hi - 1e-9, v)) - lo) / 4) AS bin, lo FROM scored, e)
SELECT lo + bin * 4 AS start, lo + bin * 4 + 4 AS "end", count(*) AS calls,
 CASE WHEN lo + bin * 4 >= 0 THEN 'Call paid' ELSE 'Call did not pay' END AS side
FROM b GROUP BY lo, bin""")
def call_histogram(d):
    return T.histogram(select_calls(d.track), "3m")


@check("calls_by_quarter", f"""
SELECT CAST(date_trunc('quarter', published_day) AS DATE) AS quarter, count(*) AS calls,
 {r6('median(call_3m)')} AS median, {r6(share('count(*) FILTER (call_3m > 0)', 'count(*)'))}
 AS right_pct
FROM track WHERE stance_score <> 0 AND call_3m IS NOT NULL GROUP BY 1 HAVING count(*) >= 30""")
def calls_by_quarter(d):
    return rounded(T.by_quarter(select_calls(d.track), "3m"), "median", "right_pct")


def _call_rows(order: str, n: int, *returns: str, where: str = "TRUE") -> str:
    cols = ", ".join(f"{r6(c)} AS {c}" for c in returns)
    return f"""
SELECT published_day, ticker, title, author, bucket, {cols}, path, '{HOST}' || path AS url
FROM track WHERE stance_score <> 0 AND {where} ORDER BY {order}{f' LIMIT {n}' if n else ''}"""


@check("best_calls", _call_rows("track.call_3m DESC, path, ticker", 15, "call_3m",
                                where="call_3m IS NOT NULL"))
def best_calls(d):
    return rounded(T.extreme_calls(select_calls(d.track), "3m", True, base=HOST), "call_3m")


@check("worst_calls", _call_rows("track.call_3m, path, ticker", 15, "call_3m",
                                 where="call_3m IS NOT NULL"))
def worst_calls(d):
    return rounded(T.extreme_calls(select_calls(d.track), "3m", False, base=HOST), "call_3m")


_CALLS = [f"call_{m}" for m in MONTHS]


@check("every_call_page", _call_rows("published_day DESC, path, ticker", 500, *_CALLS))
def every_call_page(d):
    return rounded(T.every_call(select_calls(d.track), HOST, T.EVERY_CALL_ROWS), *_CALLS)


@check("every_call", _call_rows("published_day DESC, path, ticker", 0, *_CALLS))
def every_call(d):
    return rounded(T.every_call(select_calls(d.track), HOST), *_CALLS)


@check("author_call_counts", """
SELECT author, count(*) AS calls FROM track WHERE stance_score <> 0 AND author IS NOT NULL
GROUP BY author""")
def author_call_counts(d):
    return T.author_call_counts(d.track)


# --- Q9 ---------------------------------------------------------------------------------
@check("returns_since", f"""
, days AS (SELECT DISTINCT t.price_symbol AS symbol, c.published_day AS day
 FROM coverage c JOIN tickers t ON t.ticker = c.ticker WHERE t.price_symbol IS NOT NULL),
hit AS (SELECT d.symbol, d.day, p.date AS entry_date, p.close AS c0
 FROM days d ASOF LEFT JOIN prices p ON d.symbol = p.symbol AND d.day <= p.date),
ends AS (SELECT symbol, max(date) AS last_date, arg_max_null(close, date) AS c1
 FROM prices GROUP BY symbol)
SELECT h.symbol, h.day, {r6(f"CASE WHEN h.entry_date - h.day <= 7 AND e.last_date > h.entry_date THEN {pct('h.c0', 'e.c1')} END")}
 AS pct_return
FROM hit h LEFT JOIN ends e ON e.symbol = h.symbol""")
def returns_since_days(d):
    symbols = d.tickers.filter(F.col("price_symbol").isNotNull()).select(
        "ticker", F.col("price_symbol").alias("symbol"))
    days = d.coverage.join(symbols, "ticker").select(
        "symbol", F.col("published_day").alias("day")).distinct()
    return rounded(returns_since(days, d.prices).select("symbol", "day", "pct_return"),
                   "pct_return")


# --- Q1, Q8, Q18, A14-A16 -------------------------------------------------------------------
def _study(censor: int, least: int) -> str:
    adj = ", ".join(
        f"{pct('l.close', f'l.c{h}')} - {pct('b.close', f'b.c{h}')} AS adj_{h}d"
        for h in E.HORIZONS)
    usable = "coalesce(" + ", ".join(f"adj_{h}d" for h in E.HORIZONS) + ")"
    return f"""
, cov AS (SELECT k.*, a.stance_score, a.author FROM calls k JOIN articles a ON a.path = k.path),
kept AS (SELECT * FROM cov QUALIFY min(published_day) OVER (PARTITION BY ticker)
   > min(published_day) OVER () + {censor}),
counted AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_day, path)
    AS ordinal, count(*) OVER (PARTITION BY ticker) AS total,
    min(published_day) OVER (PARTITION BY ticker) AS first_day,
    '{E.BENCHMARK}' AS bsym FROM kept),
placed AS (SELECT * FROM counted WHERE total >= {least}),
priced AS (SELECT p.*, l.date AS entry_date, {adj}, b.date AS b_date
 FROM placed p ASOF LEFT JOIN legs l ON p.symbol = l.symbol AND p.published_day <= l.date
 ASOF LEFT JOIN (SELECT * FROM legs WHERE symbol = '{E.BENCHMARK}') b
   ON p.bsym = b.symbol AND p.published_day <= b.date),
entered_ok AS (SELECT * FROM priced WHERE b_date IS NOT NULL AND entry_date - published_day <= 7),
events AS (SELECT *, CASE WHEN ordinal <= 1 THEN '1st article' WHEN ordinal <= 2 THEN '2nd article'
   WHEN ordinal <= 3 THEN '3rd article' WHEN ordinal <= 5 THEN '4th-5th'
   WHEN ordinal <= 10 THEN '6th-10th' ELSE '11th+' END AS bucket,
   CASE WHEN total <= 2 THEN '2 articles' WHEN total <= 5 THEN '3-5' WHEN total <= 10 THEN '6-10'
   WHEN total <= 25 THEN '11-25' ELSE '26+' END AS intensity,
   published_day - first_day AS days_since_first
 FROM entered_ok WHERE {usable} IS NOT NULL)"""


_ADJ = [f"adj_{h}d" for h in E.HORIZONS]


def _table(key: str, order: list[str]) -> str:
    cells = []
    for h in E.HORIZONS:
        c, n = f"adj_{h}d", f"count(adj_{h}d)"
        cells += [f"{n} AS n_{h}d", f"{r6(f'avg({c})')} AS mean_{h}d",
                  f"{r6(f'median({c})')} AS median_{h}d",
                  f"{r6(share(f'count(*) FILTER ({c} > 0)', n))} AS win_{h}d"]
    labels = ", ".join("'" + x + "'" for x in order)
    return (f" SELECT {key}, count(*) AS articles, count(DISTINCT ticker) AS tickers, "
            f"{', '.join(cells)}, CAST(list_position([{labels}], {key}) AS INTEGER) AS position "
            f"FROM events GROUP BY {key}")


_CELLS = [f"{k}_{h}d" for h in E.HORIZONS for k in ("mean", "median", "win")]
_PAIRED = """
, pairs AS (SELECT h.horizon, CASE h.horizon {a} END AS a, CASE h.horizon {b} END AS b
 FROM (SELECT * FROM events WHERE ordinal = 1) f JOIN (SELECT * FROM events WHERE ordinal = 2) s
   ON f.ticker = s.ticker, (SELECT unnest([{hs}]) AS horizon) h),
paired AS (SELECT horizon, count(*) AS tickers, avg(a) AS first_mean, avg(b) AS second_mean,
  median(a) AS first_median, median(b) AS second_median, avg(a - b) AS mean_diff,
  median(a - b) AS median_diff, CAST(count(*) FILTER (a - b > 0) AS DOUBLE) / count(*) * 100
   AS first_wins_pct
 FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY horizon)""".format(
    a=" ".join(f"WHEN '{h}d' THEN f.adj_{h}d" for h in E.HORIZONS),
    b=" ".join(f"WHEN '{h}d' THEN s.adj_{h}d" for h in E.HORIZONS),
    hs=", ".join(f"'{h}d'" for h in E.HORIZONS))
_PAIR_COLS = ["first_mean", "second_mean", "first_median", "second_median", "mean_diff",
              "median_diff", "first_wins_pct"]
_RAW = {"censor_days": 0, "min_articles": 1}


def _build(d, **options):
    return E.Study(d.coverage, d.articles, d.tickers, d.prices, **options)


def _events_sql(censor: int, least: int) -> str:
    return _study(censor, least) + (
        " SELECT ticker, published_day, path, stance_score, ordinal, bucket, "
        "CAST(days_since_first AS INTEGER) AS days_since_first, total AS total_articles, "
        + ", ".join(f"{r6(c)} AS {c}" for c in _ADJ) + " FROM events")


@check("study_events", _events_sql(45, 2))
def study_events(d):
    return rounded(_build(d).events.drop("title", "author"), *_ADJ)


@check("study_events_uncensored", _events_sql(0, 1))
def study_events_uncensored(d):
    return rounded(_build(d, **_RAW).events.drop("title", "author"), *_ADJ)


@check("study_by_ordinal", _study(0, 1) + _table("bucket", E.ORDINAL_ORDER))
def study_by_ordinal(d):
    return rounded(_build(d, **_RAW).by_ordinal, *_CELLS)


@check("study_by_intensity", _study(45, 2) + _table("intensity", E.INTENSITY_ORDER))
def study_by_intensity(d):
    return rounded(_build(d).by_intensity, *_CELLS)


@check("study_paired", _study(0, 1) + _PAIRED + " SELECT horizon, tickers, "
       + ", ".join(f"{r6(c)} AS {c}" for c in _PAIR_COLS) + " FROM paired")
def study_paired(d):
    return rounded(_build(d, **_RAW).paired, *_PAIR_COLS)


@check("study_notes", _study(45, 2) + """
, why AS (SELECT 'censored' AS code, (SELECT count(DISTINCT ticker) FROM cov) -
   (SELECT count(DISTINCT ticker) FROM kept) AS count
 UNION ALL SELECT 'thin', (SELECT count(*) FROM counted WHERE total < 2)
 UNION ALL SELECT 'unpriced', (SELECT count(*) FROM priced) - (SELECT count(*) FROM entered_ok)
 UNION ALL SELECT 'unmeasured', (SELECT count(*) FROM entered_ok) - (SELECT count(*) FROM events))
SELECT * FROM why WHERE count > 0
UNION ALL SELECT 'nothing_left', 0 WHERE NOT EXISTS (SELECT 1 FROM placed)
UNION ALL SELECT 'nothing_measured', 0
  WHERE EXISTS (SELECT 1 FROM placed) AND NOT EXISTS (SELECT 1 FROM events)""")
def study_notes(d):
    return _build(d).notes.drop("text")


@check("study_headline", _study(0, 1) + _PAIRED + """
SELECT count(*) AS events, count(DISTINCT ticker) AS tickers,
  coalesce((SELECT max(tickers) FROM paired), 0) AS paired FROM events""")
def study_headline(d):
    s = _build(d, **_RAW)
    return E.headline(s.events, s.paired)


@check("study_verdict", _study(0, 1) + _PAIRED + f"""
, pick AS (SELECT * FROM paired ORDER BY CASE horizon WHEN '21d' THEN 1 WHEN '63d' THEN 2
   WHEN '5d' THEN 3 ELSE 4 END LIMIT 1),
votes AS (SELECT *, first_wins_pct BETWEEN 45 AND 55 AS even,
   CASE WHEN first_wins_pct BETWEEN 45 AND 55 THEN 0 WHEN first_wins_pct > 50 THEN 1 ELSE -1 END
   AS w FROM pick)
SELECT horizon, tickers, {r6('mean_diff')} AS mean_diff, {r6('median_diff')} AS median_diff,
 {r6('first_wins_pct')} AS first_wins_pct,
 CASE WHEN tickers < 30 THEN 'too_few'
  WHEN sign(median_diff) = 0 OR (sign(mean_diff) <> 0 AND sign(mean_diff) <> sign(median_diff))
    OR (w <> 0 AND w <> sign(median_diff)) THEN 'no_evidence'
  WHEN abs(median_diff) < 0.5 OR even THEN 'coin_flip'
  WHEN mean_diff > 0 THEN 'earlier_better' ELSE 'earlier_worse' END AS code
FROM votes""")
def study_verdict(d):
    return rounded(_build(d, **_RAW).verdict.drop("text"), "mean_diff", "median_diff",
                   "first_wins_pct")


# --- Q4 ---------------------------------------------------------------------------------
_SCORES = _study(0, 1) + f"""
, called AS (SELECT author, ticker, stance_score > 0 AS bull,
   CASE WHEN stance_score > 0 THEN adj_21d ELSE -adj_21d END AS cr
 FROM events WHERE stance_score <> 0 AND adj_21d IS NOT NULL),
base AS (SELECT CAST(count(*) FILTER (cr > 0) AS DOUBLE) / count(*) * 100 AS rate FROM called),
scores AS (SELECT author, count(*) AS calls, count(*) FILTER (cr > 0) AS hits,
  {share('count(*) FILTER (cr > 0)', 'count(*)')} AS hit_rate,
  {wilson('(count(*) FILTER (cr > 0))', 'count(*)', 'lo')} AS ci_low,
  {wilson('(count(*) FILTER (cr > 0))', 'count(*)', 'hi')} AS ci_high,
  avg(cr) AS mean_call_return, median(cr) AS median_call_return,
  {share('count(*) FILTER (bull)', 'count(*)')} AS bullish_share,
  count(DISTINCT ticker) AS tickers FROM called WHERE author IS NOT NULL GROUP BY author),
ranked AS (SELECT author, calls, hits, {r6('hit_rate')} AS hit_rate, {r6('ci_low')} AS ci_low,
 {r6('ci_high')} AS ci_high, {r6('hit_rate - rate')} AS vs_base,
 {r6('mean_call_return')} AS mean_call_return, {r6('median_call_return')} AS median_call_return,
 {r6('bullish_share')} AS bullish_share, tickers, ci_low > rate AS beats_base,
 calls >= 20 AS enough_data FROM scores, base)"""
_SCORE_COLS = ["hit_rate", "ci_low", "ci_high", "vs_base", "mean_call_return",
               "median_call_return", "bullish_share"]


def _scores(d):
    return A.author_scores(d.coverage, d.articles, d.tickers, d.prices)


@check("author_scores", _SCORES + " SELECT * FROM ranked")
def author_scores(d):
    return rounded(_scores(d).authors, *_SCORE_COLS)


@check("author_leaderboard", _SCORES + """
SELECT * FROM ranked WHERE enough_data OR NOT EXISTS (SELECT 1 FROM ranked WHERE enough_data)""")
def author_leaderboard(d):
    return rounded(A.leaderboard(_scores(d).authors), *_SCORE_COLS)


@check("author_base_rate", _SCORES + f"""
SELECT count(*) AS calls, {r6(share('count(*) FILTER (cr > 0)', 'count(*)'))} AS hit_rate,
 count(*) FILTER (bull) AS bullish_calls, count(*) FILTER (NOT bull) AS bearish_calls,
 {r6('avg(cr)')} AS mean_call_return, count(DISTINCT author) AS authors, 21 AS horizon
FROM called""")
def author_base_rate(d):
    return rounded(_scores(d).base, "hit_rate", "mean_call_return")


@check("author_notes", _SCORES + """
SELECT 'calls' AS code, count(*) AS count FROM called
UNION ALL SELECT 'bullish', count(*) FILTER (bull) FROM called
UNION ALL SELECT 'bearish', count(*) FILTER (NOT bull) FROM called
UNION ALL SELECT 'right', count(*) FILTER (cr > 0) FROM called
UNION ALL SELECT 'ranked', count(*) FROM ranked
UNION ALL SELECT 'qualified', count(*) FILTER (enough_data) FROM ranked""")
def author_notes(d):
    return _scores(d).notes.drop("text")


# --- Q2, Q16, A23 --------------------------------------------------------------------------
def _timeline(adjusted: bool) -> str:
    windows = L.MONTH_WINDOWS
    moves = ", ".join(
        f"lag(close, {s}) OVER w AS p{s}, lag(date, {s}) OVER w AS pd{s}, "
        f"lead(close, {s}) OVER w AS n{s}, lead(date, {s}) OVER w AS nd{s}"
        for s in windows.values())
    joins, cols = [], []

    def bench(name: str, day: str) -> str:
        joins.append(f"ASOF LEFT JOIN bench {name} ON a.bsym = {name}.symbol AND {day} <= {name}.date")
        return name

    bench("b0", "a.entry_date")

    def leg(stock: str, b_from: str, b_to: str) -> str:
        if not adjusted:
            return stock
        return (f"{stock} - CASE WHEN {b_to}.idx > {b_from}.idx THEN "
                f"{pct(f'{b_from}.close', f'{b_to}.close')} END")

    for m, s in windows.items():
        cols.append(f"{leg(pct(f'a.p{s}', 'a.close'), bench(f'bp{s}', f'a.pd{s}'), 'b0')} "
                    f"AS before_{m}")
        cols.append(f"{leg(pct('a.close', f'a.n{s}'), 'b0', bench(f'bn{s}', f'a.nd{s}'))} "
                    f"AS after_{m}")
    last = bench("bl", "a.last_date")
    since = leg(pct("a.close", "a.last_close"), "b0", last)
    cols.append(f"CASE WHEN a.last_idx > a.idx THEN {since} END AS since_first")
    return f"""
, cov AS (SELECT ticker, published_day, path, min(published_day) OVER () AS start,
   row_number() OVER (PARTITION BY ticker ORDER BY published_day, path) AS rn,
   min(published_day) OVER (PARTITION BY ticker) AS f
 FROM coverage WHERE verified AND is_primary),
firsts AS (SELECT c.ticker, max(t.name) AS name, max(t.price_symbol) AS symbol,
   min(f) AS first_covered, count(*) AS articles, min(f) <= min(start) + 45 AS censored,
   count(*) FILTER (published_day <= f + 30) AS articles_30d,
   count(*) FILTER (published_day <= f + 90) AS articles_90d,
   CAST(min(published_day) FILTER (rn = 2) - min(f) AS INTEGER) AS days_to_2nd,
   max(published_day) AS latest_article
 FROM cov c LEFT JOIN tickers t ON t.ticker = c.ticker GROUP BY c.ticker),
moves AS (SELECT symbol, date, close, idx, {moves},
   last_value(date) OVER z AS last_date, last_value(close) OVER z AS last_close,
   last_value(idx) OVER z AS last_idx FROM book
 WINDOW w AS (PARTITION BY symbol ORDER BY date), z AS (PARTITION BY symbol ORDER BY date
   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
hits AS (SELECT f.ticker, m.* FROM firsts f ASOF JOIN moves m
   ON f.symbol = m.symbol AND f.first_covered <= m.date WHERE m.date - f.first_covered <= 7),
anchored AS (SELECT f.*, h.* EXCLUDE (ticker, symbol, date), h.date AS entry_date,
   '{E.BENCHMARK}' AS bsym FROM firsts f LEFT JOIN hits h ON h.ticker = f.ticker),
timeline AS (SELECT a.ticker, a.name, a.first_covered, a.articles, a.censored, a.articles_30d,
   a.articles_90d, a.days_to_2nd, a.latest_article, {', '.join(cols)}
 FROM anchored a {' '.join(joins)})"""


_MOVES = [f"{p}_{m}" for m in L.MONTH_WINDOWS for p in ("before", "after")] + ["since_first"]


_ROWS = (f" SELECT * REPLACE ({', '.join(f'{r6(c)} AS {c}' for c in _MOVES)}) FROM timeline")


@check("coverage_timeline", _timeline(True) + _ROWS)
def coverage_timeline(d):
    return rounded(L.coverage_timeline(d.coverage, d.tickers, d.prices), *_MOVES)


@check("coverage_timeline_raw", _timeline(False) + _ROWS)
def coverage_timeline_raw(d):
    return rounded(L.coverage_timeline(d.coverage, d.tickers, d.prices, market_adjusted=False),
                   *_MOVES)


@check("timeline_notes", _timeline(True) + """
SELECT 'censored' AS code, count(*) AS count FROM timeline WHERE censored HAVING count(*) > 0""")
def timeline_notes(d):
    return L.timeline_notes(
        L.coverage_timeline(d.coverage, d.tickers, d.prices), d.prices).drop("text")


@check("before_after_medians", _timeline(True) + " " + " UNION ALL ".join(
    f"SELECT '{m}' AS \"window\", '{p}' AS phase, count({p}_{m}) AS n, "
    f"{r6(f'median({p}_{m})')} AS median FROM timeline HAVING count({p}_{m}) > 0"
    for m in L.MONTH_WINDOWS for p in ("before", "after")))
def before_after_medians(d):
    return rounded(L.before_after(L.coverage_timeline(d.coverage, d.tickers, d.prices)),
                   "median")


@check("coverage_reading", _timeline(True) + f"""
, m AS (SELECT count(*) AS companies, median(articles_30d) AS a, median(before_12m) AS b,
  median(after_12m) AS c FROM timeline)
SELECT companies, a AS median_articles_30d, {r6('b')} AS median_before_12m,
 {r6('c')} AS median_after_12m, CASE WHEN b > 5 AND b > c THEN 'follows the move'
  WHEN c > b THEN 'suggestive' END AS reading FROM m""")
def coverage_reading(d):
    return rounded(L.coverage_reading(L.coverage_timeline(d.coverage, d.tickers, d.prices)),
                   "median_before_12m", "median_after_12m")
