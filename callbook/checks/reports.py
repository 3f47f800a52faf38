"""Coverage reports."""

from __future__ import annotations

from callbook.checks.domain import HOST
from callbook.checks.prelude import bucket, pct, r6
from callbook.checks.registry import check, rounded
from callbook.operators.ordering import with_ordinal
from callbook.plans import reports as R

FIRST, LAST = "1996-01-01", "2000-06-30"
_DAYS = f"published_day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"
_SCORED = """
, scored AS (SELECT c.*, a.title, a.author, a.stance, a.stance_score FROM coverage c
 JOIN articles a ON a.path = c.path)"""


def avg2(expr: str) -> str:
    return f"CAST(round(CAST(avg({expr}) AS DECIMAL(18, 10)), 2) AS DOUBLE)"


@check("kpis", f"""
SELECT (SELECT count(*) FROM articles WHERE {_DAYS}) AS articles,
 (SELECT count(DISTINCT ticker) FROM coverage WHERE {_DAYS} AND is_primary) AS tickers,
 (SELECT count(DISTINCT author) FROM articles WHERE {_DAYS}) AS authors""")
def kpis(d):
    return R.kpis(d.articles, d.coverage, FIRST, LAST, primary_only=True)


@check("stance_mix", f"""
SELECT {bucket('stance')} AS bucket, count(*) AS n FROM articles WHERE {_DAYS} GROUP BY 1""")
def stance_mix(d):
    return R.stance_mix(d.articles, FIRST, LAST)


@check("bull_bear", f"""
SELECT count(*) FILTER (stance_score > 0) AS bull, count(*) FILTER (stance_score < 0) AS bear,
 {r6("CAST(count(*) FILTER (stance_score > 0) AS DOUBLE) / nullif(count(*) FILTER (stance_score < 0), 0)")}
 AS bull_per_bear FROM articles WHERE {_DAYS}""")
def bull_bear(d):
    return rounded(R.bull_bear(d.articles, FIRST, LAST), "bull_per_bear")


@check("daily_volume", f"""
SELECT published_day AS day, count(*) AS articles, CAST(sum(stance_score) AS BIGINT) AS net_stance
FROM articles WHERE {_DAYS} GROUP BY 1""")
def daily_volume(d):
    return R.daily_volume(d.articles, FIRST, LAST)


def _periods(step: str, period: str, unit: str, days: str) -> str:
    return f"""
, rolled AS (SELECT CAST({period} AS DATE) AS period, count(*) AS articles,
   CAST(sum(stance_score) AS BIGINT) AS net_stance FROM articles WHERE {days} GROUP BY 1),
grid AS (SELECT CAST(unnest(generate_series(CAST(min(period) AS TIMESTAMP),
   CAST(max(period) AS TIMESTAMP), INTERVAL {step})) AS DATE) AS period FROM rolled)
SELECT '{unit}' AS unit, g.period, coalesce(r.articles, 0) AS articles,
 coalesce(r.net_stance, 0) AS net_stance FROM grid g LEFT JOIN rolled r ON r.period = g.period"""


_WEEKS = "published_day BETWEEN DATE '1997-03-03' AND DATE '1998-02-20'"
_SHORT = "published_day BETWEEN DATE '1997-03-03' AND DATE '1997-04-10'"
_MONDAY = "published_day + CAST((8 - isodow(published_day)) % 7 AS INTEGER)"


@check("volume_by_month", _periods("1 MONTH", "date_trunc('month', published_day)", "Month", "TRUE"))
def volume_by_month(d):
    return R.volume_by_period(d.articles)


@check("volume_by_week", _periods("7 DAY", _MONDAY, "Week", _WEEKS))
def volume_by_week(d):
    return R.volume_by_period(d.articles, "1997-03-03", "1998-02-20")


@check("volume_by_day", _periods("1 DAY", "published_day", "Day", _SHORT))
def volume_by_day(d):
    return R.volume_by_period(d.articles, "1997-03-03", "1997-04-10")


@check("ticker_periods", _SCORED + f"""
, spans AS (SELECT ticker, max(published_day) - min(published_day) AS span FROM scored
 WHERE verified GROUP BY 1),
placed AS (SELECT s.ticker, CASE WHEN span <= 45 THEN 'Day' WHEN span <= 400 THEN 'Week'
   ELSE 'Month' END AS unit, CAST(CASE WHEN span <= 45 THEN published_day
   WHEN span <= 400 THEN {_MONDAY} ELSE date_trunc('month', published_day) END AS DATE) AS period,
   stance_score FROM scored s JOIN spans USING (ticker) WHERE verified),
rolled AS (SELECT ticker, unit, period, count(*) AS articles,
   CAST(sum(stance_score) AS BIGINT) AS net_stance FROM placed GROUP BY ALL),
grid AS (SELECT ticker, unit, CAST(unnest(CASE unit
    WHEN 'Day' THEN generate_series(CAST(min(period) AS TIMESTAMP), CAST(max(period) AS TIMESTAMP), INTERVAL 1 DAY)
    WHEN 'Week' THEN generate_series(CAST(min(period) AS TIMESTAMP), CAST(max(period) AS TIMESTAMP), INTERVAL 7 DAY)
    ELSE generate_series(CAST(min(period) AS TIMESTAMP), CAST(max(period) AS TIMESTAMP), INTERVAL 1 MONTH)
   END) AS DATE) AS period FROM rolled GROUP BY ticker, unit)
SELECT g.ticker, g.unit, g.period, coalesce(r.articles, 0) AS articles,
 coalesce(r.net_stance, 0) AS net_stance
FROM grid g LEFT JOIN rolled r ON r.ticker = g.ticker AND r.period = g.period""")
def ticker_periods(d):
    return R.ticker_periods(d.coverage, d.articles, verified_only=True)


@check("top_tickers", _SCORED + f"""
, top AS (SELECT ticker, count(*) AS articles, min(published_day) AS first_covered,
  max(published_day) AS last_covered, {avg2('stance_score')} AS avg_stance
 FROM scored WHERE {_DAYS} GROUP BY ticker ORDER BY articles DESC, ticker LIMIT 200)
SELECT top.ticker, t.name, articles, first_covered, last_covered, avg_stance
FROM top LEFT JOIN tickers t ON t.ticker = top.ticker""")
def top_tickers(d):
    return R.top_tickers(d.coverage, d.articles, d.tickers, FIRST, LAST)


@check("top_tickers_all", _SCORED + f"""
, top AS (SELECT ticker, count(*) AS articles, min(published_day) AS first_covered,
  max(published_day) AS last_covered, {avg2('stance_score')} AS avg_stance
 FROM scored WHERE {_DAYS} GROUP BY ticker)
SELECT top.ticker, t.name, articles, first_covered, last_covered, avg_stance
FROM top LEFT JOIN tickers t ON t.ticker = top.ticker""")
def top_tickers_all(d):
    return R.top_tickers(d.coverage, d.articles, d.tickers, FIRST, LAST, n=None)


@check("ticker_options", """
, counts AS (SELECT ticker, count(*) AS n FROM coverage WHERE is_primary GROUP BY 1)
SELECT c.ticker, c.n, t.name, c.ticker || CASE WHEN coalesce(t.name, '') <> ''
  THEN ' — ' || t.name ELSE '' END || '  (' || c.n || ' articles)' AS label
FROM counts c LEFT JOIN tickers t ON t.ticker = c.ticker""")
def ticker_options(d):
    return R.ticker_options(d.coverage, d.tickers, primary_only=True)


@check("ticker_summary", _SCORED + f"""
SELECT ticker, min(published_day) AS first_day, max(published_day) AS last_day,
 CAST(max(published_day) - min(published_day) AS INTEGER) AS days, count(*) AS articles,
 {r6('avg(stance_score)')} AS avg_stance
FROM scored WHERE is_primary AND verified GROUP BY ticker""")
def ticker_summary(d):
    return rounded(R.ticker_summary(d.coverage, d.articles, primary_only=True,
                                    verified_only=True), "avg_stance")


@check("ticker_articles", _SCORED + f"""
SELECT ticker, published_day, title, author, {bucket('stance')} AS bucket, stance_score,
 is_primary AS "primary", path, '{HOST}' || path AS url FROM scored WHERE is_primary""")
def ticker_articles(d):
    return R.ticker_articles(d.coverage, d.articles, base=HOST, primary_only=True)


@check("article_panel", _SCORED + f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker
    ORDER BY published_day DESC, title ASC NULLS FIRST, path) AS rank,
   count(*) OVER (PARTITION BY ticker) AS total FROM scored)
SELECT ticker, published_day, title, author, {bucket('stance')} AS bucket, stance_score,
 is_primary AS "primary", path, '{HOST}' || path AS url, CAST(rank AS INTEGER) AS rank, total
FROM ranked WHERE rank <= 25""")
def article_panel(d):
    return R.article_panel(d.coverage, d.articles, base=HOST)


@check("article_ordinals", """
SELECT ticker, path, row_number() OVER (PARTITION BY ticker ORDER BY published_day, path) AS ordinal,
 count(*) OVER (PARTITION BY ticker) AS total,
 min(published_day) OVER (PARTITION BY ticker) AS first_day FROM coverage""")
def article_ordinals(d):
    return with_ordinal(d.coverage.select("ticker", "path", "published_day"), "ticker",
                        "published_day", ["path"]).drop("published_day")


@check("ticker_price_history", f"""
, firsts AS (SELECT c.ticker, min(c.published_day) AS first_day, max(t.price_symbol) AS symbol
 FROM coverage c LEFT JOIN tickers t ON t.ticker = c.ticker WHERE c.is_primary GROUP BY 1),
own AS (SELECT f.ticker, count(*) AS n, arg_min(b.close, b.date) AS c0, arg_max(b.close, b.date) AS c1
 FROM firsts f JOIN book b ON b.symbol = f.symbol AND b.date >= f.first_day GROUP BY 1),
idx AS (SELECT f.ticker, count(*) AS n, arg_min(b.close, b.date) AS c0, arg_max(b.close, b.date) AS c1
 FROM firsts f JOIN bench b ON b.date >= f.first_day WHERE f.symbol IS NOT NULL GROUP BY 1),
both_ AS (SELECT f.*, CASE WHEN o.n > 1 THEN {pct('o.c0', 'o.c1')} END AS s,
  CASE WHEN i.n > 1 THEN {pct('i.c0', 'i.c1')} END AS b
 FROM firsts f LEFT JOIN own o USING (ticker) LEFT JOIN idx i USING (ticker))
SELECT ticker, first_day, symbol, {r6('s')} AS since_first, {r6('b')} AS bench_since_first,
 {r6('s - b')} AS gap FROM both_""")
def ticker_price_history(d):
    return rounded(R.ticker_price_history(d.coverage, d.tickers, d.prices, primary_only=True),
                   "since_first", "bench_since_first", "gap")


@check("rebased_prices", """
, firsts AS (SELECT ticker, min(published_day) AS first_day FROM coverage WHERE is_primary GROUP BY 1)
SELECT f.ticker, p.date, p.close FROM firsts f JOIN tickers t ON t.ticker = f.ticker
JOIN prices p ON p.symbol = t.price_symbol AND p.date >= f.first_day""")
def rebased_prices(d):
    return R.rebased_prices(d.coverage, d.tickers, d.prices, primary_only=True)


_FLIPS = _SCORED + f"""
, linked AS (SELECT *, lag(stance_score) OVER w AS prev_score, lag(published_day) OVER w AS prev_day,
  lag(title) OVER w AS prev_title, lag(path) OVER w AS prev_path
 FROM scored WHERE stance_score <> 0 {{where}}
 WINDOW w AS (PARTITION BY ticker ORDER BY published_day, path))
SELECT ticker, CASE WHEN stance_score > 0 THEN 'turned bullish' ELSE 'turned cautious' END
  AS direction, prev_day, prev_title, prev_score, '{HOST}' || prev_path AS prev_url,
 published_day, title, stance_score, '{HOST}' || path AS url,
 CAST(published_day - prev_day AS INTEGER) AS days_between, author
FROM linked WHERE prev_score IS NOT NULL AND (stance_score > 0) <> (prev_score > 0)
 AND {_DAYS}"""


@check("stance_flips", _FLIPS.format(where="AND is_primary") +
       " ORDER BY published_day DESC, ticker, path LIMIT 200")
def stance_flips(d):
    return R.stance_flips(d.coverage, d.articles, FIRST, LAST, base=HOST, primary_only=True)


@check("stance_flips_all", _FLIPS.format(where=""))
def stance_flips_all(d):
    return R.stance_flips(d.coverage, d.articles, FIRST, LAST, n=None, base=HOST)


@check("coverage_spikes", f"""
, ref AS (SELECT max(published_day) AS r FROM articles),
counts AS (SELECT ticker, count(*) FILTER (published_day > r - 30) AS last_30d,
  count(*) FILTER (published_day <= r - 30 AND published_day > r - 120) / 3.0 AS prior_avg_30d,
  max(published_day) AS latest FROM coverage, ref GROUP BY ticker),
busiest AS (SELECT * FROM counts WHERE last_30d >= 3 ORDER BY last_30d DESC, ticker LIMIT 200)
SELECT b.ticker, t.name, CASE WHEN prior_avg_30d > 0 THEN 'accelerating' ELSE 'newly covered' END
  AS status, last_30d, {r6('prior_avg_30d')} AS prior_avg_30d,
 {r6('CASE WHEN prior_avg_30d > 0 THEN last_30d / prior_avg_30d END')} AS multiple, latest
FROM busiest b LEFT JOIN tickers t ON t.ticker = b.ticker""")
def coverage_spikes(d):
    return rounded(R.coverage_spikes(d.coverage, d.articles, d.tickers), "prior_avg_30d",
                   "multiple")


@check("coverage_spikes_all", f"""
, ref AS (SELECT max(published_day) AS r FROM articles),
counts AS (SELECT ticker, count(*) FILTER (published_day > r - 30) AS last_30d,
  count(*) FILTER (published_day <= r - 30 AND published_day > r - 120) / 3.0 AS prior_avg_30d,
  max(published_day) AS latest FROM coverage, ref GROUP BY ticker),
busiest AS (SELECT * FROM counts WHERE last_30d >= 3)
SELECT b.ticker, t.name, CASE WHEN prior_avg_30d > 0 THEN 'accelerating' ELSE 'newly covered' END
  AS status, last_30d, {r6('prior_avg_30d')} AS prior_avg_30d,
 {r6('CASE WHEN prior_avg_30d > 0 THEN last_30d / prior_avg_30d END')} AS multiple, latest
FROM busiest b LEFT JOIN tickers t ON t.ticker = b.ticker""")
def coverage_spikes_all(d):
    return rounded(R.coverage_spikes(d.coverage, d.articles, d.tickers, n=None), "prior_avg_30d",
                   "multiple")


_AUTHORS = f"""
, arts AS (SELECT author, count(*) AS articles, {avg2('stance_score')} AS avg_stance,
  min(published_day) AS first_seen, max(published_day) AS last_seen
 FROM articles WHERE {_DAYS} AND author <> '' GROUP BY author),
tick AS (SELECT a.author, count(DISTINCT c.ticker) AS tickers FROM articles a
 JOIN coverage c ON c.path = a.path AND c.is_primary
 WHERE a.{_DAYS} AND a.author <> '' GROUP BY a.author),
authors AS (SELECT arts.*, coalesce(tick.tickers, 0) AS tickers FROM arts
 LEFT JOIN tick ON tick.author = arts.author)"""


@check("author_table", _AUTHORS + " SELECT * FROM authors")
def author_table(d):
    return R.author_table(d.articles, d.coverage, FIRST, LAST)


@check("author_summary", _AUTHORS + """
SELECT count(*) AS authors, median(articles) AS median_articles,
 (SELECT author FROM authors ORDER BY articles DESC, author LIMIT 1) AS most_prolific FROM authors""")
def author_summary(d):
    return R.author_summary(R.author_table(d.articles, d.coverage, FIRST, LAST))


@check("turned_cautious", _SCORED + f"""
, sides AS (SELECT ticker,
  {avg2("CASE WHEN published_day < DATE '1998-01-01' THEN stance_score END")} AS before,
  {avg2("CASE WHEN published_day >= DATE '1998-01-01' THEN stance_score END")} AS since,
  count(*) AS articles FROM scored WHERE is_primary GROUP BY ticker)
SELECT * FROM sides WHERE articles >= 20 AND before > 0.2 AND since < 0.2""")
def turned_cautious(d):
    return R.turned_cautious(d.coverage, d.articles, "1998-01-01", above=0.2, below=0.2)
