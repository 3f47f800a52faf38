"""The domain views of ``domain.py`` in SQL, plus the oracle's price legs."""

from __future__ import annotations

from callbook.checks.domain import HEADLINES, HOST, SITE
from callbook.functions import stance as S
from callbook.plans.outcomes import TRACK_HORIZONS
from callbook.plans.study import BENCHMARK, HORIZONS


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def r6(expr: str) -> str:
    """Six decimals, without a negative zero."""
    return f"(CASE WHEN round({expr}, 6) = 0 THEN 0.0 ELSE round({expr}, 6) END)"


def significant(expr: str) -> str:
    """Nine significant digits, for values that grow without a bound."""
    return f"CAST(printf('%.8e', {expr}) AS DOUBLE)"


def pct(base: str, exit_: str) -> str:
    return f"(CASE WHEN {base} <> 0 THEN ({exit_} - {base}) / {base} * 100.0 END)"


def letters(n: str) -> str:
    return f"translate(CAST({n} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


def plain_code(n: str) -> str:
    code = " || ".join(f"chr(CAST(65 + {n} // {26 ** k} % 26 AS INTEGER))" for k in (3, 2, 1, 0))
    return f"('S' || {code})"


def ticker_code(n: str) -> str:
    p = plain_code(n)
    return (f"(CASE WHEN {n} % 7 = 0 THEN left({p}, length({p}) - 1) || '.' || "
            f"right({p}, 1) ELSE {p} END)")


def series_symbol(n: str) -> str:
    base = f"replace({ticker_code(n)}, '.', '-')"
    return f"({base} || CASE WHEN {n} % 13 = 0 THEN '.TO' ELSE '' END)"


def matches(column: str, patterns) -> str:
    """Every raw pattern on its own: the oracle does not share the joining it checks."""
    each = (patterns,) if isinstance(patterns, str) else patterns
    return "(" + " OR ".join(f"regexp_matches({column}, {text(p)}, 'i')" for p in each) + ")"


def collapsed(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def label(column: str) -> str:
    """The stance rules, first match wins, in their documented order."""
    t = collapsed(column)

    def has(p):
        return matches(t, p)

    buy = f"({has(S.BUY_STRONG)} OR {has(S.BUY_QUESTION)})"
    sell = f"({has(S.SELL_STRONG)} OR {has(S.SELL_QUESTION)})"
    return (
        f"CASE WHEN {column} IS NULL OR {t} = '' THEN 'analysis' "
        f"WHEN {has(S.INSIDER)} THEN 'insider' WHEN {has(S.COMPARISON)} THEN 'comparison' "
        f"WHEN {buy} AND {sell} THEN 'mixed' WHEN {has(S.BUY_STRONG)} THEN 'buy' "
        f"WHEN {has(S.SELL_STRONG)} THEN 'sell' WHEN {has(S.BUY_QUESTION)} THEN 'buy_lean' "
        f"WHEN {has(S.SELL_QUESTION)} THEN 'sell_lean' "
        f"WHEN {has(S.MOVE_EXPLAINER)} AND NOT {has(S.FORWARD_LOOKING)} THEN 'news' "
        f"WHEN {has(S.HOLD)} THEN 'hold' WHEN {has(S.PREDICTION)} THEN 'prediction' "
        f"WHEN {has(S.WARNING)} THEN 'warning' WHEN {has(S.NEWS)} THEN 'news' "
        "ELSE 'analysis' END")


def score(column: str) -> str:
    return (f"CASE {column} WHEN 'buy' THEN 2 WHEN 'buy_lean' THEN 1 WHEN 'warning' THEN -1 "
            "WHEN 'sell_lean' THEN -1 WHEN 'sell' THEN -2 ELSE 0 END")


def bucket(column: str) -> str:
    return (f"CASE {column} WHEN 'buy' THEN 'Buy' WHEN 'buy_lean' THEN 'Buy (question)' "
            "WHEN 'warning' THEN 'Caution' WHEN 'sell_lean' THEN 'Sell (question)' "
            "WHEN 'sell' THEN 'Sell' ELSE 'No call' END")


def wilson(hits: str, n: str, side: str) -> str:
    p = f"(CAST({hits} AS DOUBLE) / {n})"
    z2 = "(1.96 * 1.96)"
    centre = f"(({p} + {z2} / (2.0 * {n})) / (1 + {z2} / {n}))"
    half = (f"((1.96 / (1 + {z2} / {n})) * "
            f"sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n})))")
    inner = f"greatest(0.0, {centre} - {half})" if side == "lo" else f"least(1.0, {centre} + {half})"
    return f"(CASE WHEN {n} > 0 THEN {inner} * 100 END)"


def share(hits: str, n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN CAST({hits} AS DOUBLE) / {n} * 100 END)"


_shape = "list_extract([" + ", ".join(text(h) for h in HEADLINES) + \
    f"], CAST((o_orderkey + o_custkey) % {len(HEADLINES)} + 1 AS INTEGER))"
_section = "CASE WHEN o_orderpriority = '5-LOW' THEN 'retirement' ELSE 'investing' END"
_desk = "(o_custkey // 10)"


def esc(e: str) -> str:
    return f"replace(replace(replace({e}, '&', '&amp;'), '\"', '&quot;'), '''', '&#x27;')"


_leads = ", ".join(f"lead(close, {h}) OVER w AS c{h}, lead(date, {h}) OVER w AS d{h}"
                   for h in sorted({*HORIZONS, *TRACK_HORIZONS.values()}))
_lead_cols = ", ".join(f"l.c{h}, l.d{h}" for h in TRACK_HORIZONS.values())
_bench_joins = " ".join(
    f"ASOF LEFT JOIN bench b{h} ON e.bsym = b{h}.symbol AND e.d{h} <= b{h}.date"
    for h in TRACK_HORIZONS.values())
_outcome_cols = ", ".join(
    f"{pct('e.entry_close', f'e.c{h}')} AS ret_{h}, "
    f"CASE WHEN e.c{h} IS NOT NULL AND b{h}.idx > b0.idx THEN {pct('b0.close', f'b{h}.close')} END "
    f"AS bench_{h}" for h in TRACK_HORIZONS.values())
_track_cols = ", ".join(
    f"o.ret_{h} - o.bench_{h} AS excess_{m}, "
    f"(o.ret_{h} - o.bench_{h}) * nullif(sign(a.stance_score), 0) AS call_{m}, "
    f"(o.ret_{h} - o.bench_{h}) * nullif(sign(a.stance_score), 0) > 0 AS hit_{m}"
    for m, h in TRACK_HORIZONS.items())

PRELUDE = f"""WITH headlines AS (
 SELECT '/' || {_section} || '/' || strftime(o_orderdate, '%Y/%m/%d') || '/o' ||
   CAST(o_orderkey AS VARCHAR) || '/' AS path,
   replace(replace({_shape}, '{{x}}', 'Acme ' || {letters('o_custkey')}), '{{n}}',
     CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR)) AS title,
   CASE WHEN {_desk} % 25 = 7 THEN '' WHEN {_desk} % 25 = 11 THEN NULL
     ELSE 'Author ' || CAST({_desk} AS VARCHAR) END AS author,
   CAST(o_orderdate AS DATE) AS published_day, {_section} AS section,
   o_orderkey AS key, o_custkey AS cust, o_orderstatus AS order_state, o_orderpriority AS priority
 FROM orders),
labelled AS (SELECT *, {label('title')} AS stance FROM headlines),
articles AS (SELECT path, title, author, published_day, section, stance,
   CAST({score('stance')} AS INTEGER) AS stance_score, key FROM labelled),
coverage AS (
 SELECT {ticker_code('l_suppkey')} AS ticker, h.path, h.published_day, p.is_primary,
   CASE WHEN p.is_primary THEN 'primary_meta' ELSE 'meta' END AS source,
   l_suppkey % 11 <> 4 AS verified
 FROM (SELECT l_orderkey, l_suppkey, bool_or(l_linenumber = 1) AS is_primary
       FROM lineitem GROUP BY ALL) p JOIN headlines h ON h.key = p.l_orderkey),
prices AS (
 SELECT {series_symbol('l_suppkey')} AS symbol, CAST(l_shipdate AS DATE) AS date,
   CASE WHEN CAST(sum(l_quantity) AS BIGINT) <> 13 THEN max(l_extendedprice) END AS close,
   CAST(sum(l_quantity) AS BIGINT) AS volume
 FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
 UNION ALL
 SELECT '{BENCHMARK}', CAST(l_shipdate AS DATE),
   CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*),
   CAST(sum(l_quantity) AS BIGINT)
 FROM lineitem GROUP BY CAST(l_shipdate AS DATE)),
tickers AS (
 SELECT {ticker_code('s_suppkey')} AS ticker,
   CASE WHEN s_suppkey % 6 <> 2 THEN s_name END AS name,
   CASE WHEN s_suppkey % 17 <> 5 THEN {series_symbol('s_suppkey')} END AS price_symbol,
   (s_suppkey % 17 = 5 AND s_suppkey % 2 = 1) AS price_failed,
   CASE WHEN s_suppkey % 3 <> 0 THEN DATE '1995-06-01' + CAST(s_suppkey % 900 AS INTEGER) END
     AS first_seen_day,
   CASE WHEN s_suppkey % 5 = 0 THEN DATE '1993-12-01' END AS history_from
 FROM supplier),
universe AS (
 SELECT CASE WHEN s_suppkey % 11 = 4 THEN 'X' ELSE 'S' END || substr({ticker_code('s_suppkey')}, 2)
   AS ticker,
   upper(s_name) AS name,
   CASE WHEN s_nationkey < 13 THEN 'NASDAQ' ELSE 'N' END AS exchange, s_acctbal < 0 AS is_etf
 FROM supplier),
frontier AS (
 SELECT path, section, published_day, CASE order_state WHEN 'F' THEN 'failed'
   WHEN 'O' THEN 'pending' ELSE 'done' END AS state, CAST(key % 7 AS INTEGER) AS attempts,
   CAST(NULL AS VARCHAR) AS last_error FROM headlines),
book AS (
 SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx
 FROM prices WHERE close IS NOT NULL),
bench AS (SELECT * FROM book WHERE symbol = '{BENCHMARK}'),
legs AS (SELECT symbol, date, close, idx, {_leads} FROM book
 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
calls AS (
 SELECT c.path, c.ticker, c.published_day, t.price_symbol AS symbol
 FROM coverage c JOIN tickers t ON t.ticker = c.ticker
 WHERE c.is_primary AND c.verified AND t.price_symbol IS NOT NULL),
entered AS (
 SELECT k.path, k.ticker, k.published_day, '{BENCHMARK}' AS bsym, l.date AS entry_date,
   l.close AS entry_close, {_lead_cols}
 FROM calls k LEFT JOIN (
   SELECT k.path, k.ticker, l.* FROM calls k ASOF JOIN legs l
     ON k.symbol = l.symbol AND k.published_day <= l.date
   WHERE date_diff('day', k.published_day, l.date) <= 7) l
 ON l.path = k.path AND l.ticker = k.ticker),
outcomes AS (
 SELECT e.path, e.ticker, e.published_day, e.entry_date, e.entry_close, {_outcome_cols}
 FROM entered e ASOF LEFT JOIN bench b0 ON e.bsym = b0.symbol AND e.entry_date <= b0.date
 {_bench_joins}),
track AS (
 SELECT o.*, a.title, a.author, a.stance, a.stance_score, {bucket('a.stance')} AS bucket,
   {_track_cols}
 FROM outcomes o JOIN articles a ON a.path = o.path)
"""

__all__ = ["PRELUDE", "HOST", "SITE"]
