"""The coverage tables as views over the given star-schema tables.

Orders stand for articles, order lines for coverage, suppliers for listed
companies, and a supplier's line prices by ship date for its daily closes. The
same definitions in SQL are in ``prelude.py``. Articles, coverage and prices are
stored tables in real use and most queries read them several times, so they are
settled once per query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.functions.stance import with_stance
from callbook.plans.outcomes import compute_outcomes, track_record
from callbook.plans.study import BENCHMARK
from callbook.session import settle

SITE = "Daily Ledger"
HOST = "https://www.example.com"
#: Articles that one task makes a page of or labels.
TASK_ROWS = 50_000

#: Headline shapes; {x} is a company, {n} a number. NULL and blank titles occur.
HEADLINES = [
    "{n} Growth Stocks to Buy for the Next Decade",
    "3 Reasons to Buy {x} Before Summer",
    "Is {x} Stock a Buy After Its Latest Report?",
    "Should You Buy {x} While It Trades Below ${n}?",
    "Time to Sell {x}? The Case Is Getting Stronger",
    "{n} Overvalued Companies to Avoid This Winter",
    "Should You Sell {x} Today?",
    "Should Investors Worry About {x}?",
    "2 Stocks to Buy and 1 to Sell as {x} Stumbles",
    "1 Chip Stock to Buy, 1 to Avoid",
    "Patient Owners of {x} Should Sit Tight",
    "{x}: The Smart Move Is to Hold",
    "{x} vs. Its Largest Rival",
    "Which Dividend Stock Is the Better Choice, {x} or Cash?",
    "{x} CFO Sells Part of a Large Stake",
    "Fund Buys {n},000 Shares of {x}",
    "Prediction: {x} Will Reach a New High by 2035",
    "Here's What History Says About {x}",
    "Why {x} Stock Jumped {n}% Today",
    "Why   {x}\tFell  This Week ",
    "{x} Earnings Call Highlights",
    "{x} Announces a Stock Split",
    "Bad News for {x} Shareholders",
    "{x} Could Be Heading for Trouble",
    "Why a Crash at {x} Might Be Coming",
    "A Closer Look at {x}",
    "What {x} Has to Prove & What \"Good\" Means",
    "",
    "   ",
    None,
    "A No-Brainer Stock at ${n}",
    "Inside the {x} Factory",
]


def letters(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", "ABCDEFGHIJ")


def _code(n: Column, dot: str = "", end: Column | None = None) -> Column:
    """S and four letters, base 26; ``dot`` stands before the last one of a share class.

    Each letter is made once: a long expression makes a method that the JVM does not compile.
    """
    *first, last = [F.char(F.floor(n / 26 ** k) % 26 + 65) for k in (3, 2, 1, 0)]
    share = F.when(n % 7 == 0, dot).otherwise("") if dot else F.lit("")
    return F.concat(F.lit("S"), *first, share, last, F.lit("") if end is None else end)


def plain_code(n: Column) -> Column:
    """Ticker as pages write it, without the dot of a share class: S and four letters, base 26."""
    return _code(n)


def ticker_code(n: Column) -> Column:
    return _code(n, ".")


def series_symbol(n: Column) -> Column:
    return _code(n, "-", F.when(n % 13 == 0, ".TO").otherwise(""))


def path_of(section: Column, day: Column, key: Column) -> Column:
    return F.concat(F.lit("/"), section, F.lit("/"), F.date_format(day, "yyyy/MM/dd"),
                    F.lit("/o"), key.cast("string"), F.lit("/"))


class Domain:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def headlines(self) -> DataFrame:
        """Articles without a stance."""
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        day = F.to_date("o_orderdate")
        section = F.when(F.col("o_orderpriority") == "5-LOW", "retirement").otherwise("investing")
        shape = F.element_at(F.array(*[F.lit(h) for h in HEADLINES]),
                             ((key + cust) % len(HEADLINES) + 1).cast("int"))
        company = F.concat(F.lit("Acme "), letters(cust))
        number = F.floor(F.col("o_totalprice") / 1000).cast("bigint").cast("string")
        desk = F.floor(cust / 10).cast("bigint")
        author = (F.when(desk % 25 == 7, "").when(desk % 25 == 11, F.lit(None))
                  .otherwise(F.concat(F.lit("Author "), desk.cast("string"))))
        return self.table("orders").select(
            path_of(section, day, key).alias("path"),
            F.replace(F.replace(shape, F.lit("{x}"), company), F.lit("{n}"), number)
            .alias("title"),
            author.alias("author"), day.alias("published_day"), section.alias("section"),
            key.alias("key"), cust.alias("cust"), F.col("o_orderstatus").alias("order_state"),
            F.col("o_orderpriority").alias("priority"))

    @cached_property
    def articles(self) -> DataFrame:
        """Labelled once, as at ingest, and stored."""
        return settle(with_stance(self._spread(self.headlines)).select(
            "path", "title", "author", "published_day", "section", "stance", "stance_score"))

    def _spread(self, df: DataFrame) -> DataFrame:
        """Give a file that arrives in a few splits to all cores, in tasks of a bounded number of rows."""
        parts = max(self.spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
        return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)

    @cached_property
    def coverage(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
        supp = F.col("l_suppkey")
        # Joined and grouped by what a path is made of, which is narrower; a path without a day is NULL.
        day = F.col("published_day")
        arts = self.headlines.select(F.col("key").alias("l_orderkey"), "published_day",
                                     F.when(day.isNotNull(), F.col("section") == "retirement").alias("retirement"))
        pairs = lines.join(arts, "l_orderkey").groupBy(
            "l_orderkey", "l_suppkey", "retirement", "published_day"
        ).agg(F.bool_or(F.col("l_linenumber") == 1).alias("is_primary"))
        section = F.when(F.col("retirement"), "retirement").otherwise("investing")
        return settle(pairs.select(
            ticker_code(supp).alias("ticker"), path_of(section, day, F.col("l_orderkey")).alias("path"),
            "published_day", "is_primary",
            F.when(F.col("is_primary"), "primary_meta").otherwise("meta").alias("source"),
            (supp % 11 != 4).alias("verified")))

    @cached_property
    def prices(self) -> DataFrame:
        day = F.to_date("l_shipdate").alias("date")
        lines = self.table("lineitem")
        quantity = F.sum("l_quantity").cast("bigint")
        stocks = (
            lines.groupBy("l_suppkey", day)
            .agg(F.max("l_extendedprice").alias("top"), quantity.alias("volume"))
            .select(series_symbol(F.col("l_suppkey")).alias("symbol"), "date",
                    F.when(F.col("volume") != 13, F.col("top")).alias("close"), "volume"))
        total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
        index = lines.groupBy(day).agg(
            (total / F.count(F.lit(1))).alias("close"), quantity.alias("volume")
        ).select(F.lit(BENCHMARK).alias("symbol"), "date", "close", "volume")
        return settle(stocks.unionByName(index))

    @cached_property
    def tickers(self) -> DataFrame:
        n = F.col("s_suppkey")
        first = F.lit("1995-06-01").cast("date")
        return self.table("supplier").select(
            ticker_code(n).alias("ticker"),
            F.when(n % 6 != 2, F.col("s_name")).alias("name"),
            F.when(n % 17 != 5, series_symbol(n)).alias("price_symbol"),
            ((n % 17 == 5) & (n % 2 == 1)).alias("price_failed"),
            F.when(n % 3 != 0, F.date_add(first, n.cast("int") % 900)).alias("first_seen_day"),
            F.when(n % 5 == 0, F.lit("1993-12-01").cast("date")).alias("history_from"))

    @cached_property
    def universe(self) -> DataFrame:
        n = F.col("s_suppkey")
        # Some companies are listed under another line than the covered one.
        line = F.when(n % 11 == 4, "X").otherwise("S")
        return self.table("supplier").select(
            F.concat(line, F.substr(ticker_code(n), F.lit(2))).alias("ticker"), F.upper("s_name").alias("name"),
            F.when(F.col("s_nationkey") < 13, "NASDAQ").otherwise("N").alias("exchange"),
            (F.col("s_acctbal") < 0).alias("is_etf"))

    @cached_property
    def frontier(self) -> DataFrame:
        state = (F.when(F.col("order_state") == "F", "failed")
                 .when(F.col("order_state") == "O", "pending").otherwise("done"))
        return self.headlines.select(
            "path", "section", "published_day", state.alias("state"),
            (F.col("key") % 7).cast("int").alias("attempts"),
            F.lit(None).cast("string").alias("last_error"))

    @cached_property
    def fetch_results(self) -> DataFrame:
        kind = (F.when(F.col("priority") == "1-URGENT", "gone")
                .when(F.col("priority") == "2-HIGH", "failed")
                .when(F.col("priority") == "3-MEDIUM", "deferred")
                .when(F.col("priority") == "4-NOT SPECIFIED", "throttled").otherwise("ok"))
        waiting = self.headlines.filter(F.col("order_state") == "O")
        return waiting.select("path", kind.alias("kind"),
                              F.repeat(F.concat("priority", F.lit(" ")), F.lit(40))
                              .alias("message"))

    @cached_property
    def landed(self) -> DataFrame:
        """Article pages as they would be fetched."""
        def escaped(c: Column) -> Column:
            return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'),
                                       F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))

        key, cust = F.col("key"), F.col("cust")
        title = escaped(F.coalesce("title", F.lit("")))
        suppliers = self.table("supplier").agg(F.max("s_suppkey")).scalar()
        a, b, c = (x % suppliers + 1 for x in (cust, key, cust + key))
        listed = F.concat_ws(
            ",", plain_code(a), F.lower(plain_code(b)), F.concat(F.lit(" "), plain_code(a)),
            F.lit("12345"), F.lit("TOOLONGTICKER"), F.replace(ticker_code(b), F.lit("."),
                                                              F.lit("-")))
        primary = F.when(key % 4 == 0, ticker_code(c)).otherwise(plain_code(a))
        og = F.when(key % 3 != 0, F.concat(
            F.lit('<meta property="og:title" content="'), title, F.lit(f' | {SITE}"/>'))
        ).otherwise("")
        return self._spread(self.headlines).select("path", F.concat(
            F.lit("<html><head>\n<title>Page "), title, F.lit(f" | {SITE}</title>\n"),
            F.lit('<meta name="author" content="'), F.coalesce("author", F.lit("")),
            F.lit('"/>\n<META NAME="author" content="Second Hand"/>\n'),
            F.lit('<meta name="tickers" content="'), listed, F.lit('"/>\n'),
            F.lit('<meta name="primary_tickers" content="'), primary, F.lit('"/>\n'), og,
            F.lit("</head>\n<body>About "), title,
            F.lit('<meta name="author" content="In the Body"/></body></html>'),
        ).alias("html"))

    @cached_property
    def sitemap_pages(self) -> DataFrame:
        """One little sitemap page per article, filed under its month."""
        return self.headlines.select(
            F.date_format("published_day", "yyyy/MM").alias("month"),
            F.concat(F.lit(f"<urlset><url><loc>{HOST}"), "path",
                     F.lit(f"?from=map#top</loc></url><url><loc>{HOST}/"), "section",
                     F.lit(f"/about/</loc></url><url><loc>{HOST}/sitemap/"),
                     F.date_format("published_day", "yyyy/MM"),
                     F.lit("/</loc></url></urlset>")).alias("body"))

    @cached_property
    def runs(self) -> DataFrame:
        kind = (F.when(F.col("event_type") == "view", "daily")
                .when(F.col("event_type") == "click", "crawl").otherwise("backfill"))
        return self.table("events").select(
            kind.alias("kind"), F.col("ts").cast("timestamp").alias("finished_ts"))

    @cached_property
    def outcomes(self) -> DataFrame:
        return compute_outcomes(self.coverage, self.tickers, self.prices)

    @cached_property
    def track(self) -> DataFrame:
        return track_record(self.outcomes, self.articles)
