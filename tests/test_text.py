from __future__ import annotations

import html
import random
from datetime import date
from html.entities import html5

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from callbook.functions import dates as D
from callbook.functions import text as X
from callbook.functions.entities import html_unescape

LISTED = ["KWIM", "ORB", "LUM.C", "LUM.D", "ZAFFO", "PEX", "Q"]


def test_path_of(spark):
    df = spark.createDataFrame([("https://www.example.com/investing/2026/09/16/x/?a=1#frag",)],
                               "url string")
    assert rows(df.select(X.path_of(F.col("url"), "https://www.example.com"))) == [
        ("/investing/2026/09/16/x/",)]


@pytest.mark.parametrize("path,section,day", [
    ("/markets-2/1999/12/01/x/", "markets-2", date(1999, 12, 1)),
    ("/a/2024/02/29/leap", "a", date(2024, 2, 29)),
    ("/a/2023/02/29/no-leap/", "a", None),
    ("/a/2023/13/01/month/", "a", None),
    ("/Upper/2023/01/01/x/", None, None),
    ("/a/23/01/01/short-year/", None, None),
    ("/a/2023/01/01/x/deeper/", None, None),
    ("/", None, None),
])
def test_dated_paths(spark, path, section, day):
    df = spark.createDataFrame([(path,)], "p string")
    assert rows(df.select(X.path_section(F.col("p")), X.path_day(F.col("p")))) == [(section, day)]


def test_sections(spark):
    df = spark.createDataFrame([("/investing/x/",), ("/other/x/",)], "p string")
    assert rows(df.select(X.section_ok(F.col("p"), ["investing"]))) == [(True,), (False,)]
    assert rows(df.select(X.section_ok(F.col("p"), []))) == [(True,), (True,)]


def by_hand(raw: str) -> str | None:
    import re

    t = raw.strip().upper().replace("-", ".")
    if not re.fullmatch(r"[A-Z][A-Z.]{0,6}", t) or not 1 <= len(t.split(".")[0]) <= 5:
        return None
    dotted = t[:-1] + "." + t[-1]
    restore = "." not in t and len(t) >= 3 and t not in LISTED and dotted in LISTED
    return dotted if restore else t


def test_ticker_normalisation(spark):
    universe = spark.createDataFrame([(t,) for t in LISTED], "ticker string")
    raws = ["LUMC", "lumd", "lum-d", "LUM.C", "\tPex\n", "ZAFFO", "ZAFFOS", "Q", "QQ", "UNLISTED",
            " ", "4EVER", "LUM.", ".Q", "PE.XXX", "O RB", "PEX.TOOL"]
    df = spark.createDataFrame([(r, r) for r in raws], "given string, raw string")
    got = {r["given"]: (r["ticker"], r["verified"])
           for r in X.normalise_tickers(df, universe).collect()}
    assert {k: v[0] for k, v in got.items()} == {r: by_hand(r) for r in raws}
    assert got["LUMC"] == ("LUM.C", True) and got["QQ"] == ("QQ", False)


def test_a_listed_undotted_ticker_is_left_alone(spark):
    universe = spark.createDataFrame([("ABCD",), ("ABC.D",)], "ticker string")
    df = spark.createDataFrame([("ABCD",)], "raw string")
    assert rows(X.normalise_tickers(df, universe).select("ticker")) == [("ABCD",)]


def test_html_unescape_equals_the_standard_library(spark):
    rng = random.Random(7)
    names = list(html5)
    cases = ["", "a & b", "&amp;lt;", "&notit;", "&copy2024", "&#39;&#x27;", "&#128;", "&#0;",
             "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#1;", "&;", "&#;", "&#x;",
             "&AMP&eacute;&nbsp;", "&#000065;", "&nosuch;", "&#xFDD0;z", "&#13;", "😀 &#128512;"]
    for _ in range(600):
        cases.append("".join(rng.choice([
            rng.choice(["&", "&#", "&#x", " ", "a", ";", "é"]), "&" + rng.choice(names),
            "&" + rng.choice(names)[:-1], str(rng.randint(0, 70000))])
            for _ in range(rng.randint(1, 7))))
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = rows(df.select("s", html_unescape(F.col("s"))))
    assert [(s, u) for s, u in got if u != html.unescape(s)] == []


def test_meta_map_first_tag_wins(spark):
    head = ('<meta name="Author" content="First"/><META NAME="author" content="Second">'
            '<meta name="tickers" content="A,B">')
    df = spark.createDataFrame([(head,), ("nothing",)], "h string")
    assert rows(df.select(X.meta_map(F.col("h")))) == [
        ({"author": "First", "tickers": "A,B"},), ({},)]


def test_picker_label(spark):
    df = spark.createDataFrame([("AB", "Acme", 3), ("CD", None, 1)],
                               "t string, name string, n int")
    assert rows(df.select(X.picker_label(F.col("t"), F.col("name"), F.col("n")))) == [
        ("AB — Acme  (3 articles)",), ("CD  (1 articles)",)]


def test_months(spark):
    def months(a, b):
        return [r[0] for r in rows(D.months_between(spark, F.lit(a), F.lit(b)))]

    assert months("2025/11", "2026/02") == ["2025/11", "2025/12", "2026/01", "2026/02"]
    assert months("2026/02", "2026/02") == ["2026/02"]
    assert months("2026/03", "2026/02") == []
    start, end = D.months_back(14, F.lit("2026-01-31").cast("date"))
    assert rows(spark.range(1).select(start, end)) == [("2024/12", "2026/01")]


def test_periods_and_days(spark):
    df = spark.createDataFrame([(date(2026, 9, 21),), (date(2026, 9, 22),)], "d date")  # Mon, Tue
    assert rows(df.select(D.week_ending_monday(F.col("d")), D.quarter_start(F.col("d")))) == [
        (date(2026, 9, 21), date(2026, 7, 1)), (date(2026, 9, 28), date(2026, 7, 1))]
    ts = F.lit("2026-09-24 02:30:00").cast("timestamp")
    assert one(spark.range(1).select(D.local_day(ts, "America/New_York")))[0] == date(2026, 9, 23)
