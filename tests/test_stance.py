from __future__ import annotations

import itertools
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from callbook.functions import stance as S

# One hit and one near miss for the rules, in the order of the rules.
CASES = [
    ("Quarry Mutual Director Disposes of Her Stake", "insider", 0),
    ("Founder Purchases 900 Shares at the Low", "insider", 0),
    ("The Director of a New Film Talks Lenses", "analysis", 0),
    ("Tin Versus Zinc for the Long Run", "comparison", 0),
    ("Tin Against Zinc for the Long Run", "analysis", 0),
    ("Two Lenders: 1 to Buy and 1 to Dump", "mixed", 0),
    ("Loading Up on Copper Before the Thaw", "buy", 2),
    ("Loading Copper Before the Thaw", "analysis", 0),
    ("A Screaming Buy Hides in Plain Sight", "buy", 2),
    ("Steer Clear of This Ferry Operator", "sell", -2),
    ("Ferries Steer Through a Clear Channel", "analysis", 0),
    ("Is This Dairy Maker a Buy?", "buy_lean", 1),
    ("This Dairy Maker Is Worth a Look", "buy_lean", 1),
    ("This Dairy Maker Is Worth Watching", "analysis", 0),
    ("Is This Dairy Maker a Value Trap?", "sell_lean", -1),
    ("Why Tile Shares Slumped in April", "news", 0),
    ("Why Tile Shares Slumped, and What a Crash Would Mean", "warning", -1),
    ("Sit Tight Through the Repairs", "hold", 0),
    ("Sit Down for the Repairs", "analysis", 0),
    ("I Predict a Mild Winter for Salt", "prediction", 0),
    ("A Red Flag in the Salt Ledger", "warning", -1),
    ("A Red Barn in the Salt District", "analysis", 0),
    ("Salt Works Plans a Stock Split", "news", 0),
    ("a red   flag in the salt ledger", "warning", -1),
    ("Übertriebene Names to  Buy", "buy", 2),
    ("", "analysis", 0),
    (" \t\n ", "analysis", 0),
    (None, "analysis", 0),
]


def labels(spark, titles):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, title string")
    return {r["i"]: (r["stance"], r["stance_score"]) for r in S.with_stance(df).collect()}


def test_every_rule_and_its_order(spark):
    got = labels(spark, [t for t, _, _ in CASES])
    wrong = [(t, got[i], (lab, sc)) for i, (t, lab, sc) in enumerate(CASES) if got[i] != (lab, sc)]
    assert wrong == []


def by_hand(title: str | None) -> str:
    """The rules with one search per pattern, in order."""
    if not title or not title.split():
        return "analysis"
    t = " ".join(title.split())

    def has(patterns):
        listed = [patterns] if isinstance(patterns, str) else patterns
        return any(re.search(p, t, re.I) for p in listed)

    buy = has(S.BUY_STRONG) or has(S.BUY_QUESTION)
    sell = has(S.SELL_STRONG) or has(S.SELL_QUESTION)
    table = [
        ("insider", has(S.INSIDER)), ("comparison", has(S.COMPARISON)), ("mixed", buy and sell),
        ("buy", has(S.BUY_STRONG)), ("sell", has(S.SELL_STRONG)), ("buy_lean", buy),
        ("sell_lean", sell),
        ("news", has(S.MOVE_EXPLAINER) and not has(S.FORWARD_LOOKING)), ("hold", has(S.HOLD)),
        ("prediction", has(S.PREDICTION)), ("warning", has(S.WARNING)), ("news", has(S.NEWS)),
    ]
    return next((name for name, hit in table if hit), "analysis")


def test_same_labels_as_one_search_per_pattern(spark):
    """Joined vocabularies in Java against the single patterns in Python."""
    parts = ["Why", "Is", "Stocks to Buy", "to Sell", "a Buy", "crash", "Could", "CEO Sells",
             "vs. ", "Prediction:", "time to sell", "12,000 shares", "earnings", "hold on", "café",
             "no-brainer buy", "IPO", "by 2031", "down 20% from"]
    titles = [" ".join(c) for n in (1, 2, 3) for c in itertools.permutations(parts, n)]
    got = labels(spark, titles)
    wrong = [(t, got[i][0], by_hand(t)) for i, t in enumerate(titles) if got[i][0] != by_hand(t)]
    assert wrong == []


def test_labels_scores_and_buckets_are_closed_sets(spark):
    df = spark.createDataFrame([(x,) for x in [*S.LABELS, "unheard of", None]], "label string")
    out = {r[0]: (r[1], r[2]) for r in rows(df.select(
        "label", S.stance_score(F.col("label")), S.stance_bucket(F.col("label"))))}
    assert set(b for _, b in out.values()) <= set(S.BUCKET_ORDER)
    assert out["buy"] == (2, "Buy") and out["sell"] == (-2, "Sell")
    assert out["warning"] == (-1, "Caution") and out["sell_lean"] == (-1, "Sell (question)")
    assert out["unheard of"] == (0, "No call") and out[None] == (0, "No call")


@pytest.mark.parametrize("value,position", [("Buy", 1), ("Sell", 6), ("other", 7)])
def test_order_key(spark, value, position):
    df = spark.range(1).select(S.order_key(F.lit(value), S.BUCKET_ORDER))
    assert rows(df) == [(position,)]


def test_words_that_settle_a_vocabulary_lose_no_match(spark):
    """Without ``low`` every pattern is tried; NULL stands for a text that is not in ASCII."""
    words = sorted({w for held in S.HOLDS.values() for w in held})
    titles = [t for t, *_ in CASES] + [f"{a} {b} it now" for a in ("Why", "is it time to", "A", "3 to", "q2") for b in words]
    titles = [t for t in titles if t]
    titles += [t.upper() for t in titles] + ["Time to \u017fell", "\u017fteer Clear", "Risky \u212aeeps"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    whole = S.label_of_clean(F.col("t"), F.lit(None).cast("string")).alias("whole")
    found = rows(df.select("t", S.label_of_clean(F.col("t")).alias("label"), whole, S.stance_label(F.col("t")).alias("own")))
    assert [r for r in found if r[1] != r[2] or r[3] != r[2]] == []
    assert len({r[1] for r in found}) > 6
    for patterns, held in S.HOLDS.items():
        for one in (patterns,) if isinstance(patterns, str) else patterns:
            hits = [t for t in titles if t.isascii() and re.search(one, t, re.IGNORECASE)]
            assert all(any(w in t.lower() for w in held) for t in hits), one


def test_a_text_is_collapsed_once(spark):
    """It may be a whole document, and each rule reads it."""
    df = spark.createDataFrame([("A  Closer Look",)], "t string").select(S.stance_label(F.col("t")).alias("stance"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 1
    assert rows(df) == [("analysis",)]
