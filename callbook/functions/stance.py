"""Headline stance: an ordered chain of regular-expression rules.

The label is one ``when`` chain of ``rlike`` columns, so it runs inside the
JVM; the score is a function of the label. Rules are ordered and the first one
that matches wins.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# The patterns, labels, scores and buckets below define the classification and
# have to stay exactly as they are for the labels to come out right.

MOVE_EXPLAINER = (
    r"^why\s+.{0,90}?\b(?:plunge[sd]?|plunging|sink(?:s|ing)?|sank|sunk|"
    r"tumble[sd]?|tumbling|crash(?:es|ed|ing)?|fell|falls|falling|"
    r"drop(?:s|ped|ping)?|slid(?:e|es|ing)?|slump(?:s|ed|ing)?|"
    r"skyrocket(?:s|ed|ing)?|soar(?:s|ed|ing)?|jump(?:s|ed|ing)?|"
    r"surge[sd]?|surging|rall(?:y|ies|ied|ying)|pop(?:s|ped|ping)?|"
    r"climb(?:s|ed|ing)?|spike[sd]?|spiking|rose|rising|gain(?:s|ed|ing)?)\b"
)
FORWARD_LOOKING = r"\b(?:could|may|might|will|would|about to|coming|set to)\b"

COMPARISON = (
    r"\bvs\.?\s|\bversus\b"
    r"|\bwhich\s+(?:\w+\s+){0,3}?(?:stock|etf|company|one|is)\b.{0,40}\b"
    r"(?:better|best|stronger|smarter)\b"
    r"|\b(?:better|best)\s+(?:buy|bet|pick|choice)\s*[:?]?\s*$"
    r"|\bor\s+\w+[:?]\s*which\b"
)
INSIDER = (
    r"\b(insider|form\s*4|13[fF]|chief\s+\w+\s+officer|cfo|ceo|coo|cto|chro|"
    r"director|evp|svp|president)\b.{0,60}\b(sell|sells|sold|buy|buys|bought|"
    r"acquires|acquired|disposes|unloads)\b"
    r"|\b(sells|sold|buys|bought|acquires|purchases)\b\s+[\d,]+\s+shares"
    r"|\bshares?\s+(sold|bought|purchased)\s+by\b"
)
BUY_STRONG = (
    r"\b(?:stocks?|etfs?|companies|coins?|picks?|names?|giants?|winners?)\s+"
    r"(?:\w+\s+){0,3}?to\s+buy\b",
    r"\breasons?\s+to\s+buy\b",
    r"\bto\s+buy\s+(?:right\s+)?now\b",
    r"\bbuy\s+(?:the\s+)?dip\b",
    r"\bscreaming\s+buys?\b",
    r"\bno[\s-]brainer\s+(?:buy|stock)",
    r"\bworth\s+buying\b",
    r"\bstart(?:ing)?\s+(?:a\s+)?position\b",
    r"\bloading\s+up\s+on\b",
    r"\bkeep\s+buying\b",
    r"\b\d+\s+to\s+buy\b",
)
BUY_QUESTION = (
    r"\bis\s+.{0,60}?\ba\s+buy\b",
    r"\bbuying\s+opportunit(?:y|ies)\b",
    r"\bshould\s+you\s+buy\b",
    r"\bis\s+it\s+(?:too\s+late|still\s+time)\s+to\s+buy\b",
    r"\btime\s+to\s+buy\b",
    r"\bbetter\s+buy\b",
    r"\bworth\s+a\s+look\b",
    r"\bbuy\s+or\s+sell\b",
)
SELL_STRONG = (
    r"\b(?:stocks?|etfs?|companies|names?)\s+(?:\w+\s+){0,3}?to\s+(?:sell|avoid|dump)\b",
    r"\breasons?\s+to\s+sell\b",
    r"\btime\s+to\s+sell\b",
    r"\bsell\s+(?:right\s+)?now\b",
    r"\bget\s+out\s+(?:of|while)\b",
    r"\bdump(?:ing)?\s+this\b",
    r"\bsteer\s+clear\b",
    r"\bstay\s+away\s+from\b",
    r"\b\d+\s+to\s+(?:sell|avoid|dump)\b",
)
SELL_QUESTION = (
    r"\bshould\s+you\s+(?:sell|avoid|dump)\b",
    r"\bis\s+it\s+time\s+to\s+(?:sell|take\s+profits|worry)\b",
    r"\bshould\s+(?:investors\s+)?worry\b",
    r"\btake\s+profits\b",
    r"\bis\s+.{0,60}?\ba\s+(?:sell|trap|value\s+trap)\b",
)
HOLD = (
    r"\bto\s+hold\b",
    r"\bhold(?:ing)?\s+(?:for|forever|on)\b",
    r"\bbuy\s+and\s+hold\b",
    r"\bwait\b",
    r"\bsit\s+tight\b",
    r"\bon\s+the\s+sidelines\b",
)
WARNING = (
    r"\bbad\s+news\b",
    r"\bred\s+flags?\b",
    r"\bwarning\b",
    r"\bbubble\b",
    r"\bcrash(?:ing|es)?\b",
    r"\bsell[\s-]off\b",
    r"\bnosedive[ds]?\b",
    r"\bplunge[ds]?\b",
    r"\btumble[ds]?\b",
    r"\bsink(?:s|ing)?\b",
    r"\bbig\s+questions?\b",
    r"\btrouble\b",
    r"\brisk(?:s|y)?\b",
    r"\bbear\s+market\b",
    r"\bworst\b",
    r"\bmistake\b",
    r"\bdanger(?:ous)?\b",
    r"\bcollapse[ds]?\b",
    r"\bfalling\s+\d+%",
    r"\bdown\s+\d+%\s+from\b",
)
PREDICTION = (
    r"^prediction\b",
    r"\bprediction:",
    r"\bi\s+predict\b",
    r"\bwill\s+be\s+worth\b",
    r"\bcould\s+be\s+worth\b",
    r"\bforecast\b",
    r"\bby\s+20[3-9]\d\b",
    r"\bhere'?s\s+what\s+history\s+says\b",
    r"\bhistory\s+says\b",
    r"\bcan\s+double\b",
    r"\bpoised\s+to\b",
    r"\bset\s+to\s+(?:soar|surge|double|thrive)\b",
    r"\bmillionaire[\s-]maker\b",
)
NEWS = (
    r"^why\s+",
    r"\bjust\s+(?:got|hit|announced|reported|posted|said)\b",
    r"\bearnings\b",
    r"\bq[1-4]\s+(?:results|earnings)\b",
    r"\bskyrocket(?:ed|s|ing)?\b",
    r"\bsoar(?:ed|s|ing)?\b",
    r"\bjump(?:ed|s|ing)?\b",
    r"\bpop(?:ped|s|ping)?\b",
    r"\brally(?:ing|ied)?\b",
    r"\bannounce[ds]?\b",
    r"\bbreakfast\s+news\b",
    r"\bipo\b",
    r"\bstock\s+split\b",
    r"\bmerger\b|\bacquisition\b|\bacquires\b",
)

#: Display order of the labels.
LABELS = [
    "buy", "buy_lean", "hold", "mixed", "comparison", "analysis", "prediction",
    "news", "insider", "warning", "sell_lean", "sell",
]
SCORES = {"buy": 2, "buy_lean": 1, "warning": -1, "sell_lean": -1, "sell": -2}
BUCKETS = {"buy": "Buy", "buy_lean": "Buy (question)", "warning": "Caution",
           "sell_lean": "Sell (question)", "sell": "Sell"}
NO_CALL = "No call"
BUCKET_ORDER = ["Buy", "Buy (question)", "No call", "Caution", "Sell (question)", "Sell"]
CALL_ORDER = ["Buy", "Buy (question)", "Caution", "Sell (question)", "Sell"]
WORD_START = r"\b"
# --- end of fixed values --------------------------------------------------------

#: Every match of a vocabulary in an ASCII text holds one of these, in lower case.
HOLDS = {
    COMPARISON: ("vs", "versus", "which", "better", "best"),
    INSIDER: ("sell", "sold", "buy", "bought", "acquire", "disposes", "unloads", "purchase"),
    BUY_STRONG: ("buy", "brainer", "position", "loading"),
    BUY_QUESTION: ("buy", "worth"),
    SELL_STRONG: ("sell", "avoid", "dump", "get", "steer", "stay"),
    SELL_QUESTION: ("sell", "avoid", "dump", "profits", "worry", "trap"),
    MOVE_EXPLAINER: ("why",),
    HOLD: ("hold", "wait", "sit", "sidelines"),
    PREDICTION: ("predict", "worth", "forecast", "20", "history", "double", "poised", "set", "millionaire"),
    WARNING: ("bad", "red", "warning", "bubble", "crash", "sell", "nosedive", "plunge", "tumble", "sink",
              "question", "trouble", "risk", "bear", "worst", "mistake", "danger", "collapse", "falling", "down"),
    NEWS: ("why", "just", "earnings", "results", "skyrocket", "soar", "jump", "pop", "rally", "announce",
           "breakfast", "ipo", "split", "merger", "acquisition", "acquires"),
}


def one_pattern(patterns: str | tuple[str, ...]) -> str:
    """A vocabulary as one alternation, so a title is scanned once per vocabulary.

    Every entry starts at a word boundary (or at the start, before a letter), so
    the boundary is tested once per position instead of once per entry.
    """
    if isinstance(patterns, str):
        return patterns
    return r"\b(?:" + "|".join(f"(?:{p.removeprefix(WORD_START)})" for p in patterns) + ")"


def _lowered(text: Column) -> Column:
    """An ASCII text in lower case, NULL for others, whose letters may match in other cases too."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text))


def _has(text: Column, low: Column, patterns) -> Column:
    # U makes \w, \s, \d and \b follow Unicode. Most texts are settled by looking for a few words.
    found = text.rlike("(?iU)" + one_pattern(patterns))
    if patterns not in HOLDS:
        return found
    return (low.isNull() | reduce(or_, (low.contains(word) for word in HOLDS[patterns]))) & found


def collapse_spaces(text: Column) -> Column:
    """Trim and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def label_of_clean(t: Column, low: Column | None = None) -> Column:
    """The stance label of a headline whose white space is already collapsed.

    ``low`` is what ``_lowered`` makes of it, where that is a column already.
    """
    low = _lowered(t) if low is None else low
    sell_strong, sell_question = _has(t, low, SELL_STRONG), _has(t, low, SELL_QUESTION)
    buy_strong, buy_question = _has(t, low, BUY_STRONG), _has(t, low, BUY_QUESTION)
    # Buy wording is settled in one branch, so the sell patterns further down
    # are only tried on titles without any.
    with_buy_wording = (
        F.when(sell_strong | sell_question, "mixed")
        .when(buy_strong, "buy")
        .otherwise("buy_lean")
    )
    return (
        F.when(t.isNull() | (t == ""), "analysis")
        .when(_has(t, low, INSIDER), "insider")
        .when(_has(t, low, COMPARISON), "comparison")
        .when(buy_strong | buy_question, with_buy_wording)
        .when(sell_strong, "sell")
        .when(sell_question, "sell_lean")
        .when(_has(t, low, MOVE_EXPLAINER) & ~_has(t, low, FORWARD_LOOKING), "news")
        .when(_has(t, low, HOLD), "hold")
        .when(_has(t, low, PREDICTION), "prediction")
        .when(_has(t, low, WARNING), "warning")
        .when(_has(t, low, NEWS), "news")
        .otherwise("analysis")
    )


def stance_label(title: Column) -> Column:
    """The stance label of a headline, which may be a whole text.

    It is collapsed once and then read as the only element of an array. That also keeps the rules out of
    the code generated for a stage, whose one method would become too long for the JVM to compile.
    """
    both = F.transform(F.array(collapse_spaces(title)), lambda t: F.struct(t.alias("t"), _lowered(t).alias("low")))
    return F.transform(both, lambda x: label_of_clean(x["t"], x["low"]))[0]


def _lookup(table: dict, key: Column, default) -> Column:
    # The key occurs once, so an inlined label is not repeated per entry.
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def stance_score(label: Column) -> Column:
    """Signed strength of a label, -2..+2; 0 means no direction."""
    return _lookup(SCORES, label, 0)


def stance_bucket(label: Column) -> Column:
    """Display bucket of a label; unknown labels make no call."""
    return _lookup(BUCKETS, label, NO_CALL)


def order_key(value: Column, order: list[str]) -> Column:
    """Position of a category in a display order, past the end when unknown."""
    position = F.array_position(F.array(*[F.lit(o) for o in order]), value)
    return F.when(position > 0, position).otherwise(F.lit(len(order) + 1)).cast("int")


def with_stance(df: DataFrame, title: str = "title") -> DataFrame:
    """Add ``stance`` and ``stance_score``."""
    return df.withColumn("stance", stance_label(F.col(title))).withColumn("stance_score", stance_score(F.col("stance")))
