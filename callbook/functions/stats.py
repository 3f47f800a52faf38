"""Return arithmetic, intervals and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ORDINAL_BUCKETS = [(1, "1st article"), (2, "2nd article"), (3, "3rd article"),
                   (5, "4th-5th"), (10, "6th-10th"), (None, "11th+")]
INTENSITY_BUCKETS = [(2, "2 articles"), (5, "3-5"), (10, "6-10"), (25, "11-25"), (None, "26+")]
CI_VERDICTS = ["Beats a coin flip", "Can't tell", "Worse than a coin flip"]
WILSON_Z = 1.96

ORDINAL_ORDER = [label for _, label in ORDINAL_BUCKETS]
INTENSITY_ORDER = [label for _, label in INTENSITY_BUCKETS]


def pct_return(base: Column, exit_: Column) -> Column:
    """Percent return; NULL when the base is zero or either leg is missing."""
    return F.when(base != 0, (exit_ - base) / base * 100.0)


def direction(score: Column) -> Column:
    """+1 / -1 for a directional score, NULL for none."""
    return F.nullif(F.signum(score.cast("double")), F.lit(0.0))


def _wilson(hits: Column, n: Column, side: int) -> Column:
    count = n.cast("double")
    z2 = WILSON_Z * WILSON_Z
    share = hits.cast("double") / count
    spread = F.sqrt(share * (1.0 - share) / count + F.lit(z2) / (count * count * 4.0))
    bound = ((share + F.lit(z2) / (count * 2.0)) + F.lit(side * WILSON_Z) * spread) / (
        F.lit(z2) / count + 1.0)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)) * 100.0)


def wilson_low(hits: Column, n: Column) -> Column:
    """Lower end of the Wilson interval in percent, NULL for an empty sample."""
    return _wilson(hits, n, -1)


def wilson_high(hits: Column, n: Column) -> Column:
    """Upper end of the Wilson interval in percent, NULL for an empty sample."""
    return _wilson(hits, n, 1)


def share_pct(hits: Column, n: Column) -> Column:
    """hits / n in percent, NULL for an empty sample."""
    return F.try_divide(hits.cast("double"), n.cast("double")) * 100.0


def _bucket(n: Column, steps) -> Column:
    chain = None
    for upper, label in steps:
        if upper is None:
            return chain.otherwise(label)
        chain = F.when(n <= upper, label) if chain is None else chain.when(n <= upper, label)
    return chain


def ordinal_bucket(n: Column) -> Column:
    return _bucket(n, ORDINAL_BUCKETS)


def intensity_bucket(n: Column) -> Column:
    return F.when(n > 0, _bucket(n, INTENSITY_BUCKETS))


def ci_verdict(low: Column, high: Column) -> Column:
    """Whether an interval clears fifty percent."""
    return (F.when(low > 50, CI_VERDICTS[0]).when(high < 50, CI_VERDICTS[2])
            .otherwise(CI_VERDICTS[1]))


def multiple_of(value: Column, base: Column) -> Column:
    """value / base, NULL without a positive base."""
    return F.when(base > 0, value / base)


def spike_status(base: Column) -> Column:
    return F.when(base > 0, "accelerating").otherwise("newly covered")


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))
