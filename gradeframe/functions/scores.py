"""Judge scores: validity, the round-decayed score and log-probability statistics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Points of the integer scores, and the decay per round.
SCORE_POINTS = {0: 0.0, 1: 1.0, 2: 3.0, 3: 7.0, 4: 10.0}
DECAY = 0.2
SCORE_RANGE = (0.0, 5.0)
MIN_K = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)


def valid_score(c: Column, lo: float = SCORE_RANGE[0], hi: float = SCORE_RANGE[1]) -> Column:
    """The score if it lies in [lo, hi], else null; NaN is out."""
    return F.when(c.between(lo, hi), c)


def points(score: Column) -> Column:
    """Points of a score; unmapped scores scale linearly (5 gives 12.5)."""
    out = None
    for value, p in SCORE_POINTS.items():
        out = F.when(score == value, p) if out is None else out.when(score == value, p)
    return out.otherwise(score / 4.0 * 10)


def is_mapped(score: Column) -> Column:
    return score.isin([float(v) for v in SCORE_POINTS])


def weight(position: Column) -> Column:
    return F.exp(F.lit(-DECAY) * position)


def target_loglik(logprobs: Column, n: Column) -> Column:
    """Sum over the last n log-probabilities."""
    size = F.size(logprobs)
    take = F.least(n, size)
    tail = F.slice(logprobs, size - take + 1, take)
    return F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x)


def sequence_loss(logprobs: Column) -> Column:
    """Mean negative log-likelihood of a sequence, null if empty."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(-total, F.size(logprobs))


def min_k_stat(ascending: Column, k: float) -> Column:
    """Negative mean of the lowest int(length * k) log-probabilities, null if that is none."""
    n = (F.size(ascending) * F.lit(float(k))).cast("int")
    total = F.aggregate(F.slice(ascending, F.lit(1), n), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 0, -total / n)
