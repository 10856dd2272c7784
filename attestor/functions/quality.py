"""Column functions that turn counts into rates, levels and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor import fixed


def rate(after: Column, before: Column) -> Column:
    """Share that is left; the divisor is at least one, so 0 of 0 is 0."""
    return after / F.greatest(before, F.lit(1))


def dpmo(defects: Column, opportunities: Column) -> Column:
    """Defects per million opportunities, at most a million, 0 without opportunities."""
    return (F.when(opportunities == 0, F.lit(0.0))
            .otherwise(F.least(F.try_divide(defects, opportunities) * 1000000, F.lit(1000000.0))))


def sigma(defects_per_million: Column) -> Column:
    """The sigma level: linear between the lower ends of the yield bands.

    Below the lowest band the level is the yield itself.
    """
    share = 1 - defects_per_million / 1000000
    level = F.when(defects_per_million <= 0, F.lit(6.0)).when(defects_per_million >= 1000000, F.lit(0.0))
    upper = None
    for at, low in fixed.SIGMA_BANDS:
        value = F.lit(at) if upper is None else F.lit(at) + (share - low) / (upper - low)
        level = level.when(share >= low, value)
        upper = low
    return level.otherwise(share)


def grade(sigma_level: Column, compatibility: Column) -> Column:
    chain = F
    for level, score, name in fixed.QUALITY_GRADES:
        chain = chain.when((sigma_level >= level) & (compatibility >= score), name)
    return chain.otherwise(fixed.WORST_GRADE)


def score_grade(score: Column) -> Column:
    chain = F
    for low, name in fixed.SCORE_GRADES:
        chain = chain.when(score >= low, name)
    return chain.otherwise(fixed.WORST_SCORE_GRADE)
