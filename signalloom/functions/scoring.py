"""Threshold rules: labels, momentum, deviations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalloom.functions.rounding import exact_round

# Score bands of one text or one average.
POSITIVE_ABOVE = 60.0
NEGATIVE_BELOW = 40.0

# Growth in percent that counts as movement.
RISING_ABOVE = 20.0
FADING_BELOW = -20.0

# Scales that make the two deviations comparable.
MEDIAN_DEVIATION_SCALE = 0.6745
MEAN_DEVIATION_SCALE = 0.7979


def sentiment_label(score: Column) -> Column:
    """positive above 60, negative below 40, neutral between; NULL stays NULL."""
    value = exact_round(score, 4)
    return (
        F.when(value > POSITIVE_ABOVE, F.lit("positive"))
        .when(value < NEGATIVE_BELOW, F.lit("negative"))
        .when(value.isNotNull(), F.lit("neutral"))
    )


def growth_rate(earlier: Column, recent: Column) -> Column:
    """Growth in percent; NULL when something came out of nothing."""
    return F.when(earlier != 0, (recent - earlier) / earlier * 100.0).when(recent <= 0, F.lit(0.0))


def momentum(earlier: Column, recent: Column) -> Column:
    """emerging, rising, fading or stable."""
    growth = growth_rate(earlier, recent)
    return (
        F.when(growth.isNull(), F.lit("emerging"))
        .when(growth > RISING_ABOVE, F.lit("rising"))
        .when(growth < FADING_BELOW, F.lit("fading"))
        .otherwise(F.lit("stable"))
    )


def modified_z(value: Column, median: Column, mad: Column, mean_deviation: Column) -> Column:
    """Robust deviation of a value; NULL for a flat series."""
    gap = F.abs(value - median)
    raw = F.when(mad > 0, F.lit(MEDIAN_DEVIATION_SCALE) * gap / mad).when(
        mean_deviation > 0, F.lit(MEAN_DEVIATION_SCALE) * gap / mean_deviation
    )
    return exact_round(raw, 4)


def banded(value: Column, bands: tuple[tuple[float, str], ...]) -> Column:
    """Name of the first band whose inclusive lower bound the value reaches."""
    rule = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in bands[:-1]:
        rule = rule.when(value >= bound, F.lit(name))
    return rule.otherwise(F.lit(bands[-1][1]))
