"""Thirty-day publishing velocity and the score built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions import lexicons
from signalloom.functions.rounding import clamp, exact_round
from signalloom.operators.dataset import moment, signal_key, with_run
from signalloom.operators.ranking import top_k
from signalloom.operators.sentiment import exact_sum
from signalloom.session import materialize, small_side

# Length of the window, slopes that count as movement, strengths.
WINDOW_DAYS = 30
SLOPE_LIMIT = 0.05
HIGH_VOLUME, MEDIUM_VOLUME = 5, 1
VOLUME_WEIGHT, ENGAGEMENT_WEIGHT, MAX_SCORE = 0.5, 0.001, 10.0


def observed_values(metrics: DataFrame) -> DataFrame:
    """Per signal: sum over all metrics, and over the three canonical names only."""
    value = F.col("value")
    return metrics.filter(value.isNotNull()).groupBy("signal_id").agg(
        exact_sum(value).alias("all_values"),
        exact_sum(F.when(F.col("name").isin(*lexicons.CANONICAL_METRICS), value)).alias("engagement"),
    )


def daily_volume(signals: DataFrame, metrics: DataFrame, runs: DataFrame, by: tuple[str, ...] = ("run_id", "source")) -> DataFrame:
    """Signals and metric sums per group and day of the window, days without any as 0.

    The window covers the days after its first one up to and including the day
    on which it ends.
    """
    end_day = F.to_date("timeframe_end")
    dated = with_run(
        signals.select(*dict.fromkeys((*by, "run_id", "signal_id", "published_at"))), runs, "timeframe_end"
    ).withColumn("day", F.to_date("published_at"))
    inside = (F.col("day") > F.date_sub(end_day, WINDOW_DAYS)) & (F.col("day") <= end_day)
    facts = (
        dated.filter(inside)
        .join(observed_values(metrics), "signal_id", "left")
        .groupBy(*by, "day")
        .agg(F.count(F.lit(1)).alias("volume"), F.sum("all_values").alias("engagement"))
    )
    groups = with_run(signals.select(*by).distinct(), runs, "timeframe_end")
    days = F.sequence(F.date_sub(end_day, WINDOW_DAYS - 1), end_day)
    calendar = groups.select(*by, F.posexplode(days).alias("_place", "day")).withColumn("day_no", F.col("_place") + 1)
    return calendar.join(facts, [*by, "day"], "left").select(
        *by,
        "day",
        "day_no",
        F.coalesce("volume", F.lit(0)).alias("volume"),
        F.coalesce(F.col("engagement").cast("double"), F.lit(0.0)).alias("engagement"),
    )


def velocity(daily: DataFrame, by: tuple[str, ...] = ("run_id", "source")) -> DataFrame:
    """Least-squares slope of the daily volume, its fit, direction and score."""
    y = F.col("volume").cast("double")
    x = F.col("day_no").cast("double")
    fitted = daily.groupBy(*by).agg(
        F.regr_slope(y, x).alias("_slope"),
        F.regr_r2(y, x).alias("_r2"),
        F.avg(y).alias("_average"),
        F.var_pop(y).alias("_spread"),
    )
    slope, average = F.col("_slope"), F.col("_average")
    relative = F.when(average > 0, slope / average).otherwise(F.lit(0.0))
    direction = F.when(slope > SLOPE_LIMIT, "up").when(slope < -SLOPE_LIMIT, "down").otherwise("stable")
    strength = F.when(average > HIGH_VOLUME, "high").when(average > MEDIUM_VOLUME, "medium").otherwise("low")
    return fitted.withColumn("_score", F.lit(5.0) + relative * 10.0).select(
        *by,
        exact_round(clamp(F.col("_score"), 0.0, 10.0), 4).alias("velocity_score"),
        exact_round(slope, 4).alias("velocity_slope"),
        direction.alias("velocity_direction"),
        # A flat series has nothing to explain, so its fit is 0 rather than 1.
        exact_round(F.when((average == 0) | (F.col("_spread") == 0), F.lit(0.0)).otherwise(F.col("_r2")), 4).alias("velocity_r2"),
        strength.alias("signal_strength"),
        exact_round(average, 2).alias("avg_daily_volume"),
    )


def hype_metrics(signals: DataFrame, metrics: DataFrame, by: tuple[str, ...] = ("run_id", "source")) -> DataFrame:
    """Volume, engagement and score per group; only groups that have both."""
    volume = signals.select(*by, "signal_id").join(observed_values(metrics), "signal_id", "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("volume_count"), F.sum("engagement").cast("double").alias("engagement_volume")
    )
    raw = F.col("volume_count") * VOLUME_WEIGHT + F.col("engagement_volume") * ENGAGEMENT_WEIGHT
    return volume.filter(F.col("engagement_volume").isNotNull()).withColumn(
        "hype_score", F.least(F.lit(MAX_SCORE), raw)
    )


def trending_titles(signals: DataFrame, title: Column, by: tuple[str, ...] = ("run_id", "source"), k: int = 5) -> DataFrame:
    """The first ``k`` titles of each group in signal order; titles are read for these signals only."""
    titled = signals.filter(F.coalesce(title, F.lit("")) != "").select(*{*by, "run_id", "source"}, "signal_id", moment().alias("_moment"))
    first = materialize(top_k(titled, list(by), signal_key("_moment"), k).select(*by, "signal_id", "rank"), "titles")
    return signals.select("signal_id", title.alias("title")).join(small_side(first), "signal_id").select(*by, "title", "rank")
