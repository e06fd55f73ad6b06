"""Latest counters, engagement records, rankings and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import lexicons
from signalloom.functions.rounding import exact_round, ratio
from signalloom.operators.dataset import canonical_metric, has_modality, metric_key, moment
from signalloom.operators.ranking import numbered
from signalloom.operators.sentiment import exact_sum, warning_list

COUNTERS = lexicons.CANONICAL_METRICS

# Warning codes in the order they are reported.
ENGAGEMENT_WARNINGS = (
    "NO_APPLICABLE_SIGNALS",
    "NO_VALID_ENGAGEMENT_METRICS",
    "SIGNALS_WITHOUT_VALID_ENGAGEMENT_METRICS",
    "INVALID_ENGAGEMENT_METRICS_IGNORED",
    "UNSUPPORTED_ENGAGEMENT_METRICS_IGNORED",
    "METRIC_SNAPSHOTS_RESOLVED",
    "SAME_TIMESTAMP_METRIC_CONFLICTS_RESOLVED",
    "PARTIAL_ENGAGEMENT_METRICS",
    "ZERO_VIEWS_RATE_UNAVAILABLE",
)


def latest_counters(metrics: DataFrame) -> DataFrame:
    """Per signal: latest views, likes and comments, and what was ignored.

    The latest observation of a counter wins, the larger value if two share a
    time. One aggregate per signal yields all three counters, so no pivot or
    second shuffle is needed, and partial aggregation absorbs signals with very
    many observations.
    """
    observed = metrics.filter(F.col("value").isNotNull()).withColumn("_counter", canonical_metric())
    counter, value = F.col("_counter"), F.col("value")
    valid = counter.isNotNull() & (value >= 0)
    snapshot = F.struct(F.col("recorded_at").alias("at"), value.alias("value"))
    per_signal = observed.groupBy("signal_id").agg(
        *[F.max(F.when((counter == name) & (value >= 0), snapshot)).alias(f"_{name}") for name in COUNTERS],
        *[F.count_if((counter == name) & (value >= 0)).alias(f"_{name}_n") for name in COUNTERS],
        F.max(F.when(valid, F.col("recorded_at"))).alias("latest_metric_at"),
        F.count_if(counter.isNull()).alias("unsupported_count"),
        F.count_if(counter.isNotNull() & (value < 0)).alias("invalid_count"),
    )
    repeats = sum((F.greatest(F.col(f"_{n}_n") - 1, F.lit(0)) for n in COUNTERS), F.lit(0))
    return per_signal.select(
        "signal_id",
        *[F.col(f"_{name}.value").alias(name) for name in COUNTERS],
        "latest_metric_at",
        "unsupported_count",
        "invalid_count",
        repeats.cast("bigint").alias("duplicate_count"),
    )


def conflict_counts(metrics: DataFrame) -> DataFrame:
    """Per signal: observations that disagree with the leading value of the same time.

    Observations are read by (time, name, unit, value). The leader at any point
    has the time of the previous observation, so only observations of one
    counter at one time can conflict. Equal observations are merged before the
    window: of n equal ones, all conflict while a larger value leads, otherwise
    only the first can.
    """
    unit = F.coalesce("unit", F.lit("")) if "unit" in metrics.columns else F.lit("")
    observed = metrics.withColumns({"_counter": canonical_metric(), "_name": metric_key(), "_unit": unit})
    observed = observed.filter(F.col("_counter").isNotNull() & (F.col("value") >= 0))
    instant = ["signal_id", "_counter", "recorded_at"]
    merged = observed.groupBy(*instant, "_name", "_unit", "value").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*instant)
        .orderBy("_name", "_unit", "value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    leader = F.max("value").over(earlier)
    led = merged.withColumn("_leader", leader)
    lost = F.when(F.col("_leader") > F.col("value"), F.col("_n")).when(F.col("_leader") < F.col("value"), 1).otherwise(0)
    return led.groupBy("signal_id").agg(F.sum(lost).cast("bigint").alias("conflict_count"))


def interactions(likes: Column, comments: Column) -> Column:
    """Likes plus comments; NULL only when both are missing."""
    zero = F.lit(0.0)
    return F.when(F.coalesce(likes, comments).isNotNull(), F.coalesce(likes, zero) + F.coalesce(comments, zero))


def engagement_records(signals: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per engagement signal with its counters and rates.

    Signals without any valid counter stay in with ``present_count`` 0, so that
    the summary can count them; rankings and totals ignore them.
    """
    relevant = signals.filter(F.coalesce(has_modality("engagement"), F.lit(False))).select(
        "run_id", "signal_id", "source", "signal_type", moment().alias("ranking_at")
    )
    joined = relevant.join(latest, "signal_id", "left").fillna(
        0, ["unsupported_count", "invalid_count", "duplicate_count"]
    )
    present = sum((F.col(name).isNotNull().cast("int") for name in COUNTERS), F.lit(0))
    views, likes, comments = (F.col(name) for name in COUNTERS)
    records = joined.withColumns({"interactions": interactions(likes, comments), "present_count": present})
    both = F.col("interactions")
    return records.withColumns(
        {
            "like_rate": ratio(likes, views),
            "comment_rate": ratio(comments, views),
            "engagement_rate": ratio(both, views),
            "metric_completeness": exact_round(F.col("present_count") / len(COUNTERS), 4),
            "is_partial": F.col("present_count") < len(COUNTERS),
        }
    )


def _measures() -> list[Column]:
    """Additive measures of a group of records; each is NULL-aware by itself."""
    views = F.col("views")
    usable = F.col("present_count") > 0
    out = [
        F.count_if(usable).alias("signal_count"),
        F.count_if(usable & ~F.col("is_partial")).alias("complete_signal_count"),
        F.count_if(usable & F.col("is_partial")).alias("partial_signal_count"),
    ]
    for name in (*COUNTERS, "interactions"):
        out += [exact_sum(F.col(name)).alias(name), F.count(name).alias(f"{name}_signal_count")]
    for name, part in (("like", "likes"), ("comment", "comments"), ("engagement", "interactions")):
        counted = F.col(part).isNotNull() & (views > 0)
        out += [
            exact_sum(F.when(counted, F.col(part))).alias(f"_{name}_num"),
            exact_sum(F.when(counted, views)).alias(f"_{name}_den"),
            F.count_if(counted).alias(f"{name}_rate_signal_count"),
        ]
    out += [
        F.count(F.lit(1)).alias("applicable_count"),
        F.sum("present_count").alias("_present"),
        F.count_if(~usable).alias("skipped_signal_count"),
        F.count_if((views == 0) & F.col("interactions").isNotNull()).alias("zero_view_count"),
        F.sum("unsupported_count").alias("unsupported_observation_count"),
        F.sum("invalid_count").alias("invalid_observation_count"),
        F.sum("duplicate_count").alias("duplicate_observation_count"),
    ]
    return out


def engagement_summary(records: DataFrame) -> DataFrame:
    """Totals and weighted rates per run (``source`` NULL) and per (run, source).

    The records are reduced to (run, source) once; both levels then come from
    grouping sets over that small result.
    """
    base = records.groupBy("run_id", "source").agg(*_measures())
    base = base.withColumn("_sources", F.lit(1))
    measured = [c for c in base.columns if c not in ("run_id", "source")]
    both = base.groupingSets(
        [["run_id"], ["run_id", "source"]], "run_id", "source"
    ).agg(*[F.sum(c).alias(c) for c in measured], F.grouping("source").alias("_whole"))
    rates = {
        f"{name}_rate": ratio(F.col(f"_{name}_num"), F.col(f"_{name}_den"))
        for name in ("like", "comment", "engagement")
    }
    return both.withColumns(
        {
            **rates,
            **{name: F.col(name).cast("double") for name in (*COUNTERS, "interactions")},
            "metric_completeness": ratio(F.col("_present"), F.col("signal_count") * len(COUNTERS), 4),
            "level": F.when(F.col("_whole") == 1, F.lit("run")).otherwise(F.lit("source")),
            "source_count": F.col("_sources"),
        }
    ).drop("_whole", "_sources", "_present", *[f"_{n}_{p}" for n in ("like", "comment", "engagement") for p in ("num", "den")])


def rank_records(records: DataFrame) -> DataFrame:
    """Add interaction and engagement-rate ranks; unrankable records keep NULL.

    Both ranks are computed over range-partitioned rows, so a run that holds a large part of all signals is ranked by
    many tasks. The records are evaluated once: the second ranking takes the written rows of the first, with its rank.
    Unrankable records sort last, where they shift nobody.
    """
    newest = F.col("ranking_at").desc()
    both = (F.col("interactions").desc_nulls_last(), F.col("engagement_rate").desc_nulls_last())
    ranked = records.filter(F.col("present_count") > 0)
    for value, order, out in (("interactions", both, "interaction_rank"), ("engagement_rate", both[::-1], "engagement_rate_rank")):
        ranked = numbered(ranked, ["run_id"], [*order, newest, F.col("signal_id")], out, out.replace("_", "-"))
        ranked = ranked.withColumn(out, F.when(F.col(value).isNotNull(), F.col(out)))
    return ranked


def order_records(ranked: DataFrame) -> DataFrame:
    """Ranked records first, then the unranked ones in canonical signal order."""
    return ranked.orderBy(
        "run_id", F.col("interaction_rank").asc_nulls_last(), "ranking_at", "source", "signal_id"
    )


def observation_quality(records: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Ignored, repeated and conflicting observations and skipped signals per run."""
    joined = records.join(conflicts, "signal_id", "left")
    return joined.groupBy("run_id").agg(
        F.sum("unsupported_count").alias("unsupported_observation_count"),
        F.sum("invalid_count").alias("invalid_observation_count"),
        F.sum("duplicate_count").alias("duplicate_observation_count"),
        F.sum(F.coalesce("conflict_count", F.lit(0))).alias("conflicting_observation_count"),
        F.count_if(F.col("present_count") == 0).alias("skipped_signal_count"),
    )


def engagement_result(signals: DataFrame, summary: DataFrame, quality: DataFrame) -> DataFrame:
    """Module result per run: status, coverage and warnings around the run summary."""
    every = signals.groupBy("run_id").agg(F.count(F.lit(1)).alias("dataset_signal_count"))
    whole = summary.filter(F.col("level") == "run").drop("source", "level")
    joined = (
        every.join(whole, "run_id", "left")
        .join(quality.select("run_id", "conflicting_observation_count"), "run_id", "left")
        .fillna(
            0,
            [
                "signal_count", "applicable_count", "skipped_signal_count", "partial_signal_count",
                "zero_view_count", "unsupported_observation_count", "invalid_observation_count",
                "duplicate_observation_count", "conflicting_observation_count", "source_count",
            ],
        )
    )
    done, applicable = F.col("signal_count"), F.col("applicable_count")
    skipped, invalid = F.col("skipped_signal_count"), F.col("invalid_observation_count")
    partial, zero = F.col("partial_signal_count"), F.col("zero_view_count")
    degraded = (skipped > 0) | (invalid > 0) | (partial > 0) | (zero > 0)
    unsupported, repeats = F.col("unsupported_observation_count"), F.col("duplicate_observation_count")
    conflicts = F.col("conflicting_observation_count")
    return joined.withColumns(
        {
            "status": F.when(done > 0, F.lit("completed")).otherwise(F.lit("skipped")),
            "coverage_status": F.when(done == 0, F.lit("no_data"))
            .when(degraded, F.lit("degraded"))
            .otherwise(F.lit("complete")),
            "coverage": F.when(applicable > 0, done / applicable).otherwise(F.lit(0.0)),
            "warnings": warning_list(
                (ENGAGEMENT_WARNINGS[0], applicable == 0, F.lit(0)),
                (ENGAGEMENT_WARNINGS[1], (applicable > 0) & (done == 0), applicable),
                (ENGAGEMENT_WARNINGS[2], skipped > 0, skipped),
                (ENGAGEMENT_WARNINGS[3], invalid > 0, invalid),
                (ENGAGEMENT_WARNINGS[4], unsupported > 0, unsupported),
                (ENGAGEMENT_WARNINGS[5], repeats > 0, repeats),
                (ENGAGEMENT_WARNINGS[6], conflicts > 0, conflicts),
                (ENGAGEMENT_WARNINGS[7], partial > 0, partial),
                (ENGAGEMENT_WARNINGS[8], zero > 0, zero),
            ),
        }
    )


def signal_engagement(metrics: DataFrame) -> DataFrame:
    """Per signal: sum of all non-negative engagement observations, every snapshot included."""
    relevant = metrics.filter(canonical_metric().isNotNull())
    return relevant.groupBy("signal_id").agg(
        exact_sum(F.greatest(F.col("value"), F.lit(0.0))).alias("engagement")
    )
