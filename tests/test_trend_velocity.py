from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from signalloom.operators import trend, velocity
from signalloom.plans.modules import trend_module

from conftest import START, one

# The ten-day timeframe is split after 120 hours.


def test_cumulative_counters_use_the_latest_and_others_add_up(make):
    metrics = make.metrics(("a", "views", 100, 1), ("a", "views", 150, 2), ("a", "views", 300, 130), ("a", "upvotes", 3, 1), ("a", "upvotes", 4, 2), ("a", "upvotes", 14, 140))
    relevant = trend.trend_signals(make.signals({"signal_id": "a"}), make.runs())
    rows = {r.metric_name: r for r in trend.trend_metrics(trend.half_values(relevant, metrics)).collect()}
    assert (rows["views"].previous_value, rows["views"].current_value, rows["views"].momentum) == (150.0, 300.0, "rising")
    assert (rows["upvotes"].previous_value, rows["upvotes"].current_value, rows["upvotes"].growth_rate) == (7.0, 14.0, 100.0)


def test_two_sided_summary(make):
    row = one(trend_module(make.signals({"signal_id": "a"}), make.metrics(("a", "views", 100, 1), ("a", "views", 130, 130)), make.runs()))
    assert (row.status, row.coverage_status, row.overall_momentum, row.trend_score) == ("completed", "complete", "rising", 65.0)
    assert (row.earlier_total, row.recent_total, row.total_metric_observations) == (100.0, 130.0, 2)


def test_one_sided_summary_is_degraded(make):
    row = one(trend_module(make.signals({"signal_id": "a"}), make.metrics(("a", "views", 100, 130)), make.runs()))
    assert (row.status, row.coverage_status, row.overall_momentum, row.trend_score, row.overall_growth_rate) == ("completed", "degraded", "stable", 50.0, None)


def test_signal_in_the_unobserved_half_fails_the_run(make):
    signals = make.signals({"signal_id": "a"}, {"signal_id": "b"})
    row = one(trend_module(signals, make.metrics(("a", "views", 100, 130)), make.runs()))
    assert (row.status, row.trend_score, row.overall_momentum) == ("failed", None, None)


def test_emerging_and_negative_totals(make):
    emerging = one(trend_module(make.signals({"signal_id": "a"}), make.metrics(("a", "views", 0, 1), ("a", "views", 5, 130)), make.runs()))
    assert (emerging.overall_momentum, emerging.trend_score) == ("emerging", 75.0)
    negative = one(trend_module(make.signals({"signal_id": "a"}), make.metrics(("a", "views", -4, 1), ("a", "views", 5, 130)), make.runs()))
    assert negative.status == "failed"


def test_skipped_without_metrics(make):
    row = one(trend_module(make.signals({"signal_id": "a"}), make.metrics(("x", "views", 1, 1)), make.runs()))
    assert (row.status, [w["code"] for w in row.warnings]) == ("skipped", ["NO_METRICS"])


def test_growing_volume_has_an_upward_velocity(make):
    runs = make.runs(days=30)
    rows, metrics = [], []
    for day in range(1, 31):
        for n in range(day):
            rows.append({"signal_id": f"{day}-{n}", "published_at": START + timedelta(days=day, hours=1)})
            metrics.append((f"{day}-{n}", "views", 10, 1))
    daily = velocity.daily_volume(make.signals(*rows), make.metrics(*metrics), runs)
    ordered = [r.volume for r in daily.orderBy("day").collect()]
    assert ordered == list(range(1, 31))
    row = one(velocity.velocity(daily))
    assert (row.velocity_direction, row.velocity_slope, row.velocity_r2, row.signal_strength) == ("up", 1.0, 1.0, "high")
    assert row.velocity_score == round(5 + 10 / 15.5, 4)


def test_flat_volume_has_no_fit(make):
    daily = velocity.daily_volume(make.signals({"signal_id": "a", "published_at": None}), make.metrics(("a", "views", 1, 1)), make.runs(days=30))
    row = one(velocity.velocity(daily))
    assert (row.velocity_r2, row.velocity_slope, row.velocity_score, row.velocity_direction) == (0.0, 0.0, 5.0, "stable")


def test_hype_needs_counters(make):
    signals = make.signals({"signal_id": "a"}, {"signal_id": "b"}, {"signal_id": "c", "source": "hype"})
    row = one(velocity.hype_metrics(signals, make.metrics(("a", "views", 1000, 1), ("a", "view_count", 50, 1), ("c", "search_interest", 3, 1))))
    assert (row.source, row.volume_count, row.engagement_volume, row.hype_score) == ("youtube", 2, 1000.0, 2.0)
