import itertools
import random

import pytest
from pyspark.sql import functions as F

from signalloom.operators import engagement as E
from signalloom.plans.modules import engagement_module

from conftest import one


def records(make, metrics, *signals):
    rows = signals or ({"signal_id": "a"},)
    return E.engagement_records(make.signals(*rows), E.latest_counters(make.metrics(*metrics)))


def test_full_record(make):
    row = one(records(make, [("a", "views", 100, 1), ("a", "likes", 10, 1), ("a", "comments", 5, 1)]))
    assert (row.interactions, row.like_rate, row.comment_rate, row.engagement_rate) == (15.0, 0.1, 0.05, 0.15)
    assert row.metric_completeness == 1.0 and not row.is_partial


def test_aliases(make):
    row = one(records(make, [("a", " View_Count ", 200, 1), ("a", "upvotes", 30, 1), ("a", "reply_count", 10, 1)]))
    assert (row.views, row.likes, row.comments, row.engagement_rate) == (200.0, 30.0, 10.0, 0.2)


def test_latest_observation_wins_and_repeats_are_counted(make):
    row = one(records(make, [("a", "views", 100, 1), ("a", "view_count", 250, 2), ("a", "likes", 10, 1), ("a", "likes", 40, 2), ("a", "comments", 10, 1)]))
    assert (row.views, row.likes, row.engagement_rate, row.duplicate_count) == (250.0, 40.0, 0.2, 2)


def test_same_time_uses_the_larger_value(make):
    metrics = make.metrics(("a", "view_count", 500, 1), ("a", "views", 400, 1))
    assert one(E.latest_counters(metrics)).views == 500.0
    assert one(E.conflict_counts(metrics)).conflict_count == 1


def conflicts_by_reading(observations):
    """Reads the observations one by one and keeps the leader, as a check."""
    names = {"views": "views", "view_count": "views", "view": "views"}
    leader, count = None, 0
    for at, name, unit, value in sorted(observations):
        if leader is not None and leader[0] == at and leader[1] != value:
            count += 1
        candidate = (at, value, name == names[name], name, unit)
        if leader is None or candidate >= leader:
            leader = candidate
    return count


def test_conflicts_agree_with_reading_in_order(make):
    rng = random.Random(3)
    metrics, expected = [], {}
    for i in range(60):
        seen = [(rng.randint(0, 2), rng.choice(["views", "view_count", "view"]), rng.choice(["", "u"]), float(rng.randint(0, 3))) for _ in range(rng.randint(1, 12))]
        expected[f"s{i}"] = conflicts_by_reading(seen)
        metrics += [(f"s{i}", name, value, at, unit or None) for at, name, unit, value in seen]
    got = {r.signal_id: r.conflict_count for r in E.conflict_counts(make.metrics(*metrics)).collect()}
    assert got == expected


def test_missing_and_zero_views_have_no_rates(make):
    rows = {r.signal_id: r for r in records(make, [("a", "likes", 5, 1), ("b", "views", 0, 1), ("b", "likes", 5, 1)], {"signal_id": "a"}, {"signal_id": "b"}).collect()}
    assert rows["a"].views is None and rows["a"].interactions == 5.0 and rows["a"].engagement_rate is None
    assert rows["b"].views == 0.0 and rows["b"].engagement_rate is None


def test_rates_are_weighted_and_sources_are_separate(make):
    metrics = [("a", "views", 100, 1), ("a", "likes", 50, 1), ("b", "views", 900, 1), ("b", "likes", 50, 1), ("c", "likes", 7, 1), ("d", "other", 1, 1)]
    found = records(make, metrics, *({"signal_id": s, "source": "x" if s == "a" else "y"} for s in "abcd"))
    rows = {(r.level, r.source): r for r in E.engagement_summary(found).collect()}
    whole = rows[("run", None)]
    assert whole.like_rate == 0.1 and whole.like_rate_signal_count == 2
    assert (whole.likes, whole.likes_signal_count, whole.comments, whole.comments_signal_count) == (107.0, 3, None, 0)
    assert (whole.signal_count, whole.skipped_signal_count, whole.partial_signal_count) == (3, 1, 3)
    assert rows[("source", "x")].like_rate == 0.5 and rows[("source", "y")].views == 900.0


def test_ranks(make):
    metrics = [("a", "views", 100, 1), ("a", "likes", 10, 1), ("b", "likes", 10, 1), ("c", "views", 50, 1), ("c", "likes", 10, 1), ("d", "views", 5, 1)]
    ranked = E.rank_records(records(make, metrics, *({"signal_id": s} for s in "abcd")))
    rows = {r.signal_id: (r.interaction_rank, r.engagement_rate_rank) for r in ranked.collect()}
    assert rows == {"c": (1, 1), "a": (2, 2), "b": (3, None), "d": (None, None)}
    assert [r.signal_id for r in E.order_records(ranked).collect()] == ["c", "a", "b", "d"]


def test_warnings_in_fixed_order(make):
    metrics = make.metrics(("a", "views", 0, 1), ("a", "likes", 2, 1), ("a", "likes", 3, 1), ("a", "shares", 1, 1), ("b", "views", -1, 1))
    row = one(engagement_module(make.signals({"signal_id": "a"}, {"signal_id": "b"}), metrics, make.runs()))
    assert [(w["code"], w["count"]) for w in row.warnings] == [
        ("SIGNALS_WITHOUT_VALID_ENGAGEMENT_METRICS", 1), ("INVALID_ENGAGEMENT_METRICS_IGNORED", 1),
        ("UNSUPPORTED_ENGAGEMENT_METRICS_IGNORED", 1), ("METRIC_SNAPSHOTS_RESOLVED", 1),
        ("SAME_TIMESTAMP_METRIC_CONFLICTS_RESOLVED", 1), ("PARTIAL_ENGAGEMENT_METRICS", 1), ("ZERO_VIEWS_RATE_UNAVAILABLE", 1),
    ]
    assert (row.status, row.coverage_status, row.coverage) == ("completed", "degraded", 0.5)


def test_no_data(make):
    row = one(engagement_module(make.signals({"signal_id": "a", "modalities": ["text"]}), make.metrics(("x", "views", 1, 1)), make.runs()))
    assert (row.status, row.coverage_status, row.warnings[0]["code"]) == ("skipped", "no_data", "NO_APPLICABLE_SIGNALS")
