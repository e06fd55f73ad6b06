"""Stored signals and observations of all runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.session import small_side


def run_signals(signals: DataFrame, module_runs: DataFrame) -> DataFrame:
    """Signals with the run and collector of their module run."""
    named = small_side(module_runs.select("module_run_id", "run_id", "module_type"))
    return signals.drop("run_id").join(named, "module_run_id")


def eligible_metrics(metrics: DataFrame, signals: DataFrame) -> DataFrame:
    """Observations of non-spam signals."""
    eligible = signals.filter(~F.col("spam_flag")).select("signal_id")
    return metrics.join(eligible, "signal_id", "left_semi")


def signals_with_metrics(signals: DataFrame, metrics: DataFrame) -> DataFrame:
    """Signals next to their observations, one row per observation.

    Signals without any keep one row. Observations stay rows instead of one
    array per signal, because a signal can have any number of them.
    """
    return signals.join(metrics, "signal_id", "left")


def signals_of_runs(signals: DataFrame, module_runs: DataFrame) -> DataFrame:
    """Signals that belong to any module run of the given table."""
    return signals.join(small_side(module_runs.select("module_run_id")), "module_run_id", "left_semi")
