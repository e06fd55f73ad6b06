"""The sealed dataset: order, modalities, timeframe and fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions import lexicons
from signalloom.functions import text as T
from signalloom.operators.ranking import numbered
from signalloom.session import small_side

# Versions that are part of a dataset's identity.
PREPROCESSING_VERSION = "text-v1"
CONFIGURATION_VERSION = "analysis-v1"

# Sixty-bit pieces of a line digest; their sums identify the set of lines.
_PIECES = 4


def moment(column: str = "published_at") -> Column:
    """Publication time, or collection time where that is missing."""
    return F.coalesce(F.col(column), F.col("collected_at"))


def signal_key(at: str) -> list[Column]:
    """The canonical order of the signals of a run; ``at`` is their moment."""
    return [F.col(at), F.col("source"), F.col("signal_id")]


def signal_order(signals: DataFrame) -> DataFrame:
    """Number of every signal in the canonical order of its run (``signal_no``).

    The order is (published or collected, source, id). Only these columns are
    sorted and written; texts do not take part.
    """
    keys = signals.select("run_id", "signal_id", "source", moment().alias("_moment"))
    return numbered(keys, ["run_id"], signal_key("_moment"), "signal_no", "order").select("signal_id", "signal_no")


def seal(signals: DataFrame) -> DataFrame:
    """Signals with ``signal_no``. Use the plain signals where the order does not matter.

    Both sides grow with the data. The hint keeps a text table that compresses
    well from being taken for a small one and broadcast, and from being sorted:
    the narrow numbers of a partition are hashed, the texts only pass by.
    """
    return signals.join(signal_order(signals).hint("shuffle_hash"), "signal_id")


def normalize_arrays(signals: DataFrame) -> DataFrame:
    """Tags trimmed, without blanks and copies, sorted; modalities distinct and sorted."""
    tags = F.array_sort(F.array_distinct(F.filter(F.transform("tags", T.strip), lambda t: t != "")))
    fixed = {"tags": tags}
    if "modalities" in signals.columns:
        fixed["modalities"] = F.array_sort(F.array_distinct("modalities"))
    return signals.withColumns(fixed)


def normalize_metrics(metrics: DataFrame) -> DataFrame:
    """Drop empty observations and those that are not finite numbers."""
    value = F.col("value")
    return metrics.filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))


def metric_key(column: str = "name") -> Column:
    return F.lower(T.strip(F.col(column)))


def canonical_metric(column: str = "name") -> Column:
    """views, likes or comments; NULL for any other counter."""
    key = metric_key(column)
    rule = None
    for canonical in lexicons.CANONICAL_METRICS:
        names = [alias for alias, target in lexicons.METRIC_ALIASES.items() if target == canonical]
        rule = F.when(key.isin(*names), canonical) if rule is None else rule.when(key.isin(*names), canonical)
    return rule


def tag_modalities(signals: DataFrame, metrics: DataFrame, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``modalities`` from the text, the observed counters and the signal type.

    ``prepare`` adds columns such as the cleaned text row by row. It runs on what the shuffle has dealt already, so a
    second copy of a text is not shuffled.
    """
    seen = metrics.filter(F.col("value").isNotNull()).groupBy("signal_id").agg(
        F.bool_or(canonical_metric().isNotNull()).alias("_engagement"),
        F.bool_or(metric_key().isin(*lexicons.TREND_METRICS)).alias("_trend"),
    )
    kind = F.col("signal_type")
    # Listed in alphabetical order, which is the stored order.
    modalities = F.array_compact(
        F.array(
            F.when(F.col("_engagement"), F.lit("engagement")),
            F.when(kind == "serp_result", F.lit("search_intent")),
            F.when(F.col("cleaned_text") != "", F.lit("text")),
            F.when((kind == "trend_observation") | F.col("_trend"), F.lit("trend_observation")),
        )
    )
    # The narrow flags are hashed, so the texts are not sorted and do not spill.
    flagged = signals.join(seen.hint("shuffle_hash"), "signal_id", "left")
    prepared = prepare(flagged) if prepare else flagged
    return prepared.withColumn("modalities", modalities).drop("_engagement", "_trend")


def has_modality(*names: str) -> Column:
    """True for signals of one of the modalities. Untagged texts count as text."""
    tagged = F.arrays_overlap(F.col("modalities"), F.array(*[F.lit(n) for n in names]))
    if "text" in names:
        return tagged | ((F.size("modalities") == 0) & F.col("cleaned_text").isNotNull())
    return tagged


def with_modality(signals: DataFrame, *names: str) -> DataFrame:
    return signals.filter(F.coalesce(has_modality(*names), F.lit(False)))


def with_run(signals: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    """Attach columns of the run to rows that carry ``run_id``."""
    return signals.join(small_side(runs.select("run_id", *columns)), "run_id")


def in_timeframe(signals: DataFrame, runs: DataFrame, column: str = "published_at") -> DataFrame:
    """Signals published inside the half-open timeframe of their run."""
    framed = with_run(signals, runs, "timeframe_start", "timeframe_end")
    return framed.filter((F.col(column) >= F.col("timeframe_start")) & (F.col(column) < F.col("timeframe_end")))


def run_timeframe(start_date: Column, end_date: Column) -> tuple[Column, Column]:
    """Half-open timestamps of an inclusive range of days."""
    return F.to_timestamp(start_date), F.to_timestamp(F.date_add(end_date, 1))


def recent_window(end_date: Column, days: int = 30) -> tuple[Column, Column]:
    """The last ``days`` days up to and including ``end_date``."""
    end = F.to_timestamp(F.date_add(end_date, 1))
    return F.to_timestamp(F.date_add(end_date, 1 - days)), end


def _line_sums(df: DataFrame, line: Column, group: str) -> DataFrame:
    digest = F.sha2(line, 256)
    sums = []
    for i in range(_PIECES):
        piece = F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
        sums.append(F.sum(piece).cast("decimal(38,0)").alias(f"_s{i}"))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("_lines"), *sums)


def exact_text(value: Column) -> Column:
    """A double in as many digits as tell it from every other one; both zeros are one."""
    return (value.cast("double") + F.lit(0.0)).cast("string")


def fingerprint(runs: DataFrame, signals: DataFrame, metrics: DataFrame) -> DataFrame:
    """Digest of each run's analysed input, independent of row order.

    Every signal and every observation is one line. The digests of the lines
    are added up, so equal sets of lines give equal sums in any order and no
    run is ever gathered in one place; a final hash covers the sums, the
    keyword, the timeframe and the versions.
    """
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    text = T.collapse(F.coalesce("cleaned_text", F.lit("")))
    empty = F.lit("")
    signal_line = F.concat_ws(
        "|",
        F.lit("sig"),
        F.col("signal_id").cast("string"),
        F.coalesce("external_item_id", empty),
        F.col("source"),
        F.col("signal_type"),
        F.coalesce("language", empty),
        F.coalesce(F.date_format("published_at", stamp), empty),
        F.date_format("collected_at", stamp),
        F.array_join("modalities", ","),
        text,
    )
    metric_line = F.concat_ws(
        "|",
        F.lit("met"),
        F.col("signal_id").cast("string"),
        F.col("name"),
        exact_text(F.col("value")),
        F.date_format("recorded_at", stamp),
    )
    observed = metrics.filter(F.col("value").isNotNull())
    per_signal = _line_sums(observed, metric_line, "signal_id")
    met = (
        signals.select("run_id", "signal_id")
        .join(per_signal, "signal_id")
        .groupBy("run_id")
        .agg(*[F.sum(c).cast("decimal(38,0)").alias(c.replace("_", "_m", 1)) for c in per_signal.columns[1:]])
    )
    sig = _line_sums(signals, signal_line, "run_id")
    parts = [c for c in (*sig.columns[1:], *met.columns[1:])]
    numbers = [F.coalesce(F.col(c).cast("decimal(38,0)"), F.lit(0)).cast("string") for c in parts]
    header = [
        F.col("keyword"),
        F.date_format("timeframe_start", stamp),
        F.date_format("timeframe_end", stamp),
        F.lit(PREPROCESSING_VERSION),
        F.lit(CONFIGURATION_VERSION),
    ]
    digest = F.sha2(F.concat_ws("|", *header, *numbers), 256)
    return (
        runs.join(sig, "run_id", "left")
        .join(met, "run_id", "left")
        .select(
            "run_id",
            F.coalesce(F.col("_lines"), F.lit(0)).alias("signal_count"),
            F.coalesce(F.col("_mlines").cast("bigint"), F.lit(0)).alias("observation_count"),
            F.concat(F.lit("sha256:"), digest).alias("input_fingerprint"),
        )
    )


def check_identity(executions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Fields in which an execution does not describe its dataset; empty when it does."""
    fields = ("snapshot_id", "input_fingerprint")
    other = datasets.select("run_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_known"))
    joined = executions.join(other, "run_id", "left")
    mismatch = [F.when(F.col("_known").isNull(), F.lit("run_id"))]
    for f in fields:
        differs = ~F.col(f).eqNullSafe(F.col(f"_{f}")) & F.col("_known").isNotNull()
        mismatch.append(F.when(differs, F.lit(f)))
    return joined.withColumn("mismatched_fields", F.array_compact(F.array(*mismatch))).drop(
        "_known", *[f"_{f}" for f in fields]
    )
