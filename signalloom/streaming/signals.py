"""Continuous arrival: the record operators over unbounded input."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalloom.functions import lexicons
from signalloom.functions import text as T
from signalloom.operators.dataset import canonical_metric
from signalloom.operators.quality import is_bot, is_empty_record, is_spam, with_content_hash
from signalloom.session import materialize, small_side
from signalloom.sinks.commits import STATUS_PRIORITY, Rows, Rule, Store
from signalloom.sinks.tables import append_signals, upsert_newest

# Fixed value: share of the record target at which preliminary results may start.
PRELIMINARY_SHARE = 0.5


def read_files(
    spark: SparkSession, path: str, schema, *, format: str = "parquet", max_files: int | None = None, glob: str | None = None,
    origin: str | None = None,
) -> DataFrame:
    """Folder of arriving files as a stream. ``origin`` names a column for the file that a row came from."""
    reader = spark.readStream.schema(schema).format(format)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(path)
    return rows.withColumn(origin, F.col("_metadata.file_path")) if origin else rows


def prepare_records(
    records: DataFrame,
    spam_phrases: tuple[str, ...] = lexicons.SPAM_PHRASES,
    bot_words: tuple[str, ...] = lexicons.BOT_WORDS,
    bot_phrases: tuple[str, ...] = lexicons.BOT_PHRASES,
) -> DataFrame:
    """Content hash, cleaned text and flags of arriving records; stateless."""
    raw = F.col("raw_text")
    cleaned = with_content_hash(records).withColumn("cleaned_text", T.clean_text(raw))
    return cleaned.withColumns(
        {
            "is_empty": is_empty_record(raw, F.col("external_item_id")),
            "is_bot": is_bot(raw, F.col("signal_type"), bot_words, bot_phrases),
            "spam_flag": is_spam(raw, F.col("cleaned_text"), spam_phrases),
        }
    )


def store_distinct(records: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Append the first delivery of every content hash to a signal table.

    The stored hashes decide, so a copy may come at any time and no row is late. A batch that is delivered again finds
    its own rows stored. ``records`` carries a unique ``arrival`` number.
    """
    return for_each_batch(
        records,
        checkpoint,
        lambda batch, number: append_signals(batch.sparkSession, path, batch, batch=(stream_name(checkpoint), number)),
        available_now=available_now,
    )


def daily_sums(signals: DataFrame, event_time: str = "event_time") -> DataFrame:
    """Signals and engagement per run and UTC day; engagement adds up in twelve decimal places, in any order alike."""
    return signals.groupBy("run_id", F.to_date(event_time).alias("day")).agg(
        F.count(F.lit(1)).alias("signal_count"), F.sum(F.col("engagement").cast("decimal(38,12)")).alias("engagement")
    )


def sealed_runs(statuses: DataFrame) -> DataFrame:
    """Runs all of whose collectors (run_id, source, status) have ended."""
    ended = F.coalesce(F.col("status").isin(*STATUS_PRIORITY), F.lit(False))
    return statuses.groupBy("run_id").agg(F.min(ended).alias("_ended")).filter("_ended").select("run_id")


def stream_name(checkpoint: str) -> str:
    """What stands for a stream in the manifests of a store: its batches are numbered under one checkpoint."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()


def store_accepted(
    signals: DataFrame, path: str, checkpoint: str, summarize: Callable[[DataFrame], dict[str, Rows]], *,
    sealed: Callable[[], DataFrame] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Commit what ``summarize`` makes of every batch, and the rows that come too late, to a store.

    A run is closed for rows that arrive when it is in ``sealed()``; they go to the table ``rejected`` as they are. The
    stream keeps no state, so nothing of a sealed run is held any longer. Where rows have an ``origin``, the file they
    came from, its first delivery counts: files that are read again, under this checkpoint or a new one, change nothing.
    Without it, a new checkpoint is a new stream.
    """
    name = stream_name(checkpoint)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = Store(spark, path)
        if found.has(name, number):
            return
        # Every table of the commit reads the batch.
        arrived = batch = batch.persist()
        tables: dict[str, Rows] = {}
        if "origin" in batch.columns:
            fresh, known = batch.select("origin").distinct(), found.read("origins")
            if known is not None:
                fresh = fresh.join(known, "origin", "left_anti")
            fresh = materialize(fresh.coalesce(1), "origins")
            # A row per input file of one batch, which the stream lists in the driver as well.
            batch = batch.join(F.broadcast(fresh), "origin", "left_semi")
            tables["origins"] = Rows(fresh)
        if sealed is not None:
            closed = small_side(materialize(sealed().select("run_id").distinct(), "sealed"))
            tables["rejected"] = Rows(batch.join(closed, "run_id", "left_semi"))
            batch = batch.join(closed, "run_id", "left_anti")
        found.commit({**summarize(batch), **tables}, batch=(name, number))
        arrived.unpersist()

    return for_each_batch(signals, checkpoint, store, available_now=available_now)


def store_daily(
    signals: DataFrame, path: str, checkpoint: str, event_time: str = "event_time", *, sealed: Callable[[], DataFrame] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Add the day sums of every batch to a store; ``read_daily`` sums them up, ``read_rejected`` has the late rows."""
    return store_accepted(
        signals, path, checkpoint, lambda batch: {"days": Rows(daily_sums(batch, event_time))}, sealed=sealed, available_now=available_now
    )


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Signals and engagement per run and UTC day of all batches so far."""
    stored = Store(spark, path).read("days")
    return stored.groupBy("run_id", "day").agg(F.sum("signal_count").alias("signal_count"), F.sum("engagement").alias("engagement"))


def read_rejected(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of sealed runs that came after the seal, or None if no batch was checked for them."""
    return Store(spark, path).read("rejected")


def store_latest_counters(
    metrics: DataFrame, path: str, checkpoint: str, *, sealed: Callable[[], DataFrame] | None = None, available_now: bool = True
) -> StreamingQuery:
    """Keep the latest value per signal and canonical counter in a store; ``read_latest_counters`` merges the batches.

    A batch adds its own latest values, so the stream needs no state for the signals that it has seen. With ``sealed``,
    ``metrics`` carries ``run_id``, and rows of sealed runs are rejected.
    """

    def summarize(batch: DataFrame) -> dict[str, Rows]:
        return {"counters": Rows(newest_counters(batch), Rule("latest", ("signal_id", "counter"), "newest"), "signal_id")}

    return store_accepted(metrics, path, checkpoint, summarize, sealed=sealed, available_now=available_now)


def read_latest_counters(spark: SparkSession, path: str) -> DataFrame:
    """Latest value per signal and counter of all batches; of values of one time the larger one."""
    return Store(spark, path).read("counters").select("signal_id", "counter", F.col("newest.value").alias("value"), "newest.recorded_at")


def preliminary_progress(signals: DataFrame, targets: DataFrame) -> DataFrame:
    """Running number of valid signals per run and collector, and whether half the target is reached.

    ``targets`` is a static table (run_id, source, target).
    """
    counted = signals.groupBy("run_id", "source").agg(F.count_if(~F.col("spam_flag")).alias("valid_count"))
    needed = F.ceil(F.col("target") * PRELIMINARY_SHARE)
    return counted.join(targets, ["run_id", "source"]).withColumn("preliminary_ready", F.col("valid_count") >= needed)


def newest_counters(metrics: DataFrame) -> DataFrame:
    """Per signal and canonical counter, the latest (recorded_at, value)."""
    valid = metrics.withColumn("counter", canonical_metric()).filter(F.col("counter").isNotNull() & (F.col("value") >= 0))
    return valid.groupBy("signal_id", "counter").agg(F.max(F.struct("recorded_at", "value")).alias("newest"))


def latest_counters(metrics: DataFrame) -> DataFrame:
    """Latest value per signal and canonical counter, kept up to date."""
    return newest_counters(metrics).select("signal_id", "counter", F.col("newest.value").alias("value"), "newest.recorded_at")


def upsert_to(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], *, available_now: bool = True
) -> StreamingQuery:
    """Keep the newest state of every key in a keyed table; each batch writes the keys that it changed.

    A batch that is delivered again after a failure is not written again.
    """
    return for_each_batch(
        stream,
        checkpoint,
        lambda batch, number: upsert_newest(batch.sparkSession, path, batch, keys, batch=(stream_name(checkpoint), number)),
        available_now=available_now,
    )


def for_each_batch(
    stream: DataFrame, checkpoint: str, action: Callable[[DataFrame, int], None], *, available_now: bool = True
) -> StreamingQuery:
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(action)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
