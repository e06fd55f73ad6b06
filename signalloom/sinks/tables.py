"""Keyed tables on Parquet: append, first writer, priority, latest, replace.

Every table is a store of its own, see ``commits``: a batch writes its rows and nothing else, readers merge them under
the rule of the table, and ``compact`` merges them for good. Batches of a stream carry its name and their number, so a
batch that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators.ranking import latest_per_key
from signalloom.sinks.commits import BUCKETS, STATUS_PRIORITY, Rows, Rule, Store
from signalloom.sinks.membership import parts_that_hit

__all__ = [
    "BUCKETS", "STATUS_PRIORITY", "append_signals", "compact", "conflicting_rows", "insert_first_writer", "merge_by_priority",
    "read_table", "replace_by_key", "synchronize_sources", "upsert_latest", "upsert_newest", "write_keyword_export", "write_sources",
]

TABLE = "rows"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that count, or None before the first write."""
    return Store(spark, path).read(TABLE)


def compact(spark: SparkSession, path: str) -> None:
    """Merge the batches of a table into one and delete what no reader needs any more."""
    store = Store(spark, path)
    store.compact()
    store.expire()


def unknown(store: Store, table: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored. Only commits whose filter hits are read."""
    known = parts_that_hit(store, table, rows, keys)
    if not known:
        return rows
    return rows.join(store.rows(table, known).select(*keys), list(keys), "left_anti")


def append_signals(
    spark: SparkSession, path: str, signals: DataFrame, buckets: int = BUCKETS, batch: tuple[str, int] | None = None
) -> DataFrame:
    """Append signals whose content hash is neither stored nor seen earlier in the batch.

    ``signals`` carries a unique ``arrival`` number. Returns the appended rows.
    """
    store, keys = Store(spark, path), ["content_hash"]
    firsts = unknown(store, TABLE, signals.groupBy(*keys).agg(F.min("arrival").alias("arrival")), keys)
    fresh = signals.join(firsts.select("arrival"), "arrival", "left_semi").select(*signals.columns)
    number = store.commit({TABLE: Rows(fresh, Rule("first", tuple(keys)), "run_id", buckets)}, batch=batch)
    return store.rows(TABLE, [p for p in store.parts(TABLE) if p.number == number]).drop("commit_no")


def insert_first_writer(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], order: Column, buckets: int = BUCKETS
) -> DataFrame:
    """Insert rows whose key is new; the first row under ``order`` wins inside the batch.

    Returns the canonical stored row of every key in ``rows``.
    """
    store = Store(spark, path)
    fresh = unknown(store, TABLE, latest_per_key(rows, keys, [order]), keys).select(*rows.columns)
    store.commit({TABLE: Rows(fresh, Rule("first", tuple(keys)), keys[0], buckets)})
    wanted = rows.select(*keys).distinct()
    return store.rows(TABLE, parts_that_hit(store, TABLE, wanted, keys)).drop("commit_no").join(wanted, list(keys), "left_semi")


def conflicting_rows(stored: DataFrame, rows: DataFrame, keys: Sequence[str], definition: Sequence[str]) -> DataFrame:
    """Rows whose key is stored with a different definition."""
    old = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in definition])
    differs = F.lit(False)
    for column in definition:
        differs = differs | ~F.col(column).eqNullSafe(F.col(f"_{column}"))
    return rows.join(old, list(keys)).filter(differs).drop(*[f"_{c}" for c in definition])


def upsert_latest(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], version: str, buckets: int = BUCKETS
) -> None:
    """One row per key: the highest version; a new row wins against an equal one."""
    Store(spark, path).commit({TABLE: Rows(rows, Rule("latest", tuple(keys), version), keys[0], buckets)})


def upsert_newest(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], buckets: int = BUCKETS, batch: tuple[str, int] | None = None
) -> None:
    """One row per key: the one of the last batch that has the key."""
    Store(spark, path).commit({TABLE: Rows(rows, Rule("newest", tuple(keys)), keys[0], buckets)}, batch=batch)


def merge_by_priority(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], status: str = "status", buckets: int = BUCKETS
) -> None:
    """One row per key; a stored row is replaced only by a status of higher priority."""
    Store(spark, path).commit({TABLE: Rows(rows, Rule("priority", tuple(keys), status), keys[0], buckets)})


def replace_by_key(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], replaced: DataFrame | None = None, buckets: int = BUCKETS
) -> None:
    """Remove all stored rows of the replaced keys and store ``rows`` instead.

    ``replaced`` has the keys that were computed anew, also those without any new row; by default the keys in ``rows``.
    The keys are written with the rows, in one commit, and remove what earlier commits have of them.
    """
    gone = rows.select(*keys) if replaced is None else replaced.select(*keys).union(rows.select(*keys))
    rule = Rule("replace", tuple(keys))
    Store(spark, path).commit({TABLE: Rows(rows, rule, keys[0], buckets), f"{TABLE}-gone": Rows(gone.distinct())})


def synchronize_sources(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Source dimension after synchronization with the configuration.

    Known (platform, source_name) pairs keep their id and take the configured
    attributes; new pairs get an id derived from the pair.
    """
    pair = ["platform", "source_name"]
    attributes = [c for c in configured.columns if c not in pair]
    ids = stored.groupBy(*pair).agg(F.min("source_id").alias("source_id"))
    fresh_id = F.sha2(F.concat_ws(":", *pair), 256)
    synced = configured.join(ids, pair, "left").select(
        F.coalesce(F.col("source_id").cast("string"), fresh_id).alias("source_id"), *pair, *attributes
    )
    untouched = stored.join(configured.select(*pair), pair, "left_anti").select(
        F.col("source_id").cast("string").alias("source_id"), *pair, *attributes
    )
    return synced.unionByName(untouched)


def write_sources(spark: SparkSession, path: str, configured: DataFrame) -> DataFrame:
    """Synchronize the stored source dimension with the configuration, and return it.

    Only sources of the configuration are written; stored ones that it does not name keep their rows.
    """
    store, pair = Store(spark, path), ["platform", "source_name"]
    kept = store.read(TABLE)
    if kept is None:
        kept = configured.limit(0).withColumn("source_id", F.lit(None).cast("string"))
    synced = synchronize_sources(kept, configured).join(configured.select(*pair).distinct(), pair, "left_semi")
    store.commit({TABLE: Rows(synced, Rule("newest", tuple(pair)))})
    return store.read(TABLE)


def write_keyword_export(export: DataFrame, path: str) -> None:
    """CSV files with a header, one folder per run, rows in rank order."""
    ordered = export.repartitionByRange("run_id", "Rank").sortWithinPartitions("run_id", "Rank")
    ordered.write.mode("errorifexists").partitionBy("run_id").option("header", True).csv(path)
