"""The supplied star-schema and document tables in the shape of signal tables.

Documents become signals of 20 runs on three platforms, events become metric
observations. Attributes that the tables lack are derived from the document
number; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions import lexicons
from signalloom.functions import text as T
from signalloom.operators.dataset import seal, tag_modalities
from signalloom.operators.quality import is_spam
from signalloom.session import apply_settings, materialize

# The prose of the tables is invented, so the shipped lists get frequent words of it.
RUN_KEYWORD = "case when length(run_id) = 4 then 'The eriner' else 'the  Thanea ond' end"
LANGUAGES = ("en", "fr", "de")
SPAM_PHRASES = (*lexicons.SPAM_PHRASES, "rewh rewh")
BOT_WORDS = (*lexicons.BOT_WORDS, "attion")
BOT_PHRASES = (*lexicons.BOT_PHRASES, r"that\s+it")
LEXICON = lexicons.Lexicon(
    positive_phrases=(*lexicons.POSITIVE_PHRASES, "of the"),
    positive_words=(*lexicons.POSITIVE_WORDS, "is", "ing", "thon", "la", "und", "que"),
    negative_phrases=(*lexicons.NEGATIVE_PHRASES, "the and"),
    negative_words=(*lexicons.NEGATIVE_WORDS, "was", "re", "de", "der"),
)
ASPECTS = {
    "music": (*lexicons.ASPECT_TERMS["music"], "thwh"),
    "visuals": (*lexicons.ASPECT_TERMS["visuals"], "oran"),
    "gameplay": (*lexicons.ASPECT_TERMS["gameplay"], "rewh"),
    "story": (*lexicons.ASPECT_TERMS["story"], "eau"),
}


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input that was read in fewer pieces than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_settings(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Timestamps without a zone are UTC.
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def platform() -> Column:
    return F.expr("case doc_id % 3 when 0 then 'youtube' when 1 then 'community' else 'hype' end")


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored_once(df: DataFrame, sf_dir: str, name: str) -> DataFrame:
    """A table that many queries start from, written once per session and folder."""
    key = (df.sparkSession.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = materialize(df, name, compression="zstd")
    return _stored[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the columns that all derived tables share."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang"))
    return docs.select(
        "doc_id",
        F.col("source").alias("run_id"),
        platform().alias("source"),
        F.concat_ws("-", "source", platform()).alias("module_run_id"),
        F.expr("case doc_id % 3 when 0 then 'video' when 1 then 'community' else 'serp_result' end").alias("signal_type"),
        F.col("text").alias("raw_text"),
        F.col("lang").alias("language"),
        F.expr("case when doc_id % 29 = 0 then null else md5(text) end").alias("external_item_id"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries in arrival order; equal texts of a run and platform are copies of one item."""
    return documents(spark, sf_dir).withColumnsRenamed({"doc_id": "arrival"}).withColumn("platform", F.col("source"))


def plain_signals(docs: DataFrame) -> DataFrame:
    """Documents, numbered by ``signal_id``, as signals with cleaned text and spam flag."""
    day = "timestamp'2024-01-01 00:00:00'"
    signals = docs.withColumns(
        {
            "country_code": F.expr(
                "case signal_id div 20 % 5 when 0 then 'VN' when 1 then 'us' when 2 then ' JP' when 3 then null else 'KR' end"
            ),
            "location_mode": F.expr(
                "case signal_id % 7 when 0 then 'collector' when 1 then ' Region ' "
                "when 2 then case when length(run_id) = 4 then 'gps' end when 3 then '' end"
            ),
            "tags": F.expr("array(language, concat(' ', source), '', concat('t', cast(signal_id div 20 % 5 as string)))"),
            "published_at": F.expr(
                f"case when signal_id % 11 = 0 then null "
                f"else {day} + make_interval(0, 0, 0, 0, cast(signal_id * 37 % 720 as int), 0, 0) end"
            ),
            "collected_at": F.expr("timestamp'2024-01-31 00:00:00'"),
            "cleaned_text": T.clean_text(F.col("raw_text")),
        }
    )
    return signals.withColumn("spam_flag", is_spam(F.col("raw_text"), F.col("cleaned_text"), SPAM_PHRASES))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with aliases, a search-interest metric and negative values."""
    total = table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    events = table(spark, sf_dir, "events")
    return events.select(
        (F.col("event_id") % total).alias("signal_id"),
        F.expr(
            "case event_type when 'view' then case when event_id % 2 = 0 then 'views' else ' View_Count' end "
            "when 'click' then 'likes' when 'signup' then 'comments' when 'purchase' then 'search_interest' "
            "else 'views' end"
        ).alias("name"),
        F.expr(
            "case event_type when 'view' then round(value * 100) when 'error' then -value else value end"
        ).alias("value"),
        F.date_trunc("day", "ts").alias("recorded_at"),
        F.expr("case when event_id % 5 = 0 then 'count' end").alias("unit"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run with its half-open timeframe."""
    found = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id")).distinct()
    return stored_once(
        found.select(
            "run_id",
            F.expr(RUN_KEYWORD).alias("keyword"),
            F.expr("timestamp'2024-01-01 00:00:00'").alias("timeframe_start"),
            F.expr("timestamp'2024-01-31 00:00:00'").alias("timeframe_end"),
        ),
        sf_dir,
        "runs",
    )


def module_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collector run per run and platform; search collectors of long-named runs failed."""
    found = documents(spark, sf_dir).select("module_run_id", "run_id", F.col("source").alias("module_type")).distinct()
    failed = (F.col("module_type") == "hype") & (F.length("run_id") == 5)
    return found.withColumn("status", F.when(failed, "failed").otherwise("completed"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal table as ingest stores it: cleaned, flagged, tagged.

    It is written once per session to the shared folder. All analysis queries
    start from this table, as they would in production, instead of cleaning the
    texts again.
    """
    apply_settings(spark)
    docs = documents(spark, sf_dir).withColumnRenamed("doc_id", "signal_id")
    return spread(stored_once(tag_modalities(docs, metrics(spark, sf_dir), plain_signals), sf_dir, "signals"))


def dataset_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-spam signals: the input of the modules."""
    return signals(spark, sf_dir).filter(~F.col("spam_flag"))


def sealed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seal(dataset_signals(spark, sf_dir))


def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as evaluation examples."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    named = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("example_id"),
        "run_id",
        F.expr(RUN_KEYWORD).alias("keyword"),
        "language",
        F.col("raw_text").alias("text"),
        named.alias("human_label"),
    )


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(
        F.col("p_partkey").alias("brand_id"),
        F.col("p_brand").alias("brand_name"),
        F.lit("Readers of the onanan, hestha and erin stories for all").alias("target_audience"),
        F.concat_ws(" ", F.lit("Economy goods with a small"), "p_name").alias("positioning_notes"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(
        F.col("p_partkey").alias("candidate_id"),
        F.col("p_name").alias("candidate_name"),
        F.col("p_type").alias("category"),
        F.concat_ws(" ", "p_name", F.expr("case when p_size % 4 = 0 then 'can crash' else 'is steady' end")).alias("notes"),
    )


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a candidate of one of the runs."""
    parts = table(spark, sf_dir, "part")
    return parts.select(
        F.concat_ws("-", F.lit("sel"), "p_partkey").alias("id"),
        F.concat(F.lit("src"), (F.col("p_partkey") % 20).cast("string")).alias("run_id"),
        F.col("p_partkey").alias("candidate_id"),
    )
