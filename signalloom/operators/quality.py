"""Record checks, spam and bot rules, exclusion cascade and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions import identity, lexicons
from signalloom.functions import text as T

# Exclusion reasons in the order they are tested.
EXCLUSION_REASONS = ("empty_record", "duplicate_batch", "duplicate_db", "bot", "spam")


def is_spam(
    raw: Column,
    cleaned: Column,
    phrases: tuple[str, ...] = lexicons.SPAM_PHRASES,
    min_length: int = lexicons.MIN_TEXT_LENGTH,
) -> Column:
    """Too short after cleaning, or the raw text holds a spam phrase."""
    lowered = F.lower(F.coalesce(raw, F.lit("")))
    verdict = F.coalesce(F.length(cleaned), F.lit(0)) < min_length
    for phrase in phrases:
        verdict = verdict | lowered.contains(phrase)
    return verdict


def is_bot(
    text: Column,
    signal_type: Column,
    words: tuple[str, ...] = lexicons.BOT_WORDS,
    phrases: tuple[str, ...] = lexicons.BOT_PHRASES,
) -> Column:
    """Automated publisher. Search results have no publisher, so they never match."""
    pattern = "|".join((rf"\b(?:{'|'.join(words)})\b", *phrases))
    is_search = F.coalesce(signal_type == "serp_result", F.lit(False))
    return ~is_search & F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))


def is_empty_record(raw: Column, external_id: Column) -> Column:
    return T.is_blank(raw) | T.is_blank(external_id)


def validate_records(records: DataFrame) -> DataFrame:
    """Keep records with id, source and some text; strip ids and clean texts."""
    trimmed = records.withColumns(
        {
            "external_item_id": T.strip(F.coalesce("external_item_id", F.lit(""))),
            "source": T.strip(F.coalesce("source", F.lit(""))),
        }
    )
    has_text = ~T.is_blank(F.col("title")) | ~T.is_blank(F.col("content"))
    kept = trimmed.filter((F.col("external_item_id") != "") & (F.col("source") != "") & has_text)
    return kept.withColumns({name: T.clean_text(F.col(name)) for name in ("title", "content", "raw_text")})


def first_copies(records: DataFrame) -> DataFrame:
    """Arrival number and content hash of the first non-empty copy of every item."""
    hashed = records.filter(~is_empty_record(F.col("raw_text"), F.col("external_item_id")))
    return hashed.groupBy("content_hash").agg(F.min("arrival").alias("arrival"))


def with_content_hash(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "content_hash",
        identity.content_hash(F.col("platform"), F.col("module_run_id"), F.col("external_item_id")),
    )


def exclude_records(
    records: DataFrame,
    stored_hashes: DataFrame,
    *,
    spam_phrases: tuple[str, ...] = lexicons.SPAM_PHRASES,
    bot_words: tuple[str, ...] = lexicons.BOT_WORDS,
    bot_phrases: tuple[str, ...] = lexicons.BOT_PHRASES,
) -> DataFrame:
    """Give every record its first exclusion reason, or ``retained``.

    ``records`` carries a unique, increasing ``arrival`` number. Copies of one
    item may be a large part of the input: the first copy is found by a partial
    aggregate, and the verdict goes back over the unique arrival number, so no
    step gathers the copies of an item. All copies share ``content_hash``,
    which identifies the signal that their audit rows point to.
    """
    hashed = with_content_hash(records)
    stored = stored_hashes.select("content_hash").distinct().withColumn("_stored", F.lit(True))
    firsts = first_copies(hashed).join(stored, "content_hash", "left").select(
        "arrival", F.coalesce("_stored", F.lit(False)).alias("_stored"), F.lit(True).alias("_first")
    )
    raw, external = F.col("raw_text"), F.col("external_item_id")
    cleaned = hashed.withColumn("cleaned_text", T.clean_text(raw))
    own = (
        F.when(is_empty_record(raw, external), F.lit("empty_record"))
        .when(is_bot(raw, F.col("signal_type"), bot_words, bot_phrases), F.lit("bot"))
        .when(is_spam(raw, F.col("cleaned_text"), spam_phrases), F.lit("spam"))
        .otherwise(F.lit("retained"))
    )
    judged = cleaned.withColumn("_own", own).join(firsts, "arrival", "left")
    outcome = (
        F.when(F.col("_own") == "empty_record", F.col("_own"))
        .when(F.col("_first").isNull(), F.lit("duplicate_batch"))
        .when(F.col("_stored"), F.lit("duplicate_db"))
        .otherwise(F.col("_own"))
    )
    return judged.withColumn("outcome", outcome).drop("_own", "_first", "_stored")


def filter_audits(judged: DataFrame) -> DataFrame:
    """One audit row per record. Duplicates point to the signal they repeat."""
    empty = F.col("outcome") == "empty_record"
    placeholder = F.sha2(F.concat_ws(":", F.col("platform"), F.lit("empty"), F.col("arrival").cast("string")), 256)
    retained = F.col("outcome") == "retained"
    return judged.select(
        "run_id",
        "arrival",
        F.when(empty, placeholder).otherwise(F.col("content_hash")).alias("signal_hash"),
        retained.alias("retained_flag"),
        F.when(~retained, F.col("outcome")).alias("exclusion_reason"),
    )


def filter_summary(judged: DataFrame) -> DataFrame:
    """Counts per run over the outcomes of :func:`exclude_records`."""
    outcome = F.col("outcome")
    counted = judged.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_checked_count"),
        F.count_if(outcome == "retained").alias("retained_count"),
        F.count_if(outcome == "spam").alias("spam_count"),
        F.count_if(outcome == "bot").alias("bot_count"),
        F.count_if(outcome.startswith("duplicate")).alias("duplicate_count"),
        F.count_if(outcome == "empty_record").alias("low_quality_count"),
    )
    excluded = F.col("total_checked_count") - F.col("retained_count")
    return counted.withColumn("exclusion_rate", excluded / F.col("total_checked_count"))


def retained_signals(signals: DataFrame, audits: DataFrame, key: str = "content_hash") -> DataFrame:
    """Signals with a retained audit, each once however many audits it has."""
    kept = audits.filter("retained_flag").select(F.col("signal_hash").alias(key)).distinct()
    return signals.join(kept, key, "left_semi")


def filter_statistics(signals: DataFrame) -> DataFrame:
    """Collected, eligible and excluded signals per run, with the spam rate."""
    counted = signals.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("collected_count"),
        F.count_if(~F.col("spam_flag")).alias("eligible_count"),
        F.count_if("spam_flag").alias("excluded_count"),
    )
    rate = F.col("excluded_count") / F.col("collected_count")
    return counted.withColumns(
        {"spam_exclusion_rate": rate, "severity_score": F.when(rate > 0.3, F.lit(1.0)).otherwise(F.lit(0.0))}
    )


def source_coverage(signals: DataFrame, module_runs: DataFrame) -> DataFrame:
    """Per run and collector: completed if any of its module runs is, eligible signals."""
    eligible = signals.filter(~F.col("spam_flag")).groupBy("module_run_id").agg(F.count(F.lit(1)).alias("_eligible"))
    merged = module_runs.join(eligible, "module_run_id", "left")
    any_completed = F.max(F.col("status") == "completed")
    # Without a completed module run the last one seen decides.
    last_status = F.max_by("status", "module_run_id")
    return merged.groupBy("run_id", F.col("module_type").alias("collector")).agg(
        F.when(any_completed, F.lit("completed")).otherwise(last_status).alias("status"),
        F.sum(F.coalesce("_eligible", F.lit(0))).alias("eligible_count"),
    )


def active_platforms(module_runs: DataFrame) -> DataFrame:
    """Number and sorted names of the collectors that completed, per run."""
    done = module_runs.filter(F.col("status") == "completed").select("run_id", F.initcap("module_type").alias("name"))
    return done.distinct().groupBy("run_id").agg(
        F.count(F.lit(1)).alias("source_count"), F.array_sort(F.collect_list("name")).alias("platforms")
    )
