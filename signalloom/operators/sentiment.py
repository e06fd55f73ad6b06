"""Lexicon sentiment per signal, its run summary and the aspect mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions import lexicons
from signalloom.functions import text as T
from signalloom.functions.rounding import clamp, exact_round
from signalloom.functions.scoring import sentiment_label
from signalloom.operators.dataset import has_modality
from signalloom.operators.ranking import top_k

LABELS = ("positive", "neutral", "negative")

# Scores of a text without any lexicon word, and the score range.
NEUTRAL_SCORE = 50.0
NEUTRAL_CONFIDENCE = 0.5
MAX_SCORE = 99.99

# Warning codes in the order they are reported.
SENTIMENT_WARNINGS = (
    "NO_APPLICABLE_TEXT",
    "NO_VALID_TEXT",
    "INVALID_TEXT_SKIPPED",
    "UNSUPPORTED_LANGUAGE_SKIPPED",
)

WORD_PATTERN = rf"([{T.WORD}]+(?:['’][{T.WORD}]+)?)"
# Private characters that stand for one found phrase each: the supplementary planes hold 131,068 of them.
_MARKS = [chr(code) for plane in (0xF0000, 0x100000) for code in range(plane, plane + 0xFFFE)]


def warning_list(*warnings: tuple[str, Column, Column]) -> Column:
    """Array of (code, count) in the given order, for warnings that apply."""
    entries = [
        F.when(applies, F.struct(F.lit(code).alias("code"), count.cast("bigint").alias("count")))
        for code, applies, count in warnings
    ]
    return F.array_compact(F.array(*entries))


def classify_sentiment(
    df: DataFrame, text: str = "cleaned_text", lexicon: lexicons.Lexicon = lexicons.DEFAULT_LEXICON
) -> DataFrame:
    """Add ``label``, ``score`` and ``confidence``; all NULL for a blank text.

    Every phrase is replaced by a mark of its own, so phrases are counted once
    and their words are not counted again as single words.
    """
    phrases = (*lexicon.positive_phrases, *lexicon.negative_phrases)
    if len(phrases) > len(_MARKS):
        raise ValueError(f"more than {len(_MARKS)} phrases")
    marks = _MARKS[: len(phrases)]
    good_marks = "".join(marks[: len(lexicon.positive_phrases)])
    bad_marks = "".join(marks[len(lexicon.positive_phrases) :])

    marked = F.translate(F.lower(text), "".join(marks), " " * len(marks)) if marks else F.lower(text)
    for phrase, mark in zip(phrases, marks):
        marked = F.replace(marked, F.lit(phrase), F.lit(mark))
    # One projection per step keeps each costly expression evaluated once.
    df = df.withColumn("_marked", marked)
    df = df.withColumn("_words", F.regexp_extract_all("_marked", F.lit(WORD_PATTERN), F.lit(1)))

    def hits(words: tuple[str, ...], found: str) -> Column:
        singles = F.size(F.filter("_words", lambda w: w.isin(*words))) if words else F.lit(0)
        if not found:
            return singles
        return singles + F.length("_marked") - F.length(F.translate("_marked", found, ""))

    df = df.withColumns({"_good": hits(lexicon.positive_words, good_marks), "_bad": hits(lexicon.negative_words, bad_marks)})
    found = F.col("_good") + F.col("_bad")
    balance = F.lit(NEUTRAL_SCORE) + (F.col("_good") - F.col("_bad")) / found * 50.0
    blank = T.is_blank(F.col(text))
    raw = F.when(~blank & (found > 0), balance).when(~blank, F.lit(NEUTRAL_SCORE))
    df = df.withColumn("_raw", raw).withColumn("score", exact_round(clamp(F.col("_raw"), 0.0, MAX_SCORE), 4))
    confidence = F.lit(NEUTRAL_CONFIDENCE) + F.abs(F.col("score") - NEUTRAL_SCORE) / 100.0
    return df.withColumns(
        {"label": sentiment_label(F.col("score")), "confidence": clamp(confidence, 0.0, 1.0)}
    ).drop("_marked", "_words", "_good", "_bad", "_raw")


def classified_signals(
    signals: DataFrame,
    lexicon: lexicons.Lexicon = lexicons.DEFAULT_LEXICON,
    languages: tuple[str, ...] = lexicons.SUPPORTED_LANGUAGES,
) -> DataFrame:
    """Every signal with its text status (``no_text``, ``unsupported``, ``invalid``,
    ``processed``) and, where processed, its classification."""
    known = F.coalesce(has_modality("text"), F.lit(False))
    supported = T.supports_language(F.col("language"), languages)
    status = (
        F.when(~known, F.lit("no_text"))
        .when(~supported, F.lit("unsupported"))
        .when(T.is_blank(F.col("cleaned_text")), F.lit("invalid"))
        .otherwise(F.lit("processed"))
    )
    gated = signals.withColumn("text_status", status).withColumn(
        "_text", F.when(F.col("text_status") == "processed", F.col("cleaned_text"))
    )
    return classify_sentiment(gated, "_text", lexicon).drop("_text")


def sentiment_items(classified: DataFrame) -> DataFrame:
    """One row per processed signal."""
    return classified.filter(F.col("text_status") == "processed").select(
        "run_id", "signal_id", "source", "signal_type", "label", "score", "confidence"
    )


def exact_sum(col: Column, scale: int = 6) -> Column:
    """Sum that does not depend on the order of the rows."""
    return F.sum(col.cast(f"decimal(38,{scale})"))


def percentage(count: Column, total: Column) -> Column:
    """Share in percent, NULL of nothing."""
    return exact_round(F.when(total > 0, count / total * 100.0), 2)


def sentiment_summary(classified: DataFrame) -> DataFrame:
    """Module result per run: status, counts, averages, distribution, warnings.

    Rows are first reduced to (run, source), so that the number of distinct
    sources falls out of the second, small aggregate.
    """
    status = F.col("text_status")
    by_source = classified.groupBy("run_id", "source").agg(
        F.count(F.lit(1)).alias("signal_count"),
        F.count_if(status != "no_text").alias("applicable_count"),
        F.count_if(status == "processed").alias("processed_count"),
        F.count_if(status == "invalid").alias("invalid_text_count"),
        F.count_if(status == "unsupported").alias("unsupported_language_count"),
        *[F.count_if(F.col("label") == label).alias(f"{label}_count") for label in LABELS],
        exact_sum(F.col("score")).alias("_score"),
        exact_sum(F.col("confidence"), 8).alias("_confidence"),
    )
    counts = [c for c in by_source.columns if c.endswith("_count")]
    by_run = by_source.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.count_if(F.col("applicable_count") > 0).alias("source_count"),
        F.sum("_score").alias("_score"),
        F.sum("_confidence").alias("_confidence"),
    )
    done = F.col("processed_count")
    skipped = F.col("invalid_text_count") + F.col("unsupported_language_count")
    completed = done > 0
    scored = by_run.withColumns(
        {
            "skipped_count": skipped,
            "average_score": exact_round(F.when(completed, F.col("_score").cast("double") / done), 4),
            "average_confidence": exact_round(F.when(completed, F.col("_confidence").cast("double") / done), 4),
            **{f"{label}_pct": percentage(F.col(f"{label}_count"), done) for label in LABELS},
            "status": F.when(completed, F.lit("completed")).otherwise(F.lit("skipped")),
            "coverage_status": text_coverage(completed, skipped),
            "coverage": F.when(F.col("applicable_count") > 0, done / F.col("applicable_count")).otherwise(F.lit(0.0)),
            "warnings": warning_list(
                (SENTIMENT_WARNINGS[0], F.col("applicable_count") == 0, F.lit(0)),
                (SENTIMENT_WARNINGS[1], (F.col("applicable_count") > 0) & ~completed, skipped),
                (SENTIMENT_WARNINGS[2], F.col("invalid_text_count") > 0, F.col("invalid_text_count")),
                (SENTIMENT_WARNINGS[3], F.col("unsupported_language_count") > 0, F.col("unsupported_language_count")),
            ),
        }
    )
    return scored.withColumn("overall_label", sentiment_label(F.col("average_score"))).drop("_score", "_confidence")


def text_coverage(completed: Column, skipped: Column) -> Column:
    return (
        F.when(~completed, F.lit("no_data")).when(skipped > 0, F.lit("degraded")).otherwise(F.lit("complete"))
    )


def stored_sentiment(
    signals: DataFrame, lexicon: lexicons.Lexicon = lexicons.DEFAULT_LEXICON
) -> DataFrame:
    """Classification stored at collection time: every non-spam signal, any language.

    A blank text is stored as neutral with no confidence.
    """
    scored = classify_sentiment(signals.filter(~F.col("spam_flag")), "cleaned_text", lexicon)
    return scored.withColumns(
        {
            "confidence": F.when(F.col("label").isNull(), F.lit(0.0)).otherwise(F.col("confidence")),
            "score": F.coalesce("score", F.lit(NEUTRAL_SCORE)),
            "label": F.coalesce("label", F.lit("neutral")),
        }
    )


def aspect_sentiments(scored: DataFrame, aspects: dict[str, tuple[str, ...]] = lexicons.ASPECT_TERMS) -> DataFrame:
    """One row per signal and mentioned aspect, carrying the sentiment of the whole text."""
    scored = scored.withColumn("_lowered", F.lower("cleaned_text"))
    lowered = F.col("_lowered")
    mentions = []
    for name, terms in aspects.items():
        found = F.lit(False)
        for term in terms:
            found = found | lowered.contains(term)
        mentions.append(F.when(found, F.lit(name)))
    # The outer form keeps the optimizer from testing the texts a second time in a filter.
    return scored.select(
        "run_id", "signal_id", "source", "label", "score", F.explode_outer(F.array(*mentions)).alias("aspect")
    ).filter(F.col("aspect").isNotNull())


def aspect_rollup(aspects: DataFrame, by: tuple[str, ...] = ("run_id",), k: int = 5) -> DataFrame:
    """The ``k`` most mentioned aspects with their average score."""
    counted = aspects.groupBy(*by, "aspect").agg(
        F.count(F.lit(1)).alias("mention_count"), exact_sum(F.col("score")).alias("_score")
    )
    averaged = counted.withColumn(
        "avg_score", exact_round(F.col("_score").cast("double") / F.col("mention_count"), 2)
    ).drop("_score")
    return top_k(averaged, list(by), [F.col("mention_count").desc(), F.col("aspect")], k)


def source_sentiment(signals: DataFrame, scored: DataFrame, aspects: DataFrame) -> DataFrame:
    """Sentiment per run and source as stored after collection, with defaults for no data."""
    eligible = signals.groupBy("run_id", "source").agg(F.count_if(~F.col("spam_flag")).alias("signal_count"))
    n = F.count(F.lit(1))
    measured = scored.groupBy("run_id", "source").agg(
        (exact_sum(F.col("score")).cast("double") / n).alias("_score"),
        (exact_sum(F.col("confidence"), 8).cast("double") / n).alias("_confidence"),
        *[(F.count_if(F.col("label") == label) / n * 100.0).alias(f"_{label}") for label in LABELS],
    )
    leading = aspect_rollup(aspects, ("run_id", "source"))
    listed = leading.groupBy("run_id", "source").agg(
        F.array_sort(F.collect_list(F.struct("rank", "aspect", "mention_count", "avg_score"))).alias("top_aspects")
    )
    return (
        eligible.join(measured, ["run_id", "source"], "left")
        .join(listed, ["run_id", "source"], "left")
        .select(
            "run_id",
            "source",
            "signal_count",
            F.coalesce("_score", F.lit(NEUTRAL_SCORE)).alias("weighted_score"),
            F.coalesce("_confidence", F.lit(NEUTRAL_CONFIDENCE)).alias("avg_confidence"),
            *[F.coalesce(f"_{label}", F.lit(0.0)).alias(f"{label}_pct") for label in LABELS],
            "top_aspects",
        )
    )


def daily_sentiment(signals: DataFrame, scored: DataFrame) -> DataFrame:
    """Volume and average sentiment per publication day; unscored signals count as neutral."""
    scores = scored.select("signal_id", F.col("score").alias("_score"))
    dated = (
        signals.filter(~F.col("spam_flag") & F.col("published_at").isNotNull())
        .select("run_id", "signal_id", F.to_date("published_at").alias("day"))
        .join(scores, "signal_id", "left")
    )
    value = F.coalesce("_score", F.lit(NEUTRAL_SCORE))
    return dated.groupBy("run_id", "day").agg(
        F.count(F.lit(1)).alias("volume"),
        exact_round(exact_sum(value).cast("double") / F.count(F.lit(1)), 1).alias("sentiment"),
    )


def daily_sentiment_or_fallback(signals: DataFrame, scored: DataFrame, as_of: Column) -> DataFrame:
    """:func:`daily_sentiment`, with one row dated ``as_of`` for runs without dated signals."""
    daily = daily_sentiment(signals, scored)
    whole = signals.groupBy("run_id").agg(F.count_if(~F.col("spam_flag")).alias("volume"))
    average = scored.groupBy("run_id").agg(
        exact_round(exact_sum(F.col("score")).cast("double") / F.count(F.lit(1)), 1).alias("sentiment")
    )
    missing = (
        whole.join(daily.select("run_id").distinct(), "run_id", "left_anti")
        .join(average, "run_id", "left")
        .select("run_id", F.to_date(as_of).alias("day"), "volume", F.coalesce("sentiment", F.lit(NEUTRAL_SCORE)).alias("sentiment"))
    )
    return daily.unionByName(missing)
