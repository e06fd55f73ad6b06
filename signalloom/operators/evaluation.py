"""Scoring a classifier against human labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions import lexicons
from signalloom.functions import text as T
from signalloom.functions.rounding import exact_round
from signalloom.operators.sentiment import LABELS, classify_sentiment
from signalloom.session import materialize

# Release gate.
RELEASE_AGREEMENT = Decimal("0.75")
RELEASE_SAMPLES = 500
MODEL_ROUTES = ("llm", "cache")


@dataclass(frozen=True)
class Gate:
    threshold: Decimal = RELEASE_AGREEMENT
    min_samples: int = RELEASE_SAMPLES


def content_identity() -> dict[str, Column]:
    """Normalized (keyword, language, text) under which two examples are the same."""
    return {
        "_keyword": T.casefold(T.strip(F.col("keyword"))),
        "_language": F.col("language"),
        "_text": T.casefold(T.collapse(F.col("text"))),
    }


def example_problems(examples: DataFrame) -> DataFrame:
    """Invalid rows, repeated ids and repeated contents, each with its number of surplus rows."""
    valid = examples.filter("is_valid")
    surplus = F.sum(F.col("n") - 1)
    invalid = examples.filter("NOT is_valid").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("invalid_example").alias("problem"), "n"
    )
    ids = valid.groupBy("example_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(surplus.alias("n"))
    keys = content_identity()
    texts = (
        valid.withColumns(keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(surplus.alias("n"))
    )
    return (
        invalid.unionByName(ids.select(F.lit("duplicate_example_id").alias("problem"), "n"))
        .unionByName(texts.select(F.lit("duplicate_content").alias("problem"), "n"))
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


def require_valid(examples: DataFrame) -> DataFrame:
    """The examples, or an error that names the first problem found."""
    found = example_problems(examples).filter("n > 0").orderBy("problem").take(1)
    if found:
        raise ValueError(f"{found[0]['problem']}: {found[0]['n']} row(s)")
    if examples.isEmpty():
        raise ValueError("validation dataset must contain at least one example")
    return examples.drop("is_valid")


@dataclass(frozen=True)
class Predictor:
    """A classifier that can be evaluated: ``predict`` takes labelled examples without their labels and gives
    (example_id, predicted_label, route). Examples that it leaves out, or gives no label, count as missing."""

    name: str
    version: str
    predict: Callable[[DataFrame], DataFrame]


def lexicon_predictor(lexicon: lexicons.Lexicon = lexicons.DEFAULT_LEXICON, version: str = "v1") -> Predictor:
    """The lexicon classifier, which runs as plain expressions."""

    def predict(examples: DataFrame) -> DataFrame:
        return classify_sentiment(examples, "text", lexicon).select("example_id", F.col("label").alias("predicted_label"), F.lit("lexicon").alias("route"))

    return Predictor("lexicon", version, predict)


def batch_predictor(name: str, version: str, function: Callable[[pd.DataFrame], pd.Series], route: str = "model") -> Predictor:
    """A classifier from a function of pandas batches of examples (example_id, keyword, language, text) to labels.

    Each Arrow batch of a task is one call; a missing label stays missing.
    """

    def predict(examples: DataFrame) -> DataFrame:
        given = examples.select("example_id", "keyword", "language", "text")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = pd.Series(function(batch), index=batch.index, dtype=object)
                yield pd.DataFrame({"example_id": batch["example_id"], "predicted_label": found.where(found.notna(), None), "route": route})

        kind = given.schema["example_id"].dataType.simpleString()
        return given.mapInPandas(run, f"example_id {kind}, predicted_label string, route string").filter("predicted_label IS NOT NULL")

    return Predictor(name, version, predict)


def evaluate(labels: DataFrame, predictor: Predictor) -> DataFrame:
    """Every example with the predictor's answer; an answer that is no label, twice given or for no example is an error."""
    predictions = materialize(predictor.predict(labels.drop("human_label")), "predictions")
    odd = predictions.filter(~F.col("predicted_label").isin(*LABELS)).select("example_id", F.lit("unknown_label").alias("problem"))
    found = prediction_problems(labels, predictions).unionByName(odd).orderBy("problem", "example_id").take(1)
    if found:
        raise ValueError(f"{predictor.name}: {found[0]['problem']} for example {found[0]['example_id']}")
    return matched(labels, predictions)


def compare_predictors(labels: DataFrame, predictors: Sequence[Predictor], by: tuple[str, ...] = ()) -> DataFrame:
    """The confusion matrix of every predictor over the same examples."""
    tables = [
        confusion_matrix(evaluate(labels, p), by).withColumns({"classifier_name": F.lit(p.name), "classifier_version": F.lit(p.version)}) for p in predictors
    ]
    return reduce(DataFrame.unionByName, tables)


def prediction_problems(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions for unknown examples and repeated predictions."""
    unknown = predictions.join(labels, "example_id", "left_anti").select("example_id").distinct()
    repeated = predictions.groupBy("example_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return unknown.select("example_id", F.lit("unknown_example").alias("problem")).unionByName(
        repeated.select("example_id", F.lit("duplicate_prediction").alias("problem"))
    )


def matched(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every example with its prediction; without one the route is ``missing``."""
    given = predictions.select("example_id", "predicted_label", "route")
    return labels.join(given, "example_id", "left").withColumn("route", F.coalesce("route", F.lit("missing")))


def confusion_matrix(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per human label and predicted label, ``missing`` where there is none."""
    predicted = F.col("predicted_label")
    return pairs.groupBy(*by, F.col("human_label").alias("actual_label")).agg(
        *[F.count_if(predicted == label).alias(label) for label in LABELS],
        F.count_if(predicted.isNull()).alias("missing"),
    )


def label_metrics(confusion: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; a missing prediction is a false negative."""
    actual = F.col("actual_label")
    sums = []
    for label in LABELS:
        support = sum((F.col(c) for c in (*LABELS, "missing")), F.lit(0))
        sums += [
            F.sum(F.when(actual == label, F.col(label)).otherwise(0)).alias(f"_{label}_hit"),
            F.sum(F.col(label)).alias(f"_{label}_predicted"),
            F.sum(F.when(actual == label, support).otherwise(0)).alias(f"_{label}_support"),
        ]
    wide = confusion.groupBy(*by).agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.col(f"_{label}_hit").alias("hit"),
                F.col(f"_{label}_predicted").alias("predicted"),
                F.col(f"_{label}_support").alias("support"),
            )
            for label in LABELS
        ]
    )
    long = wide.select(*by, F.inline(rows))
    hit = F.col("hit")
    scored = long.withColumns({"precision": share(hit, F.col("predicted")), "recall": share(hit, F.col("support"))})
    both = F.col("precision") + F.col("recall")
    f1 = exact_round(F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)), 4)
    return scored.withColumn("f1", f1).select(*by, "label", "precision", "recall", "f1", "support")


def macro_f1(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    total = F.sum(F.col("f1").cast("decimal(20,4)")).cast("double")
    return metrics.groupBy(*by).agg(exact_round(total / len(LABELS), 4).alias("macro_f1"))


def share(part: Column, whole: Column) -> Column:
    return exact_round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), 4)


def meets(part: Column, whole: Column, threshold: Decimal) -> Column:
    """Exact comparison of a ratio with a threshold, without rounding."""
    limit = F.lit(threshold).cast("decimal(9,6)")
    return (whole > 0) & (part.cast("decimal(20,0)") >= whole.cast("decimal(20,0)") * limit)


def language_agreement(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    correct = F.col("predicted_label") == F.col("human_label")
    counted = pairs.groupBy(*by, "language").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(correct).alias("correct_count")
    )
    return counted.withColumn("agreement", share(F.col("correct_count"), F.col("sample_count")))


def route_counts(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by, "route").agg(F.count(F.lit(1)).alias("count"))


def evaluation_report(
    pairs: DataFrame,
    *,
    hybrid: bool,
    manifest_verified: bool,
    gate: Gate = Gate(),
    languages: tuple[str, ...] = lexicons.SUPPORTED_LANGUAGES,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Agreement, coverage, macro F1 and all parts of the release gate in one row per group."""
    predicted = F.col("predicted_label")
    correct = predicted == F.col("human_label")
    counts = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count(predicted).alias("prediction_count"),
        F.count_if(correct).alias("correct_count"),
        F.count_if(predicted.isNotNull() & F.col("route").isin(*MODEL_ROUTES)).alias("llm_count"),
        *[F.count_if(F.col("human_label") == label).alias(f"_has_{label}") for label in LABELS],
        *[F.count_if(F.col("language") == name).alias(f"_n_{name}") for name in languages],
        *[F.count_if((F.col("language") == name) & correct).alias(f"_ok_{name}") for name in languages],
    )
    macro = macro_f1(label_metrics(confusion_matrix(pairs, by), by), by)
    joined = counts.join(macro, list(by)) if by else counts.withColumn("macro_f1", macro.scalar())
    n, ok = F.col("sample_count"), F.col("correct_count")

    def all_of(conditions) -> Column:
        result = F.lit(True)
        for condition in conditions:
            result = result & condition
        return result

    required_languages = all_of(F.col(f"_n_{name}") > 0 for name in languages)
    per_language = all_of(meets(F.col(f"_ok_{x}"), F.col(f"_n_{x}"), RELEASE_AGREEMENT) for x in languages)
    required_labels = all_of(F.col(f"_has_{label}") > 0 for label in LABELS)
    full_predictions = F.col("prediction_count") == n
    full_model = F.col("llm_count") == n
    release = (
        F.lit(hybrid)
        & meets(ok, n, RELEASE_AGREEMENT)
        & (n >= RELEASE_SAMPLES)
        & per_language
        & required_labels
        & full_predictions
        & full_model
        & F.lit(manifest_verified)
    )
    return joined.select(
        *by,
        "sample_count",
        "prediction_count",
        "correct_count",
        share(ok, n).alias("human_agreement"),
        share(F.col("prediction_count"), n).alias("prediction_coverage"),
        share(F.col("llm_count"), n).alias("llm_coverage"),
        "macro_f1",
        meets(ok, n, gate.threshold).alias("meets_agreement_threshold"),
        (n >= gate.min_samples).alias("meets_minimum_sample_count"),
        per_language.alias("meets_per_language_agreement"),
        required_languages.alias("has_required_languages"),
        required_labels.alias("has_required_labels"),
        F.lit(manifest_verified).alias("annotation_manifest_verified"),
        release.alias("release_ready"),
    )
