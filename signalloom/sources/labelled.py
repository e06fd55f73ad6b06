"""Human-labelled examples (JSON lines) and the manifest that describes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions import lexicons
from signalloom.functions import text as T
from signalloom.operators.sentiment import LABELS

EXAMPLE_SCHEMA = (
    "example_id string, keyword string, language string, text string, human_label string, "
    "source_category string, phenomena array<string>"
)
EXAMPLE_FIELDS = ("example_id", "keyword", "language", "text", "human_label", "source_category", "phenomena")
MANIFEST_SCHEMA = (
    "dataset_version string, labelled_at date, reviewer_count int, blind_review boolean, adjudicated boolean, "
    "pii_reviewed boolean, rights_reviewed boolean, annotator_agreement double"
)


def read_labelled_examples(
    spark: SparkSession, path: str, languages: tuple[str, ...] = lexicons.SUPPORTED_LANGUAGES
) -> DataFrame:
    """Examples with ``is_valid``; blank lines are skipped, unknown fields are not accepted."""
    lines = spark.read.text(path).filter(~T.is_blank(F.col("value")))
    parsed = lines.select(
        F.from_json("value", EXAMPLE_SCHEMA, {"mode": "PERMISSIVE"}).alias("e"),
        F.json_object_keys("value").alias("_fields"),
    ).select("e.*", "_fields")
    trimmed = parsed.withColumns({c: T.blank_to_null(F.col(c)) for c in ("example_id", "keyword", "text")})
    phenomena = F.array_sort(F.array_distinct(F.filter(F.transform("phenomena", T.strip), lambda p: p != "")))
    required = F.lit(True)
    for name in ("example_id", "keyword", "text", "language", "human_label"):
        required = required & F.col(name).isNotNull()
    valid = (
        required
        & F.col("_fields").isNotNull()
        & (F.size(F.array_except("_fields", F.array(*[F.lit(f) for f in EXAMPLE_FIELDS]))) == 0)
        & F.col("language").isin(*languages)
        & F.col("human_label").isin(*LABELS)
        & (F.length("example_id") <= 100)
        & (F.length("keyword") <= 255)
        & F.coalesce(F.length("source_category") <= 100, F.lit(True))
    )
    return trimmed.withColumns(
        {"phenomena": F.coalesce(phenomena, F.array().cast("array<string>")), "is_valid": F.coalesce(valid, F.lit(False))}
    ).drop("_fields")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with ``verified``: all reviews done, at least two reviewers."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    reviewed = F.lit(True)
    for name in ("blind_review", "adjudicated", "pii_reviewed", "rights_reviewed"):
        reviewed = reviewed & F.col(name)
    agreement = F.col("annotator_agreement")
    valid = (
        F.coalesce(F.length("dataset_version").between(1, 100), F.lit(False))
        & F.col("labelled_at").isNotNull()
        & F.coalesce(F.col("reviewer_count") >= 2, F.lit(False))
        & F.coalesce(agreement.between(0.0, 1.0), F.lit(True))
    )
    return manifest.withColumns(
        {"is_valid": valid, "verified": valid & F.coalesce(reviewed, F.lit(False))}
    )
