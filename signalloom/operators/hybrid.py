"""Model sentiment with a durable cache and a lexicon fallback.

The model is any callable ``classify_batch(keyword, items)`` that takes a list
of dicts (item_id, text, language) and returns a dict with ``predictions``
(item_id, label, score, confidence) and optionally token usage, ``model`` and
``response_id``. A :class:`ProviderError` names the reason of a failure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions import identity
from signalloom.functions import text as T
from signalloom.functions.scoring import sentiment_label
from signalloom.operators.dataset import with_run
from signalloom.operators.ranking import numbered
from signalloom.session import materialize, small_side

USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")
RESULT_SCHEMA = (
    "run_id {run}, batch_no bigint, cache_key string, label string, score double, confidence double, "
    "actual_model string, response_id string, error_code string, "
    + ", ".join(f"{name} bigint" for name in USAGE)
)


class ProviderError(RuntimeError):
    """Failure of a model call; ``code`` says why, ``usage`` what it cost."""

    def __init__(self, code: str, usage: dict[str, int] | None = None) -> None:
        super().__init__(code)
        self.code = code
        self.usage = usage or {}

    def __reduce__(self):
        return (ProviderError, (self.code, self.usage))


@dataclass(frozen=True)
class Provider:
    """What identifies a model; all of it is part of the cache key."""

    provider: str
    model: str
    prompt_version: str
    prompt_hash: str
    response_schema_version: str


@dataclass(frozen=True)
class CostRates:
    input_per_million_usd: Decimal
    output_per_million_usd: Decimal


def prepare_inputs(items: DataFrame, runs: DataFrame, provider: Provider, max_chars: int | None = None) -> DataFrame:
    """Add the model text, whether it was cut, and the cache key.

    ``items`` are processed signals with cleaned_text, language and signal_no.
    Whole texts are used unless ``max_chars`` states the model's input limit;
    the key covers exactly what the model gets.
    """
    whole = T.strip(F.col("cleaned_text"))
    if max_chars is None:
        model_text, is_cut = whole, F.lit(False)
    else:
        model_text, is_cut = F.substring(whole, 1, max_chars), F.length(whole) > max_chars
    keyed = with_run(items, runs, "keyword").withColumns({"llm_text": model_text, "is_truncated": is_cut})
    key = identity.cache_key(
        keyword=F.col("keyword"),
        text=F.col("llm_text"),
        language=F.col("language"),
        provider=provider.provider,
        model=provider.model,
        prompt_hash=provider.prompt_hash,
        prompt_version=provider.prompt_version,
        response_schema_version=provider.response_schema_version,
    )
    return keyed.withColumn("cache_key", key)


def pending_batches(inputs: DataFrame, cache: DataFrame, batch_size: int = 20) -> DataFrame:
    """One row per run and uncached key, numbered into batches in signal order.

    Copies of a text share a key and are sent once. The first copy of a key is
    a partial aggregate, so many copies never meet in one task.
    """
    firsts = inputs.groupBy("run_id", "cache_key").agg(F.min("signal_no").alias("signal_no"))
    pending = firsts.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")
    ordered = numbered(pending, ["run_id"], [F.col("signal_no")], "_no", "pending")
    numbered_keys = ordered.withColumn("batch_no", F.floor((F.col("_no") - 1) / batch_size)).drop("_no", "cache_key")
    texts = inputs.select("run_id", "signal_no", "cache_key", "keyword", "language", "llm_text")
    return numbered_keys.join(texts, ["run_id", "signal_no"])


def _batch_runner(classify_batch: Callable, label_rule: Callable[[float], str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("signal_no")
        items = [
            {"item_id": key, "text": text, "language": language}
            for key, text, language in zip(pdf["cache_key"], pdf["llm_text"], pdf["language"])
        ]
        out = {
            "run_id": pdf["run_id"].tolist(),
            "batch_no": pdf["batch_no"].tolist(),
            "cache_key": pdf["cache_key"].tolist(),
        }
        found: dict[str, dict] = {}
        usage: dict[str, int] = {}
        reply: dict = {}
        code = None
        try:
            reply = classify_batch(pdf["keyword"].iloc[0], items)
            predictions = reply["predictions"]
            usage = reply.get("usage", {})
            found = {p["item_id"]: p for p in predictions}
            if len(predictions) != len(items) or set(found) != set(out["cache_key"]):
                raise ProviderError("PROVIDER_RESPONSE_ITEM_MISMATCH")
            if any(p["label"] != label_rule(p["score"]) for p in predictions):
                raise ValueError("label does not match score")
        except ProviderError as error:
            code, found, usage = error.code, {}, error.usage
        except Exception:  # any other failure of the callable is reported the same way
            code, found, usage = "PROVIDER_UNEXPECTED_FAILURE", {}, {}
        for name in ("label", "score", "confidence"):
            out[name] = [found.get(key, {}).get(name) for key in out["cache_key"]]
        out["actual_model"] = [reply.get("model") if code is None else None] * len(items)
        out["response_id"] = [reply.get("response_id") if code is None else None] * len(items)
        out["error_code"] = [code] * len(items)
        for name in USAGE:
            # The usage of a call is carried by its first row.
            out[name] = [int(usage.get(name, 0))] + [0] * (len(items) - 1)
        return pd.DataFrame(out)

    return run


def _label_of(score: float) -> str:
    value = round(score, 4)
    return "positive" if value > 60 else "negative" if value < 40 else "neutral"


def classify_pending(batches: DataFrame, classify_batch: Callable) -> DataFrame:
    """Call the model once per batch. A group holds at most one batch of texts.

    After the first failing batch of a run all its later batches count as
    failed with the same code. The answers are written down at once, because a
    second evaluation would call the model again.
    """
    run_type = dict(batches.dtypes)["run_id"]
    columns = ["run_id", "batch_no", "signal_no", "cache_key", "keyword", "language", "llm_text"]
    answers = batches.select(*columns).groupBy("run_id", "batch_no").applyInPandas(
        _batch_runner(classify_batch, _label_of), RESULT_SCHEMA.format(run=run_type)
    )
    answers = materialize(answers, "answers")
    failures = answers.filter(F.col("error_code").isNotNull())
    first = failures.groupBy("run_id").agg(
        F.min_by("error_code", "batch_no").alias("_code"), F.min("batch_no").alias("_failed")
    )
    joined = answers.join(small_side(first), "run_id", "left")
    dropped = F.coalesce(F.col("batch_no") > F.col("_failed"), F.lit(False))
    fields = {
        name: F.when(~dropped, F.col(name))
        for name in ("label", "score", "confidence", "actual_model", "response_id")
    }
    return joined.withColumns(
        {
            **fields,
            **{name: F.when(dropped, F.lit(0)).otherwise(F.col(name)) for name in USAGE},
            "error_code": F.when(dropped, F.col("_code")).otherwise(F.col("error_code")),
            "was_called": ~dropped,
        }
    ).drop("_code", "_failed")


def hybrid_items(inputs: DataFrame, cache: DataFrame, answers: DataFrame) -> DataFrame:
    """Classification, route and fallback code of every input signal.

    The cache comes first, then the model's answer, then the lexicon values
    that the inputs already carry.
    """
    known = cache.select(
        "cache_key",
        F.struct("label", "score", "confidence", "actual_model").alias("_cached"),
    ).dropDuplicates(["cache_key"])
    given = answers.select(
        "run_id",
        "cache_key",
        F.when(F.col("label").isNotNull(), F.struct("label", "score", "confidence", "actual_model")).alias("_given"),
        "error_code",
    )
    base = inputs.select(
        "run_id", "signal_id", "source", "signal_type", "language", "cache_key", "is_truncated",
        F.struct("label", "score", "confidence", F.lit(None).cast("string").alias("actual_model")).alias("_lexicon"),
    )
    joined = base.join(known, "cache_key", "left").join(given, ["run_id", "cache_key"], "left")
    best = F.coalesce("_cached", "_given", "_lexicon")
    fallback = F.col("_cached").isNull() & F.col("_given").isNull()
    route = (
        F.when(F.col("_cached").isNotNull(), "cache").when(F.col("_given").isNotNull(), "llm").otherwise("lexicon_fallback")
    )
    return joined.select(
        "run_id", "signal_id", "source", "signal_type", "language", "cache_key", "is_truncated",
        best["label"].alias("label"),
        best["score"].alias("score"),
        best["confidence"].alias("confidence"),
        best["actual_model"].alias("actual_model"),
        route.alias("route"),
        F.when(fallback, F.coalesce("error_code", F.lit("CACHE_UNAVAILABLE"))).alias("fallback_code"),
    )


def new_cache_entries(answers: DataFrame, provider: Provider) -> DataFrame:
    """Usable answers in the shape of the cache, one per key."""
    usable = answers.filter(F.col("label").isNotNull())
    return usable.select(
        "cache_key",
        "label",
        "score",
        "confidence",
        F.coalesce("actual_model", F.lit(provider.model)).alias("actual_model"),
        "response_id",
    ).dropDuplicates(["cache_key"])


def inference_summary(items: DataFrame, answers: DataFrame, rates: CostRates | None = None) -> DataFrame:
    """Routes, calls, tokens, cost and models per run."""
    routes = items.groupBy("run_id").agg(
        F.count_if(F.col("route") == "llm").alias("llm_count"),
        F.count_if(F.col("route") == "cache").alias("cache_hit_count"),
        F.count_if(F.col("route") == "lexicon_fallback").alias("fallback_count"),
        F.count_if("is_truncated").alias("truncated_count"),
    )
    models = items.select("run_id", "actual_model").distinct().groupBy("run_id").agg(
        F.array_sort(F.collect_list("actual_model")).alias("actual_models")
    )
    per_batch = answers.groupBy("run_id", "batch_no").agg(
        F.bool_or("was_called").alias("_called"), *[F.sum(name).alias(name) for name in USAGE]
    )
    calls = per_batch.groupBy("run_id").agg(
        F.count_if("_called").alias("provider_call_count"), *[F.sum(name).alias(name) for name in USAGE]
    )
    joined = routes.join(models, "run_id", "left").join(calls, "run_id", "left").fillna(0, ["provider_call_count", *USAGE])
    return joined.withColumn("estimated_cost_usd", estimated_cost(rates))


def estimated_cost(rates: CostRates | None) -> Column:
    """Token cost in US dollars, six decimals, ties away from zero."""
    if rates is None:
        return F.lit(None).cast("decimal(18,6)")

    def part(column: str, rate: Decimal) -> Column:
        return F.col(column).cast("decimal(18,0)") * F.lit(rate).cast("decimal(12,6)")

    total = part("input_tokens", rates.input_per_million_usd) + part("output_tokens", rates.output_per_million_usd)
    return F.round(total.cast("decimal(30,6)") * F.lit(Decimal("0.000001")), 6).cast("decimal(18,6)")


__all__ = [
    "CostRates", "Provider", "ProviderError", "classify_pending", "estimated_cost", "hybrid_items",
    "inference_summary", "new_cache_entries", "pending_batches", "prepare_inputs", "sentiment_label",
]
