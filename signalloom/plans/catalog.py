"""Registered queries: every operator over the supplied tables, whole tables each.

A query returns plain columns. Times become text and arrays become joined text,
so that other engines can state the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions import identity
from signalloom.functions import text as T
from signalloom.operators import (
    anomaly, dataset, engagement, evaluation, fit, geo, hybrid, keywords, paging, quality, sentiment, trend, velocity,
)
from signalloom.operators.ranking import latest_per_key
from signalloom.plans import modules, scores
from signalloom.session import materialize, scratch_path
from signalloom.sinks import batches
from signalloom.sinks import tables as sinks
from signalloom.sources import adapter as A
from signalloom.sources import labelled, payloads, privacy
from signalloom.sources import tables as stored
from signalloom.streaming import signals as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf: wide_integers(function(spark, sf))
        return function

    return register


def wide_integers(df: DataFrame) -> DataFrame:
    """All whole numbers as BIGINT."""
    narrow = {c: F.col(c).cast("bigint") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")}
    return df.withColumns(narrow) if narrow else df


_kept: dict[tuple, object] = {}


def once(spark: SparkSession, sf: str, name: str, build: Callable[[], object]) -> object:
    """A result that several queries report on, computed once per session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def day(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def joined(column: str | Column) -> Column:
    return F.array_join(column, "|")


def coded(warnings: str | Column = "warnings") -> Column:
    return F.array_join(F.transform(warnings, lambda w: F.concat(w["code"], F.lit(":"), w["count"].cast("string"))), "|")


SETTINGS = modules.Settings(A.LEXICON, A.LANGUAGES)


# ---------------------------------------------------------------- sources


@query("src1_join1_run_signals")
def run_signals(spark, sf):
    found = stored.run_signals(A.signals(spark, sf), A.module_runs(spark, sf))
    return found.select("run_id", "module_run_id", "module_type", "signal_id", "signal_type", F.length("raw_text").alias("n_chars"))


@query("src2_eligible_metrics")
def eligible_metrics(spark, sf):
    found = stored.eligible_metrics(A.metrics(spark, sf), A.signals(spark, sf))
    return found.select("signal_id", "name", "value", stamp("recorded_at").alias("recorded_at"), "unit")


def video_responses(spark, sf):
    """One response per document: every line of the text is a video."""
    docs = A.documents(spark, sf)
    item = F.transform(
        F.split("raw_text", "\n"),
        lambda line, i: F.struct(
            F.concat_ws("-", F.col("doc_id").cast("string"), i.cast("string")).alias("id"),
            F.struct(
                line.alias("title"),
                F.concat(F.lit("By thon: "), line).alias("description"),
                F.when(i % 7 != 6, F.lit("2024-01-02T03:04:05Z")).alias("publishedAt"),
                F.lit("thon").alias("channelTitle"),
            ).alias("snippet"),
            F.struct(
                (i * 10 + 1).cast("string").alias("viewCount"),
                F.when(i % 3 != 0, i.cast("string")).alias("likeCount"),
                F.when(i % 2 == 0, i).alias("commentCount"),
            ).alias("statistics"),
        ),
    )
    return docs.select(F.col("doc_id").alias("request_id"), F.to_json(F.struct(item.alias("items"))).alias("payload"))


@query("src3_video_records")
def video_records(spark, sf):
    records = payloads.normalize_videos(video_responses(spark, sf))
    return records.select(
        "request_id", "external_item_id", "title", F.md5("content").alias("content_md5"), F.md5("raw_text").alias("raw_md5"),
        "published_at", F.col("engagement")["views"].alias("views"), F.try_element_at("engagement", F.lit("likes")).alias("likes"),
        F.try_element_at("engagement", F.lit("comments")).alias("comments"), "url",
    )


@query("src4_unique_video_ids")
def unique_video_ids(spark, sf):
    docs = A.documents(spark, sf)
    words = F.regexp_extract_all("raw_text", F.lit(r"([a-z]+)"), F.lit(1))
    # The words are plain letters, so the payload is joined from them as it is; without a text it has no list.
    first, last = '{"id":{"videoId":"', '"}}'
    items = F.when(F.size("words") > 0, F.concat(F.lit(first), F.array_join("words", f"{last},{first}"), F.lit(last))).otherwise("")
    payload = F.when(F.col("words").isNull(), "{}").otherwise(F.concat(F.lit('{"items":['), items, F.lit("]}")))
    responses = docs.select("doc_id", words.alias("words")).select(F.col("doc_id").alias("request_id"), payload.alias("payload"))
    return payloads.unique_video_ids(responses).select("request_id", "video_id", F.col("first_no").cast("bigint").alias("first_no"))


def issue_responses(spark, sf):
    """One response per document: the document is an issue."""
    docs = A.documents(spark, sf)
    item = F.struct(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 17).alias("number"),
        F.element_at(F.split("raw_text", "\n"), 1).alias("title"),
        F.col("raw_text").alias("body"),
        F.lit("2024-01-02T03:04:05Z").alias("created_at"),
        F.concat(F.lit("https://github.com/thon/repo/issues/"), F.col("doc_id").cast("string")).alias("html_url"),
        F.struct(F.lit("erin").alias("login")).alias("user"),
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 5).alias("comments"),
    )
    return docs.select(F.col("doc_id").alias("request_id"), F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))


@query("src5_issue_records")
def issue_records(spark, sf):
    records = payloads.normalize_issues(issue_responses(spark, sf))
    return records.select(
        "external_item_id", "title", F.md5("content").alias("content_md5"), F.md5("raw_text").alias("raw_md5"),
        F.try_element_at("engagement", F.lit("comments")).alias("comments"), "url",
    )


def search_responses(spark, sf):
    """One response per page: every link of the page is a hit."""
    pages = A.spread(A.table(spark, sf, "pages"))
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    hit = F.transform(
        links,
        lambda link, i: F.struct(
            F.concat(F.lit("Hit "), link).alias("title"),
            F.concat(F.lit("HTTPS://Example.org"), link, F.lit("#top")).alias("url"),
            (i % 9).alias("position"),
            F.lit(" about it ").alias("snippet"),
            F.when(i % 2 == 0, F.lit("Web")).alias("engine"),
        ),
    )
    return pages.select(
        F.col("page_id").alias("request_id"),
        F.lit("  The  Eriner ").alias("query"),
        F.lit("2024-01-31T00:00:00Z").alias("observed_at"),
        F.to_json(F.struct(hit.alias("results"))).alias("payload"),
    )


@query("src6_prj12_search_records")
def search_records(spark, sf):
    records = payloads.normalize_search_results(search_responses(spark, sf), max_results=10)
    return records.select(
        "request_id", F.col("item_no").cast("bigint").alias("item_no"), "external_item_id", "title", "content", "url", "observed_at"
    )


def examples_path(spark, sf):
    """Labelled documents as JSON lines, every second one with its id repeated."""
    labels = A.human_labels(spark, sf)
    rows = labels.select(
        F.to_json(
            F.struct(
                F.concat(F.lit(" doc-"), F.col("example_id").cast("string")).alias("example_id"),
                "keyword", "language", "text", "human_label",
            )
        ).alias("value")
    )
    path = scratch_path(spark, "examples")
    rows.write.text(path)
    return path


@query("src7_set7_labelled_examples")
def labelled_examples(spark, sf):
    found = labelled.read_labelled_examples(spark, examples_path(spark, sf), A.LANGUAGES)
    return evaluation.example_problems(found).select("problem", F.col("n").cast("bigint").alias("n"))


@query("src7_parsed_examples")
def parsed_examples(spark, sf):
    found = labelled.read_labelled_examples(spark, examples_path(spark, sf), A.LANGUAGES)
    return found.select("example_id", "keyword", "language", F.md5("text").alias("text_md5"), "human_label", "is_valid")


@query("src8_manifests")
def manifests(spark, sf):
    labels = A.table(spark, sf, "labels")
    rows = labels.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic")
    ).select(
        "quality",
        F.to_json(
            F.struct(
                F.concat(F.lit("v"), F.col("quality").cast("string")).alias("dataset_version"),
                F.lit("2024-01-31").alias("labelled_at"),
                (F.col("quality") + 1).alias("reviewer_count"),
                F.lit(True).alias("blind_review"),
                (F.col("n") > 1).alias("adjudicated"),
                F.lit(True).alias("pii_reviewed"),
                (F.col("toxic") >= 0).alias("rights_reviewed"),
            )
        ).alias("value")
    )
    # A manifest is a file of its own.
    path = scratch_path(spark, "manifests")
    rows.write.partitionBy("quality").text(path)
    found = labelled.read_manifest(spark, path)
    return found.select("dataset_version", F.col("reviewer_count").cast("bigint").alias("reviewer_count"), "is_valid", "verified")


@query("src9_lim1_signal_page")
def signal_page(spark, sf):
    return page_columns(paging.signal_page(A.signals(spark, sf), A.metrics(spark, sf), limit=10, offset=5))


def page_columns(page: DataFrame) -> DataFrame:
    return page.select(
        "run_id", F.col("row_number").cast("bigint").alias("row_number"), "total_count", "signal_id",
        stamp("published_at").alias("published_at"), "views", "likes", "comments",
    )


@query("src9_lim1_deep_page")
def deep_page(spark, sf):
    """A page far down the list of all signals, which form one run here."""
    signals = A.signals(spark, sf).withColumn("run_id", F.lit("all"))
    return page_columns(paging.signal_page(signals, A.metrics(spark, sf), limit=100, offset=800))


@query("src9_stored_page")
def stored_page(spark, sf):
    """A page of the signals that were stored batch by batch, with their links."""
    found = delivered_batches(spark, sf)
    page = paging.signal_page(found["signals"], found["metrics"], limit=25, offset=40)
    return page.select(
        "run_id", "row_number", "total_count", "signal_id", stamp("published_at").alias("published_at"), "views", "likes", "comments", "url",
        F.md5("raw_text").alias("raw_md5"),
    )


# ---------------------------------------------------------------- text, filters, projections


@query("prj1_clean_text")
def clean_text(spark, sf):
    return A.documents(spark, sf).select("doc_id", T.clean_text(F.col("raw_text")).alias("cleaned_text"))


@query("flt1_flt2_flt3_record_flags")
def record_flags(spark, sf):
    docs = A.documents(spark, sf).withColumn("cleaned_text", T.clean_text(F.col("raw_text")))
    return docs.select(
        "doc_id",
        quality.is_spam(F.col("raw_text"), F.col("cleaned_text"), A.SPAM_PHRASES).alias("is_spam"),
        quality.is_bot(F.col("raw_text"), F.col("signal_type"), A.BOT_WORDS, A.BOT_PHRASES).alias("is_bot"),
        quality.is_empty_record(F.col("raw_text"), F.col("external_item_id")).alias("is_empty"),
    )


@query("flt4_valid_records")
def valid_records(spark, sf):
    lines = F.split("raw_text", "\n")
    docs = A.documents(spark, sf).select(
        "doc_id",
        F.concat(F.lit("  "), F.col("external_item_id"), F.lit("\t")).alias("external_item_id"),
        F.concat(F.lit(" "), F.col("source")).alias("source"),
        F.element_at(lines, 1).alias("title"),
        F.try_element_at(lines, F.lit(2)).alias("content"),
        "raw_text",
    )
    return quality.validate_records(docs)


def judged_records(spark, sf):
    records = A.records(spark, sf)
    labels = A.table(spark, sf, "labels").select(F.col("doc_id").alias("arrival"))
    hashed = quality.with_content_hash(records)
    already = hashed.join(labels, "arrival", "left_semi").filter(F.col("language") != "en").select("content_hash")
    return quality.exclude_records(
        records, already, spam_phrases=A.SPAM_PHRASES, bot_words=A.BOT_WORDS, bot_phrases=A.BOT_PHRASES
    )


@query("flt5_win9_join7_exclusion_outcomes")
def exclusion_outcomes(spark, sf):
    return judged_records(spark, sf).select("arrival", "run_id", "content_hash", "outcome", F.length("cleaned_text").alias("n_clean"))


@query("flt5_filter_audits")
def filter_audits(spark, sf):
    return quality.filter_audits(judged_records(spark, sf))


@query("agg22_filter_summary")
def filter_summary(spark, sf):
    return quality.filter_summary(judged_records(spark, sf))


@query("join2_retained_signals")
def retained_signals(spark, sf):
    judged = judged_records(spark, sf)
    audits = quality.filter_audits(judged)
    hashed = quality.with_content_hash(A.records(spark, sf))
    return quality.retained_signals(hashed, audits).select("arrival", "run_id", "content_hash")


@query("prj2_redacted_text")
def redacted_text(spark, sf):
    docs = A.documents(spark, sf)
    return docs.select("doc_id", T.redact(F.col("raw_text")).alias("redacted"))


def metadata_records(spark, sf):
    lines = F.split("raw_text", "\n")
    first = F.element_at(lines, 1)
    metadata = F.struct(
        first.alias("title"),
        F.struct(F.lit("Thon").alias("login"), F.array(F.struct(F.lit("erin").alias("name"))).alias("aliases")).alias("authorInfo"),
        F.struct(F.struct(F.lit("eriner").alias("profileURL"), first.alias("note")).alias("inner"), F.lit(3).alias("n")).alias("details"),
        F.lit("secret").alias("raw_payload"),
        F.array(first, F.lit("thon")).alias("list"),
    )
    return A.documents(spark, sf).select(
        "doc_id", first.alias("title"), F.lit("").alias("content"), "raw_text",
        F.lit("https://example.org/Thon/x").alias("url"), F.lit("ouiae").alias("channel_id"),
        F.to_json(metadata).alias("platform_metadata"),
    )


@query("prj3_prj4_sanitized_records")
def sanitized_records(spark, sf):
    found = privacy.sanitize_records(metadata_records(spark, sf))
    return found.select("doc_id", "title", F.md5("raw_text").alias("raw_md5"), "url", "channel_id", "platform_metadata")


@query("flt6_supported_languages")
def supported_languages(spark, sf):
    docs = A.documents(spark, sf).withColumn(
        "tag", F.expr("case doc_id % 4 when 0 then upper(language) when 1 then concat(' ', language, '-XX') when 2 then '' end")
    )
    return docs.select("doc_id", T.supports_language(F.col("tag"), A.LANGUAGES).alias("is_supported"))


@query("prj5_modalities")
def modalities(spark, sf):
    return A.signals(spark, sf).select("signal_id", joined("modalities").alias("modalities"))


@query("flt7_set2_modality_views")
def modality_views(spark, sf):
    found = dataset.with_modality(A.signals(spark, sf), "engagement", "search_intent")
    return found.select("signal_id", "run_id")


@query("prj6_normalized_tags")
def normalized_tags(spark, sf):
    return dataset.normalize_arrays(A.signals(spark, sf)).select("signal_id", joined("tags").alias("tags"))


@query("flt8_in_timeframe")
def in_timeframe(spark, sf):
    found = dataset.in_timeframe(A.signals(spark, sf), A.runs(spark, sf))
    return found.select("run_id", "signal_id", stamp("published_at").alias("published_at"))


@query("flt9_recent_window")
def recent_window(spark, sf):
    orders = A.table(spark, sf, "orders")
    first, end = dataset.recent_window(F.to_date("o_orderdate"))
    return orders.select("o_orderkey", stamp(first).alias("window_start"), stamp(end).alias("window_end"))


@query("prj7_timestamps")
def timestamps(spark, sf):
    events = A.table(spark, sf, "events").select(
        "event_id",
        F.expr(
            "case event_id % 5 when 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") "
            "when 1 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+07:00') "
            "when 2 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') when 3 then event_type end"
        ).alias("given"),
    )
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return events.select(
        "event_id",
        stamp(identity.published_or(F.col("given"), as_of, keep_missing=True)).alias("kept_missing"),
        stamp(identity.published_or(F.col("given"), as_of, keep_missing=False)).alias("always_set"),
    )


@query("prj8_canonical_metrics")
def canonical_metrics(spark, sf):
    metrics = A.metrics(spark, sf).withColumn("counter", F.coalesce(dataset.canonical_metric(), F.lit("unsupported")))
    return metrics.select("signal_id", "name", "counter", "value", stamp("recorded_at").alias("recorded_at"))


@query("prj9_country_codes")
def country_codes(spark, sf):
    return A.signals(spark, sf).select("signal_id", identity.country_code(F.col("country_code")).alias("country_code"))


@query("prj10_content_hashes")
def content_hashes(spark, sf):
    return quality.with_content_hash(A.records(spark, sf)).select("arrival", "content_hash")


@query("prj11_canonical_urls")
def canonical_urls(spark, sf):
    pages = A.table(spark, sf, "pages")
    shown = F.expr("case page_id % 3 when 0 then upper(substr(url, 1, 9)) || substr(url, 10) when 1 then replace(url, 'http', 'ftp') else url end")
    return pages.select("page_id", identity.canonical_url(shown).alias("canonical_url"))


PROVIDER = hybrid.Provider("demo", "model-a", "v1", "abc", "1.0")


def processed_inputs(spark, sf):
    sealed = A.sealed_signals(spark, sf)
    classified = sentiment.classified_signals(sealed, A.LEXICON, A.LANGUAGES)
    processed = classified.filter(F.col("text_status") == "processed")
    return hybrid.prepare_inputs(processed, A.runs(spark, sf), PROVIDER)


@query("prj13_prj14_model_inputs")
def model_inputs(spark, sf):
    found = processed_inputs(spark, sf)
    return found.select("signal_id", F.md5("llm_text").alias("text_md5"), "is_truncated", "cache_key")


@query("prj16_first_snippets")
def first_snippets(spark, sf):
    found = paging.first_snippets(A.dataset_signals(spark, sf))
    return found.select("run_id", F.col("snippet_no").cast("bigint").alias("snippet_no"), "signal_id")


@query("flt10_flt11_run_lists")
def run_lists(spark, sf):
    runs = A.runs(spark, sf).withColumns(
        {"created_by": F.concat(F.lit("u"), F.length("run_id").cast("string")), "created_at": F.to_timestamp("timeframe_end")}
    )
    found = paging.list_runs(paging.search_runs(runs, "ERINER"), F.lit("u4"))
    return found.select("run_id", "keyword", "created_by")


# ---------------------------------------------------------------- joins


@query("join3_signals_with_metrics")
def signals_with_metrics(spark, sf):
    found = stored.signals_with_metrics(A.signals(spark, sf).select("signal_id", "run_id"), A.metrics(spark, sf))
    return found.select("signal_id", "run_id", "name", "value", stamp("recorded_at").alias("recorded_at"))


@query("join11_signals_of_runs")
def signals_of_runs(spark, sf):
    completed = A.module_runs(spark, sf).filter(F.col("status") == "completed")
    return stored.signals_of_runs(A.signals(spark, sf), completed).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("join14_identity_check")
def identity_check(spark, sf):
    prints = dataset.fingerprint(A.runs(spark, sf), A.dataset_signals(spark, sf), A.metrics(spark, sf))
    datasets = prints.select("run_id", F.concat(F.lit("snap-"), "run_id").alias("snapshot_id"), "input_fingerprint")
    executions = datasets.withColumns(
        {
            "snapshot_id": F.when(F.length("run_id") == 4, F.col("snapshot_id")).otherwise("snap"),
            "input_fingerprint": F.when(F.col("run_id") == "src1", "x").otherwise(F.col("input_fingerprint")),
        }
    )
    checked = dataset.check_identity(executions, datasets)
    return checked.select("run_id", joined("mismatched_fields").alias("mismatched_fields"))


# ---------------------------------------------------------------- sentiment and aspects


def classified(spark, sf):
    return sentiment.classified_signals(A.dataset_signals(spark, sf), A.LEXICON, A.LANGUAGES)


def stored_scores(spark, sf):
    return sentiment.stored_sentiment(A.signals(spark, sf), A.LEXICON)


@query("scl1_scl2_sentiment_items")
def sentiment_items(spark, sf):
    return sentiment.sentiment_items(classified(spark, sf))


@query("agg1_sentiment_summary")
def sentiment_summary(spark, sf):
    found = sentiment.sentiment_summary(classified(spark, sf))
    return found.withColumn("warnings", coded())


@query("scl3_aspect_mentions")
def aspect_mentions(spark, sf):
    return sentiment.aspect_sentiments(stored_scores(spark, sf), A.ASPECTS)


@query("agg3_topk2_aspect_rollup")
def aspect_rollup(spark, sf):
    found = sentiment.aspect_rollup(sentiment.aspect_sentiments(stored_scores(spark, sf), A.ASPECTS))
    return found


@query("agg2_source_sentiment")
def source_sentiment(spark, sf):
    scored = stored_scores(spark, sf)
    found = sentiment.source_sentiment(A.signals(spark, sf), scored, sentiment.aspect_sentiments(scored, A.ASPECTS))
    named = F.transform("top_aspects", lambda a: F.concat_ws(":", a["aspect"], a["mention_count"].cast("string")))
    return found.withColumn("top_aspects", joined(named))


@query("agg25_join4_daily_sentiment")
def daily_sentiment(spark, sf):
    as_of = F.lit("2024-02-01").cast("date")
    found = sentiment.daily_sentiment_or_fallback(A.signals(spark, sf), stored_scores(spark, sf), as_of)
    return found.withColumn("day", day("day"))


# ---------------------------------------------------------------- keywords


def lazy_forms(spark, sf):
    """The extraction that all keyword queries use, and the names of the sources that its bits stand for.

    The words are stored once; a query that reads the forms once counts them itself, since they take more room than
    their texts.
    """

    def build():
        sources = keywords.source_names(A.dataset_signals(spark, sf))
        spelled = keywords.spellings(A.sealed_signals(spark, sf), A.runs(spark, sf), sources, A.LANGUAGES)
        return keywords.keyword_forms(spelled, A.runs(spark, sf)), sources

    return once(spark, sf, "lazy-forms", build)


def keyword_table(spark, sf):
    return keywords.keyword_table(*lazy_forms(spark, sf))


def merged_counts(spark, sf):
    return keywords.merged_forms(lazy_forms(spark, sf)[0])


@query("scl4_win11_terms")
def terms(spark, sf):
    return keywords.signal_terms(A.dataset_signals(spark, sf).select("signal_id", "cleaned_text"))


@query("scl5_normalized_keys")
def normalized_keys(spark, sf):
    docs = A.documents(spark, sf)
    return docs.select("doc_id", F.md5(T.normalize_key(F.col("raw_text"))).alias("key_md5"))


@query("agg4_keywords")
def all_keywords(spark, sf):
    found = keyword_table(spark, sf)
    return found.select("run_id", "canonical_form", "keyword", "frequency", joined("sources").alias("sources"))


@query("win6_keyword_ranks")
def keyword_ranks(spark, sf):
    # The ranking sorts and stores its rows, so it gets only the columns that it needs.
    found = keywords.ranked_keywords(keyword_table(spark, sf).select("run_id", "canonical_form", "keyword", "frequency", "first"))
    return found.select("run_id", "rank", "keyword", "frequency")


@query("agg6_keyword_totals")
def keyword_totals(spark, sf):
    found = keywords.keyword_totals(A.dataset_signals(spark, sf), keyword_table(spark, sf), A.LANGUAGES)
    return found.withColumn("warnings", coded())


@query("agg5_topk3_merged_keywords")
def merged_keywords(spark, sf):
    found = keywords.leading_keywords(merged_counts(spark, sf))
    return found.select("run_id", F.col("rank").cast("bigint").alias("rank"), "keyword", "count")


@query("prj15_keyword_exclusion")
def keyword_exclusion(spark, sf):
    texts = A.dataset_signals(spark, sf).select("run_id", "cleaned_text")
    plain = keywords.extract_terms(texts).groupBy("run_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return keywords.drop_run_keyword(plain, A.runs(spark, sf), "term")


@query("scl17_keyword_match_scores")
def keyword_match_scores(spark, sf):
    top = keywords.leading_keywords(merged_counts(spark, sf), 4)
    mood = sentiment.sentiment_summary(classified(spark, sf)).select("run_id", "average_score")
    found = keywords.keyword_match_scores(top, mood)
    return found


@query("snk7_keyword_export")
def keyword_export(spark, sf):
    merged = merged_counts(spark, sf)
    path = scratch_path(spark, "keyword-csv")
    sinks.write_keyword_export(keywords.export_keywords(merged), path)
    return spark.read.option("header", True).schema("Rank bigint, Keyword string, Count bigint, run_id string").csv(path)


# ---------------------------------------------------------------- engagement


def records(spark, sf):
    return engagement.engagement_records(A.dataset_signals(spark, sf), engagement.latest_counters(A.metrics(spark, sf)))


@query("win1_latest_counters")
def latest_counters(spark, sf):
    found = engagement.latest_counters(A.metrics(spark, sf))
    return found.withColumn("latest_metric_at", stamp("latest_metric_at"))


@query("win1b_conflict_counts")
def conflict_counts(spark, sf):
    return engagement.conflict_counts(A.metrics(spark, sf))


@query("scl7_scl8_engagement_records")
def engagement_records(spark, sf):
    return records(spark, sf).select(
        "run_id", "signal_id", "source", stamp("ranking_at").alias("ranking_at"), "views", "likes", "comments",
        "interactions", "like_rate", "comment_rate", "engagement_rate", "metric_completeness", "is_partial",
    )


ENGAGEMENT_COLUMNS = (
    "run_id", "source", "level", "signal_count", "complete_signal_count", "partial_signal_count",
    "views", "views_signal_count", "likes", "likes_signal_count", "comments", "comments_signal_count",
    "interactions", "interactions_signal_count", "like_rate", "like_rate_signal_count", "comment_rate",
    "comment_rate_signal_count", "engagement_rate", "engagement_rate_signal_count", "metric_completeness",
)


@query("agg7_agg8_agg9_agg10_engagement_summary")
def engagement_summary(spark, sf):
    return engagement.engagement_summary(records(spark, sf)).select(*ENGAGEMENT_COLUMNS)


@query("agg11_observation_quality")
def observation_quality(spark, sf):
    return engagement.observation_quality(records(spark, sf), engagement.conflict_counts(A.metrics(spark, sf)))


@query("win3_win4_srt2_ranked_records")
def ranked_records(spark, sf):
    found = engagement.order_records(engagement.rank_records(records(spark, sf)))
    return found.select("run_id", "signal_id", "interactions", "engagement_rate", "interaction_rank", "engagement_rate_rank")


@query("agg35_engagement_warnings")
def engagement_warnings(spark, sf):
    found = modules.engagement_module(A.dataset_signals(spark, sf), A.metrics(spark, sf), A.runs(spark, sf))
    return found.select("run_id", "status", "coverage_status", "coverage", coded().alias("warnings"))


# ---------------------------------------------------------------- trend, velocity


def halves(spark, sf):
    relevant = trend.trend_signals(A.dataset_signals(spark, sf), A.runs(spark, sf))
    return relevant, trend.half_values(relevant, A.metrics(spark, sf))


@query("agg12_win2_set3_scl6_trend_metrics")
def trend_metrics(spark, sf):
    return trend.trend_metrics(halves(spark, sf)[1])


@query("agg13_period_counts")
def period_counts(spark, sf):
    return trend.period_counts(halves(spark, sf)[0], A.metrics(spark, sf))


@query("agg14_trend_summary")
def trend_summary(spark, sf):
    found = modules.trend_module(A.dataset_signals(spark, sf), A.metrics(spark, sf), A.runs(spark, sf))
    return found.select(
        "run_id", "status", "coverage_status", "signal_count", "applicable_count", "earlier_observations", "recent_observations",
        "earlier_total", "recent_total", "overall_growth_rate", "overall_momentum", "trend_score", "total_metric_observations",
    )


@query("agg19_join12_daily_volume")
def daily_volume(spark, sf):
    found = velocity.daily_volume(A.dataset_signals(spark, sf), A.metrics(spark, sf), A.runs(spark, sf))
    return found.select("run_id", "source", day("day").alias("day"), "volume", "engagement")


@query("agg20_scl19_velocity")
def velocity_scores(spark, sf):
    return velocity.velocity(velocity.daily_volume(A.dataset_signals(spark, sf), A.metrics(spark, sf), A.runs(spark, sf)))


@query("agg21_hype_scores")
def hype_scores(spark, sf):
    return velocity.hype_metrics(A.dataset_signals(spark, sf), A.metrics(spark, sf))


@query("topk1_trending_titles")
def trending_titles(spark, sf):
    title = F.element_at(F.split("raw_text", "\n"), 1)
    return velocity.trending_titles(A.dataset_signals(spark, sf), title)


# ---------------------------------------------------------------- regions, anomalies


def regional_base(spark, sf):
    items = sentiment.sentiment_items(classified(spark, sf))
    return geo.regional_base(A.dataset_signals(spark, sf), A.metrics(spark, sf), items)


@query("agg15_win5_win7_join5_regions")
def regions(spark, sf):
    found = geo.geo_regions(regional_base(spark, sf))
    return found


@query("agg16_geo_summary")
def geo_summary(spark, sf):
    return geo.geo_summary(regional_base(spark, sf))


@query("set6_regional_terms")
def regional_terms(spark, sf):
    return geo.regional_terms(A.dataset_signals(spark, sf))


def series(spark, sf):
    return anomaly.daily_series(A.dataset_signals(spark, sf), A.metrics(spark, sf), A.runs(spark, sf))


@query("agg17_win13_daily_series")
def daily_series(spark, sf):
    return series(spark, sf).withColumn("day", day("day"))


@query("agg18_baselines")
def baselines(spark, sf):
    found = anomaly.baselines(series(spark, sf))
    return found.select(
        "run_id", "metric_name", *[F.round(c, 3).alias(c) for c in ("median", "mad", "mean_deviation")], "periods"
    )


def day_scores(spark, sf):
    daily = materialize(series(spark, sf), "series")
    return anomaly.scored_days(daily, anomaly.baselines(daily))


@query("win12_scl9_scored_days")
def scored_days(spark, sf):
    return day_scores(spark, sf).select("run_id", "metric_name", day("day").alias("day"), "value", "deviation")


@query("scl9_scl10_srt3_scl20_alerts")
def alerts(spark, sf):
    found = anomaly.alerts(day_scores(spark, sf))
    return found.withColumns({"period_start": day("period_start"), "period_end": day("period_end"), "probable_cause": anomaly.probable_cause()})


@query("scl10_detection_summary")
def detection_summary(spark, sf):
    found = anomaly.detection_summary(A.runs(spark, sf), anomaly.baselines(series(spark, sf)))
    return found.withColumn("metrics_analyzed", joined("metrics_analyzed"))


@query("scl9_alert_evidence")
def alert_evidence(spark, sf):
    found = anomaly.alert_evidence(anomaly.alerts(day_scores(spark, sf)), A.dataset_signals(spark, sf), A.runs(spark, sf))
    return found.withColumn("period_start", day("period_start"))


# ---------------------------------------------------------------- dataset, manifests


@query("agg23_agg26_filter_statistics")
def filter_statistics(spark, sf):
    return quality.filter_statistics(A.signals(spark, sf))


@query("agg24_source_coverage")
def source_coverage(spark, sf):
    return quality.source_coverage(A.signals(spark, sf), A.module_runs(spark, sf))


@query("agg27_active_platforms")
def active_platforms(spark, sf):
    return quality.active_platforms(A.module_runs(spark, sf)).withColumn("platforms", joined("platforms"))


@query("agg28_fingerprints")
def fingerprints(spark, sf):
    return dataset.fingerprint(A.runs(spark, sf), A.dataset_signals(spark, sf), A.metrics(spark, sf))


@query("srt1_signal_order")
def signal_order(spark, sf):
    return dataset.signal_order(A.dataset_signals(spark, sf))


def analysis(spark, sf):
    def build():
        signals, table = A.dataset_signals(spark, sf), keyword_table(spark, sf)
        return modules.analyze(signals, A.metrics(spark, sf), A.runs(spark, sf), SETTINGS, table)

    return once(spark, sf, "analysis", build)


@query("udf1_agg35_module_results")
def module_results(spark, sf):
    found = analysis(spark, sf).envelopes
    return found.select(
        "run_id", "module", "status", "coverage_status", "applicable_count", "processed_count", "source_count", coded().alias("warnings")
    )


@query("agg34_execution_manifest")
def execution_manifest(spark, sf):
    return analysis(spark, sf).manifest


@query("join13_module_outputs")
def module_outputs(spark, sf):
    return analysis(spark, sf).outputs


@query("scl11_scl12_vibe_scores")
def vibe_scores(spark, sf):
    return analysis(spark, sf).vibe


@query("scl13_community_health")
def community_health(spark, sf):
    return analysis(spark, sf).health


@query("scl14_topk4_insight_findings")
def insight_findings(spark, sf):
    found = analysis(spark, sf).findings
    return found.select("run_id", F.col("ordinal").cast("bigint").alias("ordinal"), "category", "statement", "evidence", "source_module")


@query("scl14_insight_summaries")
def insight_summaries(spark, sf):
    found = analysis(spark, sf).summary
    return found.withColumns({c: joined(c) for c in ("contributing_modules", "unavailable_modules")})


# ---------------------------------------------------------------- collaboration fit


def fit_results(spark, sf):
    signals, metrics, runs = A.dataset_signals(spark, sf), A.metrics(spark, sf), A.runs(spark, sf)
    counted = signals.groupBy("run_id").agg(F.count(F.lit(1)).alias("signal_count"))
    mood = sentiment.sentiment_summary(classified(spark, sf)).select("run_id", "average_score")
    paced = modules.trend_module(signals, metrics, runs).select("run_id", "overall_momentum")
    results = materialize(counted.join(mood, "run_id", "left").join(paced, "run_id", "left"), "fit-runs")
    inputs = fit.fit_inputs(
        A.selections(spark, sf), A.candidates(spark, sf), A.brands(spark, sf), results, keyword_table(spark, sf)
    )
    return fit.collaboration_fit(inputs)


@query("scl15_set4_join8_collaboration_fit")
def collaboration_fit(spark, sf):
    found = fit_results(spark, sf)
    return found.withColumns({c: joined(c) for c in ("risk_signals", "strengths", "weaknesses")})


@query("join9_run_evaluations")
def run_evaluations(spark, sf):
    """The best ten evaluations of every run."""
    page = fit.evaluation_page(fit_results(spark, sf), A.selections(spark, sf), limit=10, offset=0)
    return page.select("run_id", F.col("row_number").cast("bigint").alias("row_number"), "selection_id", "collaboration_score", "total_count")


# ---------------------------------------------------------------- evaluation


def evaluation_pairs(spark, sf):
    """Labelled documents and lexicon predictions for all of them but one in seven."""
    labels = A.human_labels(spark, sf)
    scored = sentiment.classify_sentiment(labels, "text", A.LEXICON)
    route = F.expr("case when example_id % 7 = 0 then null when example_id % 3 = 0 then 'cache' when example_id % 3 = 1 then 'llm' else 'lexicon_fallback' end")
    predictions = scored.select("example_id", F.col("label").alias("predicted_label"), route.alias("route")).filter("route IS NOT NULL")
    return labels, predictions


def lead_words(batch):
    """A classifier for the predictor hook: it looks at the first words of a text, and gives up on some languages."""
    lead = batch["text"].fillna("").str.slice(0, 60).str.lower()
    label = lead.str.contains("th", regex=False).map({True: "positive", False: "neutral"}).where(~lead.str.contains("de", regex=False), "negative")
    return label.where(batch["language"] != "de")


@query("udf4_predictor_reports")
def predictor_reports(spark, sf):
    labels = A.human_labels(spark, sf)
    hooks = (evaluation.lexicon_predictor(A.LEXICON), evaluation.batch_predictor("lead-words", "v1", lead_words))
    return evaluation.compare_predictors(labels, hooks, ("language",)).select(
        "classifier_name", "classifier_version", "language", "actual_label", "positive", "neutral", "negative", "missing"
    )


@query("join10_matched_predictions")
def matched_predictions(spark, sf):
    labels, predictions = evaluation_pairs(spark, sf)
    return evaluation.matched(labels, predictions).select("example_id", "human_label", "predicted_label", "route")


@query("set5_join10_prediction_problems")
def prediction_problems(spark, sf):
    labels, predictions = evaluation_pairs(spark, sf)
    every = A.documents(spark, sf).select(F.col("doc_id").alias("example_id"), F.lit("neutral").alias("predicted_label"), F.lit("llm").alias("route"))
    return evaluation.prediction_problems(labels, predictions.unionByName(every))


@query("agg29_confusion_matrix")
def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(evaluation.matched(*evaluation_pairs(spark, sf)), ("run_id",))


@query("agg30_label_metrics")
def label_metrics(spark, sf):
    pairs = evaluation.matched(*evaluation_pairs(spark, sf))
    return evaluation.label_metrics(evaluation.confusion_matrix(pairs, ("run_id",)), ("run_id",))


@query("agg30_macro_f1")
def macro_f1(spark, sf):
    pairs = evaluation.matched(*evaluation_pairs(spark, sf))
    return evaluation.macro_f1(evaluation.label_metrics(evaluation.confusion_matrix(pairs)))


@query("agg31_language_agreement")
def language_agreement(spark, sf):
    return evaluation.language_agreement(evaluation.matched(*evaluation_pairs(spark, sf)))


@query("agg31_route_counts")
def route_counts(spark, sf):
    return evaluation.route_counts(evaluation.matched(*evaluation_pairs(spark, sf)))


@query("agg31_agg32_evaluation_report")
def evaluation_report(spark, sf):
    pairs = materialize(evaluation.matched(*evaluation_pairs(spark, sf)), "pairs")
    return evaluation.evaluation_report(
        pairs, hybrid=True, manifest_verified=True, gate=evaluation.Gate(Decimal("0.25"), 100), languages=A.LANGUAGES, by=("run_id",)
    )


# ---------------------------------------------------------------- hybrid sentiment


def demo_model(keyword: str, items: list[dict]) -> dict:
    """Stands in for a remote model: scores by text length, fails on some batches."""
    if sum(len(i["text"]) for i in items) % 11 == 0:
        raise hybrid.ProviderError("PROVIDER_RATE_LIMITED", {"input_tokens": 5, "total_tokens": 5})
    names = {0: ("negative", 10.0), 1: ("neutral", 50.0), 2: ("positive", 90.0)}
    out = []
    for item in items:
        label, score = names[len(item["text"]) % 3]
        out.append({"item_id": item["item_id"], "label": label, "score": score, "confidence": 0.9})
    size = sum(len(i["text"]) for i in items)
    return {"predictions": out, "usage": {"input_tokens": size, "output_tokens": len(items), "total_tokens": size + len(items)}, "model": "model-a-1"}


def hybrid_parts(spark, sf):
    inputs = materialize(processed_inputs(spark, sf).drop("raw_text", "cleaned_text"), "inputs")
    labels = A.table(spark, sf, "labels").select(F.col("doc_id").alias("signal_id"))
    cached = inputs.join(labels, "signal_id", "left_semi").select("cache_key").distinct()
    cache = cached.select(
        "cache_key", F.lit("positive").alias("label"), F.lit(75.0).alias("score"), F.lit(0.8).alias("confidence"),
        F.lit("model-a-0").alias("actual_model"), F.lit(None).cast("string").alias("response_id"),
    )
    answers = hybrid.classify_pending(hybrid.pending_batches(inputs, cache), demo_model)
    answers = materialize(answers, "used-answers")
    return hybrid.hybrid_items(inputs, cache, answers), answers


@query("win14_udf2_udf5_join6_hybrid_items")
def hybrid_items(spark, sf):
    items, _ = hybrid_parts(spark, sf)
    return items.select("run_id", "signal_id", "label", "score", "confidence", "route", "fallback_code")


@query("agg33_inference_summary")
def inference_summary(spark, sf):
    items, answers = hybrid_parts(spark, sf)
    rates = hybrid.CostRates(Decimal("0.15"), Decimal("0.60"))
    found = hybrid.inference_summary(items, answers, rates)
    return found.select(
        "run_id", "llm_count", "cache_hit_count", "fallback_count", "truncated_count", joined("actual_models").alias("actual_models"),
        "provider_call_count", "input_tokens", "output_tokens", "total_tokens", F.col("estimated_cost_usd").cast("double").alias("estimated_cost_usd"),
    )


# ---------------------------------------------------------------- sinks


def hashed_records(spark, sf):
    return quality.with_content_hash(A.records(spark, sf)).select("arrival", "run_id", "language", "content_hash")


def labelled_ids(spark, sf, name):
    return A.table(spark, sf, "labels").select(F.col("doc_id").alias(name))


@query("snk1_appended_signals")
def appended_signals(spark, sf):
    path = scratch_path(spark, "signal-table")
    rows = hashed_records(spark, sf)
    sinks.append_signals(spark, path, rows.join(labelled_ids(spark, sf, "arrival"), "arrival", "left_semi"))
    sinks.append_signals(spark, path, rows)
    return sinks.read_table(spark, path)


def collected(records: DataFrame) -> DataFrame:
    """Normalized records as deliveries of 20 runs, in the order of request and item."""
    run = F.concat(F.lit("run"), (F.col("request_id") % 20).cast("string"))
    return records.select(
        F.concat_ws("/", "source", "request_id", "item_no").alias("arrival"), run.alias("run_id"), F.concat_ws("-", run, "source").alias("module_run_id"),
        "source", "external_item_id", "title", "content", "raw_text", "published_at", "engagement", "url", "channel_id", "platform_metadata",
        "signal_type", F.lit("en").alias("language"), F.lit("US").alias("country_code"),
    )


def delivered_batches(spark, sf):
    """The store after two deliveries: the videos, then the issues, the search hits and all videos once more."""

    def build():
        path = scratch_path(spark, "batches")
        videos = payloads.normalize_videos(video_responses(spark, sf))
        issues = payloads.normalize_issues(issue_responses(spark, sf))
        hits = payloads.normalize_search_results(search_responses(spark, sf))
        for records in (videos, payloads.union_records(issues, hits, videos)):
            batches.persist_batch(
                spark, path, collected(records), recorded_at=F.lit("2024-01-31 00:00:00").cast("timestamp"), lexicon=A.LEXICON, aspects=A.ASPECTS,
                spam_phrases=A.SPAM_PHRASES,
            )
        return path

    return batches.stored_batches(spark, once(spark, sf, "batches", build))


@query("snk1_persisted_batches")
def persisted_batches(spark, sf):
    found = delivered_batches(spark, sf)
    by = ["run_id", "source"]
    signals = found["signals"]
    owner = signals.select("signal_id", "source")

    def counted(name, *measures):
        return found[name].join(owner, "signal_id").groupBy(*by).agg(*measures)

    n = F.count(F.lit(1))
    out = signals.groupBy(*by).agg(n.alias("signals"), F.count_if("spam_flag").alias("spam"), F.count("published_at").alias("dated"))
    out = out.join(counted("metrics", n.alias("metrics"), F.sum("value").alias("metric_sum")), by, "left")
    out = out.join(
        counted(
            "sentiments", n.alias("sentiments"), F.count_if(F.col("label") == "positive").alias("positive"),
            F.count_if(F.col("label") == "negative").alias("negative"), F.sum(F.col("score").cast("decimal(38,4)")).cast("double").alias("score_sum"),
        ),
        by, "left",
    )
    return out.join(counted("aspects", n.alias("aspects")), by, "left")


@query("snk1_agg7_stored_engagement")
def stored_engagement(spark, sf):
    found = delivered_batches(spark, sf)
    signals = dataset.tag_modalities(found["signals"].filter(~F.col("spam_flag")), found["metrics"])
    summary = engagement.engagement_summary(engagement.engagement_records(signals, engagement.latest_counters(found["metrics"])))
    return summary.select(*ENGAGEMENT_COLUMNS)


@query("snk2_upserted_metrics")
def upserted_metrics(spark, sf):
    path = scratch_path(spark, "hype-table")
    docs = A.documents(spark, sf)
    by = ["run_id", "source", "language"]
    every = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(1))
    some = docs.join(labelled_ids(spark, sf, "doc_id"), "doc_id", "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sinks.upsert_latest(spark, path, every, by, "version")
    sinks.upsert_latest(spark, path, some.withColumn("version", F.lit(2)), by, "version")
    return sinks.read_table(spark, path)


@query("snk3_replaced_rows")
def replaced_rows(spark, sf):
    path = scratch_path(spark, "geo-table")
    docs = A.documents(spark, sf)
    by = ["run_id", "source", "language"]
    every = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    some = docs.join(labelled_ids(spark, sf, "doc_id"), "doc_id", "left_semi").filter(F.col("language") != "en")
    sinks.replace_by_key(spark, path, every, ["run_id", "source"])
    sinks.replace_by_key(spark, path, some.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), ["run_id", "source"])
    return sinks.read_table(spark, path)


@query("snk3_emptied_keys")
def emptied_keys(spark, sf):
    """Keys that were computed anew lose their rows, also where nothing was found for them."""
    path = scratch_path(spark, "geo-table")
    docs = A.documents(spark, sf)
    by = ["run_id", "source", "language"]
    some = docs.join(labelled_ids(spark, sf, "doc_id"), "doc_id", "left_semi")
    sinks.replace_by_key(spark, path, docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), ["run_id", "source"])
    again = some.filter("source = 'youtube'").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sinks.replace_by_key(spark, path, again, ["run_id", "source"], some.select("run_id", "source"))
    return sinks.read_table(spark, path)


def request_rows(spark, sf):
    docs = A.documents(spark, sf)
    rows = A.table(spark, sf, "labels").join(docs, "doc_id")
    return rows.select(
        "doc_id", "run_id", F.col("language").alias("stage"), F.col("quality").alias("revision"), "toxic",
        F.md5("raw_text").alias("input_fingerprint"),
    )


@query("snk4_first_writers")
def first_writers(spark, sf):
    path = scratch_path(spark, "execution-table")
    rows = request_rows(spark, sf)
    keys = ["run_id", "stage", "revision"]
    sinks.insert_first_writer(spark, path, rows.filter("toxic = 1"), keys, F.col("doc_id"))
    return sinks.insert_first_writer(spark, path, rows, keys, F.col("doc_id"))


@query("snk4_conflicting_requests")
def conflicting_requests(spark, sf):
    rows = request_rows(spark, sf)
    keys = ["run_id", "stage", "revision"]
    first = latest_per_key(rows, keys, [F.col("doc_id")])
    return sinks.conflicting_rows(first, rows, keys, ["input_fingerprint"]).select("doc_id", *keys)


@query("snk5_priority_results")
def priority_results(spark, sf):
    path = scratch_path(spark, "result-table")
    docs = A.documents(spark, sf)
    by = ["run_id", "source", "language"]
    status = F.expr("case count(*) % 3 when 0 then 'failed' when 1 then 'skipped' else 'completed' end").alias("status")
    every = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), status)
    some = docs.join(labelled_ids(spark, sf, "doc_id"), "doc_id", "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), status)
    sinks.merge_by_priority(spark, path, every, by)
    sinks.merge_by_priority(spark, path, some, by)
    return sinks.read_table(spark, path)


@query("snk6_udf3_cache_entries")
def cache_entries(spark, sf):
    path = scratch_path(spark, "cache-table")
    rows = A.documents(spark, sf).select(F.md5("raw_text").alias("cache_key"), "doc_id", F.length("raw_text").alias("n"))
    known = rows.join(labelled_ids(spark, sf, "doc_id"), "doc_id", "left_semi")
    sinks.insert_first_writer(spark, path, known, ["cache_key"], F.col("doc_id"))
    return sinks.insert_first_writer(spark, path, rows, ["cache_key"], F.col("doc_id")).select("cache_key", "doc_id", "n")


@query("snk8_synchronized_sources")
def synchronized_sources(spark, sf):
    parts = A.table(spark, sf, "part")
    old = parts.select(F.col("p_partkey").alias("source_id"), F.col("p_type").alias("platform"), F.col("p_brand").alias("source_name"), F.lit("old").alias("category"))
    old = latest_per_key(old, ["platform", "source_name"], [F.col("source_id")])
    new = parts.groupBy(F.col("p_type").alias("platform"), F.col("p_name").alias("source_name")).agg(F.lit("new").alias("category"))
    some = parts.filter(F.col("p_size") == 1).groupBy(F.col("p_type").alias("platform"), F.col("p_brand").alias("source_name")).agg(F.lit("new").alias("category"))
    return sinks.synchronize_sources(old, new.unionByName(some))


@query("snk8_stored_sources")
def stored_sources(spark, sf):
    path = scratch_path(spark, "source-table")
    parts = A.table(spark, sf, "part")
    named = lambda name, kind: parts.select(F.col("p_type").alias("platform"), F.col(name).alias("source_name"), F.lit(kind).alias("category")).distinct()
    sinks.write_sources(spark, path, named("p_brand", "old"))
    some = parts.filter(F.col("p_size") == 1).select(F.col("p_type").alias("platform"), F.col("p_brand").alias("source_name"), F.lit("new").alias("category"))
    return sinks.write_sources(spark, path, named("p_name", "new").unionByName(some.distinct()))


@query("win8_canonical_sources")
def canonical_sources(spark, sf):
    parts = A.table(spark, sf, "part").select(
        F.col("p_partkey").alias("source_id"), F.col("p_type").alias("platform"), F.col("p_brand").alias("source_name")
    )
    lines = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_id"))
    return paging.remap_sources(lines, paging.canonical_sources(parts))


@query("win10_latest_results")
def latest_results(spark, sf):
    orders = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("module"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("generated_at"), F.col("o_orderkey").alias("execution_id"),
    )
    found = latest_per_key(orders, ["run_id", "module"], [F.col("generated_at").desc(), F.col("execution_id").desc()])
    return found.select("run_id", "module", "status", "execution_id")


@query("set1_unified_records")
def unified_records(spark, sf):
    merged = payloads.union_records(
        payloads.normalize_videos(video_responses(spark, sf)),
        payloads.normalize_issues(issue_responses(spark, sf)),
        payloads.normalize_search_results(search_responses(spark, sf)),
    )
    return merged.select(
        "source", "signal_type", "request_id", "item_no", "external_item_id", "title", F.md5("content").alias("content_md5"),
        F.md5("raw_text").alias("raw_md5"), "published_at", "url", "observed_at",
        *[F.try_element_at("engagement", F.lit(name)).alias(name) for name in ("views", "likes", "comments")],
    )


# ---------------------------------------------------------------- streaming


# Bytes of a row group of an arriving file.
ARRIVING_BLOCK = 4 << 20


def arriving_shuffled(spark, sf, name, key):
    """The table as six files in random order, one of them per trigger.

    Their row groups are small, so that all cores read the one file of a trigger.
    """
    A.apply_settings(spark)
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    folder = scratch_path(spark, f"stream-{name}")
    table.repartition(6, F.xxhash64(key)).write.option("parquet.block.size", ARRIVING_BLOCK).parquet(folder)
    return streams.read_files(spark, folder, table.schema, max_files=1, origin="origin")


def arriving_records(spark, sf):
    docs = arriving_shuffled(spark, sf, "documents", "doc_id")
    shaped = docs.select(
        F.col("doc_id").alias("arrival"),
        F.col("source").alias("run_id"),
        A.platform().alias("platform"),
        F.concat_ws("-", "source", A.platform()).alias("module_run_id"),
        F.expr("case doc_id % 3 when 0 then 'video' when 1 then 'community' else 'serp_result' end").alias("signal_type"),
        F.col("text").alias("raw_text"),
        F.expr("md5(text)").alias("external_item_id"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id % 720 as int), 0, 0)").alias("event_time"),
    )
    return streams.prepare_records(shaped, A.SPAM_PHRASES, A.BOT_WORDS, A.BOT_PHRASES)


def finished(streaming_query) -> None:
    streaming_query.awaitTermination()


@query("str1_str2_distinct_deliveries")
def distinct_deliveries(spark, sf):
    path, checkpoint = scratch_path(spark, "stream-signals"), scratch_path(spark, "stream-state")
    finished(streams.store_distinct(arriving_records(spark, sf), path, checkpoint))
    return sinks.read_table(spark, path).select("content_hash", "run_id", "is_bot", "spam_flag")


def event_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("run_id"), F.col("ts").cast("timestamp").alias("event_time"), F.round("value", 2).alias("engagement"), "origin"
    )


@query("str3_str7_daily_buckets")
def stream_daily_buckets(spark, sf):
    """All files once, and all of them again under a new checkpoint."""
    path = scratch_path(spark, "stream-days")
    events = event_rows(arriving_shuffled(spark, sf, "events", "event_id"))
    for _ in range(2):
        finished(streams.store_daily(events, path, scratch_path(spark, "stream-state")))
    found = streams.read_daily(spark, path)
    return found.select("run_id", day("day").alias("day"), "signal_count", F.col("engagement").cast("double").alias("engagement"))


@query("str5_sealed_days")
def sealed_days(spark, sf):
    """Files that arrive before the seals and files that arrive after them: what is stored and what is rejected."""
    path, checkpoint, folder = (scratch_path(spark, f"stream-{name}") for name in ("sealed", "state", "events"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    collectors = events.select(
        F.col("event_type").alias("run_id"), (F.col("user_id") % 3).alias("source"),
        F.expr("case when event_type = 'view' and user_id % 3 = 0 then 'running' else 'completed' end").alias("status"),
    ).distinct()
    late = F.col("event_id") % 6 >= 4
    events.filter(~late).repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    arriving_now = lambda: event_rows(streams.read_files(spark, folder, events.schema, max_files=1, origin="origin"))
    finished(streams.store_daily(arriving_now(), path, checkpoint))
    events.filter(late).repartition(2, F.xxhash64("event_id")).write.mode("append").parquet(folder)
    finished(streams.store_daily(arriving_now(), path, checkpoint, sealed=lambda: streams.sealed_runs(collectors)))
    stored_days = streams.read_daily(spark, path).withColumn("kind", F.lit("stored"))
    rejected = streams.daily_sums(streams.read_rejected(spark, path)).withColumn("kind", F.lit("rejected"))
    found = stored_days.unionByName(rejected)
    return found.select("kind", "run_id", day("day").alias("day"), "signal_count", F.col("engagement").cast("double").alias("engagement"))


@query("str4_preliminary_progress")
def preliminary_progress(spark, sf):
    path, checkpoint = scratch_path(spark, "stream-progress"), scratch_path(spark, "stream-state")
    targets = A.documents(spark, sf).groupBy("run_id", "source").agg((F.count(F.lit(1)) + F.length("run_id")).alias("target"))
    arrivals = arriving_records(spark, sf).withColumnRenamed("platform", "source")
    finished(streams.upsert_to(streams.preliminary_progress(arrivals, targets), path, checkpoint, ["run_id", "source"]))
    return sinks.read_table(spark, path).select("run_id", "source", "valid_count", "target", "preliminary_ready")


@query("str6_stream_latest_counters")
def stream_latest_counters(spark, sf):
    path = scratch_path(spark, "stream-counters")
    events = arriving_shuffled(spark, sf, "events", "event_id").select(
        F.col("user_id").alias("signal_id"),
        F.expr("case event_type when 'view' then 'view_count' when 'click' then 'likes' when 'signup' then 'replies' else 'other' end").alias("name"),
        "value",
        F.col("ts").cast("timestamp").alias("recorded_at"),
        "origin",
    )
    finished(streams.store_latest_counters(events, path, scratch_path(spark, "stream-state")))
    found = streams.read_latest_counters(spark, path)
    return found.select("signal_id", "counter", "value", stamp("recorded_at").alias("recorded_at"))


# ---------------------------------------------------------------- whole path


@query("udf6_composed_texts")
def composed_texts(spark, sf):
    docs = A.documents(spark, sf)
    loose = F.regexp_replace(F.regexp_replace("raw_text", "é", "é"), "ü", "ü")
    return docs.select("doc_id", F.md5(T.compose_accents(loose)).alias("composed_md5"))
