"""Records: checks, exclusion, payloads, privacy, sinks and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalloom.operators import paging, quality
from signalloom.session import scratch_path
from signalloom.sinks import tables as sinks
from signalloom.sources import payloads, privacy
from signalloom.streaming import signals as streams

from conftest import one

RECORDS = "arrival bigint, run_id string, platform string, module_run_id string, external_item_id string, raw_text string, signal_type string"


def incoming(spark):
    rows = [
        (1, "a", "A clean and useful post"), (2, "", "no id here at all"), (3, "a", "A clean and useful post again"),
        (4, "b", "automated bot post here"), (5, "c", "click here for free money now"), (6, "d", "This one is known already"), (7, "e", "  "),
    ]
    return spark.createDataFrame([(n, "r1", "hype", "m1", i, t, "hype") for n, i, t in rows], RECORDS)


def test_exclusion_cascade_and_audits(spark):
    records = incoming(spark)
    stored = quality.with_content_hash(records).filter("external_item_id = 'd'").select("content_hash")
    judged = quality.exclude_records(records, stored)
    assert {r.arrival: r.outcome for r in judged.collect()} == {
        1: "retained", 2: "empty_record", 3: "duplicate_batch", 4: "bot", 5: "spam", 6: "duplicate_db", 7: "empty_record",
    }
    summary = one(quality.filter_summary(judged))
    assert (summary.total_checked_count, summary.retained_count, summary.spam_count, summary.bot_count, summary.duplicate_count, summary.low_quality_count) == (7, 1, 1, 1, 2, 2)
    assert summary.exclusion_rate == 6 / 7
    audits = {r.arrival: r for r in quality.filter_audits(judged).collect()}
    assert audits[3].signal_hash == audits[1].signal_hash and not audits[3].retained_flag and audits[1].exclusion_reason is None
    assert quality.retained_signals(quality.with_content_hash(records), quality.filter_audits(judged)).select("arrival").orderBy("arrival").collect()[0][0] == 1


def test_many_copies_keep_one_first(spark):
    copies = spark.range(3000).select(
        F.col("id").alias("arrival"), F.lit("r1").alias("run_id"), F.lit("hype").alias("platform"), F.lit("m1").alias("module_run_id"),
        F.lit("same").alias("external_item_id"), F.lit("a long enough text").alias("raw_text"), F.lit("hype").alias("signal_type"),
    )
    judged = quality.exclude_records(copies.repartition(5), spark.createDataFrame([], "content_hash string"))
    assert {r.outcome: (r.n, r.first) for r in judged.groupBy("outcome").agg(F.count("*").alias("n"), F.min("arrival").alias("first")).collect()} == {
        "retained": (1, 0), "duplicate_batch": (2999, 1),
    }


def test_record_validation(spark):
    df = spark.createDataFrame(
        [(" a ", "s", " <b>T</b> ", None, "x  y"), ("", "s", "t", "c", "r"), ("b", " ", "t", "c", "r"), ("c", "s", " ", "", "r"), ("d", "s", None, "c", None)],
        "external_item_id string, source string, title string, content string, raw_text string",
    )
    assert [tuple(r) for r in quality.validate_records(df).orderBy("external_item_id").collect()] == [("a", "s", "T", "", "x y"), ("d", "s", "", "c", "")]


def responses(spark, *documents):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "request_id bigint, payload string")


def test_videos(spark):
    def video(**changes):
        item = {"id": "v1", "snippet": {"title": "By Chan ", "publishedAt": "2024-01-01T00:00:00Z", "description": "mail a@b.co", "channelTitle": "Chan"}, "statistics": {"viewCount": "12", "likeCount": 3}}
        item.update(changes)
        return item
    df = responses(spark, {"items": [video(), video(id=5), video(statistics={}), video(snippet={"title": " "})]}, "not json", {"items": 3})
    row = one(payloads.normalize_videos(df))
    assert (row.external_item_id, row.title, row.content, row.raw_text) == ("v1", "By redacted", "mail redacted", "By redacted\n\nmail redacted")
    assert row.engagement == {"views": 12, "likes": 3} and row.channel_id is None
    assert json.loads(row.platform_metadata) == {"title": "By redacted", "url": payloads.VIDEO_URL + "v1", "views": 12, "likes": 3}
    assert payloads.malformed_responses(df).count() == 2


def test_issues_and_unique_ids(spark):
    issue = {"id": 77, "number": 4, "title": "Crash by joe", "body": "see <b>octo</b>", "created_at": "2024-01-01T00:00:00Z", "html_url": "https://github.com/octo/r/issues/4", "user": {"login": "joe"}, "comments": 2}
    row = one(payloads.normalize_issues(responses(spark, {"items": [issue, {**issue, "title": None}]})))
    assert (row.external_item_id, row.title, row.content, row.url) == ("77", "Crash by redacted", "see redacted", "https://github.com/redacted/r/issues/4")
    assert row.engagement == {"comments": 2} and json.loads(row.platform_metadata)["number"] == 4
    ids = payloads.unique_video_ids(responses(spark, {"items": [{"id": {"videoId": v}} for v in ("b", "a", "b", " ")] + [{"id": "x"}]}))
    assert [(r.video_id, r.first_no) for r in ids.orderBy("first_no").collect()] == [("b", 0), ("a", 1)]


def test_search_results(spark):
    def hit(url, **more):
        return {"title": "T", "url": url, "position": 1, **more}
    hits = [hit("HTTP://H.com/a#x"), hit("http://h.com/a"), hit("ftp://h/b"), hit("http://h/c", position=True), hit("http://h/d", position=0), hit("http://h/e", position="2", snippet=" s "), hit("http://h/f")]
    df = responses(spark, {"results": hits}).withColumns({"query": F.lit(" The  Q "), "observed_at": F.lit("2024-01-01")})
    rows = payloads.normalize_search_results(df, 2).orderBy("item_no").collect()
    assert [(r.url, r.raw_text, r.signal_type, r.observed_at) for r in rows] == [("HTTP://H.com/a#x", "T", "serp_result", "2024-01-01"), ("http://h/e", "T\n\ns", "serp_result", "2024-01-01")]


def test_metadata_is_taken_apart_in_small_pieces(spark):
    sizes = [len(x) for x in privacy.pieces(pd.Series(range(2 * privacy.PIECE_ROWS + 3)))]
    assert sizes == [privacy.PIECE_ROWS, privacy.PIECE_ROWS, 3] and [len(x) for x in privacy.pieces(pd.Series([], dtype=object))] == [0]
    many = spark.range(0, 2 * privacy.PIECE_ROWS + 3, 1, 1).select(
        "id", F.lit("t").alias("title"), F.lit("").alias("content"), F.lit("by Ann").alias("raw_text"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("channel_id"),
        F.when(F.col("id") % 5 != 0, F.format_string('{"author": "Ann", "note": "Ann %d"}', "id")).alias("platform_metadata"),
    )
    for r in privacy.sanitize_records(many).collect():
        assert r.platform_metadata == (None if r.id % 5 == 0 else '{"note":"redacted %d"}' % r.id)
        assert r.raw_text == ("by Ann" if r.id % 5 == 0 else "by redacted")


def test_privacy_of_nested_metadata(spark):
    metadata = {"authorName": "Ann Lee", "deep": [{"userId": {"v": " bob "}, "keep": "by Ann Lee and BOB, x@y.zz"}], "rawBody": "zzz", "n": 3, "authority": "ok"}
    df = spark.createDataFrame(
        [("by bob", "c", "Ann Lee", "https://h/chan-1", "chan-1", json.dumps(metadata)), ("t", "c", "r", "u", None, None)],
        "title string, content string, raw_text string, url string, channel_id string, platform_metadata string",
    )
    first, second = privacy.sanitize_records(df).orderBy("title").collect()
    assert (first.title, first.raw_text, first.url, first.channel_id) == ("by redacted", "redacted", "https://h/redacted", None)
    assert json.loads(first.platform_metadata) == {"deep": [{"keep": "by redacted and redacted, redacted"}], "n": 3, "authority": "ok"}
    assert second.title == "t" and second.platform_metadata is None


def test_append_skips_stored_and_repeated(spark):
    path = scratch_path(spark, "t-append")
    df = spark.createDataFrame([(1, "r", "h1"), (2, "r", "h1"), (3, "r", "h2")], "arrival bigint, run_id string, content_hash string")
    sinks.append_signals(spark, path, df.filter("arrival < 3"))
    assert [r.arrival for r in sinks.append_signals(spark, path, df).collect()] == [3]
    assert sorted(r.arrival for r in sinks.read_table(spark, path).collect()) == [1, 3]


def test_upsert_replace_and_priority(spark):
    def rows(*data):
        return spark.createDataFrame(list(data), "run_id string, source string, n bigint, status string")
    path = scratch_path(spark, "t-upsert")
    sinks.upsert_latest(spark, path, rows(("a", "x", 1, ""), ("b", "x", 5, "")), ["run_id", "source"], "n")
    sinks.upsert_latest(spark, path, rows(("a", "x", 3, ""), ("b", "x", 4, "")), ["run_id", "source"], "n")
    assert sorted((r.run_id, r.n) for r in sinks.read_table(spark, path).collect()) == [("a", 3), ("b", 5)]
    path = scratch_path(spark, "t-replace")
    sinks.replace_by_key(spark, path, rows(("a", "x", 1, ""), ("a", "y", 2, ""), ("b", "x", 3, "")), ["run_id"], buckets=1)
    sinks.replace_by_key(spark, path, rows(("a", "z", 9, "")), ["run_id"], buckets=1)
    assert sorted((r.run_id, r.source) for r in sinks.read_table(spark, path).collect()) == [("a", "z"), ("b", "x")]
    path = scratch_path(spark, "t-priority")
    sinks.merge_by_priority(spark, path, rows(("a", "x", 1, "skipped"), ("b", "x", 1, "completed"), ("c", "x", 1, "failed")), ["run_id"])
    sinks.merge_by_priority(spark, path, rows(("a", "x", 2, "completed"), ("b", "x", 2, "completed"), ("c", "x", 2, "failed")), ["run_id"])
    assert sorted((r.run_id, r.n) for r in sinks.read_table(spark, path).collect()) == [("a", 2), ("b", 1), ("c", 1)]


def test_first_writer_and_conflicts(spark):
    def rows(*data):
        return spark.createDataFrame(list(data), "run_id string, no int, definition string")
    path = scratch_path(spark, "t-first")
    sinks.insert_first_writer(spark, path, rows(("a", 1, "x")), ["run_id"], F.col("no"))
    kept = sinks.insert_first_writer(spark, path, rows(("a", 2, "y"), ("b", 4, "q"), ("b", 3, "p")), ["run_id"], F.col("no"))
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 1, "x"), ("b", 3, "p")]
    clash = sinks.conflicting_rows(kept, rows(("a", 2, "y"), ("b", 5, "p")), ["run_id"], ["definition"])
    assert [r.run_id for r in clash.collect()] == ["a"]


def test_sources_and_pages(spark):
    stored = spark.createDataFrame([(1, "p", "a", "old"), (2, "p", "b", "old")], "source_id int, platform string, source_name string, category string")
    configured = spark.createDataFrame([("p", "a", "new"), ("p", "c", "new")], "platform string, source_name string, category string")
    rows = {r.source_name: (r.source_id, r.category) for r in sinks.synchronize_sources(stored, configured).collect()}
    assert rows["a"] == ("1", "new") and rows["b"] == ("2", "old") and len(rows["c"][0]) == 64
    with pytest.raises(ValueError):
        paging.page(stored, [F.col("source_id")], limit=101)
    assert [r.source_id for r in paging.page(stored, [F.col("source_id").desc()], 1, 1).collect()] == [1]


def test_streams_agree_with_batches(spark):
    folder = scratch_path(spark, "t-stream")
    schema = "signal_id string, name string, value double, recorded_at timestamp"
    for part in range(3):
        spark.range(40).select(
            (F.col("id") % 7).cast("string").alias("signal_id"), F.expr("case id % 2 when 0 then 'views' else 'reply_count' end").alias("name"),
            ((F.col("id") * 7 + part * 3) % 11).cast("double").alias("value"),
            F.expr(f"timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast((id * 5 + {part}) % 9 as int), 0, 0)").alias("recorded_at"),
        ).write.mode("append").parquet(folder)
    path = scratch_path(spark, "t-stream-out")
    stream = streams.latest_counters(streams.read_files(spark, folder, schema, max_files=2))
    streams.upsert_to(stream, path, scratch_path(spark, "t-state"), ["signal_id", "counter"]).awaitTermination()
    got = sinks.read_table(spark, path).drop("version")
    expected = streams.latest_counters(spark.read.parquet(folder))
    assert sorted(map(tuple, got.select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    # A second start finds nothing new and changes nothing.
    before = got.count()
    assert before == expected.count() > 5


def test_streams_lose_nothing(spark):
    """Many small batches in any order give what one batch gives, and late rows of sealed runs are kept apart."""
    folder = scratch_path(spark, "t-late")
    rows = spark.range(120).select(
        F.col("id").alias("arrival"), F.concat(F.lit("r"), F.col("id") % 3).alias("run_id"), (F.col("id") % 50).cast("string").alias("content_hash"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id * 37 % 90 as int))").alias("event_time"), F.col("id").cast("double").alias("engagement"),
    )
    rows.repartition(5, F.xxhash64("arrival")).write.parquet(folder)
    stream = lambda: streams.read_files(spark, folder, rows.schema, max_files=1, origin="origin")
    path = scratch_path(spark, "t-distinct")
    for _ in range(2):
        streams.store_distinct(stream(), path, scratch_path(spark, "t-state")).awaitTermination()
    assert sorted(r.content_hash for r in sinks.read_table(spark, path).collect()) == sorted(str(i) for i in range(50))
    path, state = scratch_path(spark, "t-daily"), scratch_path(spark, "t-state")
    streams.store_daily(stream(), path, state).awaitTermination()
    expected = sorted(map(tuple, streams.daily_sums(rows).collect()))
    assert sorted(map(tuple, streams.read_daily(spark, path).collect())) == expected
    statuses = spark.createDataFrame([("r1", "a", "completed"), ("r1", "b", "failed"), ("r2", "a", "running"), ("r2", "b", "completed")], "run_id string, source string, status string")
    seals = streams.sealed_runs(statuses)
    # A new checkpoint reads the same files again and changes nothing, sealed runs or not.
    streams.store_daily(stream(), path, scratch_path(spark, "t-state"), sealed=lambda: seals).awaitTermination()
    assert sorted(map(tuple, streams.read_daily(spark, path).collect())) == expected
    assert streams.read_rejected(spark, path).count() == 0
    # New files after the seal: rows of the sealed run are kept apart as they are.
    rows.withColumn("arrival", F.col("arrival") + 1000).repartition(3, F.xxhash64("arrival")).write.mode("append").parquet(folder)
    streams.store_daily(stream(), path, state, sealed=lambda: seals).awaitTermination()
    late = streams.read_rejected(spark, path)
    assert sorted(r.arrival for r in late.collect()) == [1000 + i for i in range(120) if i % 3 == 1]
    assert sum(r.signal_count for r in streams.read_daily(spark, path).collect()) == 120 + 80


def test_latest_counters_without_state(spark):
    folder = scratch_path(spark, "t-counters")
    rows = spark.range(300).select(
        F.concat(F.lit("r"), F.col("id") % 2).alias("run_id"), (F.col("id") % 14).cast("string").alias("signal_id"), F.lit("Views").alias("name"),
        (F.col("id") * 7 % 11).cast("double").alias("value"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id * 5 % 9 as int))").alias("recorded_at"),
    )
    rows.repartition(6, F.xxhash64("signal_id", "value")).write.parquet(folder)
    read = lambda: streams.read_files(spark, folder, rows.schema, max_files=2, origin="origin")
    path = scratch_path(spark, "t-latest")
    for _ in range(2):
        query = streams.store_latest_counters(read(), path, scratch_path(spark, "t-state"))
        query.awaitTermination()
        assert query.lastProgress is None or not query.lastProgress["stateOperators"]
        expected = streams.latest_counters(rows)
        got = streams.read_latest_counters(spark, path).select(expected.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    sinks.Store(spark, path).compact()
    assert sorted(map(tuple, streams.read_latest_counters(spark, path).select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    closed = spark.createDataFrame([("r1",)], "run_id string")
    path = scratch_path(spark, "t-latest")
    streams.store_latest_counters(read(), path, scratch_path(spark, "t-state"), sealed=lambda: closed).awaitTermination()
    assert {int(r.signal_id) % 2 for r in streams.read_latest_counters(spark, path).collect()} == {0}
    assert streams.read_rejected(spark, path).count() == 150


def test_keyed_tables_can_be_trusted(spark):
    def rows(*data):
        return spark.createDataFrame(list(data), "run_id string, n bigint")
    path = scratch_path(spark, "t-keys")
    sinks.replace_by_key(spark, path, rows(("a", 1), ("b", 2)), ["run_id"], buckets=4)
    sinks.replace_by_key(spark, path, rows(), ["run_id"], rows(("a", 0)), buckets=16)
    assert [tuple(r) for r in sinks.read_table(spark, path).collect()] == [("b", 2)]
    path = scratch_path(spark, "t-buckets")
    for buckets in (8, 3):
        sinks.upsert_latest(spark, path, rows(*((f"k{i}", i) for i in range(20))), ["run_id"], "n", buckets=buckets)
    assert sinks.read_table(spark, path).count() == 20


def test_keys_are_read_as_words():
    table = {"userID": ["user", "id"], "HTTPServer": ["httpserver"], " author-Name ": ["author", "name"], "a1B": ["a1", "b"], "x__y": ["x", "y"], "": [], "é": []}
    assert {key: privacy.key_words(key) for key in table} == table
    frame, texts, _ = privacy.split_metadata('{"a":{"\\u0000":7},"b":["t",{"c":"u"}]}')
    assert json.loads(privacy.fill_metadata(frame, [t.upper() for t in texts])) == {"a": {"\0": 7}, "b": ["T", {"c": "U"}]}
