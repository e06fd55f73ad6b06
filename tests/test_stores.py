"""Stores: commits over several tables, rules on reading, filters of keys, compaction."""

import os
import random

import pytest
from pyspark.sql import functions as F

from signalloom.session import scratch_path
from signalloom.sinks import batches, commits, membership
from signalloom.sinks import tables as sinks
from signalloom.sinks.commits import Rows, Rule, Store


def files(path):
    found = {}
    for folder, _, names in os.walk(path.removeprefix("file:")):
        for name in names:
            if name.startswith("part-"):
                full = os.path.join(folder, name)
                found[full] = os.path.getsize(full)
    return found


@pytest.fixture
def rows(spark):
    def make(*data, schema="run_id string, source string, n bigint, status string"):
        return spark.createDataFrame(list(data), schema)

    return make


def test_a_commit_is_seen_as_a_whole_or_not_at_all(spark, rows, monkeypatch):
    store = Store(spark, scratch_path(spark, "t-whole"))
    a, b = rows(("a", "x", 1, "")), rows(("b", "x", 2, ""))
    write = Store._write

    def broken(self, new, folder):
        if folder.startswith("second"):
            raise OSError("no more room")
        write(self, new, folder)

    monkeypatch.setattr(Store, "_write", broken)
    with pytest.raises(OSError):
        store.commit({"first": Rows(a), "second": Rows(b)})
    assert store.read("first") is None and store.read("second") is None and files(store.path)
    monkeypatch.setattr(Store, "_write", write)
    assert store.commit({"first": Rows(a), "second": Rows(b)}) == 0
    assert store.read("first").count() == store.read("second").count() == 1
    # What the failed commit left behind goes on request, and nothing else.
    assert len(store.expire()) == 1 and store.read("first").count() == 1 and store.expire() == []


def test_two_writers_cannot_take_one_number(spark, rows, monkeypatch):
    path = scratch_path(spark, "t-race")
    first, second = Store(spark, path), Store(spark, path)
    publish = Store._publish

    def late(self, manifest):
        monkeypatch.setattr(Store, "_publish", publish)
        second.commit({"t": Rows(rows(("b", "x", 2, "")))})
        publish(self, manifest)

    monkeypatch.setattr(Store, "_publish", late)
    with pytest.raises(Exception, match="[Ee]xist"):
        first.commit({"t": Rows(rows(("a", "x", 1, "")))})
    assert [r.run_id for r in Store(spark, path).read("t").collect()] == ["b"]


def test_batches_count_once_and_plans_keep_their_state(spark, rows):
    store = Store(spark, scratch_path(spark, "t-batches"))
    for _ in range(2):
        store.commit({"t": Rows(rows(("a", "x", 1, "")))}, batch=("s", 0))
    before = store.read("t")
    store.commit({"t": Rows(rows(("b", "x", 1, "")))}, batch=("s", 1))
    assert before.count() == 1 and store.read("t").count() == 2
    store.compact()
    assert store.commit({"t": Rows(rows(("c", "x", 1, "")))}, batch=("s", 1)) is None
    assert store.commit({"t": Rows(rows(("c", "x", 1, "")))}, batch=("other", 0)) == 3
    assert store.read("t").count() == 3


def plain(kind, batches, keys):
    """What a rule keeps, batch after batch, by key."""
    rank = commits.STATUS_PRIORITY
    held = {}
    for batch in batches:
        if kind == "replace":
            for row in batch:
                held = {k: v for k, v in held.items() if k[0] != row[0]}
            for at, row in enumerate(batch):
                held[row[0], at] = row
            continue
        for row in batch:
            key = row[:keys]
            old = held.get(key)
            if old is None or kind == "newest" or (kind == "latest" and row[2] >= old[2]) or (kind == "priority" and rank[row[3]] > rank[old[3]]):
                held[key] = row
    return sorted(map(str, held.values()))


@pytest.mark.parametrize("kind", ["latest", "newest", "priority", "replace"])
def test_rules_equal_plain_updates(spark, rows, kind, monkeypatch):
    pick = random.Random(kind)
    for limit in (0, 1000):
        monkeypatch.setattr(commits, "BROADCAST_ROW_LIMIT", limit)
        path, batches = scratch_path(spark, f"t-{kind}"), []
        store = Store(spark, path)
        for number in range(5):
            keys = pick.sample([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("c", None), ("d", "x")], 3)
            batch = [(*k, pick.randrange(4), pick.choice(["failed", "skipped", "completed"])) for k in keys]
            batches.append(batch)
            df = rows(*batch)
            if kind == "latest":
                sinks.upsert_latest(spark, path, df, ["run_id", "source"], "n", buckets=2)
            elif kind == "newest":
                sinks.upsert_newest(spark, path, df, ["run_id", "source"], buckets=2)
            elif kind == "priority":
                sinks.merge_by_priority(spark, path, df, ["run_id", "source"], buckets=2)
            else:
                sinks.replace_by_key(spark, path, df, ["run_id"], buckets=2)
            if number == 2:
                sinks.compact(spark, path)
                assert len(store.commits()) == 1
            assert sorted(str(tuple(r)) for r in sinks.read_table(spark, path).collect()) == plain(kind, batches, 2)


def test_a_batch_writes_only_its_own_rows(spark):
    path = scratch_path(spark, "t-bytes")
    many = spark.range(50_000).select(F.col("id").cast("string").alias("run_id"), F.sha2(F.col("id").cast("string"), 256).alias("value"), F.lit(1).alias("version"))
    sinks.upsert_latest(spark, path, many, ["run_id"], "version", buckets=4)
    before = files(path)
    few = many.filter("run_id in ('3', '77')").withColumn("version", F.lit(2))
    sinks.upsert_latest(spark, path, few, ["run_id"], "version", buckets=4)
    after = files(path)
    assert {k: after[k] for k in before} == before
    assert sum(after.values()) - sum(before.values()) < sum(before.values()) / 100
    assert sinks.read_table(spark, path).groupBy("version").count().orderBy("version").collect() == [(1, 49_998), (2, 2)]


def test_only_files_whose_filter_hits_are_read(spark):
    path = scratch_path(spark, "t-filters")
    batch = lambda low, high: spark.range(low, high).select(
        F.col("id").alias("arrival"), F.lit("r").alias("run_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash")
    )
    for k in range(4):
        assert sinks.append_signals(spark, path, batch(k * 3000, k * 3000 + 3000), buckets=2).count() == 3000
    store = Store(spark, path)
    asked = batch(4000, 4100)
    hit = membership.parts_that_hit(store, "rows", asked, ["content_hash"])
    assert [p.number for p in hit] == [1]
    fresh = sinks.unknown(store, "rows", asked.union(batch(20_000, 20_010)), ["content_hash"])
    assert fresh.count() == 10
    read = {f.split("commit_no=")[1].split("/")[0] for f in store.rows("rows", hit).inputFiles()}
    assert read == {"1"}
    assert membership.parts_that_hit(store, "rows", batch(50_000, 50_020), ["content_hash"]) == []


def test_false_hits_are_settled_exactly(spark, monkeypatch):
    monkeypatch.setattr(membership, "BITS_PER_KEY", 1)
    path = scratch_path(spark, "t-crowded")
    batch = lambda low, high: spark.range(low, high).select(
        F.col("id").alias("arrival"), F.lit("r").alias("run_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash")
    )
    sinks.append_signals(spark, path, batch(0, 30_000), buckets=2)
    store = Store(spark, path)
    assert len(membership.parts_that_hit(store, "rows", batch(30_000, 32_000), ["content_hash"])) == 1
    assert sinks.append_signals(spark, path, batch(29_000, 32_000), buckets=2).count() == 2000
    assert sinks.read_table(spark, path).select("content_hash").distinct().count() == sinks.read_table(spark, path).count() == 32_000


def test_first_writers_stay_over_many_batches(spark, rows):
    path, seen = scratch_path(spark, "t-first"), {}
    pick = random.Random(3)
    for number in range(4):
        data = [(pick.choice("abcdefgh"), "s", 100 * number + i, "") for i in range(6)]
        got = sinks.insert_first_writer(spark, path, rows(*data), ["run_id"], F.col("n"), buckets=2)
        for row in data:
            seen.setdefault(row[0], row)
        assert sorted(map(tuple, got.collect())) == sorted(seen[k] for k in {r[0] for r in data})
    sinks.compact(spark, path)
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == sorted(seen.values())
    assert sinks.insert_first_writer(spark, path, rows(("a", "s", -1, "")), ["run_id"], F.col("n")).collect()[0].n == seen["a"][2]


def test_sources_are_written_and_keep_their_ids(spark):
    path = scratch_path(spark, "t-sources")
    configured = lambda *data: spark.createDataFrame(list(data), "platform string, source_name string, category string")
    first = {r.source_name: r.source_id for r in sinks.write_sources(spark, path, configured(("p", "a", "old"), ("p", "b", "old"))).collect()}
    after = {r.source_name: (r.source_id, r.category) for r in sinks.write_sources(spark, path, configured(("p", "b", "new"), ("p", "c", "new"))).collect()}
    assert after["a"] == (first["a"], "old") and after["b"] == (first["b"], "new") and after["c"][1] == "new" and len(after) == 3


def test_names_of_the_store_are_refused(spark):
    with pytest.raises(ValueError, match="bucket"):
        Store(spark, scratch_path(spark, "t-names")).commit({"t": Rows(spark.createDataFrame([(1,)], "Bucket int"))})


def test_rules_have_names():
    with pytest.raises(ValueError):
        Rule("sometimes")


def batch_records(spark, *data):
    """Rows of (arrival, run, external id, title, views)."""
    return spark.createDataFrame(
        [(a, r, f"{r}-youtube", "youtube", i, t, "", t, "2024-01-02T03:04:05Z", {"views": v} if v is not None else {}, None, "chan", None, "video", "en", "US") for a, r, i, t, v in data],
        "arrival long, run_id string, module_run_id string, source string, external_item_id string, title string, content string, raw_text string, published_at string, "
        "engagement map<string,bigint>, url string, channel_id string, platform_metadata string, signal_type string, language string, country_code string",
    )


def test_a_clash_drops_its_own_record_only(spark):
    path, at = scratch_path(spark, "t-batch"), F.lit("2024-02-01").cast("timestamp")
    first = batch_records(spark, (1, "r", "a", "I love this wonderful music", 5), (2, "r", "a", "a copy of the item", 9), (3, "r", "b", "short", 7), (4, "r", None, "no id at all here", 1))
    assert batches.persist_batch(spark, path, first, recorded_at=at, buckets=2) == 0
    second = batch_records(spark, (1, "r", "a", "delivered again with other text", 50), (2, "r", "c", "mail me at x@y.zz about the music", None), (3, "s", "a", "same item of another run", 2))
    assert batches.persist_batch(spark, path, second, recorded_at=at, buckets=2, batch=("feed", 7)) == 1
    assert batches.persist_batch(spark, path, second, recorded_at=at, buckets=2, batch=("feed", 7)) is None
    assert batches.persist_batch(spark, path, second, recorded_at=at, buckets=2) == 2
    found = batches.stored_batches(spark, path)
    signals = {(r.run_id, r.external_item_id): r for r in found["signals"].collect()}
    assert set(signals) == {("r", "a"), ("r", "b"), ("r", "c"), ("s", "a")}
    assert signals["r", "a"].raw_text == "I love this wonderful music" and signals["r", "b"].spam_flag
    assert signals["r", "c"].raw_text == "mail me at redacted about the music"
    ids = {k: r.signal_id for k, r in signals.items()}
    assert {(r.signal_id, r.name, r.value) for r in found["metrics"].collect()} == {(ids["r", "a"], "views", 5.0), (ids["r", "b"], "views", 7.0), (ids["s", "a"], "views", 2.0)}
    # Spam has no sentiment, and every aspect belongs to a stored signal.
    assert {r.signal_id for r in found["sentiments"].collect()} == set(ids.values()) - {ids["r", "b"]}
    assert {(r.signal_id, r.aspect) for r in found["aspects"].collect()} == {(ids["r", "a"], "music"), (ids["r", "c"], "music")}


def test_a_batch_that_fails_between_its_tables_leaves_nothing(spark, monkeypatch):
    path, at = scratch_path(spark, "t-half"), F.lit("2024-02-01").cast("timestamp")
    rows = batch_records(spark, (1, "r", "a", "I love this wonderful music", 5))
    write = Store._write

    def broken(self, new, folder):
        if folder.startswith("sentiments"):
            raise OSError("lost")
        write(self, new, folder)

    monkeypatch.setattr(Store, "_write", broken)
    with pytest.raises(OSError):
        batches.persist_batch(spark, path, rows, recorded_at=at, buckets=2, batch=("feed", 0))
    assert batches.stored_batches(spark, path) is None and any("signals" in f for f in files(path))
    monkeypatch.setattr(Store, "_write", write)
    assert batches.persist_batch(spark, path, rows, recorded_at=at, buckets=2, batch=("feed", 0)) == 0
    assert [d.count() for d in batches.stored_batches(spark, path).values()] == [1, 1, 1, 1]


@pytest.mark.parametrize("gone, hashed", [(200_000, 5_000_000), (0, 5_000_000), (0, 0)])
def test_new_records_are_the_same_however_many_go(spark, monkeypatch, gone, hashed):
    monkeypatch.setattr(batches, "is_small", lambda df, limit=gone, *size, kept=batches.is_small: kept(df, limit, *size))
    monkeypatch.setattr(batches, "HASHED_ROWS", hashed)
    store = Store(spark, scratch_path(spark, "t-new"))
    rows = [(k, "r", f"item {k % 5}", f"text {k}", k) for k in range(20)] + [(None, "r", "no number", "text", 1), (30, "r", None, "no id", 1), (0, "r", "item 9", "number of another", 2)]
    found, _ = batches.new_records(store, batch_records(spark, *rows))
    # Equal numbers are judged as one; a null one names no record.
    assert sorted((r.arrival, r.external_item_id) for r in found.collect()) == [(0, "item 0"), (0, "item 9"), *((k, f"item {k}") for k in range(1, 5))]


def test_a_batch_shuffles_no_texts_if_few_records_go_and_leaves_nothing_else(spark, monkeypatch):
    plans, put_away = [], []

    def shown(df, name, *rest, kept=batches.materialize, **options):
        if name == "batch":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            assert "content" not in df.columns and "label" in df.columns
        stored = kept(df, name, *rest, **options)
        put_away.extend(stored.inputFiles())
        return stored

    monkeypatch.setattr(batches, "materialize", shown)
    path, at = scratch_path(spark, "t-clean"), F.lit("2024-02-01").cast("timestamp")
    rows = batch_records(spark, (1, "r", "a", "I love this wonderful music", 5), (2, "r", "a", "a copy of the item", 9))
    batches.persist_batch(spark, path, rows, recorded_at=at, buckets=2)
    assert "SortMergeJoin" not in plans[0] and "hashpartitioning" not in plans[0]
    assert put_away and not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in put_away)
    assert all(".zstd." in f for f in files(path) if f.endswith(".parquet") and "filters" not in f)
