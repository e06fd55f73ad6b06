import random

from pyspark.sql import functions as F

from signalloom.operators import engagement, paging, ranking, velocity
from signalloom.operators.paging import page_per_run
from signalloom.operators.ranking import latest_per_key, numbered, selected_between, top_k


def hot_rows(spark, n=4000):
    """One run holds most rows; many rows tie."""
    rng = random.Random(5)
    rows = [("hot" if i % 10 else f"r{i % 7}", rng.randint(0, 50), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "run_id string, score int, id int")


def test_numbers_are_gap_free_and_ordered_in_a_hot_group(spark):
    rows, df = hot_rows(spark)
    got = numbered(df.repartition(7), ["run_id"], [F.col("score").desc(), F.col("id")], "rank").collect()
    expected = {}
    for run in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == run), key=lambda r: (-r[1], r[2]))
        expected |= {r[2]: i for i, r in enumerate(ordered, start=1)}
    assert {r.id: r["rank"] for r in got} == expected


def test_nulls_follow_the_given_order(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 7.0)], "run_id string, id int, x double")
    got = numbered(df, ["run_id"], [F.col("x").desc_nulls_last(), F.col("id")], "n").collect()
    assert {r.id: r.n for r in got} == {3: 1, 2: 2, 1: 3}


def test_top_k_reduces_before_the_shuffle(spark):
    rows, df = hot_rows(spark)
    top = top_k(df, ["run_id"], [F.col("score").desc(), F.col("id")], 3)
    assert top.groupBy("run_id").count().filter("count > 3").count() == 0
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # once before and once after the exchange


def test_deep_pages_split_a_hot_run(spark):
    rows, df = hot_rows(spark)
    found = page_per_run(df, [F.col("score").desc(), F.col("id")], limit=10, offset=2000)
    ordered = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[1], r[2]))
    assert [(r.row_number, r.id) for r in found.orderBy("row_number").collect()] == [(2001 + i, r[2]) for i, r in enumerate(ordered[2000:2010])]
    assert {r.total_count for r in found.collect()} == {len(ordered)}


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, w string")
    assert {r.k: r.w for r in latest_per_key(df, ["k"], [F.col("v").desc()]).collect()} == {"a": "y", "b": "z"}


def test_bounds_come_from_counts(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SPARE", 20)
    monkeypatch.setattr(ranking, "BINS", 512)
    rng = random.Random(8)
    values = {
        "wide": [rng.randint(-(2**63), 2**63 - 1) for _ in range(700)],
        "ties": [rng.choice([3, 3, 3, 9]) for _ in range(400)],
        "ends": [2**63 - 1] * 90 + [-(2**63)] * 90,
        "few": [5, 1],
    }
    df = spark.createDataFrame([(g, v, i) for g, vs in values.items() for i, v in enumerate(vs)], "run_id string, v long, id int").repartition(5)
    for first, last in ((90, 95), (300, 5000)):
        found = {r.run_id: r for r in selected_between(df, "run_id", F.col("v"), first, last).collect()}
        assert set(found) == {g for g, vs in values.items() if len(vs) >= first}
        for g, r in found.items():
            ordered = sorted(values[g])
            wanted = ordered[first - 1 : last]
            assert r.low <= wanted[0] and r.high >= wanted[-1] and r.total == len(ordered)
            assert r.before == sum(v < r.low for v in ordered)
            held = sum(r.low <= v <= r.high for v in ordered)
            assert held <= len(wanted) + 40 or held <= len(wanted) + sum(v in (wanted[0], wanted[-1]) for v in ordered) + 40


def test_deep_pages_with_ties_take_only_rows_between_the_bounds(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SPARE", 50)
    rows, df = hot_rows(spark)
    rows += [("hot", None, 10_000 + i) for i in range(200)]
    df = df.union(spark.createDataFrame(rows[-200:], "run_id string, score int, id int"))
    along = F.coalesce(-F.col("score").cast("long"), F.lit(2**63 - 1))
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    ordered = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    numbered_rows = []
    real = ranking.numbered
    monkeypatch.setattr(paging, "numbered", lambda near, *a: numbered_rows.append(near.count()) or real(near, *a))
    for offset in (7, 2000, len(ordered) - 5):
        found = page_per_run(df, order, 10, offset, along).filter("run_id = 'hot'").orderBy("row_number").collect()
        assert [(r.row_number, r.id) for r in found] == [(offset + 1 + i, r[2]) for i, r in enumerate(ordered[offset : offset + 10])]
        assert {r.total_count for r in found} == {len(ordered)}
    assert max(numbered_rows[1:]) < 700


def test_no_text_is_shuffled_before_the_fetch(spark, make):
    signals = make.signals(*[{"signal_id": f"s{i}", "cleaned_text": f"text {i}" if i % 4 else " "} for i in range(40)])
    found = paging.first_snippets(signals, 3)
    assert [(r.snippet_no, r.signal_id, r.cleaned_text) for r in found.orderBy("snippet_no").collect()] == [
        (1, "s1", "text 1"), (2, "s10", "text 10"), (3, "s11", "text 11")
    ]
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    titles = velocity.trending_titles(signals, F.trim("cleaned_text"), k=2)
    assert sorted((r["rank"], r.title) for r in titles.collect()) == [(1, "text 1"), (2, "text 10")]


def test_pages_have_links(spark, make):
    signals = make.signals(*[{"signal_id": f"s{i}"} for i in range(4)]).withColumn("platform_metadata", F.expr("""case when signal_id <> 's2' then '{"url": "http://x/' || signal_id || '"}' end"""))
    page = paging.signal_page(signals, make.metrics(("s1", "views", 4, 1), ("s1", "views", 5, 2)), limit=2, offset=1)
    assert [(r.row_number, r.signal_id, r.url, r.views) for r in page.orderBy("row_number").collect()] == [(2, "s1", "http://x/s1", 5.0), (3, "s2", None, None)]


def test_rankings_read_the_records_once(spark, make):
    rows = spark.createDataFrame(
        [("r", f"s{i:02}", 1 + i % 3, None if i % 5 == 0 else float(i % 7), None if i % 3 == 0 else (i % 4) / 4) for i in range(60)],
        "run_id string, signal_id string, present_count int, interactions double, engagement_rate double",
    ).withColumn("ranking_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.signal_id: r for r in engagement.rank_records(rows).collect()}
    data = [r.asDict() for r in rows.collect()]
    for value, other, out in (("interactions", "engagement_rate", "interaction_rank"), ("engagement_rate", "interactions", "engagement_rate_rank")):
        able = sorted((r for r in data if r[value] is not None), key=lambda r: (-r[value], r[other] is None, -(r[other] or 0), r["signal_id"]))
        assert {r["signal_id"]: i for i, r in enumerate(able, 1)} == {k: r[out] for k, r in got.items() if r[out] is not None}
    plan = engagement.rank_records(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 8
