"""Steps that large tables need: what a plan reads once, and what many cores can read."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from signalloom.functions import text as T
from signalloom.operators import dataset
from signalloom.plans import catalog
from signalloom.sources import payloads


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_searches_no_whole_text(spark):
    df = spark.createDataFrame([("　\x85 a\tb  \n",), (" \t",), (None,), ("x",)], "t string")
    found = df.select(T.strip(F.col("t")).alias("t"))
    assert [r.t for r in found.collect()] == ["a\tb", "", None, "x"]
    assert "regexp" not in optimized(found)


def test_redact_searches_addresses_only_where_there_are_any(spark):
    rows = [
        ("Anna met ANNA, Joanna and hannah", ["anna"]), ("Übung für ÜBER und über", ["über"]), ("Kate and kate", ["Kate"]),
        ("write to a.b@example.org or @some_one, +1 (234) 567-8901", []), ("12 345 is short, 1234567890 is not", [" "]), (None, ["x"]),
    ]
    df = spark.createDataFrame(rows, "t string, known array<string>")
    found = df.select(T.redact(F.col("t"), F.col("known")).alias("t"))
    assert [r.t for r in found.collect()] == [
        "redacted met redacted, Joanna and hannah", "Übung für redacted und redacted",
        "redacted and redacted", "write to redacted or @redacted, redacted", "12 345 is short, redacted is not",
        None,
    ]
    assert "CONTAINS" in optimized(found).upper()


def test_video_ids_are_read_once(spark):
    payload = '{"items": [{"id": {"videoId": " a "}}, {"id": {"videoId": 7}}, 3, {"id": {"videoId": " "}}, {"id": {"videoId": "b"}}, {"id": {"videoId": "a"}}]}'
    df = spark.createDataFrame([(1, payload), (2, "{}"), (3, "no"), (4, None)], "request_id long, payload string")
    found = payloads.unique_video_ids(df)
    assert sorted(map(tuple, found.collect())) == [(1, "a", 0), (1, "b", 4)]
    plan = optimized(found).splitlines()
    assert not any("Project" in line for line in plan) and not any("variant" in line.lower() for line in plan if "Filter" in line)


def test_arriving_files_are_read_by_many_tasks(spark, tmp_path):
    words = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(150)])
    spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), words.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    before = set(glob.glob(f"{catalog.scratch_path(spark, 'x').rsplit('/', 1)[0].removeprefix('file:')}/stream-documents-*"))
    catalog.arriving_shuffled(spark, str(tmp_path), "documents", "doc_id")
    found = set(glob.glob(f"{catalog.scratch_path(spark, 'x').rsplit('/', 1)[0].removeprefix('file:')}/stream-documents-*")) - before
    files = glob.glob(f"{found.pop()}/*.parquet")
    assert len(files) == 6 and all(pq.ParquetFile(f).num_row_groups > 1 for f in files)


def test_texts_are_cleaned_after_they_are_dealt(spark, make):
    signals = make.signals({"signal_id": "a", "cleaned_text": "x <b>y</b>"}, {"signal_id": "b", "cleaned_text": " "}).drop("modalities")
    signals = signals.withColumnRenamed("cleaned_text", "raw_text")
    tagged = dataset.tag_modalities(
        signals, make.metrics(("a", "views", 1, 1)), lambda df: df.withColumn("cleaned_text", T.clean_text(F.col("raw_text")))
    )
    assert {r.signal_id: (r.cleaned_text, r.modalities) for r in tagged.collect()} == {"a": ("x y", ["engagement", "text"]), "b": ("", [])}
    above_join = optimized(tagged).split("Join")[0]
    assert "regexp_replace" in above_join
