"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import math
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from signalloom.llm import mixing
from tools.compare import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].partition("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLE))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    assert compare(spark, con, name, FOLDER).startswith("SAME")


def test_query_digests(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in entry.queries()["op7_media_columns"](spark, FOLDER).collect():
        data = texts[r["doc_id"]]
        assert r["payload_sha256"] == hashlib.sha256(data + b"\0" * (-len(data) % 64 if data else 64)).hexdigest()
    for r in entry.queries()["op1_sentencepiece"](spark, FOLDER).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]]).hexdigest()


def test_pipeline_stages(spark):
    read = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, sizes = read, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, FOLDER), name)
        sizes.append(docs.count())
        if name != "encoding":
            assert docs.columns == read.columns
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[-1]
    assert docs.filter("NOT round_trip").count() == 0


def test_stages_take_odd_tables(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, None), (None, "a b c d e f", None, "s", 3), (2, "", "en", None, None), (4, "a b c d e f", "x", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 5 - (name == "near_copies"), name


def test_result_carries_the_mix(spark):
    rows = sorted(corpus_pipeline.run(spark, FOLDER).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(rows)))
    held = Counter(r["source"] for r in rows)
    total = sum(math.sqrt(n) for n in held.values())
    want = {s: math.sqrt(n) / total for s, n in held.items()}
    taken = Counter()
    for n, r in enumerate(rows, 1):
        taken[r["source"]] += 1
        # A block of 16 on either side, and one that the prefix cuts; the first source to run out ends the bound.
        assert all(abs(taken[s] - w * n) < 32 for s, w in want.items())
        if taken[r["source"]] == held[r["source"]]:
            break
    slots = [r["slot"] for r in rows]
    assert slots == sorted(slots)


def test_encoding_places_every_row(spark):
    rows = [(i % 3 or None, f"text {i}", "en", "st"[i % 2], 6) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.encoding_stage(spark, docs, FOLDER).collect()
    assert sorted(r["position"] for r in out) == list(range(90))


def test_written_order_of_the_mix_reaches_the_result(spark, tmp_path):
    """The mixing stage decides the order of its files, and the last stage reads the places there, whatever order it finds."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i % 40 or None, f"text {i}", "en", "sst"[i % 3], 6) for i in range(120)]
    corpus_pipeline.mixing_stage(spark, spark.createDataFrame(rows, schema), FOLDER).write.parquet(f"{tmp_path}/mixed")
    written = [r for f in sorted((tmp_path / "mixed").glob("*.parquet")) for r in pq.ParquetFile(f).read().to_pylist()]
    assert sorted(r["text"] for r in written) == sorted(r[1] for r in rows)
    share = math.sqrt(80) / (math.sqrt(80) + math.sqrt(40))
    taken = 0
    for n, r in enumerate(written, 1):
        taken += r["source"] == "s"
        assert abs(taken - share * n) < 32 or taken == 80 or n - taken == 40
    # Eleven files or more, of which the tenth begins with another digit than the second.
    turned = written[::-1]
    for k in range(12):
        spark.createDataFrame(turned[10 * k : 10 * k + 10], schema).coalesce(1).write.parquet(f"{tmp_path}/part/{k}")
        (piece,) = (tmp_path / "part" / str(k)).glob("*.parquet")
        (tmp_path / "turned").mkdir(exist_ok=True)
        (tmp_path / "turned" / f"part-{k:05d}-x.parquet").write_bytes(piece.read_bytes())
    for folder, order in (("mixed", written), ("turned", turned)):
        docs = spark.read.parquet(f"{tmp_path}/{folder}").withColumn("n_chars", F.col("n_chars") + F.substring("text", 6, 3).cast("long"))
        out = sorted(corpus_pipeline.encoding_stage(spark, docs, FOLDER).collect(), key=lambda r: r["position"])
        assert [r["n_chars"] - 6 for r in out] == [int(r["text"][5:]) for r in order]
        assert [r["position"] for r in out] == list(range(120))
    # Only in the order of the mix do slots rise with the positions; each has 16 documents at most.
    docs = spark.read.parquet(f"{tmp_path}/mixed")
    slots = [r["slot"] for r in sorted(corpus_pipeline.encoding_stage(spark, docs, FOLDER).collect(), key=lambda r: r["position"])]
    assert slots == sorted(slots) and max(Counter(slots).values()) == 16


def test_rows_of_one_id_have_places_of_their_own(spark):
    rows = [(7, f"text {i}", "en", "s", 6) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["position"] for r in mixing.in_mixed_order(docs).collect()] == list(range(20))


def test_rows_made_from_those_of_files_are_mixed(spark, tmp_path):
    spark.createDataFrame([(1, "s"), (2, "t")], "doc_id long, source string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert mixing.file_order(docs.filter("doc_id > 0")) is not None
    assert mixing.file_order(docs.crossJoin(docs.select("doc_id").withColumnRenamed("doc_id", "other"))) is None
    twice = docs.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    assert [r["position"] for r in mixing.in_mixed_order(twice).collect()] == list(range(6))
