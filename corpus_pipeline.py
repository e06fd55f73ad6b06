"""A corpus pipeline: toxic documents go, near copies and repeated passages go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from signalloom.llm import jaccard_join, mixing, pieces, suffix_dedup, toxicity
from signalloom.llm.catalog import piece_model_path
from signalloom.llm.common import append_columns, keep, read, shed, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def begin(spark: SparkSession) -> None:
    """Have the executors' workers, which the stages share, give back the memory of the stage before.

    The mixing stage needs no workers and does not call this.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shed()
        yield from batches

    ship(spark)
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled ones among them, does not call toxic."""
    begin(spark)
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, lexicon).filter("predicted = 0").select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, 0.8); rows without an id stay.

    Rows that share an id but not a text are different documents.
    """
    begin(spark)
    return jaccard_join.first_of_groups(docs.select(*COLUMNS), words=5, percent=80)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 bytes and more that a document with a smaller id has.

    Bytes of a character that the cut splits go too. Null texts stay null; a text can become empty.
    """
    begin(spark)

    def rest(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, kept = (batch.column(batch.schema.get_field_index(n)) for n in ("text", "kept"))
        values = [k.as_py().decode("utf-8", "ignore") if t.is_valid else None for t, k in zip(texts, kept)]
        return [pa.array(values, pa.string())]

    cleaned = append_columns(suffix_dedup.remove_repeats(docs, 50), [StructField("text", StringType())], rest)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix of sources.

    The order of the rows, in files that are numbered in that order, is what this stage adds; the next one reads it there.
    """
    ship(spark)
    return mixing.in_mixed_order(docs).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, whether decoding them gives the text back, and the place of the row in the mix.

    The mix is the order in which the stage before wrote the rows: their places in its files give ``slot`` and
    ``position``, which carry the mix to whoever reads the result. Rows that are not read from files are mixed and written
    first. Places are found for the narrow rows and joined to the texts first; the texts are encoded last, so no ids are
    shuffled.
    """
    begin(spark)
    loaded = pieces.PieceModel.load(piece_model_path())
    # The workers of this stage have run the stages before.
    loaded.most_words = loaded.most_pairs = 50_000
    model = spark.sparkContext.broadcast(loaded)
    rows = mixing.file_order(docs.select(*COLUMNS))
    if rows is None:
        rows = mixing.file_order(keep(mixing_stage(spark, docs, sf_dir), "mixed"))
    places = mixing.written_places(rows)

    def encode(batch: pa.RecordBatch) -> list[pa.Array]:
        found, same = [], []
        for text in batch.column(batch.schema.get_field_index("text")):
            text = text.as_py() or ""
            found.append(model.value.encode(text))
            same.append(model.value.decode(found[-1].tolist()) == text)
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
        return [pa.array(np.diff(offsets).astype(np.int64)), ids, pa.array(same, pa.bool_())]

    fields = [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]
    placed = rows.join(places, mixing.LINE).drop(*mixing.LINE)
    return append_columns(placed, fields, encode).select(
        "doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "round_trip", "slot", "position"
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

# SQL cannot express the learned lexicon, the components and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
