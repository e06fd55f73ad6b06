"""Exact duplicates through counting quotient filters.

1. Every row gets the SHA-256 of its normalised text; the leading ``bits`` bits are its fingerprint.
2. Each task counts its fingerprints in quotient filters, one for each range of fingerprints.
3. The filters of one range are merged by sorted remainders, without loss. Fingerprints counted once are unique texts.
4. Texts of the other fingerprints are compared byte by byte: they are grouped by the bytes themselves, copies of one
   task collapse before the shuffle.
5. The classes go back to the rows by digest. Classes that hold more than a thousandth of all rows, at most 1,000, are
   broadcast, so that no task receives a large group of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import PIECE_BYTES, materialize
from signalloom.llm.quotient import QuotientFilter, add_up, merge

FINGERPRINT_BITS = 64
# Rows whose fingerprints one merging group takes, and fingerprints that a task holds before it writes filters.
RANGE_ROWS = 1_000_000
HELD = 2_000_000
# Fingerprints are broadcast up to this number, eight bytes each.
BROADCAST_FINGERPRINTS = 500_000
HEAVY_SHARE = 1000


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], pa.Array]]:
    """(ids, texts, digests) of pieces of the batches; letters A to Z in lower case, a null text is empty."""
    for whole in batches:
        rows = max(1, whole.num_rows * PIECE_BYTES // max(whole.nbytes, 1))
        for batch in (whole.slice(k, rows) for k in range(0, whole.num_rows, rows)):
            texts = [t.as_buffer().to_pybytes().lower() if t.is_valid else b"" for t in batch.column(1)]
            yield batch.column(0), texts, pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())


def _fingerprint(bits: int):
    """The leading ``bits`` bits of the digest as a whole number; the column is signed, as Spark's are."""
    return F.shiftrightunsigned(F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long"), 64 - bits)


def digested(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, digest, copies): each distinct pair of id and text, and how many rows have it."""

    def run(batches):
        for ids, _, digests in _texts(batches):
            yield pa.RecordBatch.from_arrays([ids, digests], ["doc_id", "digest"])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))


def repeated_fingerprints(facts: DataFrame, ranges: int, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(fingerprint, n) of the fingerprints that more than one row has, from merged filters.

    ``facts`` has ``fingerprint`` and ``copies``. The ``ranges`` cut the fingerprints by their leading bits; each range
    is one group of filters.
    """
    cut = min(bits - 1, max(0, (ranges - 1).bit_length()))
    inner = bits - cut

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(held):
            values, n = add_up(*(np.concatenate(x) for x in zip(*held)))
            part = (values >> np.uint64(inner)).astype(np.int64) if inner < 64 else np.zeros(len(values), np.int64)
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() + [len(part)]
            low = values & np.uint64(2**inner - 1)
            made = [(int(part[a]), QuotientFilter.build(inner, low[a:b], n[a:b]).to_bytes()) for a, b in zip(edges, edges[1:])]
            for k in range(0, len(made), 64):
                parts, blobs = zip(*made[k : k + 64])
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], ["part", "filter"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size >= HELD:
                held = [add_up(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size >= HELD // 2:
                    yield from filters(held)
                    held, size = [], 0
        if held:
            yield from filters(held)

    def merged(table: pa.Table) -> pa.Table:
        whole = merge([QuotientFilter.from_bytes(b) for b in table.column("filter").to_pylist()])
        values, n = whole.entries()
        often = n > 1
        high = np.uint64((table.column("part")[0].as_py() << inner) % 2**64)
        return pa.table({"fingerprint": (values[often] | high).view(np.int64), "n": n[often]})

    built = facts.select("fingerprint", "copies").mapInArrow(count, "part long, filter binary")
    return built.groupBy("part").applyInArrow(merged, "fingerprint long, n long")


def verified_classes(df: DataFrame, repeated: DataFrame, rows: int, doc_id: str, text: str, bits: int) -> DataFrame:
    """(digest, keep_id, group_size) of each class of equal texts among rows with a repeated fingerprint."""

    def run(batches):
        for ids, texts, digests in _texts(batches):
            yield pa.RecordBatch.from_arrays([ids, digests, pa.array(texts, pa.binary())], ["doc_id", "digest", "bytes"])

    texts = (
        df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, digest binary, bytes binary")
        .withColumn("fingerprint", _fingerprint(bits))
    )
    if repeated.count() <= BROADCAST_FINGERPRINTS:
        asked = texts.join(F.broadcast(repeated.select("fingerprint")), "fingerprint", "left_semi")
    else:
        heavy = F.broadcast(repeated.filter(F.col("n") * HEAVY_SHARE > rows).select("fingerprint"))
        light = repeated.filter(F.col("n") * HEAVY_SHARE <= rows).select("fingerprint")
        asked = texts.join(heavy, "fingerprint", "left_semi").union(texts.join(light, "fingerprint", "left_semi"))
    # The group key is the text itself, so different texts never share a class, whatever their digests.
    classes = asked.groupBy("digest", "bytes").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return classes.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )


def exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = FINGERPRINT_BITS) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256) per row of ``df``.

    Texts are equal when their bytes are after lower-casing A to Z only; of equal ones the row with the largest id is
    kept. A null text is empty, and empty texts equal each other. Rows without an id take part; their id loses to every
    other, and a group without any id has a null ``keep_id``. Of rows that repeat an id with the same text exactly one
    is kept; with different texts they are rows of their own. Further columns are not read, whatever their names. An
    empty table gives no rows. ``bits`` is the length of a fingerprint: short ones only send more rows to the
    comparison of bytes. Two different texts with one SHA-256 raise an error rather than being merged.
    """
    if not 1 <= bits <= 64:
        raise ValueError("a fingerprint has 1 to 64 bits")
    facts = materialize(digested(df, doc_id, text).withColumn("fingerprint", _fingerprint(bits)), "digests")
    rows = facts.agg(F.sum("copies")).first()[0] or 0
    repeated = materialize(repeated_fingerprints(facts, -(-rows // RANGE_ROWS), bits), "repeated")
    classes = materialize(verified_classes(df, repeated, rows, doc_id, text, bits).filter("group_size > 1 OR texts > 1"), "classes")
    checked = classes.select(
        "digest", "keep_id",
        F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts with one digest")).cast("long")).alias("group_size"),
    )
    large = F.col("group_size") * HEAVY_SHARE > rows
    heavy = checked.filter(large).select(F.col("digest").alias("d1"), F.struct("keep_id", "group_size").alias("c1"))
    light = checked.filter(~large).select(F.col("digest").alias("d2"), F.struct("keep_id", "group_size").alias("c2"))
    met = facts.join(F.broadcast(heavy), F.col("digest") == F.col("d1"), "left")
    # Rows with a class already are dealt by something that is no digest, evenly.
    key = F.when(F.col("c1").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.xxhash64("doc_id", "digest"))))
    met = met.withColumn("key", key).join(light, F.col("key") == F.col("d2"), "left")
    found = F.coalesce("c1", "c2")
    out = met.select(
        "doc_id",
        F.when(found.isNull(), F.col("doc_id")).otherwise(found["keep_id"]).alias("keep_id"),
        F.coalesce(found["group_size"], F.lit(1).cast("long")).alias("group_size"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"),
    )
    return out.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256"
    )
