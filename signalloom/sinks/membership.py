"""Which stored keys a batch may have, from small filters, before any stored key is read.

The keys that a commit adds to a table are marked in blocks of 32,768 bits, eight marks a key and about 24 bits of room
for each. A key that is stored has all its marks in its block of that commit, so a commit without such a block holds
none of the batch's keys and is not read. About one new key in 25,000 finds all marks by chance; the commits that hit
are compared exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
BITS_PER_KEY = 24


def _hashed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys as a hash that names their block and eight places in it."""
    columns = [F.col(f"`{k}`") for k in keys]
    places = [
        F.shiftrightunsigned(F.xxhash64(*columns, F.lit(salt)), 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for salt in (1, 2) for k in range(4)
    ]
    return df.select(F.xxhash64(*columns).alias("hash"), F.array(*places).alias("places"))


def describe(store, part, folder: str) -> dict:
    """Mark the keys of a part in a folder of the store; gives what the manifest says about it."""
    blocks = 1
    while blocks * BLOCK_BITS < part.count * BITS_PER_KEY:
        blocks *= 2
    marks = _hashed(store._open([part]), part.rule.keys).select(F.pmod("hash", F.lit(blocks)).alias("block"), F.explode("places").alias("place"))
    filters = marks.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    filters.write.parquet(f"{store.path}/{folder}")
    return {"folder": folder, "blocks": blocks}


def _marked(places: Column, bits: Column) -> Column:
    def has(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.expr("1").bitwiseAND(F.call_function("shiftright", byte, (place % 8).cast("int"))) == 1

    return F.forall(places, has)


def parts_that_hit(store, table: str, rows: DataFrame, keys: Sequence[str]) -> list:
    """The parts of a table that may hold a key of ``rows``: a number per commit since the base comes to the driver."""
    parts = [p for p in store.parts(table) if p.count]
    described = [p for p in parts if p.facts]
    if not described:
        return parts
    base = f"{store.path}/{table}-filters"
    schema = "block long, bits binary, commit_no long, attempt string"
    filters = store.spark.read.schema(schema).option("basePath", base).parquet(*[f"{store.path}/{p.facts['folder']}" for p in described])
    by_commit = F.create_map(*[F.lit(x) for p in described for x in (p.number, p.facts["blocks"])])
    filters = filters.withColumn("blocks", by_commit[F.col("commit_no").cast("int")])
    levels = sorted({p.facts["blocks"] for p in described})
    asked = _hashed(rows.select(*[F.col(f"`{k}`") for k in keys]).distinct(), keys)
    asked = asked.withColumn("blocks", F.explode(F.array(*[F.lit(n) for n in levels]))).withColumn("block", F.pmod("hash", "blocks"))
    hits = asked.join(filters, ["blocks", "block"]).filter(_marked(F.col("places"), F.col("bits")))
    hit = {r["commit_no"] for r in hits.select("commit_no").distinct().collect()}
    return [p for p in parts if not p.facts or p.number in hit]
