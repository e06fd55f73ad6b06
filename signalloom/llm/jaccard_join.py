"""Exact Jaccard self-join of shingle sets, light sets by subsets and heavy sets by inverted lists.

Sets up to a boundary enumerate all their subsets of the sizes that a partner must share, so that a common subset is a
link. Larger sets put the first shingles of a global order into inverted lists and are compared with the other members.
The boundary minimises the number of emitted rows over the histogram of set sizes.

Frequent shingles come last in the order, so lists stay short except inside groups of near copies. Such groups are
joined first through one hub per list; after that only members of different components meet, each list's largest
component being met but never enumerated against itself. Equal sets are one node throughout, named by one of their rows,
so rows that share an id but not a text are different nodes.

Texts are shuffled once, to the nodes; after that only texts of nodes in candidate pairs are. Sets are made from texts
where they are compared, since they take several times the room.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from signalloom.llm.common import append_columns, shedding, slices, without
from signalloom.llm.common import keep as materialize
from signalloom.llm.shingles import mixed, shingle_sets

LARGEST_LIGHT = 24
# A shingle is frequent from this many documents on, or more where the table is so long that the broadcast order would
# hold over MOST_FREQUENT shingles. Tasks report shingles that they have seen REPORTED times. The order decides only how
# long the lists are.
FREQUENT = 48
REPORTED = 3
MOST_FREQUENT = 200_000
# Bits of the filter of nodes, which is broadcast: 8 MB at most. A fuller filter lets more texts pass, no fewer.
FILTER_BITS = 1 << 26
CLASS = ("_n", "_d1", "_d2")


def least_common(a: Column, b: Column, percent: int) -> Column:
    """Smallest intersection with 100 * intersection >= percent * union."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent))


def _least_common(a: int, b: int, percent: int) -> int:
    return -(-(a + b) * percent // (100 + percent))


def subset_sizes(n: int, light: int, percent: int) -> list[int]:
    """Sizes of the common subsets that a light set of ``n`` shingles can be linked by."""
    sizes = {_least_common(n, m, percent) for m in range(1, light + 1) if _least_common(n, m, percent) <= min(n, m)}
    return sorted(sizes)


def _required(n: int) -> int:
    """Common shingles asked of the prefixes of two sets, the smaller of both numbers counting."""
    return 1 if n < 24 else 2 if n < 60 else 3


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-n * percent // 100) + _required(n))


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """Largest light set: the boundary with the fewest emitted subsets and list entries.

    Light sets that can be linked with a heavy one are in the lists too. A list entry costs about twice as much as a
    subset, since it is compared as well.
    """

    def cost(light: int) -> int:
        subsets = sum(sizes.get(n, 0) * sum(math.comb(n, c) for c in subset_sizes(n, light, percent)) for n in range(1, light + 1))
        entries = sum(k * prefix_length(n, percent) for n, k in sizes.items() if n * 100 >= percent * (light + 1))
        return subsets + 2 * entries

    return min(range(LARGEST_LIGHT + 1), key=lambda b: (cost(b), b))


def _subset_keys(values: np.ndarray, light: int, percent: int) -> tuple[list[int], list[int]]:
    """Keys of the subsets, and how many shingles each has."""
    spread = mixed(values)
    keys, held = [], []
    with np.errstate(over="ignore"):
        total = spread.sum(dtype=np.uint64)
        for c in subset_sizes(len(values), light, percent):
            left_out = [spread[list(x)].sum(dtype=np.uint64) for x in combinations(range(len(values)), len(values) - c)]
            keys.extend(mixed(total - np.array(left_out, np.uint64) + np.uint64(c) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist())
            held += [c] * len(left_out)
    return keys, held


def _ordered(values: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """Shingles in the global order: rare ones by value, then frequent ones from the rarer on. And how many are rare."""
    if not len(frequent) or not len(values):
        return values, len(values)
    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
    often = frequent[at] == values
    common = values[often]
    return np.concatenate([values[~often], common[np.argsort(rank[at[often]])]]), int((~often).sum())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b) as (node, component), the smallest node naming its component.

    Large-star and small-star steps, each written to the shared folder, until nothing changes.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.filter("a <> b").distinct(), "links")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _frequent(base: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [v for part in slices([batch]) for v in shingle_sets(part.column("text").to_pylist(), words) if len(v)]
            if not found:
                continue
            ordered = np.sort(np.concatenate(found))
            begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            counts = np.diff(np.concatenate([begins, [len(ordered)]]))
            often = counts >= REPORTED
            yield pa.RecordBatch.from_arrays(
                [pa.array(ordered[begins[often]].view(np.int64)), pa.array(counts[often])], ["token", "k"]
            )

    return base.mapInArrow(shedding(run), "token long, k long").groupBy("token").agg(F.sum("k").alias("count"))


def _entries(base: DataFrame, words: int, percent: int, light: int, order: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = order.value
        for batch in slices(batches):
            nodes = batch.column("node").to_numpy()
            out: list[tuple[np.ndarray, ...]] = []
            for node, values in zip(nodes, shingle_sets(batch.column("text").to_pylist(), words)):
                n = len(values)
                if n * 100 < percent * (light + 1):
                    continue
                listed, rare = _ordered(values, frequent, rank)
                listed = listed[: prefix_length(n, percent)]
                at = np.arange(len(listed), dtype=np.int32)
                out.append((listed, np.full(len(at), node), np.full(len(at), n, np.int32), at, at >= rare))
            if out:
                token, node, n, at, often = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(node), pa.array(n), pa.array(at), pa.array(often)],
                    ["token", "node", "n", "at", "often"],
                )

    return base.mapInArrow(shedding(run), "token long, node long, n int, at int, often boolean")


def _light_links(base: DataFrame, words: int, percent: int, light: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, keys, sizes, common = [], [], [], []
            for node, values in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text").to_pylist(), words)):
                if 0 < len(values) <= light:
                    found, held = _subset_keys(values, light, percent)
                    keys += found
                    common += held
                    nodes += [node] * len(found)
                    sizes += [len(values)] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(common, pa.int32())],
                ["key", "node", "n", "common"],
            )

    subsets = materialize(base.mapInArrow(shedding(run), "key long, node long, n int, common int"), "subsets")
    # All sets around one subset are linked through the smallest of them: it needs the fewest common shingles. Where two
    # sets of the group are similar by this subset, each of them is similar to the smallest one; others may not be.
    least = subsets.groupBy("key").agg(F.min(F.struct("n", "node")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return (
        subsets.join(least, "key").filter(F.col("node") != F.col("m.node"))
        .filter(least_common(F.col("n"), F.col("m.n"), percent) <= F.col("common"))
        .select(F.col("node").alias("a"), F.col("m.node").alias("b"), F.col("n").alias("n_a"), F.col("m.n").alias("n_b")).distinct()
    )


def _possible(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``base`` that a filter of fixed size does not tell apart from ``nodes``; no row of ``nodes`` is missing."""

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))

    bits = nodes.groupBy(F.bitmap_bucket_number(place("node")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place("node"))).alias("bits")
    )
    bit = F.bitmap_bit_position(place("node"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return (
        base.withColumn("bucket", F.bitmap_bucket_number(place("node")))
        .join(F.broadcast(bits), "bucket")
        .filter(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))) % 2 == 1)
        .select(*base.columns)
    )


def _verified(pairs: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    needed = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "needed")
    texts = _possible(base, needed)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            # Neighbours mostly have the same second text.
            second = batch.column("b").to_numpy()
            new = np.concatenate([[True], second[1:] != second[:-1]]) if len(second) else np.empty(0, bool)
            ys = shingle_sets(batch.column("y").filter(pa.array(new)).to_pylist(), words)
            q, keep = np.empty(0, np.uint64), []
            for p, changed in zip(shingle_sets(batch.column("x").to_pylist(), words), new.tolist()):
                q = next(ys) if changed else q
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = (
        pairs.select("a", "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    )
    return materialize(joined.select("a", "b", "x", "y").mapInArrow(shedding(compare), "a long, b long"), "pairs")


def _digested(documents: DataFrame, words: int, text: str) -> DataFrame:
    """The documents with the size and two digests of their sets and a number of the row, stored."""
    weights = np.random.default_rng(7).integers(0, 2**63, 2, dtype=np.uint64)

    def digests(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for values in shingle_sets(batch.column(batch.schema.get_field_index(text)).to_pylist(), words):
            rows.append((len(values), *(mixed(values ^ w).sum(dtype=np.uint64).view(np.int64) for w in weights)))
        return [pa.array(c, pa.int64()) for c in list(zip(*rows)) or [(), (), ()]]

    rows = append_columns(documents, [StructField(name, LongType()) for name in CLASS], digests)
    return materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _grouped(rows: DataFrame, words: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """For each set that a row with an id has: its class, ``component_id``, and ``kept``, the row that names the component."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = rows.sparkSession
    named = rows.filter(F.col(doc_id).isNotNull() & (F.col("_n") > 0))
    classes = materialize(
        named.groupBy(*CLASS).agg(F.min(F.struct(F.col(doc_id).cast("long").alias("id"), "_row")).alias("m"))
        .select(*CLASS, F.col("m.id").alias("first"), F.col("m._row").alias("node")),
        "classes",
    )
    if not classes.limit(2).count() > 1:
        return classes.select(*CLASS, F.col("first").alias("component_id"), F.col("node").alias("kept"))
    # As many nodes as there are different documents: never broadcast.
    nodes = classes.select(F.col("node").alias("_row")).hint("shuffle_hash")
    base = materialize(
        named.select("_row", F.col(text).alias("text")).join(nodes, "_row", "left_semi").select(F.col("_row").alias("node"), "text"), "base"
    )
    joined = _linked(spark, classes.select("node", F.col("_n").alias("n")), base, words, percent)
    placed = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min(F.struct("first", "node")).alias("least"))
    return placed.join(least, "component").select(*CLASS, F.col("least.first").alias("component_id"), F.col("least.node").alias("kept"))


def _linked(spark: SparkSession, nodes: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """Components of all links between the different sets of ``base``, as (node, component); single nodes are left out."""
    sizes = {r["n"]: r["count"] for r in nodes.filter(F.col("n") <= 2 * LARGEST_LIGHT).groupBy("n").count().collect()}
    light = choose_boundary(sizes, percent)
    links = _light_links(base, words, percent, light).select("a", "b") if light else spark.createDataFrame([], "a long, b long")

    counts = materialize(_frequent(base, words).filter(F.col("count") >= FREQUENT), "frequent")
    total = counts.agg(F.sum("count")).first()[0] or 0
    bar = max(FREQUENT, -(-total // MOST_FREQUENT))
    # At most total / bar shingles, hence MOST_FREQUENT, are collected.
    often = counts.filter(F.col("count") >= bar).orderBy("count", "token").select("token").toArrow().column("token").to_numpy()
    often = often.astype(np.int64).view(np.uint64)
    by_value = np.argsort(often)
    order = spark.sparkContext.broadcast((often[by_value], by_value))

    entries = _entries(base, words, percent, light, order)
    listed = materialize(
        entries.withColumn("k", F.when(F.col("often"), F.lit(2)).otherwise(F.count(F.lit(1)).over(Window.partitionBy("token", F.when(F.col("often"), F.xxhash64("node"))))))
        .filter("k > 1").select("token", "node", "n", "at"),
        "lists",
    )

    # First through hubs: the member to which the list's shingle comes earliest has the fewest shingles of its own.
    hubs = listed.groupBy("token").agg(F.min(F.struct("at", "n", "node")).alias("hub"))
    near = (
        listed.join(hubs, "token").filter(F.col("node") != F.col("hub.node"))
        .filter(F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent)
        .groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b"))
        .agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
        .filter(F.col("k") * 100 >= F.greatest(F.lit(200), (F.col("n") * (100 - percent)) / 4))
    )
    best = Window.partitionBy("a").orderBy(F.desc("k"), "b")
    first = materialize(near.withColumn("r", F.row_number().over(best)).filter("r <= 2").select("a", "b"), "near")
    links = _verified(links.union(first).distinct(), base, words, percent)
    joined = components(links)

    # Then every pair that may still join two components.
    placed = materialize(
        listed.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed"
    )
    largest = (
        placed.groupBy("token", "component").count()
        .groupBy("token").agg(F.max(F.struct("count", "component")).alias("m"), F.count(F.lit(1)).alias("kinds"))
        .filter("kinds > 1").select("token", F.col("m.component").alias("main"))
    )
    open_lists = placed.join(largest, "token")
    probe = open_lists.filter("component <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "at", "component")])
    other = open_lists.select("token", "main", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "component")])
    asked = F.when(F.least("n_a", "n_b") < 24, 1).when(F.least("n_a", "n_b") < 60, 2).otherwise(3)
    # Similar sets of these two sizes have their first common shingles this early.
    reach = asked - least_common(F.col("n_a"), F.col("n_b"), percent)
    met = (
        probe.join(other, "token")
        .filter("component_a <> component_b AND (component_b = main OR node_a < node_b)")
        .filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        .filter((F.col("at_a") < F.col("n_a") + reach) & (F.col("at_b") < F.col("n_b") + reach))
        .groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        .agg(F.count(F.lit(1)).alias("k"), F.first(asked).alias("asked")).filter("k >= asked").select("a", "b")
    )
    rest = _verified(materialize(met, "met"), base, words, percent)
    return components(links.union(rest))


def join_similar(df: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per document of ``df``.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles; the
    component is the smallest doc_id reachable by links. Documents without words, and rows without a doc_id, link with
    nothing: their component is their own doc_id. Repeated rows are linked like any equal texts; rows that share a doc_id
    but not a text each have their own links. An empty table gives an empty result.
    """
    documents = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = _digested(documents, words, "text")
    return (
        rows.select("doc_id", *CLASS).join(_grouped(rows, words, percent, "text", "doc_id"), [*CLASS], "left")
        .select(
            "doc_id",
            F.col("_n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )


def first_of_groups(df: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` of which one of each component stays: that with the smallest doc_id.

    Rows without a doc_id stay. Of documents without words, one row of each doc_id and text stays. Rows that share a
    doc_id stay together unless their texts link. Columns named like those of the class (_n, _d1, _d2) and _row go.
    """
    rows = _digested(without(df, [*CLASS, "_row"]), words, text)
    names = [c for c in rows.columns if c not in (*CLASS, "_row")]
    groups = _grouped(rows, words, percent, text, doc_id).select(F.col("kept").alias("_row")).distinct()
    wordless = rows.filter(F.col(doc_id).isNotNull() & (F.col("_n") == 0)).groupBy(doc_id, F.sha2(F.col(text), 256)).agg(F.min("_row").alias("_row"))
    stays = groups.union(wordless.select("_row")).hint("shuffle_hash")
    kept = rows.filter(F.col(doc_id).isNotNull()).join(stays, "_row", "left_semi")
    return kept.select(*names).union(rows.filter(F.col(doc_id).isNull()).select(*names))
