"""Exact top-k search by distributed histogram selection.

All pairs of a query and a candidate are scored in blocks. Counts of scores per range are added up over all blocks, and
the range with the k-th score is refined until it is one value. A last pass keeps the scores from that value on and
breaks ties by id. A block need not report ranges below its own k-th score: the k-th score of all is not lower.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.common import keep, pack, release, unpack

BINS = 256
CANDIDATES, QUERIES = 2048, 512
EXACT = 2**53
LOWEST, HIGHEST = -(2**62), 2**62


def usable(df: DataFrame, vector: str, scale: float, vec_id: str) -> DataFrame:
    """(vec_id, units) with floor(scale * x) of each component; rows without an id, or with a null or non-finite
    component, are left out."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~bad).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("units")
    )


def _matrix(column: pa.Array, exact: bool) -> np.ndarray:
    values = column.values.to_numpy(zero_copy_only=False)
    first, last = (column.offsets[0].as_py(), column.offsets[-1].as_py()) if len(column) else (0, 0)
    out = values[first:last].reshape(len(column), -1)
    # Whole numbers of any size where sums of doubles would not be exact.
    return out if exact else np.array([[int(v) for v in row] for row in out], object).reshape(out.shape)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    out = queries @ candidates.T
    return out.astype(np.int64) if out.dtype != object else np.clip(out, LOWEST, HIGHEST).astype(np.int64)


def search(
    df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, vector: str = "embedding", vec_id: str = "vec_id"
) -> DataFrame:
    """The ``k`` best candidates (query_id, rank, vec_id, score) of each query by whole-number inner product.

    Queries are the rows whose id is divisible by ``every``; candidates all rows with another id and as many
    components. Fewer than ``k`` candidates give fewer rows; ties go to the smaller id. Rows that ``usable`` drops take
    no part. Rows that repeat a query's id are one query, with the smallest vector; repeated candidates count each.
    An empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = keep(usable(df, vector, scale, vec_id).withColumn("dim", F.size("units")), "vectors")
    norm = F.aggregate("units", F.lit(0.0), lambda a, v: a + v * v)
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm")).collect()
    largest = max((r["norm"] for r in sizes), default=0.0)
    exact = largest < EXACT
    # No inner product is over the largest square of a length.
    limit = min(HIGHEST, int(math.ceil(largest)) + 1) if math.isfinite(largest) else HIGHEST
    cells = {r["dim"]: max(1, -(-r["n"] // CANDIDATES)) for r in sizes}
    per_dim = spark.createDataFrame(sorted(cells.items()), "dim int, cells long")
    candidates = vectors.join(F.broadcast(per_dim), "dim").select(
        "dim", F.pmod(F.xxhash64("vec_id"), F.col("cells")).alias("cell"), "vec_id", "units"
    )
    asked = vectors.filter(F.col("vec_id") % every == 0).groupBy("dim", "vec_id").agg(F.min("units").alias("units"))
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("dim", "units")).alias("q")).select("q.dim", "vec_id", "q.units")
    start, width = -limit, -(-(2 * limit + 1) // BINS)
    state = keep(asked.withColumn("low", F.lit(start)).withColumn("need", F.lit(k).cast("long")), "queries")

    def blocks(queries: DataFrame) -> DataFrame:
        """Blocks of queries, one row for each cell of candidates that they meet."""

        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            units = table.column("units").combine_chunks()
            payload = pack(
                table.column("vec_id").to_numpy(), _matrix(units, True), table.column("low").to_numpy(), table.column("need").to_numpy()
            )
            return pa.table({"dim": table.column("dim")[:1], "payload": pa.array([payload], pa.binary())})

        count = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts"))
        packed = (
            queries.join(F.broadcast(count), "dim").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")))
            .groupBy("dim", "part").applyInArrow(run, "dim int, payload binary")
        )
        return packed.join(F.broadcast(per_dim), "dim").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).drop("cells")

    def meet(queries: DataFrame, schema: str, function) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                ids = left.column("vec_id").to_numpy()
                against = _matrix(left.column("units").combine_chunks(), exact)
                for payload in right.column("payload").to_pylist():
                    who, units, low, need = unpack(payload)
                    units = units.reshape(len(who), -1)
                    if not exact:
                        units = np.array([[int(v) for v in row] for row in units], object).reshape(units.shape)
                    scores = _scores(units, against)
                    own = who[:, None] == ids[None, :]
                    out.append(function(who, scores, own, ids, low, need))
            names = [part.split()[0] for part in schema.split(", ")]
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * len(names)
            return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, columns)})

        return candidates.groupBy("dim", "cell").cogroup(blocks(queries).groupBy("dim", "cell")).applyInArrow(run, schema)

    span = 2 * limit + 1
    while True:
        step = width

        def counts(who, scores, own, ids, low, need, step=step, span=span):
            above_low = scores - low[:, None]
            inside = above_low // step
            # Own rows and scores below the range count nowhere, scores above it are already counted.
            inside[own | (above_low < 0) | (above_low >= span)] = BINS
            out = []
            for i in range(len(who)):
                held = np.bincount(inside[i], minlength=BINS + 1)[:BINS]
                above = np.concatenate([np.cumsum(held[::-1])[::-1][1:], [0]])
                bins = np.flatnonzero((held > 0) & (above < need[i]))
                out.append((np.full(len(bins), who[i]), bins, held[bins]))
            return [np.concatenate(c) for c in zip(*out)]

        held = meet(state, "vec_id long, bin long, n long", counts).groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("vec_id").orderBy(F.desc("bin"))
        place = (
            held.withColumn("upto", F.sum("n").over(down)).join(state.select("vec_id", "need"), "vec_id")
            .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            .select("vec_id", "bin", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))
        )
        # A query with fewer than k candidates takes all of them: it stays at the lowest value.
        found = keep(
            state.join(place, "vec_id", "left").select(
                "dim", "vec_id", "units",
                F.when(F.col("bin").isNull(), F.lit(LOWEST)).otherwise(F.col("low") + F.col("bin") * step).alias("low"),
                F.coalesce("left", "need").alias("need"),
            ),
            "queries",
        )
        release(state)
        state = found
        if width == 1:
            break
        span, width = width, -(-width // BINS)

    def best(who, scores, own, ids, low, need):
        out = []
        for i in range(len(who)):
            good = np.flatnonzero((scores[i] >= low[i]) & ~own[i])
            good = good[np.lexsort((ids[good], -scores[i][good]))][:k]
            out.append((np.full(len(good), who[i]), ids[good], scores[i][good]))
        return [np.concatenate(c) for c in zip(*out)]

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        meet(state, "query_id long, vec_id long, score long", best)
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
