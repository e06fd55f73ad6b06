"""Ranks and latest-row selection that keep working when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.session import materialize, small_side


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str, name: str = "rank") -> DataFrame:
    """Gap-free 1..n inside each group, computed without one task per group.

    Rows are range-partitioned and sorted on (group, order), so a hot group spans many partitions, and take the number
    of their partition and their place in it. The rows of a group before a partition shift the places in it. ``order``
    must be total. The sorted rows are written once, because the places and the shifts must come from one evaluation;
    nothing but one row per group and partition is shuffled after that.
    """
    keys = [*[F.col(g) for g in group], *order]
    # Without a fixed number, adaptive execution merges small neighbouring ranges.
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), name, compression="zstd")
    ranged = ranged.withColumn("_part", F.shiftrightunsigned("_at", 33))

    sizes = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return (
        ranged.join(small_side(materialize(shifts, "shifts")), [*group, "_part"])
        .withColumn(out, F.col("_at") + F.col("_shift"))
        .drop("_part", "_at", "_shift")
    )


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. Every task keeps at most k rows before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order`` (newest first)."""
    return top_k(df, keys, order, 1, "_position").drop("_position")


# How many pieces a range of positions is cut into per round, and how many rows a run may keep between two bounds
# beyond those asked for.
BINS = 256
SPARE = 4096


def selected_between(df: DataFrame, group: str, along: Column, first: int, last: int) -> DataFrame:
    """Bounds of the rows numbered ``first`` to ``last`` (from 1) of every group, by counting instead of sorting.

    ``along`` is a whole number that does not decrease along the order of the rows. Gives, per group that has the row
    ``first``: ``low`` and ``high``, between which these rows lie, ``before``, the number of rows below ``low``, and
    ``total``. Each round counts the rows in 256 pieces of the ranges that hold the two ends, until few rows are left
    in a range or they have one value; only counts are shuffled.
    """
    keyed = df.select(group, along.cast("long").alias("_along"))
    whole = keyed.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.min("_along").alias("lo"), F.max("_along").alias("hi"))
    ends = F.array(F.lit(first).cast("long"), F.least(F.lit(last).cast("long"), "total"))
    state = whole.filter(F.col("total") >= first).select(
        "*", F.lit(0).cast("long").alias("before"), F.col("total").alias("held"), F.posexplode(ends).alias("end", "want")
    )
    state = materialize(state, "bounds")
    is_open = (F.col("held") > SPARE) & (F.col("lo") < F.col("hi"))
    while state.filter(is_open).limit(1).count():
        # Decimals, because the width of a range of longs can exceed a long.
        width = F.expr(f"cast((cast(hi as decimal(38,0)) - lo + {BINS}) div {BINS} as long)")
        asked = small_side(state.filter(is_open).withColumn("width", width))
        piece = F.expr("cast((cast(_along as decimal(38,0)) - lo) div width as long)")
        inside = keyed.join(asked, group).filter(F.col("_along").between(F.col("lo"), F.col("hi")))
        same = [c for c in asked.columns if c != "held"]
        counts = inside.groupBy(*same, piece.alias("piece")).agg(F.count(F.lit(1)).alias("held"))
        # At most 256 rows for each end of a group.
        upto = F.col("before") + F.sum("held").over(Window.partitionBy(group, "end").orderBy("piece"))
        found = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("held") < F.col("want")))
        closer = found.select(
            group, "total",
            F.expr("cast(lo + cast(piece as decimal(38,0)) * width as long)").alias("lo"),
            F.expr("cast(least(cast(hi as decimal(38,0)), lo + (cast(piece as decimal(38,0)) + 1) * width - 1) as long)").alias("hi"),
            (F.col("upto") - F.col("held")).alias("before"), "held", "end", "want",
        )
        state = materialize(state.filter(~is_open).unionByName(closer), "bounds")
    low, high = F.col("end") == 0, F.col("end") == 1
    return state.groupBy(group).agg(
        F.max(F.when(low, F.col("lo"))).alias("low"), F.max(F.when(high, F.col("hi"))).alias("high"),
        F.max(F.when(low, F.col("before"))).alias("before"), F.max("total").alias("total"),
    )
