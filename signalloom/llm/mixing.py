"""Mixing of sources to target weights by Pfair scheduling of blocks.

Block i of a source of weight w is released at slot floor(i / w) and due by slot ceil((i + 1) / w). Earliest deadline
first fills every slot, so in each prefix a source is less than one block away from its weight. Weights are exact: as
whole numbers they add up to a period after which the schedule repeats. One period is scheduled, or the blocks of the
table where they are fewer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.common import dense_ranks, keep, without

BUCKETS = 1 << 12
# Slots that the driver holds at once; a longer table of slots, or of sources, is not broadcast.
MOST_HELD = 250_000
# Where a row stands in the files of its table.
LINE = ["_file", "_line"]


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole shares of at least one that add up to the period, by largest remainders."""
    names = sorted(weights)
    total = sum(weights.values())
    exact = {n: weights[n] / total * (period - len(names)) for n in names}
    out = {n: 1 + math.floor(exact[n]) for n in names}
    for n in sorted(names, key=lambda n: (math.floor(exact[n]) - exact[n], n))[: period - sum(out.values())]:
        out[n] += 1
    return out


def whole_weights(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """The smallest whole numbers in the exact proportions of the weights; floats count as the decimals they print as."""
    exact = {n: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for n, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {n: int(w * scale) for n, w in exact.items()}
    common = math.gcd(*whole.values())
    return {n: w // common for n, w in whole.items()}


def slots(share: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of the first ``blocks`` of each source.

    Earliest deadline first among the released blocks; slots for which no block is left stay empty.
    """
    period = sum(share.values())
    waiting = [(0, -(-period // share[name]), name, 0) for name, k in blocks.items() if k]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, due, name, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, -share[name], name, i))
        due, _, name, i = heapq.heappop(ready)
        yield name, i, slot, i * period // share[name], due
        slot += 1
        if i + 1 < blocks[name]:
            heapq.heappush(waiting, ((i + 1) * period // share[name], -(-(i + 2) * period // share[name]), name, i + 1))


def schedule(share: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The slots of one period."""
    return list(slots(share, share))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_HELD else df


def _slot_table(spark: SparkSession, plan: Iterator[tuple[str, int, int, int, int]], rows: int) -> DataFrame:
    """The plan as a table, in pieces that the driver can hold."""
    schema = pa.schema([("name", pa.string()), *((n, pa.int64()) for n in ("turn", "start", "opens", "due"))])
    table = None
    while True:
        piece = list(islice(plan, MOST_HELD))
        if table is not None and not piece:
            return table
        columns = list(zip(*piece)) or [()] * len(schema)
        made = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
        if rows > MOST_HELD:
            made = keep(made, "slots")
        table = made if table is None else table.union(made)


def _named(df: DataFrame, source: str) -> DataFrame:
    """``df`` with ``name``, which tells the null source from all others."""
    return df.withColumn("name", F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string"))))


def _scheduled(ranked: DataFrame, rows: DataFrame, weights: Mapping[str, float | Fraction] | None, block: int) -> DataFrame:
    """``ranked`` with the block of every row and the release, deadline and slot of the block.

    ``rank`` numbers the rows of each ``name``, source, from 0; the sources are counted in ``rows``.
    """
    spark = ranked.sparkSession
    found = rows.groupBy("name").count().collect()
    given = {f"+{n}": w for n, w in (weights or {}).items() if w > 0}
    least = min(given.values(), default=None)
    targets = {r["name"]: given.get(r["name"], math.sqrt(r["count"]) if least is None else least) for r in found}
    whole = whole_weights(targets)
    blocks = {r["name"]: -(-r["count"] // block) for r in found}
    length, held = sum(whole.values()), sum(blocks.values())
    # Blocks of a source in the schedule, after which it starts again; the schedule of all blocks never does.
    repeats = length <= held
    turns, rounds = (whole, length) if repeats else (blocks, 0)
    planned = min(length, held)
    plan = _small(_slot_table(spark, slots(whole, turns), planned), planned)
    per_source = spark.createDataFrame(sorted(turns.items()), "name string, turns long")
    return (
        ranked.join(_small(per_source, len(turns)), "name")
        .withColumn("block", F.floor(F.col("rank") / block))
        .withColumn("round", F.floor(F.col("block") / F.col("turns")))
        .withColumn("turn", F.col("block") % F.col("turns")).drop("turns")
        .join(plan, ["name", "turn"])
        .withColumn("release", F.col("round") * rounds + F.col("opens"))
        .withColumn("deadline", F.col("round") * rounds + F.col("due"))
        .withColumn("slot", F.col("round") * rounds + F.col("start"))
    )


def mix(
    df: DataFrame, weights: Mapping[str, float | Fraction] | None = None, block: int = 16, period: int = 256,
    doc_id: str = "doc_id", source: str = "source", also: Sequence[str] = (),
) -> DataFrame:
    """One row (doc_id, source, block, release, deadline, slot, position) per document; none is left out.

    ``weights`` names the target weights, which hold exactly (Fraction for what no decimal states); by default a source
    weighs the square root of its number of documents. ``period`` is the number of slots whose documents are numbered
    together, which the result does not depend on. The driver holds one entry per source, of any number. Sources that ``weights`` does not name, and the null source, weigh as much as the lightest named one. Inside a source documents come
    in the order of a hash of their id. A source that runs out leaves its slots to the others, in proportion, so
    ``position`` has no gaps; the bound of one block holds as long as all sources last. Repeated rows and equal ids are
    rows like any others. Columns named by ``also`` stay and order rows of equal ids. An empty table gives no rows.
    """
    rows = keep(_named(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *also), "source"), "mix")
    ranked = dense_ranks(rows, "name", F.shiftrightunsigned(F.xxhash64("doc_id"), 16), [F.col("doc_id"), *map(F.col, also)], "rank", BUCKETS)
    placed = _scheduled(ranked, rows, weights, block).withColumn("stretch", F.floor(F.col("slot") / period))
    sizes = placed.groupBy("stretch").agg(F.count(F.lit(1)).alias("held"))
    # One row per stretch of period * block documents.
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("stretch", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("passed"))
    inside = Window.partitionBy("stretch").orderBy("slot", "rank")
    return (
        placed.withColumn("local", F.row_number().over(inside) - 1).join(shifts, "stretch")
        .select(
            "doc_id", "source", "block", "release", "deadline", "slot", (F.col("local") + F.col("passed")).alias("position"), *also
        )
    )


def file_order(df: DataFrame) -> DataFrame | None:
    """``df`` with ``_file`` and ``_line``, which order its rows as its files do; None if it is not read from files.

    Spark numbers the files of a sorted table in its order, but reads them in another one. Rows that are made from those
    of files, as by a join or by taking lists apart, are not read from files: several can come from one place.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation"):
        return None
    try:
        return df.withColumns({"_file": F.col("_metadata.file_path"), "_line": F.col("_metadata.row_index")})
    except AnalysisException:
        return None


def in_mixed_order(df: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """All rows of ``df`` sorted by their position in the mix, in a column ``position`` that replaces one of that name.

    Every row has a position of its own, also where rows share an id.
    """
    plain = without(df, ["position", *LINE])
    rows = file_order(plain)
    if rows is None:
        # Written, so that the places of the rows stay what the mix was told.
        rows = file_order(keep(plain, "rows"))
    places = mix(rows, weights, also=LINE, **options).select("position", *LINE)
    return rows.join(places, LINE).drop(*LINE).orderBy("position")


def written_places(rows: DataFrame, weights: Mapping[str, float | Fraction] | None = None, block: int = 16, source: str = "source") -> DataFrame:
    """``slot`` and ``position`` per ``_file`` and ``_line`` of a table that :func:`in_mixed_order` sorted and that was written.

    The order of the files is the mix, so it is read off and not made again: rows are counted by file, and by file and
    source, and those of the files before shift the places in a file. A row per file goes through one task.
    """
    narrow = keep(_named(rows.select(source, "_file", "_line"), source).drop(source), "lines")
    number = F.regexp_extract(F.element_at(F.split("_file", "/"), -1), r"^part-(\d+)", 1).try_cast("long")
    counts = keep(narrow.groupBy("_file", "name").agg(F.count(F.lit(1)).alias("_held")), "line-counts")
    files = counts.groupBy("_file").agg(F.sum("_held").alias("_held")).withColumn("_number", number)
    before = Window.orderBy("_number", "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", "_number", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"))
    earlier = Window.partitionBy("name").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.join(starts, "_file").select("_file", "name", "_start", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_passed"))
    inside = Window.partitionBy("_file", "name").orderBy("_line")
    ranked = narrow.withColumn("rank", F.row_number().over(inside) - 1).join(shifts, ["_file", "name"])
    ranked = ranked.withColumns({"rank": F.col("rank") + F.col("_passed"), "position": F.col("_line") + F.col("_start")})
    return _scheduled(ranked, narrow, weights, block).select("_file", "_line", "slot", "position")
