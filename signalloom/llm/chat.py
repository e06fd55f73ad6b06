"""Conversations as training windows under a token budget, with a loss mask.

Running sums of turn tokens cut a conversation at turn borders. Each window keeps the system turn, repeats a limited
stretch of the turns before it, and only its own assistant turns carry loss, so every target is learned once.

Texts are escaped so that no control mark of the template can occur in them: a backslash is doubled and ``<|`` becomes
``<\\|``; a line break in a role becomes ``\\/``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
# Turns of this many consecutive numbers are summed up by one task.
TURNS_PER_BLOCK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\/", "$1\n"))


def rough_tokens(formatted: Column) -> Column:
    """A token for every four characters; any other whole-number expression over the formatted turn will do."""
    return F.ceil(F.length(formatted) / 4)


def windows(df: DataFrame, budget: int = 2048, history: int = 512, tokens=rough_tokens) -> DataFrame:
    """Windows of conversations: (conv_id, window, formatted, repeated, loss).

    ``df`` has conv_id, turn, role and text; other columns are ignored. Null roles and texts count as empty, null turns
    come first, and rows of one turn are ordered by role and text. ``repeated`` is the number of leading turns that an
    earlier window has already, ``loss`` the spans (start, size) of characters of the assistant texts under the mask.

    A window's own turns have at most ``budget`` - ``history`` tokens, unless it is a single longer turn. The system
    turn is kept whole; what it leaves of ``history`` goes to the turns right before the window. Rows with a null
    conv_id are one conversation. An empty table gives no windows.
    """
    step = (budget - history) // 2
    if not 0 <= history <= step:
        raise ValueError("history must be at most a third of the budget")
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turns = (
        df.select("conv_id", F.to_json(F.struct("conv_id")).alias("conv"), "turn", role.alias("role"), text.alias("text"))
        .withColumn("head", F.length(head)).withColumn("body", F.length(escape(F.col("text"))))
        .withColumn("part", F.concat(head, escape(F.col("text")), F.lit(END)))
        .withColumn("tokens", tokens(F.col("part")).cast("long"))
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / TURNS_PER_BLOCK), F.lit(-(2**62))))
        .drop("text")
    )
    # Running sums in two levels, so that one long conversation is not one task.
    blocks = turns.groupBy("conv", "block").agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select(
        "conv", "block", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("passed"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("part")]
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    placed = (
        turns.withColumn("at", F.row_number().over(inside) - 1)
        .withColumn("start", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .join(shifts, ["conv", "block"])
        .withColumn("at", F.col("at") + F.col("passed")).withColumn("start", F.col("start") + F.col("before"))
        .withColumn("window", F.floor(F.col("start") / step) * 2 + F.when(F.col("tokens") > step, 1).otherwise(0))
        .select("conv_id", "conv", "window", "at", "start", "tokens", "role", "head", "body", "part")
    )
    is_system = (F.col("at") == 0) & (F.col("role") == "system")
    begins = placed.groupBy("conv", "window").agg(F.min("start").alias("begin"))
    system = placed.filter(is_system).select(
        "conv_id", "conv", F.col("window").alias("own"), "at", "role", "head", "body", "part", F.col("tokens").alias("kept")
    )
    room = system.select("conv", "kept")
    parts = ["conv_id", "conv", "window", "kind", "at", "role", "head", "body", "part"]
    own = placed.withColumn("kind", F.lit(2)).select(*parts)
    # The next windows that begin within the history of a turn are at most three numbers on.
    told = (
        placed.filter(~is_system & (F.col("tokens") <= history))
        .withColumn("next", F.explode(F.sequence(F.col("window") + 1, F.col("window") + 3)))
        .drop("window")
        .join(begins.withColumnRenamed("window", "next"), ["conv", "next"])
        .join(room, "conv", "left")
        .filter((F.col("begin") > F.col("start")) & (F.col("begin") - F.col("start") <= history - F.coalesce("kept", F.lit(0))))
        .withColumn("window", F.col("next")).withColumn("kind", F.lit(1)).select(*parts)
    )
    retained = (
        system.join(begins, "conv").filter(F.col("window") > F.col("own")).withColumn("kind", F.lit(0)).select(*parts)
    )
    listed = (
        own.union(told).union(retained).groupBy("conv", "window")
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.sort_array(F.collect_list(F.struct("kind", "at", "role", "head", "body", "part"))).alias("parts"),
        )
    )
    empty = F.array().cast("array<struct<start:bigint,size:bigint>>")

    def step_over(state: Column, part: Column) -> Column:
        learned = (part["kind"] == 2) & (part["role"] == "assistant")
        span = F.array(F.struct((state["at"] + part["head"]).cast("long").alias("start"), part["body"].cast("long").alias("size")))
        return F.struct(
            (state["at"] + F.length(part["part"])).cast("long").alias("at"),
            F.when(learned, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return listed.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"),
        F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("repeated"),
        F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step_over, lambda s: s["spans"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Texts out of windows: adds ``turns`` (array of role and text, without repeated turns) and ``learned`` (loss texts)."""
    marked = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    fresh = F.slice(marked, F.col("repeated") + 1, F.size(marked) - 1 - F.col("repeated"))
    inner = F.transform(fresh, lambda t: F.substring(t, F.lit(len(START) + 1), F.length(t)))

    def turn(t: Column) -> Column:
        cut = F.instr(t, "\n")
        return F.struct(
            unescape_role(F.substring(t, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(t, cut + 1, F.length(t))).alias("text")
        )

    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int"))))
    return formatted.withColumn("turns", F.transform(inner, turn)).withColumn("learned", learned)
