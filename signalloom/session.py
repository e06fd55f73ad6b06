"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators are designed for. All of them can be changed at run time.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on run_id followed by an aggregate on run_id must still split a hot run.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Settings that only a new session can take. The operators build many
# expressions; recording the source line of each costs more than planning.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# A table is broadcast only after a count shows that it holds at most this many rows and bytes.
BROADCAST_ROW_LIMIT = 200_000
BROADCAST_BYTE_LIMIT = 64 << 20


def build_session(app_name: str = "signalloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **START_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that somebody else built."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: what ``spark.checkpoint.dir`` names.

    Only a local session may fall back to a temporary folder, because on a
    cluster such a folder exists on one machine only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="signalloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/signalloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on shuffle files of lost executors, and values
    such as partition ids keep their first evaluation in every later read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later step reads."""
    for table in tables:
        session = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, most_bytes: int = BROADCAST_BYTE_LIMIT) -> bool:
    """Whether a count, which stops behind ``limit``, shows that ``df`` holds no more rows and bytes than that."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) if df.columns else F.lit(0)
    found = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("size")).first()
    return found["n"] <= limit and (found["size"] or 0) <= most_bytes


def small_side(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, most_bytes: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Mark ``df`` for broadcast if it is proven small, in rows and in bytes.

    A table that Spark's own estimate finds small enough needs no mark, since Spark broadcasts it by itself. Any other
    one is measured up to the limits. A larger table keeps the ordinary shuffle join, where adaptive execution splits
    the partitions of hot keys.
    """
    spark = df.sparkSession
    own = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= own:
        return df
    return F.broadcast(df) if is_small(df, limit, most_bytes) else df
