"""Tables that are written in commits.

A store is a folder with one or more tables. A commit writes the new rows of each of its tables to a folder of its own
and then, as its last step, one small manifest that lists these folders. Readers take only listed folders, so they see
all tables of a commit or none of them, whatever fails in between, and a plan keeps the state it was made from. A commit
costs its own rows only; nothing stored is rewritten until ``compact`` merges the table into a new base. One writer per
store at a time: of two commits with one number the second fails and has to be made again.

What a table's rows mean is its rule, kept in the manifest:

* ``rows``: all rows count
* ``latest``: one row per key, the one with the highest version; of equal versions the one committed last
* ``newest``: one row per key, the one committed last
* ``priority``: one row per key, by status; of equal ones the one committed first
* ``first``: one row per key, the one committed first
* ``replace``: a commit removes all earlier rows of the keys it names
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from signalloom.operators.ranking import latest_per_key
from signalloom.session import BROADCAST_ROW_LIMIT
from signalloom.sinks import membership

BUCKETS = 64
# A column that says which commit a row came with.
COMMIT = "commit_no"

# Which stored status a new one may replace.
STATUS_PRIORITY = {"failed": 0, "skipped": 1, "completed": 2}


@dataclass(frozen=True)
class Rule:
    kind: str = "rows"
    keys: tuple[str, ...] = ()
    column: str | None = None

    def __post_init__(self):
        if self.kind not in ("rows", "latest", "newest", "priority", "first", "replace"):
            raise ValueError(f"unknown rule {self.kind}")

    def order(self, columns: Sequence[str]) -> list[Column]:
        """The order of the rows of a key, the one that counts first; equal rows are ordered by their values."""
        tie = F.xxhash64(*[F.col(c) for c in sorted(columns)])
        last = F.col(COMMIT).desc()
        if self.kind == "latest":
            return [F.col(self.column).desc(), last, tie]
        if self.kind == "newest":
            return [last, tie]
        if self.kind == "first":
            return [F.col(COMMIT), tie]
        rank = F.coalesce(*[F.when(F.col(self.column) == name, F.lit(value)) for name, value in STATUS_PRIORITY.items()])
        return [rank.desc(), F.col(COMMIT), tie]


@dataclass
class Rows:
    """The rows that a commit adds to a table. With ``column`` they are dealt to buckets by its hash."""

    rows: DataFrame
    rule: Rule = Rule()
    column: str | None = None
    buckets: int = BUCKETS


@dataclass(frozen=True)
class Part:
    """What one commit wrote of one table."""

    number: int
    folder: str
    schema: str
    count: int
    bucketed: bool
    rule: Rule
    facts: dict = field(default_factory=dict)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(buckets)).cast("int"))


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equal keys of two aliased tables; null keys are equal to each other."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


class Store:
    """A folder of tables with its commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._read: dict[str, dict] = {}

    # ------------------------------------------------------------ manifests

    def _place(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _manifests(self) -> list[str]:
        system, place = self._place(f"{self.path}/commits")
        if not system.exists(place):
            return []
        return sorted(n for s in system.listStatus(place) if (n := s.getPath().getName()).endswith(".json"))

    def commits(self) -> list[dict]:
        """The manifests from the newest base on, in order."""
        names = self._manifests()
        for name in names:
            if name not in self._read:
                system, place = self._place(f"{self.path}/commits/{name}")
                stream = system.open(place)
                try:
                    self._read[name] = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        found = [self._read[n] for n in names]
        bases = [k for k, c in enumerate(found) if c["base"]]
        return found[bases[-1] :] if bases else found

    def _publish(self, manifest: dict) -> None:
        """Write the manifest beside its place and rename it, which fails if the place is taken."""
        folder = f"{self.path}/commits"
        jvm = self.spark.sparkContext._jvm
        system, started = self._place(f"{folder}/{uuid.uuid4().hex}.tmp")
        stream = system.create(started, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, place = self._place(f"{folder}/{manifest['number']:012d}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files.rename(system.makeQualified(started), system.makeQualified(place), options)

    def has(self, stream: str, number: int) -> bool:
        """Whether this batch of a stream, or a later one, is committed."""
        return any(c["streams"].get(stream, -1) >= number for c in self.commits())

    # ------------------------------------------------------------ writing

    def commit(self, tables: dict[str, Rows], *, batch: tuple[str, int] | None = None, base: bool = False) -> int | None:
        """Write the rows of all tables and make them visible together; gives the number of the commit.

        ``batch`` names a stream and the number of a batch in it. A batch that is committed already is not written
        again, and the answer is None.
        """
        if batch and self.has(*batch):
            return None
        commits = self.commits()
        number = commits[-1]["number"] + 1 if commits else 0
        streams: dict[str, int] = {}
        for known in commits if base else []:
            for name, n in known["streams"].items():
                streams[name] = max(n, streams.get(name, -1))
        if batch:
            streams[batch[0]] = batch[1]
        written = {}
        for name, new in tables.items():
            folder = f"{name}/{COMMIT}={number}/attempt={uuid.uuid4().hex}"
            self._write(new, folder)
            part = {"folder": folder, "schema": new.rows.schema.json(), "bucketed": bool(new.column), "rule": vars(new.rule), "facts": {}}
            part["count"] = self._open([self._part(number, part)]).count()
            if new.rule.kind == "first":
                part["facts"] = membership.describe(self, self._part(number, part), f"{name}-filters/{COMMIT}={number}/attempt={uuid.uuid4().hex}")
            written[name] = part
        self._publish({"number": number, "base": base, "streams": streams, "tables": written})
        return number

    def _write(self, new: Rows, folder: str) -> None:
        path = f"{self.path}/{folder}"
        taken = {COMMIT, "attempt", "bucket"} & {c.lower() for c in new.rows.columns}
        if taken:
            raise ValueError(f"columns {sorted(taken)} are the store's own")
        if new.column:
            # Few files per bucket, and several tasks for a bucket that is too large for one.
            bucketed(new.rows, new.column, new.buckets).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path, compression="zstd")
        else:
            new.rows.write.parquet(path, compression="zstd")

    # ------------------------------------------------------------ reading

    @staticmethod
    def _part(number: int, part: dict) -> Part:
        rule = Rule(part["rule"]["kind"], tuple(part["rule"]["keys"]), part["rule"]["column"])
        return Part(number, part["folder"], part["schema"], part.get("count", 0), part["bucketed"], rule, part["facts"])

    def parts(self, table: str) -> list[Part]:
        """What the commits wrote of a table, in order."""
        return [self._part(c["number"], c["tables"][table]) for c in self.commits() if table in c["tables"]]

    def _open(self, parts: Sequence[Part], schema: str | None = None) -> DataFrame:
        """The rows of ``parts`` with the number of their commit."""
        wanted = StructType.fromJson(json.loads(schema or parts[-1].schema))
        names = wanted.names
        if not parts:
            return self.spark.createDataFrame([], wanted).withColumn(COMMIT, F.lit(0).cast("long"))
        found = []
        # Folders with and without buckets have different partition columns.
        for is_bucketed in sorted({p.bucketed for p in parts}):
            full = StructType([*wanted.fields]).add(COMMIT, LongType()).add("attempt", StringType())
            full = full.add("bucket", IntegerType()) if is_bucketed else full
            same = [p for p in parts if p.bucketed == is_bucketed]
            base = f"{self.path}/{same[0].folder.split('/')[0]}"
            files = self.spark.read.schema(full).option("basePath", base).parquet(*[f"{self.path}/{p.folder}" for p in same])
            found.append(files.select(*[F.col(f"`{n}`") for n in names], COMMIT))
        return reduce(DataFrame.union, found)

    def rows(self, table: str, parts: Sequence[Part] | None = None) -> DataFrame | None:
        """All rows that are listed, or those of the given parts, as they were written, with their commit."""
        listed = self.parts(table)
        return self._open(listed if parts is None else parts, listed[-1].schema) if listed else None

    def read(self, table: str) -> DataFrame | None:
        """The rows that count under the table's rule, or None before the first commit."""
        parts = self.parts(table)
        if not parts:
            return None
        rule = parts[-1].rule
        if rule.kind in ("rows", "first"):
            # First writers were compared with all stored keys, so no key is stored twice.
            return self._open(parts).drop(COMMIT)
        if rule.kind == "replace":
            return self._kept(table, parts, rule).drop(COMMIT)
        return self._merged(parts, rule).drop(COMMIT)

    def _merged(self, parts: list[Part], rule: Rule) -> DataFrame:
        """One row per key. The base has one already, so only keys that later commits name are compared."""
        base = [p for p in parts if p.number == self.commits()[0]["number"] and self.commits()[0]["base"]]
        later = [p for p in parts if p not in base]
        changes = self._open(later, parts[-1].schema)
        keys, order = list(rule.keys), rule.order([c for c in changes.columns if c != COMMIT])
        if not base:
            return latest_per_key(changes, keys, order)
        old = self._open(base, parts[-1].schema)
        if not later:
            return old
        named = changes.select(*keys).distinct()
        if sum(p.count for p in later) <= BROADCAST_ROW_LIMIT:
            named = F.broadcast(named)
        on = same_keys("o", "n", keys)
        untouched = old.alias("o").join(named.alias("n"), on, "left_anti")
        touched = old.alias("o").join(named.alias("n"), on, "left_semi")
        return untouched.unionByName(latest_per_key(touched.unionByName(changes), keys, order))

    def _kept(self, table: str, parts: list[Part], rule: Rule) -> DataFrame:
        """Rows whose key no later commit names."""
        rows = self._open(parts)
        gone = self.rows(f"{table}-gone")
        if gone is None:
            return rows
        keys = list(rule.keys)
        # A row per key that was ever replaced since the base.
        last = gone.groupBy(*keys).agg(F.max(COMMIT).alias("_last"))
        if sum(p.count for p in self.parts(f"{table}-gone")) <= BROADCAST_ROW_LIMIT:
            last = F.broadcast(last)
        dead = same_keys("o", "g", keys) & (F.col(f"o.{COMMIT}") < F.col("g._last"))
        return rows.alias("o").join(last.alias("g"), dead, "left_anti")

    # ------------------------------------------------------------ upkeep

    def compact(self, tables: Sequence[str] | None = None, column: dict[str, str] | None = None, buckets: int = BUCKETS) -> int | None:
        """Merge every table into a base that readers start from. Earlier commits stay until ``expire``."""
        commits = self.commits()
        names = sorted({t for c in commits for t in c["tables"] if not t.endswith("-gone")})
        if len(commits) < 2:
            return None
        new = {}
        for name in names:
            rule = self.parts(name)[-1].rule
            deal = (column or {}).get(name) or (rule.keys[0] if rule.keys else None)
            new[name] = Rows(self.read(name), rule, deal, buckets)
        return self.commit(new, base=True)

    def expire(self) -> list[str]:
        """Delete manifests before the newest base and folders that no manifest lists any more."""
        commits = self.commits()
        if not commits:
            return []
        listed = {p["folder"] for c in commits for p in c["tables"].values()}
        listed |= {p["facts"]["folder"] for c in commits for p in c["tables"].values() if p["facts"].get("folder")}
        gone = []
        for name in self._manifests():
            if int(name.split(".")[0]) < commits[0]["number"]:
                gone.append(f"commits/{name}")
                self._read.pop(name, None)
        system, root = self._place(self.path)
        for table in [s.getPath() for s in system.listStatus(root) if s.isDirectory() and s.getPath().getName() != "commits"]:
            for commit in [s.getPath() for s in system.listStatus(table)]:
                for attempt in [s.getPath() for s in system.listStatus(commit)]:
                    folder = f"{table.getName()}/{commit.getName()}/{attempt.getName()}"
                    if folder not in listed:
                        gone.append(folder)
        for folder in gone:
            system.delete(self._place(f"{self.path}/{folder}")[1], True)
        return gone
