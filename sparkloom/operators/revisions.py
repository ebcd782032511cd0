"""Examples as revisions: changes become whole rows that are appended, and a version becomes visible by the rename of one small file.

A table is a folder. ``data/<name>`` holds the revisions of one commit, by bucket of the id's hash; ``versions/<n>.json``
names the folders that version n consists of. Files are never changed, so a reader keeps its version while others write.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import all_text, content_hash
from sparkloom.operators import rules
from sparkloom.operators.similarity import near_duplicates_with
from sparkloom.schema import MESSAGES

FIELDS = {"category": "string", "messages": MESSAGES, "tools": "string", "source": "string", "group_id": "string", "status": "string"}
ROW = "id string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", content_hash string, token_count long, created_at timestamp, updated_at timestamp"
REVISION = ROW + ", deleted boolean, version long"
#: Buckets of ids within a commit of a new table: a task writes a bucket, and one id is looked up in this share of the files.
BUCKETS = 64
#: Changes of one id are scanned in runs of so many numbers, so that no task sorts all changes of an id.
RUN = 4096
#: Commits on local folders are renamed one at a time; HDFS refuses a rename onto an existing file by itself.
_RENAME = threading.Lock()


def _as_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows there are, as creations before all changes, and the changes; empty category and source say nothing."""
    before = current.select("id", F.lit(None).cast("long").alias("n"), F.lit("create").alias("op"), *FIELDS, "created_at")
    new = changes.select("id", F.col("n").cast("long").alias("n"), "op", *FIELDS, F.lit(None).cast("timestamp").alias("created_at"))
    new = new.withColumns({c: F.nullif(c, F.lit("")) for c in ("category", "source")}).where("id is not null and n is not null and op in ('create', 'update', 'status', 'delete')")
    return before.unionByName(new).withColumn("n", F.coalesce("n", F.lit(-(2**63))))


def revised(current: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """The rows that changes turn current rows into, one for each id they have an effect on, with deleted.

    changes: id, n (their order within an id, unique there), op and FIELDS. create makes a draft where there is no row;
    update replaces the fields that it states; status sets the status; delete removes the row, and later changes find
    none until the next creation. Changes without id, n or a known op, and those that ``refused`` lists, do nothing. Only what
    follows the last deletion counts, so all of it is aggregates, which are combined before they are shuffled.
    """
    all_of = _as_changes(current, changes)
    ends = all_of.groupBy("id").agg(F.max(F.when(F.col("op") == "delete", F.col("n"))).alias("end"), F.count_if(F.col("n") == -(2**63)).alias("was"), F.max("n").alias("last")).where(F.col("last") > -(2**63))
    alive = all_of.join(ends, "id").where("op <> 'delete' and (end is null or n > end)")
    lives = alive.groupBy("id").agg(F.min(F.when(F.col("op") == "create", F.col("n"))).alias("start"))
    rows = alive.join(lives, "id").where("n >= start and (op <> 'create' or n = start)")
    by_status = F.when(F.col("op") == "status", F.col("status")).when(F.col("op") == "create", F.when(F.col("n") == -(2**63), F.col("status")).otherwise("draft"))
    stated = {c: F.col(c) for c in FIELDS if c != "status"} | {"status": by_status}
    said = {c: F.when(F.col("op") != "status", v) if c != "status" else v for c, v in stated.items()}
    values = [F.max_by(v, F.when(v.isNotNull(), F.col("n"))).alias(c) for c, v in said.items()]
    net = rows.groupBy("id").agg(*values, F.min("created_at").alias("created_at"), F.max("n").alias("top"))
    out = ends.join(net, "id", "left").where("top is not null and top > -9223372036854775808 or top is null and was > 0")
    out = rules.with_tools(out).withColumn("content_hash", F.when(F.col("top").isNotNull(), content_hash(F.col("messages"), F.col("tools"))))
    return out.select("id", *FIELDS, "content_hash", F.lit(None).cast("long").alias("token_count"), F.coalesce("created_at", at).alias("created_at"), at.alias("updated_at"), F.col("top").isNull().alias("deleted"))


def refused(current: DataFrame, changes: DataFrame) -> DataFrame:
    """id, n, op, reason of changes that do nothing: a creation where there is a row (exists), another change where there is none (missing)."""
    rows = _as_changes(current, changes).withColumn("run", F.when(F.col("n") > -(2**63), F.floor(F.col("n") / RUN)))
    there = F.when(F.col("op").isin("create", "delete"), F.col("op") == "create")
    runs = rows.groupBy("id", "run").agg(F.max_by(there, F.when(there.isNotNull(), F.col("n"))).alias("left"))
    earlier = Window.partitionBy("id").orderBy(F.asc_nulls_first("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("id").alias("_id"), F.col("run").alias("_run"), F.last("left", True).over(earlier).alias("found"))
    rows = rows.where("run is not null").join(runs, (F.col("id") == F.col("_id")) & (F.col("run") == F.col("_run")))
    within = Window.partitionBy("id", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    exists = F.coalesce(F.last(there, True).over(within), "found", F.lit(False))
    reason = F.when((F.col("op") == "create") & exists, "exists").when((F.col("op") != "create") & ~exists, "missing")
    return rows.select("id", "n", "op", reason.alias("reason")).where("reason is not null")


def violations(current: DataFrame, revisions: DataFrame) -> DataFrame:
    """What the rules find in revised rows that aren't deleted, with the rows that they don't touch as peers: id, code, level, message, location.

    Equal contents are errors, similar texts warnings that name the first peer with the text. Peers aren't compared with each other.
    """
    rows = revisions.where("not deleted")
    peers = current.join(revisions.select("id"), "id", "left_anti")
    found = rules.validate(rows).unionByName(_violations(rows.join(peers.select("content_hash").distinct(), "content_hash", "left_semi"), "err", "exact duplicate"))
    texts, known = (x.select("id", all_text(F.col("messages")).alias("text")) for x in (rows, peers))
    near = near_duplicates_with(texts, known, id_col="id")
    return found.unionByName(_violations(near, "warn", "near duplicate", F.col("peer"))).distinct()


def _violations(rows: DataFrame, level: str, message: str, location: Column | None = None) -> DataFrame:
    where = F.lit(None) if location is None else location
    return rows.select("id", F.lit("C6").alias("code"), F.lit(level).alias("level"), F.lit(message).alias("message"), where.cast("string").alias("location"))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Table:
    """Versions of a folder of revisions that the driver and all executors reach. buckets counts where the first commit makes the table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str) -> tuple:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        where, fs = self._fs(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _state(self, version: int) -> tuple[list[str], int]:
        """The folders and the number of buckets of a version."""
        if version == 0:
            return [], self.buckets
        stated = json.loads(self.spark.read.option("wholetext", "true").text(f"{self.path}/versions/{version}.json").first()[0])
        return stated["folders"], stated["buckets"]

    def revisions(self, version: int | None = None) -> DataFrame:
        """All revisions that a version consists of; the newest one unless stated."""
        folders = [f"{self.path}/data/{x}" for x in self._state(self.version() if version is None else version)[0]]
        if not folders:
            return self.spark.createDataFrame([], REVISION + ", bucket int")
        return reduce(DataFrame.unionByName, (self.spark.read.schema(REVISION + ", bucket int").parquet(f) for f in folders))  # partitioned folders are read one by one

    def rows(self, version: int | None = None) -> DataFrame:
        """The latest revision of each id, without deleted ones."""
        return _latest(self.revisions(version))

    def row(self, key: str) -> DataFrame:
        """The row of one id, from the files of its bucket."""
        version = self.version()
        return _latest(self.revisions(version).where((F.col("bucket") == _bucket(F.lit(key), self._state(version)[1])) & (F.col("id") == key)))

    def _write(self, rows: DataFrame, version: int, buckets: int) -> str:
        name = uuid.uuid4().hex
        placed = rows.withColumns({"version": F.lit(version).cast("long"), "bucket": _bucket(F.col("id"), buckets)})
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        return name

    def _visible(self, version: int, folders: list[str], buckets: int) -> bool:
        """Names the folders of a version; False if another writer has named some for it."""
        part, fs = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(json.dumps({"version": version, "folders": folders, "buckets": buckets}).encode())
        out.close()
        there, _ = self._fs(f"{self.path}/versions/{version}.json")
        with _RENAME:
            won = not fs.exists(there) and fs.rename(part, there)
        if not won:
            fs.delete(part, False)
        return won

    def commit(self, make: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
        """Appends what make(current rows) gives (columns of ``revised``) as the next version, which it returns.

        If another writer was faster, make runs again on that writer's rows, so no change is lost or applied to old rows.
        """
        for _ in range(tries):
            base = self.version()
            folders, buckets = self._state(base)
            name = self._write(make(self.rows(base)), base + 1, buckets)
            if self._visible(base + 1, [*folders, name], buckets):
                return base + 1
            where, fs = self._fs(f"{self.path}/data/{name}")
            fs.delete(where, True)
        raise RuntimeError(f"other writers were faster {tries} times")

    def apply(self, changes: DataFrame, at: Column | None = None, tries: int = 10) -> int:
        """Commits changes as in ``revised``."""
        return self.commit(lambda rows: revised(rows, changes, F.current_timestamp() if at is None else at), tries)

    def compact(self) -> int:
        """The same rows in one folder, without older and deleted revisions; earlier versions stay readable."""
        base = self.version()
        buckets = self._state(base)[1]
        name = self._write(self.rows(base).withColumn("deleted", F.lit(False)), base + 1, buckets)
        if not self._visible(base + 1, [name], buckets):
            raise RuntimeError("another writer was faster")
        return base + 1


def _latest(revisions: DataFrame) -> DataFrame:
    rest = [c for c in revisions.columns if c not in ("id", "version", "bucket")]
    last = revisions.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("id", "r.*")
    return last.where("not deleted").drop("deleted")
