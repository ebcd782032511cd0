"""Applies numbered changes of clients in sequence, batch by batch, in a Structured Streaming query with paged state.

State of a client: the next number, the values so far, and the held rows that came ahead of it. Held rows lie in pages of PAGE
numbers: one map state has a page's rows as an Arrow blob, another its minimum day. A batch loads only the pages that its
rows or the next number touch; what is due is found from the minimum days alone, so a client with very many held
rows is served page by page, and at most CACHED rows of pages are in memory at once.

Time. A batch's rows share one event time, made of the largest day so far and the batch's number. The watermark that follows
a batch is the clock of the next one: timers at a client's earliest held day plus WAIT fire in the batch without data behind it,
for clients without new rows too. A last mark at the end of time lets everything held go.

Within a batch only the first row (by day, change_id) of each number of a client can be accepted, as numbers are jumped only at
a batch's start; the others are rejected beside the state. So a client with very many rows of few numbers sends few of them to its task.
What is accepted of one client in one batch does go through one task: each value depends on the one before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from sparkloom.llm.ordered import positions
from sparkloom.llm.store import kept, new_dir, scope, until_exit

BATCHES, FIRST_DAY, SPAN = 8, 19723, 160
#: Days a client's earliest held row waits for missing numbers.
WAIT = 5
#: Numbers of a page, and rows of pages in memory at once.
PAGE, CACHED = 256, 1 << 16
#: Event times have a second for each batch of a day; no more than so many batches.
SLOTS = 16
#: The event time behind all batches, in seconds.
FOREVER = 100_000_000_000
_ROW = pa.schema([("n", pa.int64()), ("day", pa.int64()), ("change_id", pa.int64()), ("op", pa.string()), ("city", pa.string()), ("balance", pa.float64())])
#: Settings of the streaming query. Each start opens its state anew; short maintenance closes what an earlier start has left open on executors.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "2s",
}


def numbered(changes: DataFrame) -> DataFrame:
    """The distinct changes with n, day and batch; rows without valid_at or change_id, or whose crc32 is divisible by 11, are gone after numbering.

    n is the dense rank of seq among the client's rows, null first; a null client_id is a client of its own. Days before the first
    batch count to it. Columns beside those of the table aren't read.
    """
    rows = kept(changes.select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").distinct(), "changes")
    ranks = positions(rows.select("client_id", "seq").distinct(), ["client_id"], ["seq"], number="n").select(F.col("client_id").alias("c"), F.col("seq").alias("s"), "n")
    h = F.crc32(F.col("change_id").cast("string"))
    rows = rows.where(F.col("valid_at").isNotNull() & (h % 11 != 0))
    rows = rows.withColumn("day", (F.unix_date(F.to_date("valid_at")) + 2 * (h % 4)).cast("long"))
    rows = rows.withColumn("batch", F.greatest(F.lit(1), F.least(F.lit(BATCHES), (1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / SPAN)).cast("int"))))
    both = F.col("client_id").eqNullSafe(F.col("c")) & F.col("seq").eqNullSafe(F.col("s"))
    return rows.join(ranks, both).select("change_id", "client_id", "n", "day", "op", "city", "balance", "batch")


def with_firsts(rows: DataFrame) -> DataFrame:
    """rows with ``first``: whether a row is the first of its batch, client and number (or equal to it in all that counts)."""
    rows = kept(rows, "numbered")
    key = ["batch", "client_id", "n"]
    order = F.struct("day", "change_id", "op", "city", "balance")
    best = rows.groupBy(*key).agg(F.min(order).alias("best")).select(*(F.col(c).alias("_" + c) for c in key), "best")
    same = F.col("client_id").eqNullSafe(F.col("_client_id")) & (F.col("batch") == F.col("_batch")) & (F.col("n") == F.col("_n"))
    return rows.join(best, same).select(*rows.columns, order.eqNullSafe(F.col("best")).alias("first"))


class Pages:
    """The held rows of one client: pages loaded when touched, written back when changed."""

    def __init__(self, blobs: Any, days: Any, count: int, page: int, cached: int):
        self.blobs, self.days, self.count = blobs, days, count  # count: pages of the stored index
        self.width, self.cached = page, cached
        self.rows: dict[int, dict[int, tuple]] = {}
        self.changed: set[int] = set()
        self.stored: set[int] = set()  # of the loaded pages
        self.index: dict[int, int] | None = {} if not count else None  # page -> minimum day
        self.size = 0

    def page(self, at: int) -> dict[int, tuple]:
        if at not in self.rows:
            if self.size > self.cached:
                self.flush()
            found = self.blobs.getValue((at,)) if self.count and (self.index is None or at in self.index) else None
            held = {}
            if found is not None:
                self.stored.add(at)
                batch = pa.ipc.read_record_batch(pa.py_buffer(found[0]), _ROW)
                held = {r[0]: r for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
            self.rows[at] = held
            self.size += len(held)
        return self.rows[at]

    def add(self, row: tuple) -> bool:
        """Holds a row, unless its number is held."""
        at = row[0] // self.width
        held = self.page(at)
        if row[0] in held:
            return False
        held[row[0]] = row
        self.size += 1
        self.changed.add(at)
        if self.index is not None:
            self.index[at] = min(row[1], self.index.get(at, row[1]))
        return True

    def take(self, n: int) -> tuple | None:
        at = n // self.width
        if self.index is not None and at not in self.index:
            return None
        held = self.page(at)
        row = held.pop(n, None)
        if row is not None:
            self.size -= 1
            self.changed.add(at)
            if self.index is not None:
                if held:
                    self.index[at] = min(r[1] for r in held.values())
                else:
                    del self.index[at]
        return row

    def whole_index(self) -> dict[int, int]:
        """Minimum day of every page with held rows; reads days, not blobs."""
        if self.index is None:
            stored = {k[0]: v[0] for k, v in self.days.iterator()} if self.count > len(self.stored) else {}
            for at, held in self.rows.items():
                stored.pop(at, None)
                if held:
                    stored[at] = min(r[1] for r in held.values())
            self.index = stored
        return self.index

    def flush(self) -> None:
        for at in self.changed:
            held = self.rows[at]
            if held:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*held.values(), strict=True), _ROW, strict=True)]
                self.blobs.updateValue((at,), (pa.RecordBatch.from_arrays(columns, schema=_ROW).serialize().to_pybytes(),))
                self.days.updateValue((at,), (min(r[1] for r in held.values()),))
                self.count += at not in self.stored
            elif at in self.stored:
                self.blobs.removeKey((at,))
                self.days.removeKey((at,))
                self.count -= 1
        self.rows, self.changed, self.stored, self.size = {}, set(), set(), 0


class Applier(StatefulProcessor):
    """One client's changes. Rows of a call have different numbers; their order doesn't matter, as numbers are jumped before them."""

    def __init__(self, page: int = PAGE, cached: int = CACHED):
        self.width, self.cached = page, cached

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next long, city string, balance double, batch int, pages long, timer long")
        self.blobs = handle.getMapState("blobs", "page long", "rows binary")
        self.days = handle.getMapState("days", "page long", "day long")

    def _load(self) -> None:
        head = self.head.get()
        self.next, self.city, self.balance, self.batch, count, self.timer = head if head is not None else (1, None, None, 0, 0, 0)
        self.pages = Pages(self.blobs, self.days, count, self.width, self.cached)

    def _store(self) -> None:
        index = self.pages.whole_index()
        timer = min((min(index.values()) + WAIT) * SLOTS, FOREVER) * 1000 if index else 0
        self.pages.flush()
        if timer != self.timer:
            if self.timer:
                self.handle.deleteTimer(self.timer)
            if timer:
                self.handle.registerTimer(timer)
        self.head.update((self.next, self.city, self.balance, self.batch, self.pages.count, timer))

    def _drain(self, key: Any, batch: int, missed: int = 0) -> Iterator[Row]:
        """Applies what is held from the next number on, without a gap."""
        while (row := self.pages.take(self.next)) is not None:
            n, _, change, op, city, balance = row
            if op == "I":
                self.city, self.balance = city, balance
            elif op == "U":
                self.city, self.balance = self.city if city is None else city, self.balance if balance is None else balance
            elif op == "D":
                self.city, self.balance = None, None
            yield Row(change_id=change, client_id=key, n=n, op=op, status="applied", batch=batch, missed=missed, city=self.city, balance=self.balance)
            missed = 0
            self.next += 1

    def _jump(self, key: Any, clock: int, batch: int) -> Iterator[Row]:
        """Passes over missing numbers while the earliest held row has waited long enough by clock, a day."""
        index = self.pages.whole_index()
        days = [(day, at) for at, day in index.items()]
        heapq.heapify(days)
        order = sorted(index)
        while index:
            while index.get(days[0][1]) != days[0][0]:  # a page whose minimum has changed
                _, at = heapq.heappop(days)
                if at in index:
                    heapq.heappush(days, (index[at], at))
            if days[0][0] + WAIT > clock:
                break
            while order[0] not in index:
                heapq.heappop(order)
            n = min(self.pages.page(order[0]))
            missed, self.next = n - self.next, n
            yield from self._drain(key, batch, missed)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        self._load()
        batch = None
        for row in rows:
            if batch is None:
                batch = row.batch
                if self.pages.count:
                    yield from self._jump(key[0], _clock(timerValues), batch)
            if row.n is None:  # the mark at the end
                continue
            if row.n < self.next or not self.pages.add((row.n, row.day, row.change_id, row.op, row.city, row.balance)):
                yield Row(change_id=row.change_id, client_id=key[0], n=row.n, op=row.op, status="rejected", batch=batch, missed=0, city=None, balance=None)
        yield from self._drain(key[0], batch)
        self.batch = batch
        self._store()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[Row]:
        self._load()
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        if expiredTimerInfo.getExpiryTimeInMs() == self.timer:
            self.timer = 0  # gone with this call
        batch = BATCHES + 1 if mark >= FOREVER else max(mark % SLOTS, self.batch) + 1
        yield from self._jump(key[0], _clock(timerValues), batch)
        self._store()


def _clock(timers: TimerValues) -> int:
    mark = timers.getCurrentWatermarkInMs() // 1000
    return FOREVER if mark >= FOREVER else mark // SLOTS


_OUT = "change_id long, client_id long, n long, op string, status string, batch int, missed long, city string, balance double"


def feed(rows: DataFrame, page: int = PAGE, cached: int = CACHED) -> DataFrame:
    """rows (of ``numbered``, with ``first``) fed batch by batch: the status of each, as _OUT. Folders are new at every call."""
    spark = rows.sparkSession
    source, out, checkpoint = (new_dir(spark, f"changes-{x}") for x in ("in", "out", "state"))
    staged = kept(rows.repartition("batch", "client_id", "n"), "staged")
    largest = {r.batch: r.day for r in staged.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    schema = staged.withColumn("at", F.timestamp_seconds(F.lit(0))).schema
    spark.createDataFrame([], schema).write.parquet(source)
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        seen = 0
        for batch in range(1, BATCHES + 2):
            if batch <= BATCHES:
                seen = max(seen, largest.get(batch, seen))
                new, at = staged.where(F.col("batch") == batch), seen * SLOTS + batch
            else:  # the end of time, as a row that is no change
                new = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in staged.schema if f.name not in ("batch", "first")), F.lit(batch).alias("batch"), F.lit(True).alias("first"))
                at = FOREVER
            new.withColumn("at", F.timestamp_seconds(F.lit(at))).select(*schema.names).write.mode("append").parquet(source)
            _start(spark, source, schema, out, checkpoint, Applier(page, cached))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for path in (source, out, checkpoint):
            until_exit(spark, path)
    return spark.read.schema(_OUT).parquet(out)


def _start(spark: SparkSession, source: str, schema: Any, out: str, checkpoint: str, applier: Applier) -> None:
    stream = spark.readStream.schema(schema).parquet(source)
    ours = stream.withWatermark("at", "0 seconds").where("first").groupBy("client_id").transformWithState(applier, _OUT, "append", "eventTime")
    null = lambda kind: F.lit(None).cast(kind)
    others = stream.where(f"not first and batch <= {BATCHES}").select("change_id", "client_id", "n", "op", F.lit("rejected").alias("status"), "batch", F.lit(0).cast("long").alias("missed"), null("string").alias("city"), null("double").alias("balance"))
    query = ours.unionByName(others).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def apply_changes(changes: DataFrame, *, page: int = PAGE, cached: int = CACHED) -> DataFrame:
    """change_id, client_id, status, batch, missed, city, cents and current of every change that takes part.

    Rows that differ only in columns that aren't named above are rows of their own; equal rows are one. An unknown op is applied and
    changes nothing. cents is null where the balance is null or not finite. An empty table gives an empty result.
    """
    with scope(changes.sparkSession) as stay:
        found = feed(with_firsts(numbered(changes)), page, cached)
        last = found.where("status = 'applied'").groupBy("client_id").agg(F.max(F.struct("n", "op")).alias("last")).select(F.col("client_id").alias("c"), F.col("last.n").alias("m"), F.coalesce(F.col("last.op") != "D", F.lit(True)).alias("alive"))
        is_last = F.col("client_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("m")) & (F.col("status") == "applied")
        cents = F.floor(100 * F.col("balance") + 0.5)
        cents = F.when(F.abs("balance") < 9e16, cents).cast("long")
        out = kept(found.join(last, is_last, "left").select("change_id", "client_id", "status", "batch", "missed", "city", cents.alias("cents"), F.coalesce("alive", F.lit(False)).alias("current")), "applied")
        stay.append(out)
    return out
