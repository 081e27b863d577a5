"""The board's life cycle as streams, with state in Spark's own state store.

Two stateful operators, each by `transformWithState`:

* `seen`: first and last sight and count of each posting. A posting not seen for so many days
  expires by an event-time timer; a sight that is older than that is late and counts not. Tasks
  combine their rows by posting before the shuffle, so a posting with very many sights is a few rows.
* `boards`: the postings of each employer over a stream of scans. What a scanned employer no
  longer shows closes, what shows again opens, what was not seen for so many days goes.
  An employer is dealt over SLICES keys by its postings' hash, each of which hears of every
  scan, so one employer with a third of all postings is not one key.

Each run takes what has arrived (availableNow) and ends. State is checkpointed with the
stream's offsets: a batch that fails is tried again from the state it began from, a stream
that is started again goes on from there, and the store drops old versions itself. The
state is read as a table by the store's own data source.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import MAX_AGE_DAYS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys over which an employer's postings are dealt.
SLICES = 8

#: In state and in tasks moments are microseconds, so no time zone has a say.
SIGHTS = "id string, first_us long, last_us long, n long"
POSTINGS = "id string, company string, first_us long, last_us long, closed boolean, closed_us long"
DAY_US = 86_400_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint folder, or where that is unset the warehouse; in local mode a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        root = "file://" + tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


@contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in the store that `transformWithState` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _moments(table: DataFrame, **names: str) -> DataFrame:
    """table with columns of microseconds as timestamps of other names."""
    return table.select(*[F.timestamp_micros(c).alias(names[c]) if c in names else F.col(c) for c in table.columns])


# --- sights -----------------------------------------------------------------


def sights(events: DataFrame) -> DataFrame:
    """id, first_us, last_us, n and last_seen of events (id, ts), combined in each task; a stream stays one."""

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            by = frame.groupby("id", sort=False)["us"]
            yield by.agg(first_us="min", last_us="max", n="count").reset_index()

    known = events.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where(F.col("id").isNotNull() & F.col("us").isNotNull())
    return known.mapInPandas(combine, SIGHTS).withColumn("last_seen", F.timestamp_micros("last_us"))


class Sights(StatefulProcessor):
    """Keeps first_seen, last_seen and n of a posting, until a timer at its last sight is due.

    The watermark runs max_days behind the latest sight, so a timer at the last sight is due when that is so old. A
    posting has one timer, which goes on to its last sight when it is due: a sight costs a read and a write of state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_us long, last_us long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        parts = [(r["first_us"], r["last_us"], r["n"]) for r in rows]
        known = self.seen.get()
        if known is not None:
            parts.append(tuple(known))
        first, last, n = min(p[0] for p in parts), max(p[1] for p in parts), sum(p[2] for p in parts)
        self.seen.update((first, last, n))
        if known is None:  # what is known has its timer
            self.handle.registerTimer(last // 1000 + 1)
        yield Row(id=key[0], first_us=first, last_us=last, n=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = self.seen.get()[1] // 1000 + 1
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def seen(events: DataFrame, max_days: int = MAX_AGE_DAYS) -> DataFrame:
    """The changes of a stream of events (id, ts): each posting that a micro-batch holds, as it stands then."""
    watched = sights(events).withWatermark("last_seen", f"{max_days} days")
    changes = watched.groupBy("id").transformWithState(statefulProcessor=Sights(), outputStructType=SIGHTS, outputMode="Update", timeMode="EventTime")
    return _moments(changes, first_us="first_seen", last_us="last_seen")


def run_seen(events: DataFrame, checkpoint: str, max_days: int = MAX_AGE_DAYS) -> None:
    """Takes what has arrived of a stream of events into the state at checkpoint."""
    with state_store(events.sparkSession):
        query = seen(events, max_days).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def seen_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state at checkpoint: id, first_seen, last_seen, n."""
    state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    return _moments(state.select("key.id", "value.first_us", "value.last_us", "value.n"), first_us="first_seen", last_us="last_seen")


def run_over(spark: SparkSession, path: str, max_days: int = MAX_AGE_DAYS) -> DataFrame:
    """The state after a stream has read every file of a path of events; a posting is a user's kind of event."""
    schema, checkpoint = spark.read.parquet(path).schema, scratch(spark, "seen")
    # A file source reads folders: a single file is given by a glob.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path + "*")
    run_seen(stream.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("id"), "ts"), checkpoint, max_days)
    plain = [F.col(c).cast(schema["ts"].dataType).alias(c) for c in ("first_seen", "last_seen")]
    return seen_table(spark, checkpoint).select("id", *plain, "n")


# --- boards -----------------------------------------------------------------


def told(scans: DataFrame, slices: int = SLICES) -> DataFrame:
    """A stream of scans (id, company, scanned_at) dealt to slices: company, slice, id, at.

    Every slice of an employer hears of its scan: a row without id, one of each task's rows for each employer. A
    scan that found nothing is such a row already (id is null).
    """
    dealt = scans.select("company", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), "id", F.unix_micros("scanned_at").alias("at"))

    def tell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heard = frame[["company", "at"]].drop_duplicates()
            yield frame[frame["id"].notna()].drop_duplicates()
            yield pd.concat([heard.assign(slice=k, id=None) for k in range(slices)])[["company", "slice", "id", "at"]]

    return dealt.where(F.col("company").isNotNull()).mapInPandas(tell, "company string, slice int, id string, at long")


class Boards(StatefulProcessor):
    """Keeps the postings of a slice of an employer over its scans."""

    def __init__(self, max_days: int):
        self.max_us = max_days * DAY_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.postings = handle.getMapState("postings", "id string", "first_us long, last_us long, closed boolean, closed_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        scans = pd.concat(list(rows), ignore_index=True)
        before = {k[0]: tuple(v) for k, v in self.postings.iterator()}
        known = dict(before)
        for now, scan in scans.groupby("at", sort=True):
            now, shown = int(now), set(scan["id"].dropna())
            known |= {i: (known[i][0] if i in known else now, now, False, None) for i in shown}
            known |= {i: (first, last, True, now) for i, (first, last, closed, _) in known.items() if i not in shown and not closed}
            known = {i: state for i, state in known.items() if now - state[1] <= self.max_us}
        changed = {i: state for i, state in known.items() if before.get(i) != state}
        for i, state in changed.items():
            self.postings.updateValue((i,), state)
        for i in before.keys() - known.keys():
            self.postings.removeKey((i,))
        if changed:
            columns = [part.split()[0] for part in POSTINGS.split(", ")]
            yield pd.DataFrame([(i, key[0], *state) for i, state in changed.items()], columns=columns).astype({"closed_us": "Int64"})

    def close(self) -> None:
        pass


def boards(scans: DataFrame, max_days: int = MAX_AGE_DAYS, slices: int = SLICES) -> DataFrame:
    """The changes of the board over a stream of scans (id, company, scanned_at); an id is one employer's."""
    keyed = told(scans, slices).groupBy("company", "slice")
    changes = keyed.transformWithStateInPandas(statefulProcessor=Boards(max_days), outputStructType=POSTINGS, outputMode="Update", timeMode="None")
    return _moments(changes, first_us="first_seen", last_us="last_seen", closed_us="closed_at")


def run_boards(scans: DataFrame, checkpoint: str, max_days: int = MAX_AGE_DAYS, slices: int = SLICES) -> None:
    """Takes the scans that have arrived into the board at checkpoint. A file of scans should hold a whole scan of its employers."""
    with state_store(scans.sparkSession):
        query = boards(scans, max_days, slices).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def board_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The board at checkpoint: id, company, first_seen, last_seen, closed, closed_at."""
    state = spark.read.format("statestore").option("stateVarName", "postings").option("flattenCollectionTypes", True).load(checkpoint)
    rows = state.select("user_map_key.id", "key.company", *[f"user_map_value.{c}" for c in ("first_us", "last_us", "closed", "closed_us")])
    return _moments(rows, first_us="first_seen", last_us="last_seen", closed_us="closed_at")


def watched_counts(events: DataFrame, late: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """Counts of event-time windows that drop what arrives later than `late` (an extra)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
