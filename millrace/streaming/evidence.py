"""Streams of network evidence (N18-N20, R12): bounded state under watermarks."""

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions.staging import quoted

#: The store that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What the latest filled phase of an event says.
LATEST = ("detail", "decision", "bytes_sent")


class MergePhases(StatefulProcessor):
    """One event's phases: what is known of it stays in state until a timer says that no more of it is waited for.

    State holds, beside the merged values, the moment that each of them is from (in columns at_<name>). Moments are
    microseconds."""

    def __init__(self, columns: Sequence[str], state: str, closed: timedelta, open_: timedelta):
        self.columns, self.state = tuple(columns), state
        self.closed, self.open = (int(wait.total_seconds() * 1_000_000) for wait in (closed, open_))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("event", self.state)

    def _row(self, key: tuple) -> Row:
        known = self.known.get()
        names = ("event_id", "started_at", "ended_at", *self.columns)
        return Row(**dict(zip(names, (*key, *known[: 2 + len(self.columns)]), strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        k = len(self.columns)
        start, end, *rest = self.known.get() if self.known.exists() else (None, None, *[None] * (2 * k))
        values, since = rest[:k], rest[k:]
        for row in rows:
            at = row["_us"]
            if row["phase"] == "open":
                start = at if start is None else min(start, at)
            elif row["phase"] == "close":
                end = at if end is None else max(end, at)
            for i, c in enumerate(self.columns):
                if row[c] is not None and (since[i] is None or at >= since[i]):
                    values[i], since[i] = row[c], at
        self.known.update((start, end, *values, *since))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = end + self.closed if end is not None else (at if start is None else start) + self.open
        self.handle.registerTimer(max(last // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        out = self._row(key)
        self.known.clear()
        yield out

    def close(self) -> None:
        pass


def merge_stream(rows: DataFrame, late: str = "1 hour", closed: timedelta = timedelta(hours=1), longest: timedelta = timedelta(days=7)) -> DataFrame:
    """Opened and closed events merged, one row each, with the decision and bytes of the latest filled phase.

    Keyed state with timers: an event whose close was seen comes out once the watermark has passed the close by `closed`;
    one that is only open once it has passed the opening by `longest`. However long an event lasts within that, it is
    one row; a phase that comes after its event is out comes out as a row of its own, without the other phase. Phases
    later than the watermark (`late`) are dropped. State is a row per event that is waited for. Null events are one
    group. The session must use the store of STATE_STORE.
    """
    columns = [c for c in LATEST if c in rows.columns]
    kind = {f.name: f.dataType for f in rows.schema}
    moments = [StructField(c, LongType()) for c in ("started_at", "ended_at")]
    values = [StructField(c, kind[c]) for c in columns]
    state = StructType([*moments, *values, *[StructField(f"at_{c}", LongType()) for c in columns]])
    out = StructType([StructField("event_id", kind["event_id"]), *moments, *values])
    stamped = rows.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).withColumn("_us", F.unix_micros("at"))
    merged = stamped.groupBy("event_id").transformWithState(MergePhases(columns, state, closed, longest), out, "Append", "EventTime")
    return merged.withColumns({c: F.timestamp_micros(c) for c in ("started_at", "ended_at")})


def dedupe_stream(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Repeats of a session's fingerprint within the watermark go; a null fingerprint is made unique by its event."""
    key = F.coalesce(F.col("fingerprint"), F.concat(F.lit("#"), F.col("event_id").cast("string")))
    return rows.withWatermark("started_at", late).withColumn("_key", key).dropDuplicatesWithinWatermark(["session_id", "_key"]).drop("_key")


def live_totals(rows: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Totals per session and window over a growing log, for update mode: state has the windows that the watermark
    has not passed."""
    return rows.withWatermark("started_at", late).groupBy(F.window("started_at", window), "session_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("decision") == "allowed").alias("allowed"), F.sum("bytes_sent").alias("bytes_sent")
    )


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over all that is there into a table of this name and end."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(name)
    query.awaitTermination()
    return query


def upsert(stream: DataFrame, path: str, log: str) -> StreamingQuery:
    """Run a stream of totals in update mode over all that is there and end. Every batch writes the rows that changed
    as a version of its own under path, numbered by its epoch: a batch that is run again writes the same version."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_version={epoch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """Of each key the row of the newest version under path; no version yet gives no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    versions = spark.read.schema(StructType([*schema, StructField("_version", LongType())])).option("basePath", path).parquet(path)
    row = F.struct(*[quoted(c) for c in versions.columns if c != "_version"])
    return versions.groupBy(*keys).agg(F.max_by(row, "_version").alias("_row")).select("_row.*")


def run_to_files(stream: DataFrame, path: str, keys: Sequence[str] = ("window", "session_id")) -> DataFrame:
    """Upsert a stream of totals over all that is there under path, and the current totals. Nothing is collected."""
    upsert(stream, f"{path}/versions", f"{path}/log")
    return current(stream.sparkSession, f"{path}/versions", stream.schema, keys)


def compact(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], to: str) -> DataFrame:
    """Write the current rows as version -1 under another path, which later versions can follow."""
    current(spark, path, schema, keys).write.mode("overwrite").parquet(f"{to}/_version=-1")
    return current(spark, to, schema, keys)


def gated(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], gate: Callable[[DataFrame, DataFrame], None], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is transformed, must pass the gate, and only then reaches the sink."""

    def handle(batch: DataFrame, epoch: int) -> None:
        out = transform(batch)
        gate(batch, out)
        sink(out, epoch)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
