"""How each outside source answers: over the last 24 hours in batch, over sliding windows as a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

HOURS = 24
MIN_ATTEMPTS = 5

# Each source, its role and the data need it answers for.
SOURCES = (
    ("sec", "primary", "13F data"),
    ("sec-xbrl", "primary", "company cash-flow data"),
    ("openfigi", "primary", "tickers"),
    ("sec-ftd", "fallback", "tickers"),
    ("stooq", "primary", "daily prices"),
    ("polygon", "fallback", "daily prices"),
    ("tiingo", "fallback", "daily prices"),
)


def known_sources(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{s}', '{r}', '{n}')" for s, r, n in SOURCES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS s(source, role, need)")


def _outcomes() -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "failed", "throttled")]


def unreliable() -> Column:
    """Five attempts or more, and under half of them answered."""
    attempts = F.col("ok") + F.col("failed") + F.col("throttled")
    return (attempts >= MIN_ATTEMPTS) & (F.col("ok") * 2 < attempts)


def source_reliability(events: DataFrame, now: Column, newest: int | None = None) -> DataFrame:
    """Every source's outcomes in the 24 hours up to now (only its `newest` ones, if given), with the last
    answer and the last error ever seen (`events` has source, at, outcome, error)."""
    valid = events.where(F.col("outcome").isin("ok", "failed", "throttled") & (F.col("at") <= now))
    recent = valid.where(F.col("at") > now - F.expr(f"INTERVAL {HOURS} HOURS"))
    if newest is not None:
        newest_first = Window.partitionBy("source").orderBy(F.col("at").desc(), F.col("outcome"))
        recent = recent.withColumn("_place", F.row_number().over(newest_first)).where(F.col("_place") <= newest)
    counts = recent.groupBy("source").agg(*_outcomes())
    ok = F.col("outcome") == "ok"
    last = valid.groupBy("source").agg(
        F.max(F.when(ok, F.col("at"))).alias("last_ok"),
        F.max_by(F.when(~ok, F.col("error")), F.when(~ok, F.struct("at", "error"))).alias("last_error"),
    )
    known = F.broadcast(known_sources(events.sparkSession))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        known.join(counts, "source", "left")
        .select("source", "role", "need", zero("ok"), zero("failed"), zero("throttled"))
        .join(last, "source", "left")
        .withColumn("unreliable", unreliable())
    )


def uncovered_needs(reliability: DataFrame) -> DataFrame:
    """Data needs, and whether every source of theirs is unreliable."""
    return reliability.groupBy("need").agg(F.bool_and("unreliable").alias("uncovered"))


def reliability_stream(events: DataFrame, slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Outcomes per source over sliding (or, with slide of 24 hours, tumbling) windows of a stream."""
    return (
        events.withWatermark("at", late)
        .groupBy(F.window("at", f"{HOURS} hours", slide).alias("w"), "source")
        .agg(*_outcomes())
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source", "ok", "failed",
            "throttled", unreliable().alias("unreliable"),
        )
    )


#: The store that keyed state with timers needs; set it on the session before the stream starts.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HOUR = 3_600_000_000
_HELD = "ok long, failed long, throttled long"
_LAST = "last_ok long, error_at long, error string"
REPORT = "source string, as_of timestamp, ok long, failed long, throttled long, last_ok timestamp, last_error string"


class _Health(StatefulProcessor):
    """A source's closed hours of the last day, and its last answer and last error of all time. Times are
    microseconds; an hour goes by its end and holds what came after its start up to and with its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "finish long", _HELD)
        self.last = handle.getValueState("last", _LAST)
        self.done = handle.getValueState("done", "finish long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last_ok, error_at, error = self.last.get() if self.last.exists() else (None, None, None)
        first = None
        for row in rows:
            # An hour closes once, so nothing is added to it later.
            self.hours.updateValue((row.finish,), (row.ok, row.failed, row.throttled))
            first = row.finish if first is None else min(first, row.finish)
            last_ok = max((t for t in (last_ok, row.last_ok) if t is not None), default=None)
            if row.error_at is not None and (error_at is None or (row.error_at, row.error or "") > (error_at, error or "")):
                error_at, error = row.error_at, row.error
        self.last.update((last_ok, error_at, error))
        if not self.done.exists() and first is not None:
            self.done.update((first - _HOUR,))
        yield from self._reports(key[0], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._reports(key[0], timerValues)

    def _reports(self, source: str, timerValues) -> Iterator[Row]:
        """The report of the last hour that the watermark closed, if none was given for it."""
        closed = timerValues.getCurrentWatermarkInMs() * 1000 // _HOUR * _HOUR
        if closed <= self.done.get()[0]:
            self._wait(closed)
            return
        held = {k[0]: v for k, v in self.hours.iterator()}
        since = closed - HOURS * _HOUR
        counts = [sum(v[i] for finish, v in held.items() if since < finish <= closed) for i in range(3)]
        for finish in held:
            if finish <= since + _HOUR:
                self.hours.removeKey((finish,))
        self.done.update((closed,))
        last_ok, _, error = self.last.get()
        yield Row(source=source, as_of=closed, ok=counts[0], failed=counts[1], throttled=counts[2], last_ok=last_ok, last_error=error)
        if any(counts):  # a silent source is followed until nothing counts any more
            self._wait(closed)

    def _wait(self, closed: int) -> None:
        self.handle.registerTimer((closed + _HOUR) // 1000)

    def close(self) -> None:
        pass


def reliability_state_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Every source's outcomes over the 24 hours up to each full hour that the watermark has passed, with its last
    answer and last error however long ago: the batch result of that hour, kept up as a stream.

    Events are first counted by hour and source (partial aggregates, so a busy source stays spread); a keyed state
    then holds the 24 closed hours of a source and what it last said. A timer gives the report of a source that has
    fallen silent, until its counts are zero. Of hours that close together only the last is reported. The session
    needs `STATE_STORE` (`start_reports` sets it)."""
    ok = F.col("outcome") == "ok"
    at = F.unix_micros("at")
    hourly = (
        events.where(F.col("outcome").isin("ok", "failed", "throttled"))
        .withColumn("tick", F.col("at") - F.expr("INTERVAL 1 MICROSECOND"))
        .withWatermark("tick", late)
        .groupBy(F.window("tick", "1 hour").alias("w"), "source")
        .agg(
            *_outcomes(), F.max(F.when(ok, at)).alias("last_ok"), F.max(F.when(~ok, at)).alias("error_at"),
            F.max_by(F.when(~ok, F.col("error")), F.when(~ok, F.struct(at, "error"))).alias("error"),
        )
        .select("source", F.unix_micros("w.end").alias("finish"), F.window_time("w").alias("closed_at"), "ok", "failed", "throttled", "last_ok", "error_at", "error")
    )
    told = REPORT.replace("timestamp", "long")
    reports = hourly.groupBy("source").transformWithState(_Health(), told, "Append", "EventTime")
    return reports.select(
        "source", F.timestamp_micros("as_of").alias("as_of"), "ok", "failed", "throttled", F.timestamp_micros("last_ok").alias("last_ok"),
        "last_error", unreliable().alias("unreliable"),
    )


def start_reports(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add the reports of what has arrived since the last run to the Parquet folder `path`, and stop."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = reliability_state_stream(events).writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_reports(reports: DataFrame) -> DataFrame:
    """Every known source with its newest report; zero counts where there is none."""
    names = [c for c in reports.columns if c not in ("source", "as_of")]
    newest = reports.groupBy("source").agg(F.max_by(F.struct(*names), "as_of").alias("r")).select("source", "r.*")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("ok", "failed", "throttled")]
    known = F.broadcast(known_sources(reports.sparkSession)).join(newest, "source", "left")
    return known.select("source", "role", "need", *zero, "last_ok", "last_error", F.coalesce("unreliable", F.lit(False)).alias("unreliable"))
