"""Structured Streaming twins of the history and sequence operators (S1..S6).

Sources are file streams over parquet folders; sinks and checkpoints live in
the shared checkpoint folder of the session. S3..S5 depend on the order of a
key's events, and files bring no order: ``transformWithState`` holds a key's
events in list state and hands them to the state machine in the order of
(time, id) once the watermark has passed them (an event-time timer per key).
The answer is therefore the same for every order of the files within the
watermark's delay. An event older than the watermark is late: it never reaches
the machine and comes out marked (S4, S5) or counted (S2, S3). A stream that
ends is closed by a marker in a folder of its own, which moves the watermark
past all events.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from suitewise.operators.features import KEY, NEVER_FAILED, RECENT_ROWS
from suitewise.operators.sequences import MAX_ATTEMPTS, PASSWORD_RESET, WRONG_PASSWORD, epoch_us
from suitewise.session import ensure_checkpoint_dir
from suitewise.sources.fixtures import test_history_from_events

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "1 day"
END = "9000-01-01 00:00:00"  # time of the closing marker, after any event

EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events*.parquet",
                 files_per_trigger: int = 1, closing: str | None = None) -> DataFrame:
    """Events arriving as parquet files in ``folder``, and in the ``closing`` folder the marker of their end."""
    def files(path, glob):
        return (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
                .option("maxFilesPerTrigger", files_per_trigger).parquet(path))

    events = files(folder, file_glob)
    return events.unionByName(files(closing, "*.parquet")) if closing else events


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def closing_folder(spark: SparkSession) -> str:
    """A folder for the marker that ends a stream; empty until ``run_to_table`` writes it."""
    path = _run_dir(spark, "closing")
    spark.createDataFrame([], EVENTS_SCHEMA).write.parquet(path)
    return path


def _close(spark: SparkSession, closing: str) -> None:
    marker = spark.range(1).select(*[(F.lit(END) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name)
                                     for f in spark.createDataFrame([], EVENTS_SCHEMA).schema])
    marker.write.mode("append").parquet(closing)


def _instant(ts: Column) -> Column:
    """The instant with the same UTC reading as a TIMESTAMP_NTZ (watermarks refuse NTZ)."""
    return F.timestamp_micros(epoch_us(ts))


def _watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Rows under a watermark on ``ts``. The condition on the marker names the watermarked column, so that it stays
    above the watermark: the marker moves it and goes no further."""
    return (df.withColumn("event_time", _instant(F.col(ts))).withWatermark("event_time", delay)
            .where(F.col("event_time") < _instant(F.lit(END).cast("timestamp_ntz"))))


def run_to_table(df: DataFrame, name: str, mode: str, key_cols: list[str] | None = None,
                 closing: str | None = None) -> DataFrame:
    """Run a stream until its input is drained (availableNow) and return what it wrote.

    append: rows as written. update / complete: every micro-batch writes its
    rows to a folder of its own (a replayed batch overwrites it); the answer
    keeps the newest row per key, by batch and, where a batch can bring several
    rows of a key, by ``_seq``. With ``closing`` the stream is then ended: the
    marker is written and a second run from the same checkpoint takes it.
    """
    spark = df.sparkSession
    base = _run_dir(spark, name)
    out, ckpt = f"{base}/out", f"{base}/checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/{batch_id}")

    def drain() -> None:
        w = df.writeStream.option("checkpointLocation", ckpt).outputMode(mode).trigger(availableNow=True)
        q = w.format("parquet").option("path", out).start() if mode == "append" else w.foreachBatch(write).start()
        q.awaitTermination()

    drain()
    if closing:
        _close(spark, closing)
        drain()
    read = spark.read.schema(_sink_schema(df, mode))
    if mode == "append":
        return read.parquet(out)
    result = read.option("recursiveFileLookup", "true").parquet(out)
    keys = key_cols or []
    order = [c for c in ("_batch", "_seq") if c in result.columns]
    values = [c for c in df.columns if c not in keys and c != "_seq"]
    latest = result.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("r"))
    return latest.select(*keys, "r.*")


def _sink_schema(df: DataFrame, mode: str) -> StructType:
    if mode == "append":
        return df.schema
    return StructType(list(df.schema.fields) + [StructField("_batch", LongType())])


# ------------------------------------------------------------------ S1, S2

def running_test_stats(history: DataFrame) -> DataFrame:
    """Per-test failure rate, mean time and change frequency, updated per batch."""
    g = history.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("passed")).alias("failures"),
        F.sum("execution_time").alias("sum_time"), F.count_if(F.col("lines_changed") > 0).alias("changed"))
    n = F.col("n").cast("double")
    return g.select(KEY, "n", (F.col("failures").cast("double") / n).alias("historical_failure_rate"),
                    (F.col("sum_time").cast("double") / n).alias("avg_execution_time"),
                    (F.col("changed").cast("double") / n).alias("code_change_frequency"))


def daily_failures(history: DataFrame, delay: str = DELAY) -> DataFrame:
    """Failures per test file and day; the watermark bounds the state, and rows behind it are dropped
    (``daily_failures_with_late`` counts them)."""
    h = _watermarked(history, "run_ts", delay)
    g = h.groupBy(F.window("event_time", "1 day").alias("w"), "test_file").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("passed")).alias("failures"))
    return g.select(_day(F.unix_micros(F.col("w.start"))).alias("day"), "test_file", "runs", "failures")


DAY_US = 86_400_000_000


def _day(us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(DAY_US)).cast("int")).cast("string")


def daily_failures_with_late(history: DataFrame, name: str, delay_days: int = 1) -> DataFrame:
    """S2 with a count of what comes too late: day, test_file, runs, failures, late_rows.

    Every micro-batch writes its share per day and file and its newest time to folders of its own (a replayed batch
    overwrites them). A row is late when the newest time of the batches before, less the delay, has passed its
    day's end; it is counted under its day and file as late and in no other number. The answer sums the shares.
    """
    spark = history.sparkSession
    base = _run_dir(spark, name)
    shares, newest = f"{base}/shares", f"{base}/newest"
    spark.createDataFrame([], "newest bigint").write.parquet(f"{newest}/-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        earlier = [f"{newest}/{i}" for i in range(-1, batch_id)]
        passed = spark.read.schema("newest bigint").parquet(*earlier).agg(F.max("newest").alias("passed"))
        rows = batch.select("test_file", "passed", epoch_us(F.col("run_ts")).alias("us")).withColumnRenamed("passed", "ok")
        closed = passed.select(F.col("passed") - F.lit(delay_days * DAY_US)).scalar()
        late = F.coalesce((F.floor(F.col("us") / DAY_US) + 1) * DAY_US <= closed, F.lit(False))
        share = rows.withColumn("late", late).groupBy(_day(F.col("us")).alias("day"), "test_file").agg(
            F.count_if(~F.col("late")).alias("runs"), F.count_if(~F.col("late") & ~F.col("ok")).alias("failures"),
            F.count_if("late").alias("late_rows"))
        share.write.mode("overwrite").parquet(f"{shares}/{batch_id}")
        rows.agg(F.max("us").alias("newest")).write.mode("overwrite").parquet(f"{newest}/{batch_id}")

    q = (history.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    schema = "day string, test_file string, runs bigint, failures bigint, late_rows bigint"
    return (spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(shares).groupBy("day", "test_file")
            .agg(*[F.sum(c).alias(c) for c in ("runs", "failures", "late_rows")]))


# ------------------------------------------------------------------ S3, S4, S5: state in event-time order

def _use_rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` needs a state store with several columns per key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Hands a key's events to ``step`` by (us, id) once the watermark has passed them.

    The events wait in list state, ``machine`` holds what ``step`` returns, and one timer per key stands at its
    earliest waiting event. Only the waiting events of one key are in memory at a time: as many as arrive within
    the watermark's delay. An element of the list holds up to ``CHUNK`` events as columns, for each element is
    written and read by itself, and each call to the state goes to the JVM and back.
    """

    CHUNK = 1_000
    events = "us array<bigint>, id array<bigint>, kind array<string>"
    machine: str
    start: tuple

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.events)
        self.state = handle.getValueState("machine", self.machine)
        self.timer = handle.getValueState("timer", "at bigint")

    def _await(self, first_us: int, at: int | None = None) -> None:
        """Set the key's timer, which stands at ``at``, to the first millisecond after ``first_us``."""
        due = first_us // 1000 + 1
        if at is not None:
            self.handle.deleteTimer(at)
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def _chunks(self, events: list[tuple]) -> list[tuple]:
        return [tuple(list(c) for c in zip(*events[i:i + self.CHUNK])) for i in range(0, len(events), self.CHUNK)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        waits, late = [], []
        for _, us, eid, kind in rows:
            (late if us < passed_us else waits).append((us, eid, kind))
        if waits:
            self.waiting.appendList(self._chunks(waits))
            first = min(e[0] for e in waits)
            timer = self.timer.get()
            if timer is None:
                self._await(first)
            elif first // 1000 + 1 < timer[0]:
                self._await(first, timer[0])
        if late:
            yield from self.too_late(key, sorted(late, key=lambda e: e[:2]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for chunk in self.waiting.get():
            for e in zip(*chunk):
                (due if e[0] < passed_us else later).append(e)
        due.sort(key=lambda e: e[:2])
        if later:
            self.waiting.put(self._chunks(later))
            self._await(min(e[0] for e in later))  # the expired timer is gone
        else:
            self.waiting.clear()
            self.timer.clear()
        yield from self.steps(key, due)

    def _machine(self) -> tuple:
        kept = self.state.get()
        return self.start if kept is None else tuple(kept)

    def too_late(self, key, events) -> Iterator[Row]:
        raise NotImplementedError

    def steps(self, key, events) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _in_order(events: DataFrame, key: str, ts: str, event_id: str, kind: Column, delay: str, processor: InOrder,
              schema: str, mode: str) -> DataFrame:
    """``events`` through the processor, one key at a time. The event time itself is not passed on: the
    processor, not Spark, tells which rows are late, so that none is dropped unseen."""
    _use_rocksdb(events.sparkSession)
    e = _watermarked(events, ts, delay).select(
        key, epoch_us(F.col(ts)).alias("us"), F.col(event_id).alias("id"), kind.cast("string").alias("kind"))
    return e.groupBy(key).transformWithState(processor, schema, mode, "EventTime")


class _Streak(InOrder):
    machine = "streak bigint, since bigint, late bigint, seq bigint"
    start = (0, -1, 0, 0)

    def _row(self, key, machine) -> Row:
        streak, since, late, seq = machine
        self.state.update(machine)
        return Row(**{KEY: key[0]}, failure_streak=min(streak, RECENT_ROWS),
                   time_since_last_failure=since if since >= 0 else NEVER_FAILED, late_rows=late, _seq=seq)

    def too_late(self, key, events):
        streak, since, late, seq = self._machine()
        if seq:  # a key of which nothing came in time has no streak to show yet
            yield self._row(key, (streak, since, late + len(events), seq + 1))
        else:
            self.state.update((streak, since, late + len(events), seq))

    def steps(self, key, events):
        streak, since, late, seq = self._machine()
        for _, _, kind in events:
            if kind == "failed":
                streak, since = streak + 1, 0
            else:
                streak, since = 0, since + 1 if since >= 0 else -1
        if events:
            yield self._row(key, (streak, since, late, seq + 1))


def live_streak(history: DataFrame, delay: str = DELAY) -> DataFrame:
    """S3: failure streak (capped at 10) and runs since the last failure, per test, as of the watermark;
    ``late_rows`` counts the rows that came behind it."""
    return _in_order(history, KEY, "run_ts", "exec_id", F.when(F.col("passed"), "passed").otherwise("failed"), delay,
                     _Streak(), f"{KEY} string, failure_streak bigint, time_since_last_failure bigint, "
                                "late_rows bigint, _seq bigint", "update")


class _Admission(InOrder):
    machine = "times array<bigint>"
    start = ([],)

    def __init__(self, max_requests: int, win_us: int):
        self.max_requests, self.win_us = max_requests, win_us

    def too_late(self, key, events):
        for _, eid, _ in events:
            yield Row(user_id=key[0], event_id=eid, admitted=None)

    def steps(self, key, events):
        admitted = list(self._machine()[0])
        first = 0  # admissions before it have left the window
        for us, eid, _ in events:
            while first < len(admitted) and us - admitted[first] >= self.win_us:
                first += 1
            ok = len(admitted) - first < self.max_requests
            if ok:
                admitted.append(us)
            yield Row(user_id=key[0], event_id=eid, admitted=ok)
        self.state.update((admitted[first:],))


def stream_rate_admit(events: DataFrame, max_requests: int, window_seconds: int, delay: str = DELAY) -> DataFrame:
    """Admission control with a per-user queue of admitted times; a late event's ``admitted`` is NULL."""
    return _in_order(events, "user_id", "ts", "event_id", F.lit(""), delay,
                     _Admission(max_requests, window_seconds * 1_000_000),
                     "user_id bigint, event_id bigint, admitted boolean", "append")


class _Lockout(InOrder):
    machine = "attempts bigint, active boolean"
    start = (0, True)

    def too_late(self, key, events):
        for _, eid, kind in events:
            yield Row(user_id=key[0], event_id=eid, event_type=kind, outcome="late")

    def steps(self, key, events):
        attempts, active = self._machine()
        for _, eid, kind in events:
            if kind == PASSWORD_RESET:
                attempts, active, out = 0, True, "reset"
            elif not active:
                out = "locked"
            elif kind == WRONG_PASSWORD:
                attempts += 1
                active = attempts < MAX_ATTEMPTS
                out = "wrong"
            else:
                attempts, out = 0, "success"
            yield Row(user_id=key[0], event_id=eid, event_type=kind, outcome=out)
        self.state.update((attempts, active))


def stream_lockout(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Login lockout with per-user (attempts, active) state; a late event has the outcome ``late``."""
    return _in_order(events, "user_id", "ts", "event_id", F.col("event_type"), delay, _Lockout(),
                     "user_id bigint, event_id bigint, event_type string, outcome string", "append")


# ------------------------------------------------------------------ S6

def score_batch(batch: DataFrame, batch_id: int, model, folder: str) -> None:
    """One micro-batch of S6. ``folder`` keeps ``history``, ``summaries`` and ``scores`` by batch.

    The batch's rows are summarised per test and merged into the summaries the batch before left, so the history
    is not read again; only tests of which a row comes out of order are summarised anew from their own history.
    A batch that runs again overwrites what it wrote, from the same summaries of the batch before.
    """
    from suitewise.operators.modeling import failure_probability
    from suitewise.operators.summaries import features_of, merge, overlapping, summarise

    spark = batch.sparkSession
    path = {name: f"{folder}/{name}" for name in ("history", "summaries", "scores")}
    own = f"_batch={batch_id}"
    test_history_from_events(batch).write.mode("overwrite").parquet(f"{path['history']}/{own}")
    new_rows = spark.read.parquet(f"{path['history']}/{own}")
    new = summarise(new_rows)
    if batch_id:
        old = spark.read.schema(new.schema).parquet(f"{path['summaries']}/_batch={batch_id - 1}")
        mixed = _kept(overlapping(old, new))
        now = merge(old, new.join(mixed, KEY, "left_anti"))
        if not mixed.isEmpty():
            history = spark.read.option("basePath", path["history"]).parquet(path["history"]).where(
                F.col("_batch") <= batch_id).drop("_batch")
            now = now.join(mixed, KEY, "left_anti").unionByName(summarise(history.join(mixed, KEY, "left_semi")))
    else:
        now = new
    now.write.mode("overwrite").parquet(f"{path['summaries']}/{own}")
    touched = spark.read.schema(new.schema).parquet(f"{path['summaries']}/{own}").join(
        new_rows.select(KEY).distinct(), KEY, "left_semi")
    scored = failure_probability(model, features_of(touched)).select(KEY, "failure_probability")
    scored.write.mode("overwrite").parquet(f"{path['scores']}/{own}")


def stream_scores(events: DataFrame, model, folder: str, checkpoint: str) -> None:
    """Per micro-batch, append new history rows, refresh the features of the touched tests and score them with
    a static model (``score_batch``)."""
    q = (events.writeStream.foreachBatch(lambda batch, batch_id: score_batch(batch, batch_id, model, folder))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def history_stream(spark: SparkSession, folder: str, file_glob: str = "events*.parquet",
                   closing: str | None = None) -> DataFrame:
    return test_history_from_events(event_stream(spark, folder, file_glob, closing=closing))
