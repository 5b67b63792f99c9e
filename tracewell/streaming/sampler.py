"""The sampler on a stream.

Each micro-batch joins what was left pending with its own spans, and the batch plan decides on that, with an explicit
time. What is decided is exported, remembered with an expiry, and forgotten: the next batch reads only what is still
pending, so the cost of a batch follows the open traces, not the age of the stream. State lies in folders numbered by
batch, each written whole from those of the batch before, which stay until the next one is done: a restart repeats a
batch under its number, and replaces what the first try wrote. Traces are closed by event time (the newest span seen),
so replays decide alike.

session_stream() is the other form: one keyed state per trace with timers, for sources where the staging table
isn't wanted.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.config import Config
from tracewell.operators.decide import decide, remember_exported
from tracewell.operators.export import batches, export_rows
from tracewell.operators.rules import Rule
from tracewell.schema import SPAN


def span_stream(spark: SparkSession, path: str, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Spans from files as they arrive."""
    reader = spark.readStream.schema(SPAN).format(kind)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


class TokenBucket:
    """Rate limit for callers of the Python interface; streams are limited at their source instead, without loss."""

    def __init__(self, rate: float = 10_000, capacity: float = 5_000, clock: Callable[[], float] = time.monotonic):
        self.rate, self.capacity, self.clock = rate, capacity, clock
        self.tokens, self.at = float(capacity), clock()

    def take(self) -> float:
        """0 if a token was there, else the seconds until one will be."""
        now = self.clock()
        self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rate), now
        if self.tokens >= 1:
            self.tokens -= 1
            return 0.0
        return (1 - self.tokens) / self.rate


_DECIDED = "trace_id string, decision string, span_count long, decided_at_ms long, batch long"
_REMEMBERED = "trace_id string, expires_at_ms long"


@dataclass
class Sampler:
    """State in folders under root: pending spans, remembered exports and the clock of the last batches; all decisions, and what was exported."""

    root: str
    config: Config = field(default_factory=Config)
    rules: Callable[[], Sequence[Rule]] = tuple
    writer: object | None = None

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _folder(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _batches(self, spark: SparkSession, name: str) -> list[int]:
        """Numbers of the batches whose folders are complete."""
        fs, path = self._folder(spark, name)
        if not fs.exists(path):
            return []
        found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(path)]
        done = [n for n, p in found if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done)

    def _state(self, spark: SparkSession, name: str, batch: int | None, schema) -> DataFrame:
        if batch is None:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self._path(name)}/batch={batch}")

    def process(self, spans: DataFrame, batch: int) -> None:
        """One micro-batch. The clock is written last: a batch counts as done once it has one."""
        spark = spans.sparkSession
        before = max((b for b in self._batches(spark, "clock") if b < batch), default=None)
        pending = self._state(spark, "pending", before, SPAN).unionByName(spans.select(*SPAN.names))
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self._path(name)}/batch={batch}")
        clock = self._state(spark, "clock", before, "now_ms long").unionByName(spans.select(F.col("timestamp_ms").alias("now_ms"))).agg(F.max("now_ms").alias("now_ms"))
        now = clock.first()[0]
        if now is None:
            return
        # A span that comes after its trace was decided on opens the trace anew, without what was decided before.
        known = self._state(spark, "remembered", before, _REMEMBERED).where(F.col("expires_at_ms") > now)
        # Written once, since the decisions are read for the export, the log, the memory and what stays.
        decided = decide(pending, now, self.config, self.rules(), known.select("trace_id"))
        put(decided.select("trace_id", "decision", "span_count", F.lit(now).alias("decided_at_ms")), "verdicts")
        verdicts = self._state(spark, "verdicts", batch, "trace_id string, decision string, span_count long, decided_at_ms long")
        kept = verdicts.where("decision = 'keep'").select("trace_id")
        rows = batches(export_rows(pending.join(kept, "trace_id", "left_semi"), self.config.compression), size=self.config.export.batch_size, shards=self.config.export.shards)
        done = verdicts.where("decision <> 'pending'")
        if self.writer is None:
            put(rows, "exported")
        else:
            # What could not be sent stays pending, and is tried again with the next batch.
            put(self.writer.write(rows, batch).groupBy("trace_id").agg(F.bool_and("sent").alias("sent")), "sent")
            failed = self._state(spark, "sent", batch, "trace_id string, sent boolean").where("NOT sent").select("trace_id")
            done = done.join(failed, "trace_id", "left_anti")
        put(done, "decided")
        done = self._state(spark, "decided", batch, "trace_id string, decision string, span_count long, decided_at_ms long")
        put(pending.join(done.select("trace_id"), "trace_id", "left_anti"), "pending")
        put(known.unionByName(remember_exported(done.where("decision = 'keep'"), now, self.config.dedup.ttl_secs)), "remembered")
        put(spark.createDataFrame([(now,)], "now_ms long"), "clock")
        self._forget(spark, batch, before)

    def _forget(self, spark: SparkSession, batch: int, before: int | None) -> None:
        """Remove the state of all batches but this one and the one it was made from."""
        for name in ("pending", "remembered", "verdicts", "sent", "clock"):
            fs, _ = self._folder(spark, name)
            for b in self._batches(spark, name):
                if b < batch and b != before:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/batch={b}"), True)

    def start(self, stream: DataFrame, **trigger: object) -> StreamingQuery:
        query = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", self._path("checkpoint"))
        return query.trigger(**(trigger or {"availableNow": True})).start()

    def pending(self, spark: SparkSession) -> DataFrame:
        """Spans that no decision has been made on."""
        return self._state(spark, "pending", max(self._batches(spark, "clock"), default=None), SPAN)

    def decisions(self, spark: SparkSession) -> DataFrame:
        """All decisions so far, with their batch."""
        fs, path = self._folder(spark, "decided")
        return spark.read.schema(_DECIDED).parquet(self._path("decided")) if fs.exists(path) else spark.createDataFrame([], _DECIDED)


SESSION = "trace_id string, span_count long, error_count long, max_duration_ms long, min_timestamp_ms long, max_timestamp_ms long, has_root boolean, reason string"
_STATE = "span_count long, error_count long, max_duration_ms long, min_timestamp_ms long, max_timestamp_ms long, has_root boolean"


def session_stream(spans: DataFrame, inactivity_ms: int = 300_000, root_inactivity_ms: int = 30_000, max_age_ms: int = 3_600_000, late_ms: int = 86_400_000) -> DataFrame:
    """A row for each trace when it closes: too old by now, else idle (sooner once a root was seen); now is the newest span's time.

    The gap depends on what the session holds, so this is keyed state with timers, not session_window. Traces close
    by now, not late_ms after it: a span that comes up to late_ms late opens its trace anew, and gives a further row.
    Spans that come later still are left out, by Spark's rule for watermarks.
    """

    def close(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _STATE.split(", ")]
        if state.hasTimedOut:
            seen = dict(zip(names, state.get, strict=True))
            old = state.getCurrentWatermarkMs() - seen["min_timestamp_ms"] > max_age_ms
            state.remove()
            yield pd.DataFrame([{"trace_id": key[0], **seen, "reason": "force" if old else "ready"}])
            return
        n, errors, longest, first, last, root = state.get if state.exists else (0, 0, 0, None, 0, False)
        for pdf in parts:
            n += len(pdf)
            errors += int((pdf["status_code"] == 2).sum())
            longest = max(longest, int(pdf["duration_ms"].max()))
            low, high = int(pdf["timestamp_ms"].min()), int(pdf["timestamp_ms"].max())
            first, last = low if first is None else min(first, low), max(last, high)
            root = root or bool(pdf["parent_span_id"].isna().any())
        state.update((n, errors, longest, first, last, root))
        due = min(last + (root_inactivity_ms if root else inactivity_ms), first + max_age_ms)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    # The watermark is late_ms behind a time that is late_ms ahead: it stands at the newest span.
    ahead = F.timestamp_millis(F.col("timestamp_ms") + F.lit(late_ms))
    timed = spans.withColumn("event_time", ahead).withWatermark("event_time", f"{late_ms} milliseconds")
    return timed.groupBy("trace_id").applyInPandasWithState(close, SESSION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
