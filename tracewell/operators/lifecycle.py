"""When a trace is finished: states as functions of its summary and of a given time, never of the wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import App


def latest(spans: DataFrame) -> int:
    """The time of the newest span: `now` of a batch."""
    return spans.agg(F.max("timestamp_ms")).first()[0] or 0


def newest(spans: DataFrame) -> Column:
    """The same as a subquery of the plan it is used in, so that no job runs beforehand."""
    return spans.agg(F.coalesce(F.max("timestamp_ms"), F.lit(0))).scalar()


def state(now_ms: int | Column, inactivity_ms: int, root_inactivity_ms: int = 30_000, max_age_ms: int = 3_600_000) -> Column:
    """force by age first, else ready by idleness (shorter once a root was seen), else active; all comparisons strict."""
    now = F.lit(now_ms)
    gap = F.when(F.col("root_span_id").isNotNull(), F.lit(root_inactivity_ms)).otherwise(F.lit(inactivity_ms))
    return (
        F.when(now - F.col("min_timestamp_ms") > max_age_ms, "force")
        .when(now - F.col("max_timestamp_ms") > gap, "ready")
        .otherwise("active")
    )


def with_state(summary: DataFrame, now_ms: int | Column, app: App | None = None, column: str = "state") -> DataFrame:
    app = app or App()
    return summary.withColumn(column, state(now_ms, app.trace_inactivity_secs * 1000, app.root_inactivity_secs * 1000, app.max_trace_duration_secs * 1000))


def ready_traces(summary: DataFrame, now_ms: int | Column, app: App | None = None) -> DataFrame:
    return with_state(summary, now_ms, app).where("state <> 'active'").select("trace_id", "state")


def ready_by_recency(summary: DataFrame, now_ms: int, inactivity_ms: int = 60_000, processing: DataFrame | None = None) -> DataFrame:
    """Columnar mode: idle by event time, and not being processed; no root shortcut and no age cap."""
    out = summary.where(F.lit(now_ms) - F.col("max_timestamp_ms") > inactivity_ms).select("trace_id")
    return out if processing is None else out.join(processing.select("trace_id"), "trace_id", "left_anti")


def closed_traces(summary: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    return summary.where(F.lit(now_ms) - F.col("max_timestamp_ms") > window_ms).select("trace_id")


def mark_phase(summary: DataFrame, now_ms: int, window_ms: int, max_idle_ms: int, root_window_ms: int = 30_000) -> DataFrame:
    """Older buffer: ready by idleness, else force by a longer idleness (not by age)."""
    idle = F.lit(now_ms) - F.col("max_timestamp_ms")
    gap = F.when(F.col("root_span_id").isNotNull(), F.lit(root_window_ms)).otherwise(F.lit(window_ms))
    return summary.withColumn("mark", F.when(idle > gap, "ready").when(idle > max_idle_ms, "force").otherwise("active"))


def mark_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count_if(F.col("mark") == "ready").alias("ready"), F.count_if(F.col("mark") == "force").alias("force"))


def large_traces(summary: DataFrame, min_spans: int, limit: int) -> DataFrame:
    """At most limit traces of min_spans or more, the largest first."""
    return summary.where(F.col("span_count") >= min_spans).orderBy(F.desc("span_count"), "trace_id").limit(limit).select("trace_id", "span_count")


def for_investigation(summary: DataFrame, now_ms: int, max_age_ms: int) -> DataFrame:
    """Traces that have run for too long since their first span."""
    return summary.where((F.col("min_timestamp_ms") > 0) & (F.lit(now_ms) - F.col("min_timestamp_ms") > max_age_ms)).select("trace_id", (F.lit(now_ms) - F.col("min_timestamp_ms")).alias("age_ms"))


def mark_investigation(states: DataFrame, traces: DataFrame, reason: str, now_ms: int) -> DataFrame:
    """states (trace_id, status, ...) with the listed traces set to investigation."""
    hit = traces.select("trace_id", F.lit(True).alias("_hit"))
    out = states.join(hit, "trace_id", "left")
    return out.withColumn("status", F.when(F.col("_hit"), "investigation").otherwise(F.col("status"))).withColumn("reason", F.when(F.col("_hit"), reason)).withColumn("since_ms", F.when(F.col("_hit"), F.lit(now_ms))).drop("_hit")


def garbage(states: DataFrame, now_ms: int, stuck_ms: int, max_age_ms: int) -> DataFrame:
    """Why a trace is collected: stuck in processing or investigation, or expired while active; null if it stays.

    states: trace_id, status, last_activity_ms, since_ms.
    """
    idle, since = F.lit(now_ms) - F.col("last_activity_ms"), F.lit(now_ms) - F.col("since_ms")
    why = (
        F.when((F.col("status") == "processing") & (idle > stuck_ms), "stuck")
        .when((F.col("status") == "investigation") & (since > stuck_ms), "stuck")
        .when((F.col("status") == "active") & (idle > max_age_ms), "expired")
    )
    return states.withColumn("garbage", why)


def status_counts(states: DataFrame) -> DataFrame:
    names = ("active", "ready", "force", "processing", "investigation")
    return states.agg(F.count(F.lit(1)).alias("traces"), *[F.count_if(F.col("status") == s).alias(s) for s in names])
