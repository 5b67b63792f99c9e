"""Trace summaries and the trace-level interface of a store of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.schema import ERROR

#: Bytes that a span is taken to need in memory, in round numbers; a documented constant, not a measurement.
SPAN_BYTES = 1000


def summarize(spans: DataFrame, *extra: Column) -> DataFrame:
    """One row per trace, from one aggregation; further aggregates may ride along on the same shuffle.

    What depends on arrival follows seq: the first service, the last span without a parent.
    """
    error = F.col("status_code") == ERROR
    root = F.max_by(F.when(F.col("parent_span_id").isNull(), F.col("span_id")), F.when(F.col("parent_span_id").isNull(), F.col("seq")))
    return spans.groupBy("trace_id").agg(
        F.min_by("service_name", "seq").alias("service_name"),
        F.count(F.lit(1)).alias("span_count"),
        F.bool_or(error).alias("has_error"),
        F.greatest(F.lit(0).cast("long"), F.max("duration_ms")).alias("max_duration_ms"),
        F.min("timestamp_ms").alias("min_timestamp_ms"),
        F.greatest(F.lit(0).cast("long"), F.max("timestamp_ms")).alias("max_timestamp_ms"),
        F.array_sort(F.collect_set("operation_name")).alias("operations"),
        F.count(F.lit(1)).alias("total_spans"),
        F.count_if(error).alias("error_count"),
        root.alias("root_span_id"),
        *extra,
    )


def summarize_metadata(spans: DataFrame) -> DataFrame:
    """The four-column scan: counts, errors and times only; the other fields are empty and error_count is 0 or 1."""
    got = spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.bool_or(F.col("status_code") == ERROR).alias("has_error"),
        F.greatest(F.lit(0).cast("long"), F.max("duration_ms")).alias("max_duration_ms"),
        F.min("timestamp_ms").alias("min_timestamp_ms"),
        F.greatest(F.lit(0).cast("long"), F.max("timestamp_ms")).alias("max_timestamp_ms"),
    )
    return got.select(
        "trace_id", F.lit("").alias("service_name"), "span_count", "has_error", "max_duration_ms", "min_timestamp_ms", "max_timestamp_ms",
        F.array().cast("array<string>").alias("operations"), F.col("span_count").alias("total_spans"), F.col("has_error").cast("long").alias("error_count"), F.lit(None).cast("string").alias("root_span_id"),
    )


def trace_spans(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of one trace; the predicate reaches the scan."""
    return spans.where(F.col("trace_id") == trace_id)


def spans_of(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """All spans of the listed traces by one semi join, not a scan for each."""
    return spans.join(traces.select("trace_id"), "trace_id", "left_semi")


def without(frame: DataFrame, traces: DataFrame) -> DataFrame:
    """frame without the listed traces."""
    return frame.join(traces.select("trace_id"), "trace_id", "left_anti")


def remove_traces(spans: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the numbers of spans and traces removed)."""
    gone = spans_of(spans, traces)
    return without(spans, traces), gone.agg(F.count(F.lit(1)).alias("removed_spans"), F.count_distinct("trace_id").alias("removed_traces"))


def trace_ids(spans: DataFrame) -> DataFrame:
    return spans.select("trace_id").distinct()


def store_stats(spans: DataFrame, backend: str = "table") -> DataFrame:
    return spans.agg(F.count(F.lit(1)).alias("span_count"), F.count_distinct("trace_id").alias("trace_count")).select(
        "span_count", "trace_count", (F.col("span_count") * SPAN_BYTES).alias("memory_bytes"), F.lit(backend).alias("backend")
    )


def admit(spans: DataFrame, max_traces: int, max_spans: int) -> DataFrame:
    """The spans that caps let in, by arrival: those of the first max_traces traces, and of them the first max_spans.

    Both ranks go through top-k plans: no window runs over all rows in one partition.
    """
    first = spans.groupBy("trace_id").agg(F.min("seq").alias("first_seq")).orderBy("first_seq", "trace_id").limit(max_traces)
    return spans.join(first.select("trace_id"), "trace_id", "left_semi").orderBy("seq").limit(max_spans)


def ingest_counts(spans: DataFrame, max_traces: int, max_spans: int) -> DataFrame:
    """One row: how many spans the caps let in, and how many they refuse."""
    all_ = spans.agg(F.count(F.lit(1)).alias("n"))
    kept = admit(spans, max_traces, max_spans).agg(F.count(F.lit(1)).alias("added"))
    return kept.join(F.broadcast(all_)).select("added", (F.col("n") - F.col("added")).alias("dropped"))


def take_chunk(spans: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(first n spans of each trace by arrival, the rest)."""
    ranked = spans.withColumn("_rank", F.row_number().over(W.partitionBy("trace_id").orderBy("seq")))
    return ranked.where(F.col("_rank") <= n).drop("_rank"), ranked.where(F.col("_rank") > n).drop("_rank")
