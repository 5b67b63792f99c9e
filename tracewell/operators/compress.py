"""Repeated similar spans of a trace become one aggregate span with statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.config import Compression
from tracewell.functions.matching import operation_type, statement
from tracewell.schema import ERROR

KEY = ("trace_id", "service_name", "operation_type", "normalized_statement", "parent_span_id")


def eligible(c: Compression) -> Column:
    """Not excluded, on the list if there is one, and not too long."""
    name, service = F.col("operation_name"), F.col("service_name")
    listed = reduce(lambda a, b: a | b, [name.contains(x) | service.contains(x) for x in c.only], F.lit(not c.only))
    return (~name.isin(c.exclude) if c.exclude else F.lit(True)) & listed & (F.col("duration_ms") <= c.max_span_secs * 1000)


def with_group_key(spans: DataFrame, c: Compression | None = None, normalised_type: bool = False) -> DataFrame:
    """Eligible spans with operation_type and normalized_statement."""
    c = c or Compression()
    return _keyed(spans.where(eligible(c)), c, normalised_type)


def _keyed(spans: DataFrame, c: Compression, normalised_type: bool = False) -> DataFrame:
    attrs = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
    out = spans.withColumn("normalized_statement", statement(F.col("operation_name"), attrs, c.patterns))
    name = F.col("normalized_statement") if normalised_type else F.col("operation_name")
    return out.withColumn("operation_type", operation_type(name, attrs, F.col("normalized_statement")))


def compressed_id() -> Column:
    """An id that depends on the group alone."""
    parts = [F.coalesce(F.col(k), F.lit("")) for k in KEY]
    return F.upper(F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 16))


def compress(spans: DataFrame, c: Compression | None = None) -> DataFrame:
    """One row per group of at least min_count spans whose starts lie within the window; a group is taken whole or not at all."""
    c = c or Compression()
    kept = _groups(with_group_key(spans, c)).where((F.col("span_count") >= c.min_count) & (F.col("last_timestamp_ms") - F.col("timestamp_ms") <= c.window_secs * 1000))
    return kept.withColumn("span_id", compressed_id()).withColumn("group_signature", F.col("normalized_statement"))


def _groups(keyed: DataFrame) -> DataFrame:
    error = F.col("status_code") == ERROR
    by_seq = F.array_sort(F.collect_list(F.struct("seq", "span_id")))
    return keyed.groupBy(*KEY).agg(
        F.min("timestamp_ms").alias("timestamp_ms"),
        F.max("timestamp_ms").alias("last_timestamp_ms"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(error).alias("error_count"),
        (F.sum("duration_ms") / F.count(F.lit(1))).alias("mean_duration_ms"),
        F.coalesce(F.min("duration_ms"), F.lit(0)).alias("min_duration_ms"),
        F.greatest(F.lit(0), F.max("duration_ms")).alias("max_duration_ms"),
        F.min_by("operation_name", "seq").alias("operation_name"),
        F.min_by("attributes", "seq").alias("attributes"),
        F.transform(by_seq, lambda x: x["span_id"]).alias("original_span_ids"),
    )


def marked(spans: DataFrame, c: Compression | None = None) -> DataFrame:
    """Spans with their group key, whether they go into a group, and whether a span of that id in the trace does.

    Every key begins with trace_id: where spans are dealt by it already, no further shuffle is needed.
    """
    c = c or Compression()
    keyed = _keyed(spans, c).withColumn("_fits", F.coalesce(eligible(c), F.lit(False)))
    group = W.partitionBy("trace_id", *KEY[1:], "_fits")
    close = F.max("timestamp_ms").over(group) - F.min("timestamp_ms").over(group) <= c.window_secs * 1000
    out = keyed.withColumn("in_group", F.col("_fits") & (F.count(F.lit(1)).over(group) >= c.min_count) & close).drop("_fits")
    return out.withColumn("absorbed", F.bool_or("in_group").over(W.partitionBy("trace_id", "span_id")))


def split(spans: DataFrame, c: Compression | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups as compress() gives them, spans that no group has absorbed), both from the same marked spans."""
    m = marked(spans, c)
    groups = _groups(m.where("in_group")).withColumn("span_id", compressed_id()).withColumn("group_signature", F.col("normalized_statement"))
    return groups, m.where("NOT absorbed").select(*spans.columns)


def residual(spans: DataFrame, compressed: DataFrame) -> DataFrame:
    """Spans that no group has absorbed, by id within the trace."""
    absorbed = compressed.select("trace_id", F.explode("original_span_ids").alias("span_id"))
    return spans.join(absorbed, ["trace_id", "span_id"], "left_anti")


def significant(max_ms: int = 60_000) -> Column:
    """Errors, or a long span, in a compressed group."""
    return (F.col("error_count") > 0) | (F.col("max_duration_ms") > max_ms)


def duration_percentiles(spans: DataFrame, c: Compression | None = None, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles and the population deviation of durations in each group."""
    groups = with_group_key(spans, c).groupBy(*KEY).agg(F.array_sort(F.collect_list("duration_ms")).alias("d"), F.stddev_pop("duration_ms").alias("stddev_ms"))
    n = F.size("d")
    picks = [F.element_at("d", F.least(n, F.floor(n * p / 100).cast("int") + 1)).alias(f"p{p}_ms") for p in percents]
    return groups.select(*KEY, n.cast("long").alias("span_count"), *picks, "stddev_ms")
