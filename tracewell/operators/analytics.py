"""Canned reports, ad-hoc SQL over spans, and results as text."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.schema import ERROR


def slowest_traces(spans: DataFrame, limit: int = 20) -> DataFrame:
    """Traces by their longest span."""
    got = spans.groupBy("trace_id").agg(F.max("duration_ms").alias("max_duration_ms"), F.count(F.lit(1)).alias("span_count"))
    return got.orderBy(F.desc("max_duration_ms"), "trace_id").limit(limit)


def error_traces(spans: DataFrame, limit: int = 20) -> DataFrame:
    """The newest error spans."""
    got = spans.where(F.col("status_code") == ERROR).select("seq", "trace_id", "span_id", "service_name", "operation_name", "timestamp_ms", "duration_ms")
    return got.orderBy(F.desc("timestamp_ms"), F.desc("seq")).limit(limit)


def service_stats(spans: DataFrame) -> DataFrame:
    """Spans, traces, durations and errors of each service, the busiest first."""
    got = spans.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("span_count"), F.count_distinct("trace_id").alias("trace_count"), F.avg("duration_ms").alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"), F.sum(F.when(F.col("status_code") == ERROR, 1).otherwise(0)).alias("error_count"),
    )
    return got.orderBy(F.desc("span_count"), "service_name")


#: Commands that only look: names of Spark's plan nodes begin with these.
_LOOKS = ("Describe", "Show", "Explain")
#: Functions that run any Java method.
_REFLECTS = re.compile(r"\b(try_reflect|reflect|java_method)\s*\(", re.I)


def _nodes(plan: object) -> Iterator[object]:
    """All nodes of a parsed plan, those of its WITH clause included."""
    yield plan
    for inner in (plan.children(), plan.innerChildren()):
        for k in range(inner.size()):
            yield from _nodes(inner.apply(k))


def check_read_only(spark: SparkSession, text: str) -> None:
    """Raise ValueError unless text is a query that changes nothing; it is parsed, and nothing of it is executed."""
    jvm = spark._jvm
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    writes = [jvm.java.lang.Class.forName(logical + c, True, jvm.java.lang.Thread.currentThread().getContextClassLoader()) for c in ("Command", "ParsedStatement", "InsertIntoDir", "CompoundPlanStatement")]
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if ("ExecuteImmediate" in kind or any(w.isInstance(node) for w in writes)) and not kind.startswith(_LOOKS):
            raise ValueError("only queries are accepted")
    if _REFLECTS.search(text):
        raise ValueError("only queries are accepted, without calls into Java")


def query(spark: SparkSession, text: str, spans: DataFrame, name: str = "spans") -> DataFrame:
    """A SQL query with spans as a view; statements that change anything are refused before anything runs."""
    check_read_only(spark, text)
    spans.createOrReplaceTempView(name)
    return spark.sql(text)


def as_text(value: object) -> str:
    """A value as the query endpoint writes it: floats to two decimals, null as "null", other kinds by name."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, str)):
        return str(value)
    if isinstance(value, float):
        return f"{value:.2f}"
    if isinstance(value, datetime.datetime):
        return str(int(value.replace(tzinfo=value.tzinfo or datetime.UTC).timestamp() * 1000))
    return f"<{type(value).__name__}>"


def text_rows(df: DataFrame, limit: int = 1000) -> dict:
    """Columns and rows of a report as text; a report is small, and limit bounds what reaches the driver."""
    return {"columns": df.columns, "rows": [[as_text(v) for v in row] for row in df.limit(limit).collect()]}
