"""Export rows, batches and writers."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions.matching import kind_label
from tracewell.operators.compress import split
from tracewell.config import Compression
from tracewell.schema import ERROR

_NS = 1_000_000
COLUMNS = ("id", "trace_id", "parent_id", "name", "resource", "service", "type", "start_ns", "end_ns", "duration_ns", "error", "meta", "metrics", "child_span_ids")


def _compact(**entries: Column) -> Column:
    """A map without the entries that are null or empty."""
    pairs = [x for k, v in entries.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))


def _overlaid(base: Column, later: Column) -> Column:
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(later, k)), later)


def plain_rows(spans: DataFrame, wire_kinds: bool = False) -> DataFrame:
    """Spans as export rows; error is the status code as it is."""
    failed = F.col("status_code") == ERROR
    meta = _compact(
        span_kind=kind_label(F.col("span_kind"), wire_kinds), service=F.col("service_name"), trace_id=F.col("trace_id"), span_id=F.col("span_id"), parent_id=F.col("parent_span_id"),
        error_message=F.when(failed, "Error status").otherwise(""), error_type=F.when(failed, "error").otherwise(""),
    )
    start, length = F.col("timestamp_ms") * _NS, F.col("duration_ms") * _NS
    return spans.select(
        F.col("span_id").alias("id"), "trace_id", F.col("parent_span_id").alias("parent_id"), F.col("operation_name").alias("name"), F.col("operation_name").alias("resource"),
        F.col("service_name").alias("service"), F.lit("custom").alias("type"), start.alias("start_ns"), (start + length).alias("end_ns"), length.alias("duration_ns"),
        F.col("status_code").alias("error"), meta.alias("meta"), F.create_map().cast("map<string,double>").alias("metrics"), F.array().cast("array<string>").alias("child_span_ids"),
    )


def compressed_rows(groups: DataFrame) -> DataFrame:
    """Groups as export rows: the end is the last span's start, the duration is the sum."""
    c = F.col
    failed = c("error_count") > 0
    own = _compact(
        service=c("service_name"), trace_id=c("trace_id"), span_id=c("span_id"), parent_id=c("parent_span_id"),
        error_message=F.when(failed, F.format_string("%d errors out of %d requests", "error_count", "span_count")).otherwise(""),
        error_type=F.when(failed, "partial_failure").otherwise(""),
    )
    tags = {
        "compression.type": F.lit("aggregated"), "compression.count": c("span_count").cast("string"), "compression.total_duration_ms": c("total_duration_ms").cast("string"),
        "compression.mean_duration_ms": F.bround(c("mean_duration_ms").cast("decimal(38,18)"), 2).cast("string"), "compression.min_duration_ms": c("min_duration_ms").cast("string"),
        "compression.max_duration_ms": c("max_duration_ms").cast("string"), "compression.group_signature": c("group_signature"), "span.type": F.lit("analytics"),
    }
    made = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)])
    numbers = {"sampling_rate": F.lit(1.0), "compression.count": c("span_count"), "compression.total_ms": c("total_duration_ms"), "compression.mean_ms": c("mean_duration_ms"), "compression.errors": c("error_count")}
    # Later maps win: first the original attributes, then tags, then the span's own fields.
    parts = [F.coalesce(c("attributes"), F.create_map().cast("map<string,string>")), made, own]
    meta = parts[0]
    for later in parts[1:]:
        meta = _overlaid(meta, later)
    return groups.select(
        F.col("span_id").alias("id"), "trace_id", F.col("parent_span_id").alias("parent_id"), F.concat("operation_name", F.lit(" (aggregated)")).alias("name"), F.col("group_signature").alias("resource"),
        F.col("service_name").alias("service"), F.lit("analytics").alias("type"), (c("timestamp_ms") * _NS).alias("start_ns"), (c("last_timestamp_ms") * _NS).alias("end_ns"),
        (c("total_duration_ms") * _NS).alias("duration_ns"), failed.cast("int").alias("error"), meta.alias("meta"),
        F.create_map(*[x for k, v in numbers.items() for x in (F.lit(k), v.cast("double"))]).alias("metrics"), F.col("original_span_ids").alias("child_span_ids"),
    )


def export_rows(spans: DataFrame, c: Compression | None = None) -> DataFrame:
    """What is sent for kept spans: groups and what they left over, or all spans if compression is off."""
    c = c or Compression()
    if not c.enabled:
        return plain_rows(spans)
    groups, rest = split(spans, c)
    return compressed_rows(groups).unionByName(plain_rows(rest))


def batches(rows: DataFrame, order: tuple[str, ...] = ("trace_id", "start_ns", "id"), size: int = 100, shards: int = 64) -> DataFrame:
    """rows with shard and batch_no: traces are dealt to shards, and each shard is cut into chunks of size in the given order.

    Shards are numbered on their own, so no task sees all rows; their number should grow with the data.
    """
    shard = F.pmod(F.conv(F.substring(F.md5("trace_id"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")
    numbered = rows.withColumn("shard", shard)
    rank = F.row_number().over(W.partitionBy("shard").orderBy(*order))
    return numbered.withColumn("batch_no", F.floor((rank - 1) / F.lit(size)).cast("long"))


def to_json(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text per row, along with the columns to keep; null fields are left out."""
    return rows.select(*keep, "trace_id", F.to_json(F.struct(*[F.col(c) for c in rows.columns if c not in ("shard", "batch_no")])).alias("body"))


def retried(send: Callable[[], bool], retries: int = 3, base_secs: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Call send until it returns true; waits double from base_secs."""
    for k in range(retries + 1):
        if send():
            return True
        if k < retries:
            sleep(base_secs * 2**k)
    return False


class HttpWriter:
    """Posts each batch (shard and batch_no) of rows as {"data": [...]}; each partition stops at its first failure.

    Rows without batch numbers are cut into batches of size as they come. A batch may arrive twice if a task is tried
    again; the receiver tells by the spans' ids.
    """

    def __init__(self, endpoint: str, path: str = "/api/v2/spans", health: str = "/api/v1/health", size: int = 100, retries: int = 3, headers: dict | None = None, timeout: float = 10.0):
        self.endpoint, self.path, self.health_path, self.size, self.retries, self.headers, self.timeout = endpoint.rstrip("/"), path, health, size, retries, headers or {}, timeout

    def post(self, bodies: list[str]) -> bool:
        data = ('{"data":[' + ",".join(bodies) + "]}").encode()
        request = urllib.request.Request(self.endpoint + self.path, data, {"Content-Type": "application/json", **self.headers})

        def once() -> bool:
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return r.status in (200, 202)
            except (urllib.error.URLError, TimeoutError):
                return False

        return retried(once, self.retries)

    def healthy(self) -> bool:
        try:
            with urllib.request.urlopen(self.endpoint + self.health_path, timeout=self.timeout) as r:
                return r.status == 200
        except (urllib.error.URLError, TimeoutError):
            return False

    def write(self, rows: DataFrame, number: int | None = None) -> DataFrame:
        """Send all rows; returns trace_id and sent for each."""
        numbered = {"shard", "batch_no"} <= set(rows.columns)
        bodies = to_json(rows, keep=("shard", "batch_no") if numbered else ())
        if numbered:
            bodies = bodies.repartition("shard").sortWithinPartitions("shard", "batch_no")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ok, held, last = True, [], None

            def sent() -> pd.DataFrame:
                nonlocal ok
                ok = ok and self.post([body for _, body in held])
                return pd.DataFrame({"trace_id": [t for t, _ in held], "sent": [ok] * len(held)})

            for pdf in parts:
                names = zip(pdf["shard"], pdf["batch_no"], strict=True) if numbered else [None] * len(pdf)
                for name, trace, body in zip(names, pdf["trace_id"], pdf["body"], strict=True):
                    if held and (name != last or len(held) >= self.size):
                        yield sent()
                        held = []
                    held.append((trace, body))
                    last = name
            if held:
                yield sent()

        return bodies.mapInPandas(run, "trace_id string, sent boolean")


class TableWriter:
    """Rows in a folder in one of Spark's formats: those of a numbered batch in its own subfolder, once however often it is tried."""

    def __init__(self, path: str, kind: str = "parquet"):
        self.path, self.kind = path, kind

    def healthy(self) -> bool:
        return True

    def write(self, rows: DataFrame, number: int | None = None) -> DataFrame:
        """Write all rows; returns trace_id and sent for each, of a numbered batch from what was written."""
        if number is None:
            rows.write.mode("append").format(self.kind).save(self.path)
            return rows.select("trace_id", F.lit(True).alias("sent"))
        path = f"{self.path}/batch={number}"
        rows.write.mode("overwrite").format(self.kind).save(path)
        return rows.sparkSession.read.schema(rows.schema).format(self.kind).load(path).select("trace_id", F.lit(True).alias("sent"))


def payload(bodies: list[str]) -> str:
    return json.dumps({"data": [json.loads(b) for b in bodies]})
