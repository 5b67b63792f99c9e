"""Where spans come from: tables, JSON lines, event tables, OTLP payloads, Kafka, and generators."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.config import Catalog, Kafka
from tracewell.schema import SPAN, check_spans


def normalised(df: DataFrame) -> DataFrame:
    """An empty parent is no parent."""
    return df.withColumn("parent_span_id", F.expr("nullif(parent_span_id, '')"))


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return normalised(check_spans(spark.read.format(kind).load(path)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Spans as JSON lines."""
    return normalised(spark.read.schema(SPAN).json(path))


def write_table(spans: DataFrame, path: str, mode: str = "append") -> None:
    """Spans by day, so that later scans can skip days."""
    day = F.to_date(F.timestamp_millis("timestamp_ms"))
    spans.withColumn("day", day).write.mode(mode).partitionBy("day").parquet(path)


#: The projection of an event table to spans; @US and @K stand for an engine's expressions.
EVENT_CTES = """m AS (
  SELECT event_id, user_id, event_type, value, CAST(@K AS BIGINT) AS k,
         CAST((@US - @US % 1000) / 1000 AS BIGINT) - 1704067200000 AS off_ms
  FROM events),
e AS (SELECT *, CAST((off_ms - off_ms % 604800000) / 604800000 AS BIGINT) AS wk FROM m),
t AS (
  SELECT *, concat('U', CAST(user_id AS STRING), 'W', CAST(wk AS STRING)) AS trace_id,
         lpad(CAST(event_id AS STRING), 16, '0') AS span_id FROM e),
r AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY event_id) AS rn,
         first_value(span_id) OVER (PARTITION BY trace_id ORDER BY event_id) AS first_id FROM t),
spans AS (
  SELECT event_id AS seq, trace_id, span_id,
    CASE WHEN rn = 1 AND event_type <> 'view' THEN NULL WHEN rn = 1 THEN 'EXTERNAL' ELSE first_id END AS parent_span_id,
    1704067200000 + CAST((off_ms - off_ms % 1000) / 1000 AS BIGINT) AS timestamp_ms,
    CAST(floor(value * 300) AS BIGINT) AS duration_ms,
    CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS status_code,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 ELSE 0 END AS span_kind,
    concat('svc-', CAST(user_id % 8 AS STRING)) AS service_name,
    concat('SELECT * FROM ', event_type, ' WHERE k = ', CAST(k AS STRING)) AS operation_name,
    concat('tenant-', CAST(user_id % 5 AS STRING)) AS attr_tenant,
    CAST(200 + (k % 4) * 100 AS STRING) AS attr_http_status,
    concat('/api/v', CAST(1 + k % 2 AS STRING), '/', event_type) AS attr_http_route,
    CASE WHEN event_type IN ('view', 'click') THEN 'postgresql' END AS attr_db_system
  FROM r)"""

SPARK_EVENT_CTES = EVENT_CTES.replace("@US", "unix_micros(CAST(ts AS TIMESTAMP))").replace("@K", "get_json_object(props, '$.k')")


def from_events(spark: SparkSession, path: str) -> DataFrame:
    """Spans of an event table: one trace for a user and week, one span for an event."""
    events = spark.read.parquet(path)
    flat = spark.sql("WITH events AS (SELECT * FROM {events}), " + SPARK_EVENT_CTES + " SELECT * FROM spans", events=events)
    pairs = {"tenant.id": "attr_tenant", "http.status_code": "attr_http_status", "http.route": "attr_http_route", "db.system": "attr_db_system"}
    attrs = F.map_filter(F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), F.col(c))]), lambda _, v: v.isNotNull())
    return flat.select(*[attrs.alias("attributes") if f.name == "attributes" else F.col(f.name).cast(f.dataType) for f in SPAN])


# ---- OTLP ----------------------------------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protobuf message; raises ValueError if it isn't one."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("cut short")
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 2, 5):
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            if at + n > len(data):
                raise ValueError("cut short")
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        if tag >> 3 == 0:
            raise ValueError("field 0")
        yield tag >> 3, value


def _any_text(data: bytes) -> tuple[str | None, bool]:
    """An attribute value as text, and whether it was a string."""
    for field, v in _fields(data):
        if field == 1:
            return v.decode(), True
        if field == 2:
            return ("true" if v else "false"), False
        if field == 3:
            return str(v - (1 << 64) if v >> 63 else v), False
        if field == 4:
            return repr(struct.unpack("<d", v)[0]), False
    return None, False


def _attributes(parts: list[bytes]) -> dict[str, tuple[str, bool]]:
    out = {}
    for p in parts:
        key, value = "", (None, False)
        for field, v in _fields(p):
            if field == 1:
                key = v.decode()
            elif field == 2:
                value = _any_text(v)
        if value[0] is not None:
            out[key] = value
    return out


def decode_payload(data: bytes) -> list[dict] | None:
    """Spans of one ResourceSpans message; None if it is empty, isn't decodable, or has no resource or no span."""
    try:
        top = list(_fields(data or b""))
        resources = [v for f, v in top if f == 1]
        if not resources:
            return None
        resource = _attributes([v for f, v in _fields(resources[-1]) if f == 1])
        name, is_text = resource.get("service.name", (None, False))
        service = name if is_text else "unknown-service"
        out = []
        for scope in (v for f, v in top if f == 2):
            for raw in (v for f, v in _fields(scope) if f == 2):
                got: dict = {"attrs": [], 6: 0, 7: 0, 8: 0, 1: b"", 2: b"", 4: b"", 5: b"", "status": 0}
                for f, v in _fields(raw):
                    if f == 9:
                        got["attrs"].append(v)
                    elif f == 15:
                        got["status"] = next((x for k, x in _fields(v) if k == 3), 0)
                    elif f in (7, 8):
                        got[f] = struct.unpack("<Q", v)[0]
                    elif f in got:
                        got[f] = v
                attrs = {k: v for k, (v, _) in {**resource, **_attributes(got["attrs"])}.items()}
                out.append(
                    {
                        "trace_id": got[1].hex().upper(), "span_id": got[2].hex().upper(), "parent_span_id": got[4].hex().upper() or None,
                        "timestamp_ms": got[7] // 1_000_000, "duration_ms": max(0, got[8] - got[7]) // 1_000_000, "status_code": got["status"], "span_kind": got[6],
                        "service_name": service, "operation_name": got[5].decode(), "attributes": attrs,
                    }
                )
        return out or None
    except (ValueError, UnicodeDecodeError, AttributeError, struct.error, TypeError):
        return None


#: Bits of a sequence number for the place of a span in its message.
PLACE_BITS = 17


def decode_otlp(messages: DataFrame, value_col: str = "value", seq_col: str | None = None) -> DataFrame:
    """Spans of a frame of payloads, works on streams too; payloads without spans vanish.

    seq: the message's number (seq_col, below 2^46; 0 without) times 2^17, plus the span's place in it. What doesn't
    fit raises: a message holds 131,072 spans at most.
    """
    number = F.coalesce(F.col(seq_col).cast("long"), F.lit(0)) if seq_col else F.lit(0).cast("long")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in SPAN]
        for pdf in parts:
            rows = []
            for seq, data in zip(pdf["seq"], pdf["value"], strict=True):
                for k, span in enumerate(decode_payload(bytes(data)) or [] if data is not None else []):
                    if k >> PLACE_BITS or seq >> (63 - PLACE_BITS):
                        raise OverflowError(f"message {seq} or its span {k} is beyond what a sequence number holds")
                    rows.append({"seq": (int(seq) << PLACE_BITS) + k, **span})
            yield pd.DataFrame(rows, columns=names)

    return messages.select(number.alias("seq"), F.col(value_col).alias("value")).mapInPandas(run, SPAN)


# ---- Kafka ---------------------------------------------------------------------------------------------------


def kafka_options(k: Kafka) -> dict[str, str]:
    """Options of Spark's Kafka source: rate and security; what isn't set is left out."""
    out = {
        "kafka.bootstrap.servers": k.brokers, "subscribe": k.topic, "startingOffsets": "latest", "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": str(k.max_offsets_per_trigger), "kafka.max.partition.fetch.bytes": str(k.max_message_bytes), "kafka.fetch.max.wait.ms": str(k.fetch_wait_ms),
        "kafka.group.id": k.group,
    }
    if k.sasl_mechanism:
        module = "org.apache.kafka.common.security.plain.PlainLoginModule" if k.sasl_mechanism == "PLAIN" else "org.apache.kafka.common.security.scram.ScramLoginModule"
        out |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": k.sasl_mechanism, "kafka.sasl.jaas.config": f'{module} required username="{k.username}" password="{k.password}";'}
    if k.ca_location:
        out |= {"kafka.ssl.truststore.type": "PEM", "kafka.ssl.truststore.location": k.ca_location}
    return out


def kafka_stream(spark: SparkSession, k: Kafka) -> DataFrame:
    """A stream of spans; needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**kafka_options(k)).load()
    return decode_otlp(raw.withColumn("_n", message_number(F.col("partition"), F.col("offset"), k.max_partitions)), "value", "_n")


def message_number(partition: F.Column, offset: F.Column, max_partitions: int = 64) -> F.Column:
    """One number below 2^46 for a message, by partition and offset; raises where there are more of either than it holds."""
    bits = 63 - PLACE_BITS - (max_partitions - 1).bit_length()
    fits = (partition < max_partitions) & (offset < (1 << bits))
    return F.when(fits, partition.cast("long") * F.lit(1 << bits) + offset).otherwise(F.raise_error(F.format_string("partition %d, offset %d: more than max_partitions=%d leaves room for", partition, offset, F.lit(max_partitions))).cast("long"))


# ---- catalog -------------------------------------------------------------------------------------------------


def catalog_options(c: Catalog) -> dict[str, str]:
    """Session settings that connect Spark to an Iceberg REST catalog, for session(**options); what isn't set is left out."""
    head = f"spark.sql.catalog.{c.name}"
    out = {head: "org.apache.iceberg.spark.SparkCatalog", f"{head}.type": "rest", f"{head}.uri": c.uri, f"{head}.warehouse": c.warehouse}
    more = {"token": c.token, "s3.endpoint": c.endpoint, "client.region": c.region, "s3.access-key-id": c.access_key, "s3.secret-access-key": c.secret_key}
    out |= {f"{head}.{k}": v for k, v in more.items() if v}
    if c.endpoint:
        out |= {f"{head}.io-impl": "org.apache.iceberg.aws.s3.S3FileIO", f"{head}.s3.path-style-access": str(c.path_style).lower()}
    return out


# ---- generators ----------------------------------------------------------------------------------------------

SERVICES = ("edge", "catalogue", "basket", "billing", "shipping", "mailer", "login", "recommender")
OPERATIONS = ("GET /users", "POST /orders", "GET /products", "PUT /cart", "DELETE /session", "SELECT users", "INSERT order", "UPDATE stock", "cache.get", "queue.publish")
BATCH_OPERATIONS = ("extract", "validate", "transform", "enrich", "aggregate", "load", "index", "report")


def _pick(values: tuple[str, ...], of: F.Column) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(of, F.lit(len(values))).cast("int"))


def generate(spark: SparkSession, traces: int, spans_per_trace: int = 10, error_percent: int = 5, slow_percent: int = 5, start_ms: int = 1_704_067_200_000, seed: int = 0) -> DataFrame:
    """Traces with a root each; a share of roots fail, a share take 5 to 14 s. The same arguments give the same spans."""
    n = spans_per_trace
    base = spark.range(traces * n).select(F.col("id").alias("seq"), F.floor(F.col("id") / n).cast("long").alias("t"), (F.col("id") % n).alias("k"))
    draw = lambda salt, of: F.pmod(F.xxhash64(*[F.col(c) for c in of], F.lit(f"{seed}{salt}")), F.lit(100)).cast("int")
    failed, slow = draw("e", ["t"]) < error_percent, draw("s", ["t"]) < slow_percent
    tid = F.lpad(F.hex("t"), 32, "0")
    sid = lambda c: F.lpad(F.hex(c + 1), 16, "0")
    quick = F.lit(10) + draw("d", ["t", "k"])
    root = F.col("k") == 0
    return base.select(
        "seq", tid.alias("trace_id"), sid(F.col("seq")).alias("span_id"), F.when(~root, sid(F.col("t") * n)).alias("parent_span_id"),
        (F.lit(start_ms) + F.col("t") * 1000 + F.col("k") * 20).alias("timestamp_ms"), F.when(root & slow, F.lit(5000) + draw("l", ["t"]) * 90).otherwise(quick).cast("long").alias("duration_ms"),
        F.when(root & failed, 2).otherwise(0).cast("int").alias("status_code"), F.pmod(F.col("seq"), F.lit(5)).cast("int").alias("span_kind"),
        _pick(SERVICES, F.col("t") + F.col("k")).alias("service_name"), _pick(OPERATIONS, F.xxhash64("t", "k")).alias("operation_name"),
        F.create_map(F.lit("http.status_code"), F.when(root & failed, "500").otherwise("200")).alias("attributes"),
    )


def generate_long(spark: SparkSession, traces: int, steps: int = 100, interval_ms: int = 10_000, fail: bool = True, start_ms: int = 1_704_067_200_000) -> DataFrame:
    """Batch jobs: one span per interval and trace, under one root; the last step fails."""
    base = spark.range(traces * steps).select(F.col("id").alias("seq"), F.pmod(F.col("id"), F.lit(traces)).alias("t"), F.floor(F.col("id") / traces).cast("long").alias("k"))
    last = F.col("k") == steps - 1
    return base.select(
        "seq", F.lpad(F.concat(F.lit("B"), F.hex("t")), 32, "0").alias("trace_id"), F.lpad(F.hex(F.col("seq") + 1), 16, "0").alias("span_id"),
        F.when(F.col("k") > 0, F.lpad(F.hex(F.col("t") + 1), 16, "0")).alias("parent_span_id"), (F.lit(start_ms) + F.col("k") * interval_ms).alias("timestamp_ms"),
        (F.lit(100) + F.pmod(F.xxhash64("seq"), F.lit(500))).cast("long").alias("duration_ms"), F.when(last & F.lit(fail), 2).otherwise(0).cast("int").alias("status_code"), F.lit(1).alias("span_kind"),
        F.lit("batch-processor").alias("service_name"), _pick(BATCH_OPERATIONS, F.col("k")).alias("operation_name"), F.create_map().cast("map<string,string>").alias("attributes"),
    )
