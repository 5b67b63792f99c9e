"""One query for each operator, and SQL that gives the same rows on the same tables.

Base data: spans projected from the event table. Times are fixed by the data: `now` is the newest span.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.config import App, Compression, Config
from tracewell.functions import matching
from tracewell.operators import analytics, compress, decide, export, lifecycle, policies, rules, summary
from tracewell.session import shared_folder
from tracewell.sources import spans as sources
from tracewell.streaming.sampler import Sampler, span_stream

#: Times are compressed in the projection; this age exercises the branch for old traces.
APP = App(max_trace_duration_secs=2000)
WIDE = Compression(window_secs=300)
PATTERNS = [{"pattern": "FROM purchase", "is_regex": False, "group_name": "purchases"}, {"pattern": r"FROM (view|click) ", "is_regex": True, "group_name": "looks"}]

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_CTES = "WITH RECURSIVE " + sources.EVENT_CTES.replace("@US", "epoch_us(ts)").replace("@K", "json_extract_string(props, '$.k')") + """,
now_ms AS (SELECT max(timestamp_ms) AS now FROM spans),
summary AS (
  SELECT trace_id, arg_min(service_name, seq) AS service_name, count(*) AS span_count, bool_or(status_code = 2) AS has_error,
    greatest(0, max(duration_ms)) AS max_duration_ms, min(timestamp_ms) AS min_timestamp_ms, greatest(0, max(timestamp_ms)) AS max_timestamp_ms,
    array_to_string(list_sort(list(DISTINCT operation_name)), '|') AS operations, count(*) AS total_spans, count(*) FILTER (WHERE status_code = 2) AS error_count,
    arg_max(span_id, seq) FILTER (WHERE parent_span_id IS NULL) AS root_span_id
  FROM spans GROUP BY trace_id),
life AS (
  SELECT *, CASE WHEN now - min_timestamp_ms > 2000000 THEN 'force'
    WHEN now - max_timestamp_ms > CASE WHEN root_span_id IS NOT NULL THEN 30000 ELSE 300000 END THEN 'ready' ELSE 'active' END AS state
  FROM summary, now_ms),
decided AS (
  SELECT *, CASE WHEN state = 'active' THEN 'pending' WHEN has_error OR max_duration_ms > 30000 OR span_count > 500 THEN 'keep' ELSE 'drop' END AS decision FROM life),
keyed AS (
  SELECT *, upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(operation_name, '[0-9]+', '?', 'g'), '''[^'']*''', '?', 'g'), '"[^"]*"', '?', 'g'), '\\s+', ' ', 'g'))) AS normalized_statement
  FROM spans),
typed AS (
  SELECT *, CASE WHEN attr_db_system IS NOT NULL THEN 'db.' || attr_db_system || '.' || CASE WHEN normalized_statement LIKE 'SELECT%' THEN 'select'
    WHEN normalized_statement LIKE 'INSERT%' THEN 'insert' WHEN normalized_statement LIKE 'UPDATE%' THEN 'update' WHEN normalized_statement LIKE 'DELETE%' THEN 'delete' ELSE 'query' END
    ELSE operation_name END AS operation_type FROM keyed),
groups_all AS (
  SELECT trace_id, service_name, operation_type, normalized_statement, parent_span_id, min(timestamp_ms) AS timestamp_ms, max(timestamp_ms) AS last_timestamp_ms,
    sum(duration_ms)::BIGINT AS total_duration_ms, count(*) AS span_count, count(*) FILTER (WHERE status_code = 2) AS error_count, sum(duration_ms) / count(*) AS mean_duration_ms,
    min(duration_ms) AS min_duration_ms, greatest(0, max(duration_ms)) AS max_duration_ms, arg_min(operation_name, seq) AS operation_name,
    string_agg(span_id, ',' ORDER BY seq) AS original_span_ids
  FROM typed WHERE duration_ms <= 60000 GROUP BY ALL),
groups_wide AS (
  SELECT *, upper(substr(sha256(trace_id || chr(1) || service_name || chr(1) || operation_type || chr(1) || normalized_statement || chr(1) || coalesce(parent_span_id, '')), 1, 16)) AS span_id
  FROM groups_all WHERE span_count >= 3 AND last_timestamp_ms - timestamp_ms <= 300000),
absorbed AS (SELECT trace_id, unnest(string_split(original_span_ids, ',')) AS span_id FROM groups_wide)
"""


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = _CTES + sql
        return f

    return keep


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return sources.from_events(spark, f"{d}/events.parquet")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.summarize(_spans(spark, d))


def _now(spark: SparkSession, d: str) -> int:
    return lifecycle.latest(_spans(spark, d))


def _life(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    return lifecycle.with_state(summary.summarize(s), lifecycle.newest(s), APP)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("operations", F.array_join("operations", "|"))


# ---- decisions -----------------------------------------------------------------------------------------------


@_add("sampling_decisions", "SELECT trace_id, state, has_error, max_duration_ms, span_count, decision FROM decided")
def sampling_decisions(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    out = decide.decide(s, lifecycle.newest(s), Config(app=APP))
    return out.select("trace_id", "state", "has_error", "max_duration_ms", "span_count", "decision")


@_add("sampling_totals", "SELECT " + ", ".join(f"count(*) FILTER (WHERE decision = '{v}') AS {k}_traces, coalesce(sum(span_count) FILTER (WHERE decision = '{v}'), 0)::BIGINT AS {k}_spans" for k, v in (("sampled", "keep"), ("dropped", "drop"), ("pending", "pending"), ("purged", "purge"))) + " FROM decided")
def sampling_totals(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    return decide.totals(decide.decide(s, lifecycle.newest(s), Config(app=APP)))


_QUERIES_SPAN = "seq, trace_id, span_id, parent_span_id, timestamp_ms, duration_ms, status_code, span_kind, service_name, operation_name"


@_add("span_projection", f"SELECT {_QUERIES_SPAN}, attr_tenant AS tenant, attr_http_status AS http_status, attr_db_system AS db_system FROM spans")
def span_projection(spark: SparkSession, d: str) -> DataFrame:
    a = lambda k: F.try_element_at("attributes", F.lit(k))
    return _spans(spark, d).select(*_QUERIES_SPAN.split(", "), a("tenant.id").alias("tenant"), a("http.status_code").alias("http_status"), a("db.system").alias("db_system"))


@_add("span_kind_label", "SELECT seq, CASE span_kind WHEN 1 THEN 'Server' WHEN 2 THEN 'Client' WHEN 3 THEN 'Producer' WHEN 4 THEN 'Consumer' ELSE 'Unspecified' END AS kind FROM spans")
def span_kind_label(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("seq", matching.kind_label(F.col("span_kind")).alias("kind"))


# ---- store ---------------------------------------------------------------------------------------------------


@_add("trace_summary", "SELECT * FROM summary")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_summary(spark, d))


@_add("trace_summary_degraded", "SELECT trace_id, '' AS service_name, span_count, has_error, max_duration_ms, min_timestamp_ms, max_timestamp_ms, '' AS operations, span_count AS total_spans, has_error::BIGINT AS error_count, NULL::VARCHAR AS root_span_id FROM summary")
def trace_summary_degraded(spark: SparkSession, d: str) -> DataFrame:
    return _flat(summary.summarize_metadata(_spans(spark, d)))


@_add("trace_lookup", f"SELECT {_QUERIES_SPAN} FROM spans WHERE trace_id = 'U1W1'")
def trace_lookup(spark: SparkSession, d: str) -> DataFrame:
    return summary.trace_spans(_spans(spark, d), "U1W1").select(*_QUERIES_SPAN.split(", "))


@_add("trace_lookup_many", f"SELECT {_QUERIES_SPAN} FROM spans WHERE trace_id IN (SELECT trace_id FROM decided WHERE decision = 'keep')")
def trace_lookup_many(spark: SparkSession, d: str) -> DataFrame:
    kept = sampling_decisions(spark, d).where("decision = 'keep'")
    return summary.spans_of(_spans(spark, d), kept).select(*_QUERIES_SPAN.split(", "))


@_add("all_trace_ids", "SELECT DISTINCT trace_id FROM spans")
def all_trace_ids(spark: SparkSession, d: str) -> DataFrame:
    return summary.trace_ids(_spans(spark, d))


@_add("remove_traces", "SELECT count(*) AS removed_spans, count(DISTINCT trace_id) AS removed_traces FROM spans WHERE trace_id IN (SELECT trace_id FROM summary WHERE has_error)")
def remove_traces(spark: SparkSession, d: str) -> DataFrame:
    return summary.remove_traces(_spans(spark, d), _summary(spark, d).where("has_error"))[1]


@_add("remaining_spans", f"SELECT {_QUERIES_SPAN} FROM spans WHERE trace_id NOT IN (SELECT trace_id FROM summary WHERE has_error)")
def remaining_spans(spark: SparkSession, d: str) -> DataFrame:
    return summary.remove_traces(_spans(spark, d), _summary(spark, d).where("has_error"))[0].select(*_QUERIES_SPAN.split(", "))


@_add("store_stats", "SELECT count(*) AS span_count, count(DISTINCT trace_id) AS trace_count, count(*) * 1000 AS memory_bytes, 'table' AS backend FROM spans")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return summary.store_stats(_spans(spark, d))


_CAPPED = "f AS (SELECT trace_id FROM (SELECT trace_id, min(seq) AS s FROM spans GROUP BY trace_id) ORDER BY s LIMIT 100), c AS (SELECT seq, trace_id, span_id FROM spans WHERE trace_id IN (SELECT trace_id FROM f) ORDER BY seq LIMIT 500)"


@_add("ingest_caps", f", {_CAPPED} SELECT * FROM c")
def ingest_caps(spark: SparkSession, d: str) -> DataFrame:
    return summary.admit(_spans(spark, d), 100, 500).select("seq", "trace_id", "span_id")


@_add("ingest_counts", f", {_CAPPED} SELECT (SELECT count(*) FROM c) AS added, (SELECT count(*) FROM spans) - (SELECT count(*) FROM c) AS dropped")
def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.ingest_counts(_spans(spark, d), 100, 500)


# ---- lifecycle -----------------------------------------------------------------------------------------------


@_add("ready_traces", "SELECT trace_id, state FROM life WHERE state <> 'active'")
def ready_traces(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    return lifecycle.ready_traces(summary.summarize(s), lifecycle.newest(s), APP)


@_add("ready_traces_columnar", "SELECT trace_id FROM life WHERE now - max_timestamp_ms > 60000 AND trace_id NOT LIKE '%W1'")
def ready_traces_columnar(spark: SparkSession, d: str) -> DataFrame:
    s = _summary(spark, d)
    return lifecycle.ready_by_recency(s, _now(spark, d), 60_000, s.where(F.col("trace_id").endswith("W1")))


@_add("closed_traces", "SELECT trace_id FROM life WHERE now - max_timestamp_ms > 300000")
def closed_traces(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.closed_traces(_summary(spark, d), _now(spark, d), 300_000)


_MARK = "CASE WHEN now - max_timestamp_ms > CASE WHEN root_span_id IS NOT NULL THEN 30000 ELSE 1800000 END THEN 'ready' WHEN now - max_timestamp_ms > 600000 THEN 'force' ELSE 'active' END"


@_add("mark_phase", f"SELECT trace_id, {_MARK} AS mark FROM life")
def mark_phase(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.mark_phase(_summary(spark, d), _now(spark, d), 1_800_000, 600_000).select("trace_id", "mark")


@_add("mark_counts", f", k AS (SELECT {_MARK} AS mark FROM life) SELECT count(*) FILTER (WHERE mark = 'ready') AS ready, count(*) FILTER (WHERE mark = 'force') AS force FROM k")
def mark_counts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.mark_counts(mark_phase(spark, d))


@_add("large_traces", "SELECT trace_id, span_count FROM summary WHERE span_count >= 20 ORDER BY span_count DESC, trace_id LIMIT 10")
def large_traces(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.large_traces(_summary(spark, d), 20, 10)


_RANKED = ", k AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n FROM spans) SELECT seq, trace_id, span_id FROM k WHERE n"


@_add("trace_chunk", f"{_RANKED} <= 5")
def trace_chunk(spark: SparkSession, d: str) -> DataFrame:
    return summary.take_chunk(_spans(spark, d), 5)[0].select("seq", "trace_id", "span_id")


@_add("chunk_remainder", f"{_RANKED} > 5")
def chunk_remainder(spark: SparkSession, d: str) -> DataFrame:
    return summary.take_chunk(_spans(spark, d), 5)[1].select("seq", "trace_id", "span_id")


@_add("investigation", "SELECT trace_id, now - min_timestamp_ms AS age_ms FROM life WHERE now - min_timestamp_ms > 1000000")
def investigation(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.for_investigation(_summary(spark, d), _now(spark, d), 1_000_000)


_STATES = "st AS (SELECT trace_id, now, max_timestamp_ms AS last_activity_ms, min_timestamp_ms AS since_ms, CASE WHEN has_error THEN 'processing' WHEN span_count > 15 THEN 'investigation' ELSE 'active' END AS status FROM life)"


def _states(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("has_error"), "processing").when(F.col("span_count") > 15, "investigation").otherwise("active")
    return _summary(spark, d).select("trace_id", F.col("max_timestamp_ms").alias("last_activity_ms"), F.col("min_timestamp_ms").alias("since_ms"), status.alias("status"))


@_add("gc_classes", f", {_STATES} SELECT trace_id, status, CASE WHEN status = 'processing' AND now - last_activity_ms > 900000 THEN 'stuck' WHEN status = 'investigation' AND now - since_ms > 900000 THEN 'stuck' WHEN status = 'active' AND now - last_activity_ms > 1200000 THEN 'expired' END AS garbage FROM st")
def gc_classes(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.garbage(_states(spark, d), _now(spark, d), 900_000, 1_200_000).select("trace_id", "status", "garbage")


@_add("buffer_stats", f", {_STATES} SELECT count(*) AS traces, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("active", "ready", "force", "processing", "investigation")) + " FROM st")
def buffer_stats(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.status_counts(_states(spark, d))


@_add("mark_investigation", f", {_STATES} SELECT trace_id, CASE WHEN trace_id LIKE '%W1' THEN 'investigation' ELSE status END AS status, CASE WHEN trace_id LIKE '%W1' THEN 'too_long' END AS reason FROM st")
def mark_investigation(spark: SparkSession, d: str) -> DataFrame:
    st = _states(spark, d)
    return lifecycle.mark_investigation(st, st.where(F.col("trace_id").endswith("W1")), "too_long", 0).select("trace_id", "status", "reason")


# ---- policies ------------------------------------------------------------------------------------------------


def _policy(p: policies.Policy) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _summary(spark, d).withColumn("r", p.evaluate()).select("trace_id", "r.decision", "r.reason", F.array_join("r.matched", "|").alias("matched"))

    return run


_UNIT = "('0x' || substr(md5(trace_id || '|{}'), 1, 8))::BIGINT / 4294967296.0"
_SQL_POLICY = "SELECT trace_id, CASE WHEN {hit} AND {keep} THEN 'keep' ELSE 'drop' END AS decision, CASE WHEN {hit} THEN {yes} ELSE {no} END AS reason, CASE WHEN {hit} THEN '{tag}' ELSE '' END AS matched FROM summary"
_add("policy_error", _SQL_POLICY.format(hit="has_error", keep="true", yes="'Error trace sampled at rate 1.00: ' || error_count || ' errors found'", no="'No errors found'", tag="has_error"))(_policy(policies.ErrorPolicy()))
_add("policy_error_sampled", _SQL_POLICY.format(hit="has_error", keep=_UNIT.format("error_sampling|0") + " < 0.25", yes="'Error trace sampled at rate 0.25: ' || error_count || ' errors found'", no="'No errors found'", tag="has_error"))(_policy(policies.ErrorPolicy(0.25)))
_add("policy_latency", _SQL_POLICY.format(hit="max_duration_ms > 30000", keep=_UNIT.format("latency_sampling|0") + " < 0.5", yes="'Latency ' || max_duration_ms || 'ms > 30000ms threshold, sampled at rate 0.50'", no="'Latency ' || max_duration_ms || 'ms <= 30000ms threshold'", tag="latency_ms > 30000"))(_policy(policies.LatencyPolicy(30_000, 0.5)))
_add("policy_cardinality", _SQL_POLICY.format(hit="span_count > 20", keep="true", yes="'Span count ' || span_count || ' > 20 max, forced sample'", no="'Span count ' || span_count || ' <= 20 max'", tag="span_count > 20"))(_policy(policies.CardinalityPolicy(20)))


@_add("policy_results", "SELECT trace_id, 'error_sampling:' || CASE WHEN has_error THEN 'keep' ELSE 'drop' END || ',latency_sampling:' || CASE WHEN max_duration_ms > 30000 THEN 'keep' ELSE 'drop' END || ',cardinality_sampling:' || CASE WHEN span_count > 500 THEN 'keep' ELSE 'drop' END AS results FROM summary")
def policy_results(spark: SparkSession, d: str) -> DataFrame:
    all_ = F.transform(policies.results(policies.default_policies()), lambda r: F.concat(r["policy"], F.lit(":"), r["decision"]))
    return _summary(spark, d).select("trace_id", F.array_join(all_, ",").alias("results"))


@_add("sampled_fraction", f"SELECT trace_id, {_UNIT.format('demo')} AS unit, {_UNIT.format('demo')} < 0.3 AS kept FROM summary")
def sampled_fraction(spark: SparkSession, d: str) -> DataFrame:
    u = matching.sample_unit(F.col("trace_id"), "demo")
    return _summary(spark, d).select("trace_id", u.alias("unit"), (u < 0.3).alias("kept"))


_ERROR, _SLOW, _BIG = {"error": {"include": True}}, {"latency": {"threshold_ms": 60_000, "above": True}}, {"cardinality": {"max_spans": 15}}
_CONDITIONS: dict[str, tuple[dict, str]] = {
    "error": (_ERROR, "has_error"),
    "latency": ({"latency": {"threshold_ms": 60_000, "above": False}}, "NOT max_duration_ms > 60000"),
    "duration": ({"duration": {"min_ms": 10_000, "max_ms": 60_000}}, "max_duration_ms BETWEEN 10000 AND 60000"),
    "service": ({"service": {"match": "suffix", "values": ["-1", "-3"]}}, "(service_name LIKE '%-1' OR service_name LIKE '%-3')"),
    "operation": ({"operation": {"match": "regex", "values": ["x"], "pattern": r"FROM signup WHERE k = 1\d"}}, "regexp_matches(operations, 'FROM signup WHERE k = 1\\d')"),
    "cardinality": (_BIG, "span_count > 15"),
    "and": ({"and": [_ERROR, _SLOW]}, "has_error AND max_duration_ms > 60000"),
    "or": ({"or": [_ERROR, _BIG]}, "has_error OR span_count > 15"),
    "not": ({"not": _ERROR}, "NOT has_error"),
    "nested": ({"and": [{"or": [_SLOW, {"not": _BIG}]}, {"not": {"service": {"match": "exact", "values": ["svc-2"]}}}, {"and": []}]}, "(max_duration_ms > 60000 OR NOT span_count > 15) AND service_name <> 'svc-2'"),
}


def _condition(tree: dict) -> Query:
    return lambda spark, d: _summary(spark, d).select("trace_id", policies.condition(tree).alias("hit"))


for _name, (_tree, _text) in _CONDITIONS.items():
    _add(f"cond_{_name}", f"SELECT trace_id, {_text} AS hit FROM summary")(_condition(_tree))

_add("policy_custom", _SQL_POLICY.format(hit="(has_error OR span_count > 15)", keep=_UNIT.format("mine|0") + " < 0.5", yes="'Matched conditions, sampled at rate 0.50'", no="'No conditions matched'", tag="custom_condition"))(_policy(policies.CustomPolicy("mine", [_ERROR, _BIG], 0.5)))
_add("policy_disabled", "SELECT trace_id, 'drop' AS decision, 'Policy disabled' AS reason, '' AS matched FROM summary")(_policy(policies.CustomPolicy("mine", [_ERROR], 1.0, False)))

_THREE = [policies.ErrorPolicy(), policies.LatencyPolicy(60_000), policies.CardinalityPolicy(15)]
_KEEPS = "(has_error::INT + (max_duration_ms > 60000)::INT + (span_count > 15)::INT)"
for _name, _text in {"any": f"{_KEEPS} > 0", "all": f"{_KEEPS} = 3", "consensus": f"{_KEEPS} / 3.0 >= 0.5", "priority": f"{_KEEPS} > 0"}.items():
    _add(f"combine_{_name}", f"SELECT trace_id, CASE WHEN {_text} THEN 'keep' ELSE 'drop' END AS decision FROM summary")(
        lambda spark, d, s=_name: _summary(spark, d).select("trace_id", policies.combine(policies.results(_THREE), s, 0.5).alias("decision"))
    )

# ---- matchers and rules --------------------------------------------------------------------------------------

_MATCHES: dict[str, tuple[str, object, str]] = {
    "eq": ("tenant.id", "tenant-3", "attr_tenant = 'tenant-3'"),
    "neq": ("db.system", "mysql", "coalesce(attr_db_system <> 'mysql', false)"),
    "contains": ("http.route", "v1/pur", "contains(attr_http_route, 'v1/pur')"),
    "starts_with": ("http.route", "/api/v2", "starts_with(attr_http_route, '/api/v2')"),
    "ends_with": ("http.route", "/click", "ends_with(attr_http_route, '/click')"),
    "regex": ("http.route", r"^/api/v\d/(view|error)$", "regexp_matches(attr_http_route, '^/api/v\\d/(view|error)$')"),
    "in": ("tenant.id", ["tenant-1", "tenant-4"], "attr_tenant IN ('tenant-1', 'tenant-4')"),
    "exists": ("db.system", None, "attr_db_system IS NOT NULL"),
    "gt": ("http.status_code", 300, "attr_http_status::DOUBLE > 300"),
    "gte": ("http.status_code", "300", "attr_http_status::DOUBLE >= 300"),
    "lt": ("http.status_code", 300, "attr_http_status::DOUBLE < 300"),
    "lte": ("http.status_code", 300.0, "attr_http_status::DOUBLE <= 300"),
}


def _match(key: str, op: str, value: object) -> Query:
    return lambda spark, d: _spans(spark, d).select("seq", matching.attribute(F.col("attributes"), key, op, value).alias("hit"))


for _op, (_key, _value, _text) in _MATCHES.items():
    _add(f"match_{_op}", f"SELECT seq, {_text} AS hit FROM spans")(_match(_key, _op, _value))

_FAR = 1 << 60
RULES = [
    rules.Rule.of({"id": "a", "expires_at_ms": _FAR, "priority": 200, "action": "force_drop", "match": {"resource": [{"key": "service.name", "op": "eq", "value": "svc-2"}]}}),
    rules.Rule.of({"id": "b", "expires_at_ms": _FAR, "priority": 100, "match": {"span": [{"key": "http.route", "op": "ends_with", "value": "/purchase"}, {"key": "http.status_code", "op": "gte", "value": 500}]}}),
    rules.Rule.of({"id": "c", "expires_at_ms": _FAR, "priority": 100, "action": "force_drop", "match": {"resource": [{"key": "tenant.id", "op": "in", "values": ["tenant-4"]}], "span": [{"key": "db.system", "op": "exists"}]}}),
    rules.Rule.of({"id": "gone", "expires_at_ms": 0, "priority": 900, "match": {"resource": [{"key": "service.name", "op": "exists"}]}}),
    rules.Rule.of({"id": "off", "expires_at_ms": _FAR, "priority": 900, "enabled": False, "match": {"resource": [{"key": "service.name", "op": "exists"}]}}),
]
_FORCED = """, flags AS (
  SELECT trace_id, arg_min(service_name, seq) AS s, arg_min(attr_tenant, seq) AS t, bool_or(attr_http_route LIKE '%/purchase' AND attr_http_status::INT >= 500) AS b, bool_or(attr_db_system IS NOT NULL) AS c
  FROM spans GROUP BY trace_id),
forced AS (SELECT trace_id, CASE WHEN s = 'svc-2' THEN 'force_drop' WHEN b THEN 'force_keep' WHEN t = 'tenant-4' AND c THEN 'force_drop' END AS force FROM flags)
"""


@_add("rule_first_match", _FORCED + "SELECT trace_id, force FROM forced")
def rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    return rules.with_rule_action(_spans(spark, d), RULES, _now(spark, d)).select("trace_id", "force")


@_add("resource_attributes", "SELECT trace_id, arg_min(service_name, seq) || '/' || arg_min(attr_tenant, seq) || '/2' AS resource FROM spans GROUP BY trace_id")
def resource_attributes(spark: SparkSession, d: str) -> DataFrame:
    got = _spans(spark, d).groupBy("trace_id").agg(F.min_by("attributes", "seq").alias("a"), F.min_by("service_name", "seq").alias("s"))
    r = rules.resource_attributes(F.col("a"), F.col("s"))
    return got.withColumn("r", r).select("trace_id", F.concat_ws("/", F.col("r")["service.name"], F.col("r")["tenant.id"], F.size("r").cast("string")).alias("resource"))


@_add("rule_decisions", _FORCED + "SELECT trace_id, CASE WHEN state = 'active' THEN CASE WHEN force = 'force_keep' THEN 'keep' ELSE 'pending' END WHEN force = 'force_drop' THEN 'drop' ELSE decision END AS decision FROM decided JOIN forced USING (trace_id)")
def rule_decisions(spark: SparkSession, d: str) -> DataFrame:
    return decide.decide(_spans(spark, d), _now(spark, d), Config(app=APP), RULES).select("trace_id", "decision")


@_add("force_drop_override", _FORCED + "SELECT trace_id FROM decided JOIN forced USING (trace_id) WHERE decision = 'keep' AND force = 'force_drop'")
def force_drop_override(spark: SparkSession, d: str) -> DataFrame:
    plain = sampling_decisions(spark, d).where("decision = 'keep'").select("trace_id")
    return plain.join(rule_decisions(spark, d).where("decision = 'drop'").select("trace_id"), "trace_id", "left_semi")


@_add("force_keep_active", _FORCED + "SELECT trace_id FROM decided JOIN forced USING (trace_id) WHERE state = 'active' AND force = 'force_keep'")
def force_keep_active(spark: SparkSession, d: str) -> DataFrame:
    return decide.decide(_spans(spark, d), _now(spark, d), Config(app=APP), RULES).where("state = 'active' AND decision = 'keep'").select("trace_id")


_EXPORTED = "x AS (SELECT trace_id FROM summary WHERE service_name IN ('svc-1', 'svc-5'))"


@_add("dedup_exported", f", {_EXPORTED} SELECT trace_id FROM life WHERE state <> 'active' AND trace_id NOT IN (SELECT trace_id FROM x)")
def dedup_exported(spark: SparkSession, d: str) -> DataFrame:
    done = _summary(spark, d).where(F.col("service_name").isin("svc-1", "svc-5"))
    return decide.unexported(ready_traces(spark, d).select("trace_id"), done)


@_add("purge_exported", f", {_EXPORTED} SELECT trace_id, CASE WHEN state <> 'active' AND trace_id IN (SELECT trace_id FROM x) THEN 'purge' ELSE decision END AS decision FROM decided")
def purge_exported(spark: SparkSession, d: str) -> DataFrame:
    done = _summary(spark, d).where(F.col("service_name").isin("svc-1", "svc-5"))
    return decide.decide(_spans(spark, d), _now(spark, d), Config(app=APP), exported=done).select("trace_id", "decision")


@_add("unprocessed_traces", "SELECT trace_id FROM life WHERE state = 'active'")
def unprocessed_traces(spark: SparkSession, d: str) -> DataFrame:
    return summary.without(summary.trace_ids(_spans(spark, d)), ready_traces(spark, d))


# ---- compression ---------------------------------------------------------------------------------------------


@_add("normalize_statement", "SELECT seq, normalized_statement FROM keyed")
def normalize_statement(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("seq", matching.generic_statement(F.col("operation_name")).alias("normalized_statement"))


@_add("operation_type", "SELECT seq, operation_type FROM typed")
def operation_type(spark: SparkSession, d: str) -> DataFrame:
    n = matching.generic_statement(F.col("operation_name"))
    return _spans(spark, d).select("seq", matching.operation_type(F.col("operation_name"), F.col("attributes"), n).alias("operation_type"))


@_add("custom_patterns", "SELECT seq, CASE WHEN contains(operation_name, 'FROM purchase') THEN 'purchases' WHEN regexp_matches(operation_name, 'FROM (view|click) ') THEN 'looks' ELSE normalized_statement END AS statement FROM keyed")
def custom_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("seq", matching.statement(F.col("operation_name"), F.col("attributes"), PATTERNS).alias("statement"))


@_add("eligible_spans", "SELECT seq FROM spans WHERE operation_name <> 'SELECT * FROM view WHERE k = 1' AND (contains(operation_name, 'view') OR contains(service_name, 'view') OR contains(operation_name, 'svc-3') OR contains(service_name, 'svc-3')) AND duration_ms <= 20000")
def eligible_spans(spark: SparkSession, d: str) -> DataFrame:
    c = Compression(exclude=["SELECT * FROM view WHERE k = 1"], only=["view", "svc-3"], max_span_secs=20)
    return _spans(spark, d).where(compress.eligible(c)).select("seq")


@_add("group_keys", "SELECT seq, trace_id, service_name, operation_type, normalized_statement, parent_span_id FROM typed WHERE duration_ms <= 60000")
def group_keys(spark: SparkSession, d: str) -> DataFrame:
    return compress.with_group_key(_spans(spark, d)).select("seq", *compress.KEY)


_GROUP = "trace_id, service_name, operation_type, normalized_statement, parent_span_id, timestamp_ms, last_timestamp_ms, total_duration_ms, span_count, error_count, mean_duration_ms, min_duration_ms, max_duration_ms, operation_name"


@_add("compressed_groups", f"SELECT {_GROUP}, original_span_ids, span_id FROM groups_wide")
def compressed_groups(spark: SparkSession, d: str) -> DataFrame:
    return compress.compress(_spans(spark, d), WIDE).select(*_GROUP.split(", "), F.array_join("original_span_ids", ",").alias("original_span_ids"), "span_id")


@_add("compression_residual", f"SELECT {_QUERIES_SPAN} FROM spans ANTI JOIN absorbed USING (trace_id, span_id)")
def compression_residual(spark: SparkSession, d: str) -> DataFrame:
    _, rest = compress.split(_spans(spark, d), WIDE)
    return rest.select(*_QUERIES_SPAN.split(", "))


@_add("residual_anti_join", f"SELECT {_QUERIES_SPAN} FROM spans ANTI JOIN absorbed USING (trace_id, span_id)")
def residual_anti_join(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    return compress.residual(s, compress.compress(s, WIDE)).select(*_QUERIES_SPAN.split(", "))


@_add("compression_summary", "SELECT count(*) AS n_groups, sum(span_count)::BIGINT AS n_members, sum(total_duration_ms)::BIGINT AS sum_ms FROM groups_wide")
def compression_summary(spark: SparkSession, d: str) -> DataFrame:
    return compress.compress(_spans(spark, d), WIDE).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("span_count").alias("n_members"), F.sum("total_duration_ms").alias("sum_ms"))


@_add("significant_groups", "SELECT span_id, error_count > 0 OR max_duration_ms > 40000 AS significant FROM groups_wide")
def significant_groups(spark: SparkSession, d: str) -> DataFrame:
    return compress.compress(_spans(spark, d), WIDE).select("span_id", compress.significant(40_000).alias("significant"))


@_add("group_percentiles", ", g AS (SELECT trace_id, service_name, operation_type, normalized_statement, parent_span_id, list_sort(list(duration_ms)) AS l, count(*) AS span_count FROM typed WHERE duration_ms <= 60000 GROUP BY ALL) SELECT trace_id, service_name, operation_type, normalized_statement, parent_span_id, span_count, " + ", ".join(f"l[least(span_count, span_count * {p} // 100 + 1)] AS p{p}_ms" for p in (50, 95, 99)) + ", round(list_stddev_pop(l), 3) AS stddev_ms FROM g")
def group_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return compress.duration_percentiles(_spans(spark, d)).withColumn("stddev_ms", F.round("stddev_ms", 3))


# ---- export --------------------------------------------------------------------------------------------------

_META = ("span_kind", "service", "trace_id", "span_id", "parent_id", "error_message", "error_type")


def _scalars(rows: DataFrame, tags: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    picked = [F.try_element_at("meta", F.lit(t)).alias("meta_" + t.replace(".", "_")) for t in tags]
    return rows.select("id", "trace_id", "parent_id", "name", "resource", "service", "type", "start_ns", "end_ns", "duration_ns", "error", *picked, *more, F.array_join("child_span_ids", ",").alias("children"))


@_add("export_plain", """SELECT span_id AS id, trace_id, parent_span_id AS parent_id, operation_name AS name, operation_name AS resource, service_name AS service, 'custom' AS type,
  timestamp_ms * 1000000 AS start_ns, (timestamp_ms + duration_ms) * 1000000 AS end_ns, duration_ms * 1000000 AS duration_ns, status_code AS error,
  CASE span_kind WHEN 1 THEN 'Server' WHEN 2 THEN 'Client' WHEN 3 THEN 'Producer' WHEN 4 THEN 'Consumer' ELSE 'Unspecified' END AS meta_span_kind, service_name AS meta_service, trace_id AS meta_trace_id,
  span_id AS meta_span_id, parent_span_id AS meta_parent_id, CASE WHEN status_code = 2 THEN 'Error status' END AS meta_error_message, CASE WHEN status_code = 2 THEN 'error' END AS meta_error_type, '' AS children FROM spans""")
def export_plain(spark: SparkSession, d: str) -> DataFrame:
    return _scalars(export.plain_rows(_spans(spark, d)), _META)


_GROUP_META = ("compression.type", "compression.count", "compression.total_duration_ms", "compression.mean_duration_ms", "compression.min_duration_ms", "compression.max_duration_ms", "compression.group_signature",
               "span.type", "tenant.id", "http.route", "service", "trace_id", "span_id", "parent_id", "error_message", "error_type")
_GROUP_METRICS = ("sampling_rate", "compression.count", "compression.total_ms", "compression.mean_ms", "compression.errors")
_PLAIN_COLUMNS = """span_id AS id, trace_id, parent_span_id AS parent_id, operation_name AS name, operation_name AS resource, service_name AS service, 'custom' AS type,
  timestamp_ms * 1000000 AS start_ns, (timestamp_ms + duration_ms) * 1000000 AS end_ns, duration_ms * 1000000 AS duration_ns, status_code AS error"""
_GROUP_COLUMNS = """span_id AS id, trace_id, parent_span_id AS parent_id, operation_name || ' (aggregated)' AS name, normalized_statement AS resource, service_name AS service, 'analytics' AS type,
  timestamp_ms * 1000000 AS start_ns, last_timestamp_ms * 1000000 AS end_ns, total_duration_ms * 1000000 AS duration_ns, (error_count > 0)::INT AS error"""


@_add("export_compressed", f"""SELECT {_GROUP_COLUMNS}, 'aggregated' AS meta_compression_type, span_count::VARCHAR AS meta_compression_count, total_duration_ms::VARCHAR AS meta_compression_total_duration_ms,
  printf('%.2f', mean_duration_ms) AS meta_compression_mean_duration_ms, min_duration_ms::VARCHAR AS meta_compression_min_duration_ms, max_duration_ms::VARCHAR AS meta_compression_max_duration_ms,
  normalized_statement AS meta_compression_group_signature, 'analytics' AS meta_span_type, (SELECT attr_tenant FROM spans s WHERE s.trace_id = g.trace_id AND s.span_id = g.first_id) AS meta_tenant_id,
  (SELECT attr_http_route FROM spans s WHERE s.trace_id = g.trace_id AND s.span_id = g.first_id) AS meta_http_route, service_name AS meta_service, trace_id AS meta_trace_id, span_id AS meta_span_id, parent_span_id AS meta_parent_id,
  CASE WHEN error_count > 0 THEN error_count || ' errors out of ' || span_count || ' requests' END AS meta_error_message, CASE WHEN error_count > 0 THEN 'partial_failure' END AS meta_error_type,
  1.0::DOUBLE AS metric_sampling_rate, span_count::DOUBLE AS metric_compression_count, total_duration_ms::DOUBLE AS metric_compression_total_ms, mean_duration_ms AS metric_compression_mean_ms, error_count::DOUBLE AS metric_compression_errors,
  original_span_ids AS children FROM (SELECT *, string_split(original_span_ids, ',')[1] AS first_id FROM groups_wide) g""")
def export_compressed(spark: SparkSession, d: str) -> DataFrame:
    rows = export.compressed_rows(compress.compress(_spans(spark, d), WIDE))
    for m in _GROUP_METRICS:
        rows = rows.withColumn("metric_" + m.replace(".", "_"), F.try_element_at("metrics", F.lit(m)))
    return _scalars(rows, _GROUP_META, tuple("metric_" + m.replace(".", "_") for m in _GROUP_METRICS))


@_add("export_rows", f"""SELECT {_GROUP_COLUMNS}, span_count::VARCHAR AS meta_compression_count, NULL AS meta_span_kind, original_span_ids AS children FROM groups_wide
  UNION ALL SELECT {_PLAIN_COLUMNS}, NULL, CASE span_kind WHEN 1 THEN 'Server' WHEN 2 THEN 'Client' WHEN 3 THEN 'Producer' WHEN 4 THEN 'Consumer' ELSE 'Unspecified' END, '' FROM spans ANTI JOIN absorbed USING (trace_id, span_id)""")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    return _scalars(export.export_rows(_spans(spark, d), WIDE), ("compression.count", "span_kind"))


_SHARD = "('0x' || substr(md5(trace_id), 1, 8))::BIGINT % 64"


@_add("export_batches", f"SELECT span_id AS id, trace_id, ({_SHARD})::INT AS shard, ((row_number() OVER (PARTITION BY {_SHARD} ORDER BY trace_id, timestamp_ms, span_id)) - 1) // 100 AS batch_no FROM spans WHERE trace_id IN (SELECT trace_id FROM decided WHERE decision = 'keep')")
def export_batches(spark: SparkSession, d: str) -> DataFrame:
    kept = summary.spans_of(_spans(spark, d), sampling_decisions(spark, d).where("decision = 'keep'"))
    return export.batches(export.plain_rows(kept)).select("id", "trace_id", "shard", "batch_no")


# ---- reports and SQL -----------------------------------------------------------------------------------------


@_add("slowest_traces", "SELECT trace_id, max(duration_ms) AS max_duration_ms, count(*) AS span_count FROM spans GROUP BY trace_id ORDER BY 2 DESC, 1 LIMIT 20")
def slowest_traces(spark: SparkSession, d: str) -> DataFrame:
    return analytics.slowest_traces(_spans(spark, d))


@_add("error_traces", "SELECT seq, trace_id, span_id, service_name, operation_name, timestamp_ms, duration_ms FROM spans WHERE status_code = 2 ORDER BY timestamp_ms DESC, seq DESC LIMIT 20")
def error_traces(spark: SparkSession, d: str) -> DataFrame:
    return analytics.error_traces(_spans(spark, d))


@_add("service_stats", "SELECT service_name, count(*) AS span_count, count(DISTINCT trace_id) AS trace_count, avg(duration_ms) AS avg_duration_ms, max(duration_ms) AS max_duration_ms, sum((status_code = 2)::INT)::BIGINT AS error_count FROM spans GROUP BY service_name")
def service_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.service_stats(_spans(spark, d))


_STATEMENTS = {
    "join": "SELECT a.trace_id, a.span_id, b.span_id AS child_id FROM spans a LEFT JOIN spans b ON b.trace_id = a.trace_id AND b.parent_span_id = a.span_id WHERE a.status_code = 2",
    "right_join": "SELECT a.span_id AS parent_id, b.span_id FROM spans a RIGHT JOIN spans b ON b.trace_id = a.trace_id AND b.parent_span_id = a.span_id AND a.status_code = 0",
    "full_join": "SELECT coalesce(a.trace_id, b.trace_id) AS trace_id, a.n AS errors, b.n AS views FROM (SELECT trace_id, count(*) AS n FROM spans WHERE status_code = 2 GROUP BY trace_id) a FULL JOIN (SELECT trace_id, count(*) AS n FROM spans WHERE span_kind = 4 GROUP BY trace_id) b ON a.trace_id = b.trace_id",
    "range_join": "SELECT a.seq, count(*) AS near FROM spans a JOIN spans b ON a.trace_id = b.trace_id AND b.timestamp_ms BETWEEN a.timestamp_ms AND a.timestamp_ms + 60000 GROUP BY a.seq",
    "hinted_join": "SELECT /*+ BROADCAST(g) */ s.seq, g.n FROM spans s JOIN (SELECT service_name, count(*) AS n FROM spans GROUP BY service_name) g ON g.service_name = s.service_name",
    "semi_join": "SELECT seq FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE status_code = 2)",
    "anti_join": "SELECT seq FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans e WHERE e.trace_id = s.trace_id AND e.status_code = 2)",
    "window": "SELECT seq, rank() OVER (PARTITION BY service_name ORDER BY duration_ms DESC, seq) AS r, lag(duration_ms) OVER (PARTITION BY trace_id ORDER BY seq) AS before, sum(duration_ms) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM spans",
    "ranking": "SELECT seq, row_number() OVER w AS n, dense_rank() OVER (PARTITION BY service_name ORDER BY status_code) AS d, ntile(4) OVER w AS quarter, first_value(span_id) OVER w AS first_id, lead(seq) OVER w AS after FROM spans WINDOW w AS (PARTITION BY trace_id ORDER BY seq)",
    "range_frame": "SELECT seq, count(*) OVER (PARTITION BY trace_id ORDER BY timestamp_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS n FROM spans",
    "set_ops": "SELECT service_name, status_code FROM spans WHERE status_code = 2 UNION SELECT service_name, span_kind FROM spans WHERE span_kind = 3 EXCEPT SELECT 'svc-1', 2",
    "intersect": "SELECT trace_id FROM spans WHERE status_code = 2 INTERSECT SELECT trace_id FROM spans WHERE status_code = 1",
    "cte": "WITH sized AS (SELECT trace_id, count(*) AS n FROM spans GROUP BY trace_id HAVING count(*) > 5), large AS (SELECT * FROM sized WHERE n > 8) SELECT s.n, count(*) AS traces, count(l.n) AS large FROM sized s LEFT JOIN large l ON l.trace_id = s.trace_id GROUP BY s.n",
    "recursive": "WITH RECURSIVE steps(k, ms) AS (SELECT 0, CAST(1000 AS BIGINT) UNION ALL SELECT k + 1, ms * 2 FROM steps WHERE k < 8) SELECT k, count(*) AS n FROM steps JOIN spans ON duration_ms >= ms AND duration_ms < ms * 2 GROUP BY k",
    "values": "SELECT label, count(*) AS n FROM (VALUES (0, 'fine'), (1, 'bought'), (2, 'failed')) AS t(code, label) JOIN spans ON status_code = code GROUP BY label",
    "rollup": "SELECT service_name, status_code, count(*) AS n, max(duration_ms) AS longest FROM spans GROUP BY ROLLUP (service_name, status_code)",
    "cube": "SELECT span_kind, status_code, count(*) AS n FROM spans GROUP BY CUBE (span_kind, status_code)",
    "grouping_sets": "SELECT service_name, span_kind, grouping(service_name) AS g, count(*) AS n FROM spans GROUP BY GROUPING SETS ((service_name), (span_kind), ())",
    "filter": "SELECT service_name, count(*) FILTER (WHERE status_code = 2) AS errors, count(DISTINCT trace_id) AS traces, max(duration_ms) FILTER (WHERE span_kind = 4) AS longest FROM spans GROUP BY service_name",
    "approximate": "SELECT service_name, abs(approx_count_distinct(trace_id) - count(DISTINCT trace_id)) <= 0.25 * count(DISTINCT trace_id) AS near FROM spans GROUP BY service_name",
    "subquery": "SELECT seq FROM spans s WHERE duration_ms > (SELECT avg(duration_ms) FROM spans i WHERE i.service_name = s.service_name) AND EXISTS (SELECT 1 FROM spans e WHERE e.trace_id = s.trace_id AND e.status_code = 2)",
    "offset": "SELECT seq, duration_ms FROM spans ORDER BY duration_ms DESC, seq LIMIT 25 OFFSET 10",
    "scalar": "SELECT seq, upper(service_name) AS u, substring(operation_name, 15, 6) AS part, length(operation_name) AS n, replace(trace_id, 'U', 'u') AS t, coalesce(parent_span_id, 'none') AS p, nullif(status_code, 0) AS s, CASE WHEN duration_ms > 1000 THEN 'slow' ELSE 'quick' END AS speed, greatest(duration_ms, 500) AS g, abs(status_code - 1) AS a, concat(service_name, '/', span_id) AS c FROM spans",
    "ready_traces": "SELECT trace_id, max(timestamp_ms) AS last_ms FROM spans WHERE timestamp_ms > 0 GROUP BY trace_id HAVING (SELECT max(timestamp_ms) FROM spans) - max(timestamp_ms) > 60000",
}
#: Where DuckDB needs other words for the same.
_OTHERWISE = {"window": ("sum(duration_ms) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "(sum(duration_ms) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT")}


def _beside_ctes(text: str) -> str:
    """A statement after the common CTEs: one that has CTEs of its own goes on with the list."""
    return ", " + text.removeprefix("WITH ").removeprefix("RECURSIVE ") if text.startswith("WITH ") else text


for _name, _text in _STATEMENTS.items():
    _add(f"sql_{_name}", _beside_ctes(_text.replace(*_OTHERWISE.get(_name, ("\0", "")))))(lambda spark, d, t=_text: analytics.query(spark, t, _spans(spark, d)))


@_add("sql_unnest", "SELECT seq, unnest(string_split(operation_name, ' ')) AS word FROM spans")
def sql_unnest(spark: SparkSession, d: str) -> DataFrame:
    return analytics.query(spark, "SELECT seq, word FROM spans LATERAL VIEW explode(split(operation_name, ' ')) t AS word", _spans(spark, d))


@_add("sql_maps", "SELECT seq, attr_tenant AS tenant, attr_db_system IS NOT NULL AS db, 3 + (attr_db_system IS NOT NULL)::INT AS n FROM spans")
def sql_maps(spark: SparkSession, d: str) -> DataFrame:
    return analytics.query(spark, "SELECT seq, attributes['tenant.id'] AS tenant, map_contains_key(attributes, 'db.system') AS db, size(map_keys(attributes)) AS n FROM spans", _spans(spark, d))


# ---- streams -------------------------------------------------------------------------------------------------


def _stream_files(spark: SparkSession, d: str, parts: int = 3) -> str:
    """Spans in files of whole traces, so that times go back from file to file; returns a new folder of the shared one."""
    root = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    part = F.pmod(F.conv(F.substring(F.md5("trace_id"), 1, 4), 16, 10).cast("int"), F.lit(parts))
    _spans(spark, d).repartition(parts, part).write.parquet(f"{root}/in")
    return root


@_add("stream_decisions", "SELECT trace_id, decision FROM decided WHERE decision <> 'pending'")
def stream_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What a drained stream decides, a file for each micro-batch."""
    root = _stream_files(spark, d)
    sampler = Sampler(f"{root}/state", Config(app=APP))
    sampler.start(span_stream(spark, f"{root}/in", files_per_trigger=1)).awaitTermination()
    return sampler.decisions(spark).select("trace_id", "decision")


@_add("stream_pending", f"SELECT {_QUERIES_SPAN} FROM spans WHERE trace_id IN (SELECT trace_id FROM decided WHERE decision = 'pending')")
def stream_pending(spark: SparkSession, d: str) -> DataFrame:
    """What a drained stream still holds: the spans of open traces, and nothing that was decided."""
    root = _stream_files(spark, d)
    sampler = Sampler(f"{root}/state", Config(app=APP))
    sampler.start(span_stream(spark, f"{root}/in", files_per_trigger=1)).awaitTermination()
    return sampler.pending(spark).select(*_QUERIES_SPAN.split(", "))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
