"""Cases the queries' data doesn't hold."""

import http.server
import json
import struct
import threading

import pytest
from pyspark.sql import functions as F

from tracewell.config import App, Compression, Config, load
from tracewell.functions import matching
from tracewell.operators import analytics, compress, decide, export, lifecycle, policies, rules, summary
from tracewell.schema import SPAN, check_spans
from tracewell.sources import spans as sources
from tracewell.streaming.sampler import Sampler, TokenBucket, session_stream, span_stream


def spans(spark, *rows):
    base = {"seq": 0, "trace_id": "t", "span_id": "s", "parent_span_id": None, "timestamp_ms": 1000, "duration_ms": 100, "status_code": 0, "span_kind": 1, "service_name": "svc", "operation_name": "op", "attributes": {}}
    return spark.createDataFrame([{**base, "seq": i, "span_id": f"s{i}", **r} for i, r in enumerate(rows)], SPAN)


def one(df):
    return df.collect()[0]


def test_summary_follows_arrival(spark):
    df = spans(spark, {"service_name": "first", "status_code": 2}, {"service_name": "second", "timestamp_ms": 500}, {"parent_span_id": "s0", "duration_ms": -5})
    r = one(summary.summarize(df))
    assert (r.service_name, r.root_span_id, r.span_count, r.error_count, r.min_timestamp_ms, r.max_duration_ms) == ("first", "s1", 3, 1, 500, 100)
    assert summary.summarize(df.limit(0)).count() == 0


@pytest.mark.parametrize(("idle", "root", "want"), [(30_000, None, "active"), (30_001, None, "ready"), (300_000, "p", "active"), (300_001, "p", "ready"), (3_600_001, "p", "force")])
def test_states_are_strict(spark, idle, root, want):
    s = summary.summarize(spans(spark, {"parent_span_id": root}))
    assert one(lifecycle.with_state(s, 1000 + idle)).state == want


@pytest.mark.parametrize(
    ("op", "value", "attr", "want"),
    [
        ("eq", "a", "a", True), ("eq", 5, "5", False), ("neq", "a", "b", True), ("neq", 5, "a", True), ("neq", "a", None, False), ("contains", "b", "abc", True), ("starts_with", "ab", "abc", True),
        ("ends_with", "bc", "abc", True), ("regex", r"/users/\d+", "/users/12", True), ("regex", r"c$", "abc\n", False), ("in", ["x", "a"], "a", True), ("in", "a", "a", False), ("exists", None, "", True),
        ("exists", None, None, False), ("gte", 500, "503", True), ("gte", 500, "200", False), ("gt", "500", "500", False), ("lt", 5, " 5 ", False), ("lte", 5, "5d", False), ("gt", 1, "NaN", False),
        ("gt", 1, "inf", True), ("lt", 1, "-inf", True), ("gt", True, "5", False), ("lte", 5, "5e0", True),
    ],
)
def test_attribute_matchers(spark, op, value, attr, want):
    attrs = F.create_map().cast("map<string,string>") if attr is None else F.create_map(F.lit("k"), F.lit(attr))
    assert one(spark.range(1).select(matching.attribute(attrs, "k", op, value).alias("x"))).x is want


def test_matchers_refuse(spark):
    for op, v in (("regex", "("), ("regex", 5), ("regex", r"(?=a)"), ("like", "a")):
        with pytest.raises(ValueError):
            matching.attribute(F.create_map().cast("map<string,string>"), "k", op, v)


def test_patterns_of_java(spark):
    """Unicode classes are valid; what isn't regular, or Java refuses, is no pattern."""
    df = spark.createDataFrame([("żółw",), ("a1",), (None,)], "x string")
    assert [r.m for r in df.select(matching.matches(F.col("x"), "regex", ["v"], r"^\p{L}+$").alias("m")).collect()] == [True, False, False]
    assert [matching.search(p) for p in ("(?>a)", r"(a)\1", "[", r"(?<n>a)\k<n>", "a{2,1}")] == [None] * 5 and matching.search(r"\\1")
    assert [r.m for r in df.select(matching.matches(F.col("x"), "prefix", ["q", "a"]).alias("m")).collect()] == [False, True, False]


def test_statement_normalisation(spark):
    df = spark.createDataFrame([("select  * from t where a = 'x y' and b = 12 and c = \"q\" ٣",)], "n string")
    assert one(df.select(matching.generic_statement(F.col("n")).alias("x"))).x == "SELECT * FROM T WHERE A = ? AND B = ? AND C = ? ?"


def test_empty_trees_and_lists(spark):
    s = summary.summarize(spans(spark, {}))
    assert one(s.select(policies.condition({"and": []}).alias("x"))).x is True
    assert one(s.select(policies.condition({"or": []}).alias("x"))).x is False
    got = {k: one(s.select(policies.combine(policies.results([]), k).alias("x"))).x for k in ("any", "all", "consensus", "priority")}
    assert got == {"any": "drop", "all": "keep", "consensus": "drop", "priority": "drop"}
    with pytest.raises(ValueError):
        policies.condition({"nope": 1})


def test_draws_are_stable_and_fair(spark):
    df = spark.range(4000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("trace_id"))
    kept = df.where(policies.drawn(0.25, "p"))
    assert 0.2 < kept.count() / 4000 < 0.3
    assert kept.exceptAll(df.where(policies.drawn(0.25, "p"))).count() == 0


def test_decision_scopes(spark):
    df = spans(spark, {"trace_id": "done"}, {"trace_id": "live", "timestamp_ms": 10_000_000}, {"trace_id": "bad", "status_code": 2})
    rule = rules.Rule.of({"id": "r", "expires_at_ms": 1 << 60, "match": {"resource": [{"key": "service.name", "op": "exists"}]}})
    run = lambda c, *r: {x.trace_id: x.decision for x in decide.decide(df, 10_000_000, c, r).collect()}
    config = Config()
    assert run(config) == {"done": "drop", "live": "pending", "bad": "keep"}
    assert run(config, rule) == {"done": "drop", "live": "keep", "bad": "keep"}
    config.sampling.force_keep_scope = "all"
    assert run(config, rule)["done"] == "keep"
    rule.action = "force_drop"
    assert run(config, rule) == {"done": "drop", "live": "pending", "bad": "drop"}
    config.sampling.sample_latency = config.sampling.always_sample_errors = False
    assert run(config)["bad"] == "drop"


def test_span_matchers_need_one_span(spark):
    df = spans(spark, {"attributes": {"a": "1"}}, {"attributes": {"b": "2"}})
    rule = {"id": "r", "expires_at_ms": 1 << 60, "match": {"span": [{"key": "a", "op": "exists"}, {"key": "b", "op": "exists"}]}}
    assert one(rules.with_rule_action(df, [rules.Rule.of(rule)], 0)).force is None
    rule["match"]["span"].pop()
    assert one(rules.with_rule_action(df, [rules.Rule.of(rule)], 0)).force == "force_keep"


def test_rule_store(spark, tmp_path):
    now = [1_000_000]
    store = rules.RuleStore(tmp_path, lambda: now[0])
    a = store.create({"resource": [{"key": "service.name", "op": "eq", "value": "x"}]}, 60, rule_id="a")
    store.create({"span": [{"key": "k", "op": "in", "values": ["v"]}]}, 600, rule_id="b", priority=500)
    assert [r.id for r in store.list()] == ["b", "a"] and store.active_count() == 2
    assert store.view(a)["remaining_secs"] == 60 and store.get("a").resource[0].value == "x"
    with pytest.raises(ValueError):
        store.create({"span": [{"key": "k", "op": "regex", "value": "("}]}, 60)
    store.disable("b")
    assert [r.id for r in store.active()] == ["a"]
    store.enable("b")
    now[0] += 61_000
    assert [r.id for r in store.active()] == ["b"]
    with pytest.raises(ValueError):
        store.enable("a")
    assert store.extend("a", 10).expires_at_ms == now[0] + 10_000
    now[0] += 11_000
    assert store.cleanup() == 1 and store.delete("b") and not store.delete("b")
    (tmp_path / "junk.json").write_text("{")
    assert store.list() == [] and store.cleanup() == 1


def test_compression_groups(spark):
    sql = {"attributes": {"db.statement": "s", "db.system": "postgresql"}}
    rows = [{**sql, "operation_name": f"SELECT {i}", "duration_ms": d, "parent_span_id": "p"} for i, d in enumerate((10, 15, 20))]
    rows += [{**sql, "operation_name": f"INSERT {i}", "duration_ms": d, "parent_span_id": "p"} for i, d in enumerate((5, 8))] + [{"operation_name": "http.request"}]
    df = spans(spark, *rows)
    got = compress.compress(df, Compression(min_count=2))
    assert sorted((r.span_count, r.total_duration_ms, r.operation_type) for r in got.collect()) == [(2, 13, "db.postgresql.insert"), (3, 45, "db.postgresql.select")]
    assert [r.operation_name for r in compress.residual(df, got).collect()] == ["http.request"]
    assert compress.compress(df, Compression(min_count=5)).count() == 0
    assert compress.compress(spans(spark, {"duration_ms": 70_000}), Compression(min_count=1)).count() == 0
    late = spans(spark, {}, {}, {"timestamp_ms": 62_000})
    assert compress.compress(late, Compression(min_count=2)).count() == 0
    r = one(compress.compress(spans(spark, {"duration_ms": 10}, {"duration_ms": 20}, {"duration_ms": 30})))
    assert (r.mean_duration_ms, r.min_duration_ms, r.max_duration_ms, r.original_span_ids) == (20.0, 10, 30, ["s0", "s1", "s2"])


def test_export_rows(spark):
    df = spans(spark, {"status_code": 2}, {"status_code": 2}, {}, {"operation_name": "alone"})
    rows = {r.name: r for r in export.export_rows(df).collect()}
    group = rows["op (aggregated)"]
    assert group.meta["error_message"] == "2 errors out of 3 requests" and group.meta["compression.mean_duration_ms"] == "100.00"
    assert group.metrics["compression.count"] == 3.0 and group.error == 1 and len(group.child_span_ids) == 3
    assert "error_message" not in rows["alone"].meta and rows["alone"].end_ns - rows["alone"].start_ns == 100_000_000
    body = json.loads(one(export.to_json(export.plain_rows(df.limit(1)))).body)
    assert "parent_id" not in body and body["error"] == 2
    assert [r.batch_no for r in export.batches(export.plain_rows(df), size=3).orderBy("batch_no").collect()] == [0, 0, 0, 1]
    two = spans(spark, {"trace_id": "a"}, {"trace_id": "b"}, {"trace_id": "b"})
    assert {r.shard for r in export.batches(export.plain_rows(two), shards=2).collect()} <= {0, 1}
    no_attributes = export.compressed_rows(compress.compress(spans(spark, {"duration_ms": 1}, {"duration_ms": 2}, {"duration_ms": 2})))
    assert one(no_attributes).meta["compression.mean_duration_ms"] == "1.67"


@pytest.fixture
def receiver():
    """A server that keeps what is posted to it; it refuses bodies that name the operation "bad"."""
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            fine = all(r["name"] != "bad" for r in body["data"])
            if fine:
                got.append(body["data"])
            self.send_response(202 if fine else 500)
            self.end_headers()

        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", got
    server.shutdown()


def test_posts_are_the_numbered_batches(spark, receiver):
    url, got = receiver
    df = spans(spark, *[{"trace_id": f"t{k % 9}", "span_id": f"x{k}"} for k in range(100)])
    rows = export.batches(export.plain_rows(df), size=7, shards=3)
    writer = export.HttpWriter(url, size=7, retries=0)
    assert writer.healthy()
    sent = writer.write(rows).collect()
    assert len(sent) == 100 and all(r.sent for r in sent)
    want = {}
    for r in rows.collect():
        want.setdefault((r.shard, r.batch_no), set()).add(r.id)
    assert sorted(sorted(r["id"] for r in body) for body in got) == sorted(map(sorted, want.values()))


def test_failed_posts_are_tried_with_the_next_batch(spark, receiver, tmp_path):
    url, got = receiver
    s = Sampler(f"file://{tmp_path}/state", writer=export.HttpWriter(url, retries=0))
    first = [{"trace_id": "good", "status_code": 2}, {"trace_id": "ill", "operation_name": "bad", "status_code": 2}, {"trace_id": "late", "timestamp_ms": 10_000_000}]
    s.process(spans(spark, *first), 0)
    assert {r.trace_id for r in s.decisions(spark).collect()} == {"good"} and {r["trace_id"] for body in got for r in body} == {"good"}
    assert {r.trace_id for r in s.pending(spark).collect()} == {"ill", "late"}


def test_numbered_batches_are_written_once(spark, tmp_path):
    w = export.TableWriter(str(tmp_path / "out"))
    rows = export.batches(export.plain_rows(spans(spark, {}, {})))
    for _ in range(2):
        assert w.write(rows, 3).count() == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_retries():
    calls, waits = [], []
    assert not export.retried(lambda: bool(calls.append(1)), 3, 1, waits.append)
    assert len(calls) == 4 and waits == [1, 2, 4]
    assert not export.HttpWriter("http://127.0.0.1:9", timeout=0.2, retries=0).healthy()


def test_sql_is_read_only(spark, tmp_path):
    df = spans(spark, {}, {})
    assert one(analytics.query(spark, "-- n\nSELECT count(*) AS n FROM spans", df)).n == 2
    out = str(tmp_path / "out")
    for text in (
        "DROP TABLE x", "INSERT INTO spans VALUES (1)", "CREATE TABLE y AS SELECT 1", "/* SELECT */ DELETE FROM spans", f"FROM spans INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT seq",
        f"WITH x AS (SELECT seq FROM spans) INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT * FROM x", "SET a = 1", "CACHE TABLE spans", "ADD JAR 'x'", "TRUNCATE TABLE spans", "CREATE TEMPORARY VIEW v AS SELECT 1",
        "FROM spans INSERT INTO a SELECT seq INSERT INTO b SELECT seq", "EXECUTE IMMEDIATE 'DROP TABLE x'", "SELECT reflect('java.lang.System', 'lineSeparator')", "USE DEFAULT", "REFRESH TABLE spans",
    ):
        with pytest.raises(ValueError, match="only queries"):
            analytics.query(spark, text, df)
    assert not (tmp_path / "out").exists()
    for text in ("(SELECT 1) UNION (SELECT 2)", "VALUES (1)", "TABLE spans", "FROM spans SELECT seq", "DESCRIBE spans", "WITH a AS (SELECT 1 AS x) SELECT * FROM a WHERE x IN (SELECT 1)"):
        analytics.query(spark, text, df).collect()
    assert analytics.text_rows(spark.sql("SELECT 1 AS a, CAST(2.345 AS DOUBLE) AS b, NULL AS c, true AS d, array(1) AS e"))["rows"] == [["1", "2.35", "null", "true", "<list>"]]


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"app": {"num_workers": 8}, "compression": {"enabled": false}}')
    c = load(p, env={"TRACEWELL__APP__NUM_WORKERS": "2", "TRACEWELL__SAMPLING__LATENCY_SAMPLE_RATE": "0.5", "OTHER": "x"})
    assert (c.app.num_workers, c.compression.enabled, c.sampling.latency_sample_rate, c.app.max_spans) == (2, False, 0.5, 1_000_000)
    p.write_text('{"sampling": {"sample_errors": true}}')
    with pytest.raises(ValueError):
        load(p)


def _field(n, data):
    return bytes([n << 3 | 2]) + bytes([len(data)]) + data


def _payload(resource=True, service=b"\x0a\x03web", status=True, parent=b"\x01" * 8):
    span = _field(1, b"\xab" * 16) + _field(2, b"\xcd" * 8) + (_field(4, parent) if parent else b"") + _field(5, b"GET") + b"\x30\x02"
    span += b"\x39" + struct.pack("<Q", 5_000_000) + b"\x41" + struct.pack("<Q", 8_999_999) + _field(9, _field(1, b"k") + _field(2, b"\x18\x07")) + (_field(15, b"\x18\x02") if status else b"")
    body = _field(2, _field(2, span))
    return (_field(1, _field(1, _field(1, b"service.name") + _field(2, service))) if resource else b"") + body


def test_otlp(spark):
    assert sources.decode_payload(b"") is None and sources.decode_payload(b"not protobuf") is None and sources.decode_payload(_payload(resource=False)) is None
    (s,) = sources.decode_payload(_payload())
    assert (s["trace_id"], s["service_name"], s["timestamp_ms"], s["duration_ms"], s["status_code"], s["span_kind"]) == ("AB" * 16, "web", 5, 3, 2, 2)
    assert s["attributes"] == {"service.name": "web", "k": "7"}
    (s,) = sources.decode_payload(_payload(service=b"\x18\x05", status=False, parent=b""))
    assert (s["service_name"], s["status_code"], s["parent_span_id"]) == ("unknown-service", 0, None)
    df = spark.createDataFrame([(3, _payload()), (4, b"x"), (5, None)], "n long, value binary")
    assert [(r.seq, r.parent_span_id) for r in sources.decode_otlp(df, seq_col="n").collect()] == [(3 << sources.PLACE_BITS, "01" * 8)]


def test_sources(spark, tmp_path):
    df = sources.generate(spark, 20, 5, error_percent=100)
    assert df.schema == SPAN or check_spans(df) is df
    assert summary.summarize(df).where("has_error").count() == 20 and one(summary.store_stats(df)).trace_count == 20
    assert summary.summarize(sources.generate_long(spark, 3, 7)).where("span_count = 7 AND error_count = 1").count() == 3
    sources.write_table(df, str(tmp_path / "t"))
    assert sources.read_table(spark, str(tmp_path / "t")).count() == 100
    df.write.json(str(tmp_path / "j"))
    assert sources.read_json(spark, str(tmp_path / "j")).count() == 100
    with pytest.raises(ValueError):
        check_spans(df.drop("duration_ms"))
    from tracewell.config import Catalog, Kafka

    o = sources.catalog_options(Catalog(name="c", uri="u", endpoint="http://s3", access_key="k"))
    assert o["spark.sql.catalog.c.uri"] == "u" and o["spark.sql.catalog.c.s3.access-key-id"] == "k" and "spark.sql.catalog.c.token" not in o
    assert sources.kafka_options(Kafka(sasl_mechanism="PLAIN", username="u", password="p"))["kafka.security.protocol"] == "SASL_SSL"


def test_message_numbers(spark):
    """Every partition that is allowed for fits with any offset that is; more than that raises."""
    df = spark.createDataFrame([(0, 0), (0, (1 << 40) - 1), (31, 7), (32, 5), (63, (1 << 40) - 1)], "partition int, offset long").withColumn("n", sources.message_number(F.col("partition"), F.col("offset")))
    numbers = [r.n for r in df.collect()]
    assert numbers == sorted(set(numbers)) and max(numbers) < 1 << 46
    decoded = sources.decode_otlp(df.select("n", F.lit(_payload()).alias("value")), seq_col="n").collect()
    assert [r.seq >> sources.PLACE_BITS for r in decoded] == numbers
    for wrong in ((64, 0), (0, 1 << 40)):
        with pytest.raises(Exception, match="leaves room"):
            spark.createDataFrame([wrong], "partition int, offset long").select(sources.message_number(F.col("partition"), F.col("offset"))).collect()


def test_token_bucket():
    now = [0.0]
    b = TokenBucket(10, 2, lambda: now[0])
    assert [b.take(), b.take()] == [0, 0] and b.take() == pytest.approx(0.1)
    now[0] = 0.1
    assert b.take() == 0


def test_stream_equals_batch(spark, small, tmp_path):
    every = sources.from_events(spark, f"{small}/events.parquet").cache()
    for k in range(3):
        every.where(F.floor(F.col("seq") / 400) == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    app = App(max_trace_duration_secs=2000)
    s = Sampler(f"file://{tmp_path}/state", Config(app=app))
    q = s.start(span_stream(spark, str(tmp_path / "in" / "*"), files_per_trigger=10))
    q.awaitTermination(120)
    want = decide.decide(every, lifecycle.latest(every), Config(app=app)).where("decision <> 'pending'")
    assert sorted((r.trace_id, r.decision) for r in s.decisions(spark).collect()) == sorted((r.trace_id, r.decision) for r in want.collect())
    before = s.decisions(spark).count()
    s.process(every.limit(0), 7)
    assert s.decisions(spark).count() == before


def test_staged_spans_shrink(spark, tmp_path):
    """Only what is undecided is carried on, and a batch that is tried again changes nothing."""
    s = Sampler(f"file://{tmp_path}/state")
    s.process(spans(spark, *[{"trace_id": f"t{k}", "timestamp_ms": 100 * k, "status_code": 2} for k in range(40)]), 0)
    assert s.pending(spark).count() == 40
    for _ in range(2):
        s.process(spans(spark, {"trace_id": "n", "timestamp_ms": 100_000_000}), 1)
        assert [r.trace_id for r in s.pending(spark).collect()] == ["n"] and s.decisions(spark).count() == 40
    s.process(spans(spark, {"trace_id": "t1", "timestamp_ms": 5000}, {"trace_id": "m", "timestamp_ms": 100_000_100}), 2)
    assert {r.trace_id for r in s.pending(spark).collect()} == {"n", "m"}
    assert [r.decision for r in s.decisions(spark).where("trace_id = 't1'").orderBy("batch").collect()] == ["keep", "purge"]
    assert sorted(p.name for p in (tmp_path / "state/pending").iterdir()) == ["batch=1", "batch=2"]


def test_session_stream_ages_and_late_spans(spark, tmp_path):
    """A trace cut by its age says so, and a span that comes after its trace has closed opens it anew."""
    out = session_stream(span_stream(spark, str(tmp_path / "in/*"), files_per_trigger=1))
    q = out.writeStream.format("memory").queryName("aged").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()

    def feed(name, *rows):
        spans(spark, *rows).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        q.processAllAvailable()

    try:
        feed("p1", {"trace_id": "long", "timestamp_ms": 1, "parent_span_id": "x"}, {"trace_id": "long", "timestamp_ms": 3_500_000, "parent_span_id": "x"}, {"trace_id": "idle", "timestamp_ms": 3_400_000, "parent_span_id": "x"})
        feed("p2", {"trace_id": "z", "timestamp_ms": 3_700_500, "parent_span_id": "x"})
        feed("p3", {"trace_id": "idle", "timestamp_ms": 3_400_500, "parent_span_id": "x"})
        feed("p4", {"trace_id": "z", "timestamp_ms": 3_800_000, "parent_span_id": "x"})
        feed("p5", {"trace_id": "z", "timestamp_ms": 3_800_001, "parent_span_id": "x"})
        got = sorted((r.trace_id, r.span_count, r.min_timestamp_ms, r.reason) for r in spark.table("aged").collect())
        assert got == [("idle", 1, 3_400_000, "ready"), ("idle", 1, 3_400_500, "ready"), ("long", 2, 1, "force")]
    finally:
        q.stop()


def test_session_stream(spark, tmp_path):
    rows = [{"trace_id": "a", "timestamp_ms": 1000}, {"trace_id": "a", "timestamp_ms": 2000, "parent_span_id": "s0", "status_code": 2}, {"trace_id": "b", "parent_span_id": "x", "timestamp_ms": 1500}]
    spans(spark, *rows).coalesce(1).write.parquet(str(tmp_path / "in/p1"))
    out = session_stream(span_stream(spark, str(tmp_path / "in/*"), files_per_trigger=1))
    q = out.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
        spans(spark, {"trace_id": "z", "timestamp_ms": 100_000}).coalesce(1).write.parquet(str(tmp_path / "in/p2"))
        q.processAllAvailable()
        q.processAllAvailable()
        got = {r.trace_id: (r.span_count, r.error_count, r.reason) for r in spark.table("closed").collect()}
        assert got == {"a": (2, 1, "ready")}
    finally:
        q.stop()
