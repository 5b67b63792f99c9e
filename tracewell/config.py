"""Settings with their defaults; files and TSS__A__B environment variables override them, the later the stronger."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class App:
    max_spans: int = 1_000_000
    max_traces: int = 100_000
    num_workers: int = 4
    trace_inactivity_secs: int = 300
    root_inactivity_secs: int = 30
    max_trace_duration_secs: int = 3600


@dataclass
class Sampling:
    always_sample_errors: bool = True
    error_sample_rate: float = 1.0
    sample_latency: bool = True
    latency_threshold_ms: int = 30_000
    latency_sample_rate: float = 1.0
    max_span_count: int = 500
    strategy: str = "any"
    consensus: float = 0.5
    force_keep_scope: str = "unprocessed"


@dataclass
class Compression:
    enabled: bool = True
    min_count: int = 3
    window_secs: int = 60
    max_span_secs: int = 60
    exclude: list[str] = field(default_factory=list)
    only: list[str] = field(default_factory=list)
    patterns: list[dict] = field(default_factory=list)


@dataclass
class Rules:
    enabled: bool = True
    poll_secs: int = 5


@dataclass
class Dedup:
    ttl_secs: int = 3600


@dataclass
class Export:
    batch_size: int = 100
    max_retries: int = 3
    concurrency: int = 10
    shards: int = 64


@dataclass
class Kafka:
    brokers: str = "localhost:9092"
    topic: str = "traces"
    group: str = "trace-sampler"
    auto_commit: bool = False
    max_message_bytes: int = 10_000_000
    fetch_wait_ms: int = 100
    max_offsets_per_trigger: int = 10_000
    max_partitions: int = 64
    sasl_mechanism: str | None = None
    username: str | None = None
    password: str | None = None
    ca_location: str | None = None


@dataclass
class Catalog:
    """An Iceberg REST catalog, and the object store that its tables lie in."""

    name: str = "lake"
    uri: str = "http://localhost:8181"
    warehouse: str = "warehouse"
    token: str | None = None
    endpoint: str | None = None
    region: str | None = None
    access_key: str | None = None
    secret_key: str | None = None
    path_style: bool = True


@dataclass
class Config:
    catalog: Catalog = field(default_factory=Catalog)
    app: App = field(default_factory=App)
    sampling: Sampling = field(default_factory=Sampling)
    compression: Compression = field(default_factory=Compression)
    rules: Rules = field(default_factory=Rules)
    dedup: Dedup = field(default_factory=Dedup)
    export: Export = field(default_factory=Export)
    kafka: Kafka = field(default_factory=Kafka)


def _apply(target: object, values: Mapping, where: str = "") -> None:
    names = {f.name for f in fields(target)}
    for k, v in values.items():
        if k not in names:
            raise ValueError(f"unknown setting {where}{k}")
        now = getattr(target, k)
        if is_dataclass(now):
            _apply(now, v, f"{where}{k}.")
        elif isinstance(v, str) and not isinstance(now, (str, type(None))):
            setattr(target, k, json.loads(v.lower() if isinstance(now, bool) else v))
        else:
            setattr(target, k, v)


def load(*paths: str | Path, env: Mapping[str, str] | None = None, prefix: str = "TRACEWELL") -> Config:
    """Defaults, then JSON files in order (YAML where that library is installed), then environment variables."""
    out = Config()
    for p in map(Path, paths):
        text = p.read_text()
        if p.suffix in (".yaml", ".yml"):
            import yaml

            _apply(out, yaml.safe_load(text) or {})
        else:
            _apply(out, json.loads(text))
    for k, v in sorted((env or {}).items()):
        head, *path = k.split("__")
        if head == prefix and path:
            tree: dict = {path[-1].lower(): v}
            for part in reversed(path[:-1]):
                tree = {part.lower(): tree}
            _apply(out, tree)
    return out
