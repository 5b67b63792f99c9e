"""Override rules over attributes: compiled to columns, and kept in a directory of JSON files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.matching import OPERATORS, attribute

#: Prefixes of the span attributes that describe the resource.
RESOURCE_PREFIXES = ("service.", "deployment.", "tenant", "customer", "host.", "cloud.", "k8s.")


@dataclass
class Matcher:
    key: str
    op: str
    value: object = None

    @classmethod
    def of(cls, d: dict) -> Matcher:
        """`values` is another spelling of value, and exists needs none."""
        if d.get("op") not in OPERATORS:
            raise ValueError(f"unknown operator {d.get('op')}")
        return cls(d["key"], d["op"], d.get("value", d.get("values")))


@dataclass
class Rule:
    id: str
    expires_at_ms: int
    resource: list[Matcher] = field(default_factory=list)
    span: list[Matcher] = field(default_factory=list)
    action: str = "force_keep"
    priority: int = 100
    enabled: bool = True
    description: str = ""
    created_at_ms: int | None = None
    created_by: str | None = None

    @classmethod
    def of(cls, d: dict) -> Rule:
        d = dict(d)
        match = d.pop("match", {})
        for part in ("resource", "span"):
            d[part] = [m if isinstance(m, Matcher) else Matcher.of(m) for m in d.get(part, match.get(part, []))]
        return cls(**d)


def resource_attributes(first_attributes: Column, service: Column) -> Column:
    """service.name from the column, then the first span's attributes that describe the resource; those win."""
    chosen = F.map_filter(first_attributes, lambda k, _: reduce(lambda a, b: a | b, [k.startswith(p) for p in RESOURCE_PREFIXES]))
    entries = F.map_entries(F.map_filter(F.create_map(F.lit("service.name"), service), lambda k, _: ~F.map_contains_key(chosen, k)))
    return F.map_from_entries(F.concat(entries, F.map_entries(chosen)))


def active_rules(rules: Sequence[Rule], now_ms: int) -> list[Rule]:
    """Enabled, unexpired rules, the highest priority first, ids breaking ties."""
    return sorted((r for r in rules if r.enabled and r.expires_at_ms > now_ms), key=lambda r: (-r.priority, r.id))


def _all(matchers: Sequence[Matcher], attrs: Column) -> Column:
    return reduce(lambda a, b: a & b, [attribute(attrs, m.key, m.op, m.value) for m in matchers], F.lit(True))


def rule_aggregates(rules: Sequence[Rule]) -> list[Column]:
    """Aggregates for summarize(): the first span's attributes, and for each rule whether one span meets all its span matchers.

    They share the summary's shuffle.
    """
    attrs = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
    first = F.min_by(attrs, "seq").alias("_first_attributes")
    flags = [F.bool_or(_all(r.span, attrs)).alias(f"_rule{k}") for k, r in enumerate(rules) if r.span]
    return [first, *flags]


def rule_action(rules: Sequence[Rule]) -> Column:
    """The action of the first rule that matches, over a summary with rule_aggregates(); null if none does."""
    resource = resource_attributes(F.col("_first_attributes"), F.col("service_name"))
    out = F.lit(None).cast("string")
    for k, r in reversed(list(enumerate(rules))):
        hit = _all(r.resource, resource)
        out = F.when(hit & F.col(f"_rule{k}") if r.span else hit, F.lit(r.action)).otherwise(out)
    return out


def with_rule_action(spans: DataFrame, rules: Sequence[Rule], now_ms: int, column: str = "force") -> DataFrame:
    """Trace summaries with the action of the first active rule that matches."""
    from tracewell.operators.summary import summarize

    active = active_rules(rules, now_ms)
    own = [f"_rule{k}" for k, r in enumerate(active) if r.span]
    return summarize(spans, *rule_aggregates(active)).withColumn(column, rule_action(active)).drop("_first_attributes", *own)


class RuleStore:
    """Rules as JSON files in a directory; clock() gives the time in ms."""

    def __init__(self, folder: str | Path, clock: Callable[[], int]):
        self.folder, self.clock = Path(folder), clock
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, rule_id: str) -> Path:
        if not rule_id or "/" in rule_id or rule_id.startswith("."):
            raise ValueError(f"not a rule id: {rule_id!r}")
        return self.folder / f"{rule_id}.json"

    def _save(self, rule: Rule, lives_ms: int) -> Rule:
        (part := self._path(rule.id).with_suffix(".part")).write_text(json.dumps(asdict(rule) | {"gone_at_ms": self.clock() + lives_ms}))
        part.replace(self._path(rule.id))
        return rule

    def _load(self, path: Path) -> tuple[Rule, int] | None:
        try:
            d = json.loads(path.read_text())
            gone = d.pop("gone_at_ms")
            return Rule.of(d), gone
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def create(self, match: dict, duration_secs: int, *, rule_id: str | None = None, action: str = "force_keep", priority: int = 100, description: str = "", created_by: str | None = None) -> Rule:
        """A new rule; raises ValueError if it doesn't compile."""
        now = self.clock()
        rule = Rule.of({"id": rule_id or str(uuid.uuid4()), "expires_at_ms": now + duration_secs * 1000, "match": match, "action": action, "priority": priority, "description": description, "created_at_ms": now, "created_by": created_by})
        probe = F.lit(None).cast("map<string,string>") if _session() else None
        for m in (*rule.resource, *rule.span):
            if probe is not None:
                attribute(probe, m.key, m.op, m.value)
        return self._save(rule, duration_secs * 1000 + 60_000)

    def get(self, rule_id: str) -> Rule | None:
        got = self._load(self._path(rule_id))
        return got[0] if got and got[1] > self.clock() else None

    def list(self) -> list[Rule]:
        got = [self._load(p) for p in sorted(self.folder.glob("*.json"))]
        return sorted((r for r, gone in filter(None, got) if gone > self.clock()), key=lambda r: (-r.priority, r.id))

    def active(self) -> list[Rule]:
        return active_rules(self.list(), self.clock())

    def active_count(self) -> int:
        return len(self.active())

    def delete(self, rule_id: str) -> bool:
        existed = self.get(rule_id) is not None
        self._path(rule_id).unlink(missing_ok=True)
        return existed

    def extend(self, rule_id: str, secs: int) -> Rule | None:
        if (rule := self.get(rule_id)) is None:
            return None
        rule.expires_at_ms = max(rule.expires_at_ms, self.clock()) + secs * 1000
        return self._save(rule, rule.expires_at_ms - self.clock() + 60_000)

    def disable(self, rule_id: str) -> Rule | None:
        if (rule := self.get(rule_id)) is None:
            return None
        rule.enabled = False
        return self._save(rule, max(rule.expires_at_ms - self.clock(), 60_000))

    def enable(self, rule_id: str) -> Rule | None:
        if (rule := self.get(rule_id)) is None:
            return None
        if rule.expires_at_ms <= self.clock():
            raise ValueError("the rule has expired")
        rule.enabled = True
        return self._save(rule, rule.expires_at_ms - self.clock() + 60_000)

    def cleanup(self) -> int:
        """Remove files of rules that are gone or unreadable; returns their number."""
        n = 0
        for p in self.folder.glob("*.json"):
            got = self._load(p)
            if got is None or got[1] <= self.clock() or got[0].expires_at_ms <= self.clock():
                p.unlink(missing_ok=True)
                n += 1
        return n

    def view(self, rule: Rule) -> dict:
        return asdict(rule) | {"remaining_secs": max(0, (rule.expires_at_ms - self.clock()) // 1000)}


def _session() -> bool:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() is not None
