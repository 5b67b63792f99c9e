"""Sampling policies over trace summaries: each compiles to one struct column, and strategies combine them.

A policy is anything with a name and evaluate() -> Column of struct(policy, decision, reason, matched). Draws are
hashes of trace, policy and seed, so that a trace is judged alike wherever and however often it is judged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.config import Sampling
from tracewell.functions.matching import matches, sample_unit


class Policy(Protocol):
    name: str

    def evaluate(self) -> Column: ...


def _result(name: str, hit: Column, keep: Column, yes: Column, no: str | Column, matched: str) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(name).alias("policy"),
        F.when(hit & keep, "keep").otherwise("drop").alias("decision"),
        F.when(hit, yes).otherwise(F.lit(no) if isinstance(no, str) else no).alias("reason"),
        F.when(hit, F.array(F.lit(matched))).otherwise(none).alias("matched"),
    )


def drawn(rate: float, name: str, seed: str = "0") -> Column:
    return F.lit(True) if rate >= 1 else F.lit(False) if rate <= 0 else sample_unit(F.col("trace_id"), f"{name}|{seed}") < rate


@dataclass
class ErrorPolicy:
    rate: float = 1.0
    name: str = "error_sampling"

    def evaluate(self) -> Column:
        yes = F.format_string(f"Error trace sampled at rate {self.rate:.2f}: %d errors found", F.col("error_count"))
        return _result(self.name, F.col("has_error"), drawn(self.rate, self.name), yes, "No errors found", "has_error")


@dataclass
class LatencyPolicy:
    threshold_ms: int = 30_000
    rate: float = 1.0
    name: str = "latency_sampling"

    def evaluate(self) -> Column:
        d = F.col("max_duration_ms")
        yes = F.format_string(f"Latency %dms > {self.threshold_ms}ms threshold, sampled at rate {self.rate:.2f}", d)
        return _result(self.name, d > self.threshold_ms, drawn(self.rate, self.name), yes, F.format_string(f"Latency %dms <= {self.threshold_ms}ms threshold", d), f"latency_ms > {self.threshold_ms}")


@dataclass
class CardinalityPolicy:
    max_spans: int = 500
    force: bool = True
    name: str = "cardinality_sampling"

    def evaluate(self) -> Column:
        n = F.col("span_count")
        yes = F.format_string(f"Span count %d > {self.max_spans} max, {'forced' if self.force else 'random'} sample", n)
        return _result(self.name, n > self.max_spans, F.lit(True), yes, F.format_string(f"Span count %d <= {self.max_spans} max", n), f"span_count > {self.max_spans}")


def condition(tree: dict) -> Column:
    """A condition tree as a column. One key names the kind:

    error: include; latency: threshold_ms, above; duration: min_ms, max_ms; service / operation: match, values,
    pattern; cardinality: max_spans; and / or: a list (empty: true / false); not: a tree.
    """
    (kind, spec), = tree.items()
    c = F.col
    if kind == "error":
        return c("has_error") == F.lit(spec.get("include", True))
    if kind == "latency":
        return (c("max_duration_ms") > spec["threshold_ms"]) == F.lit(spec.get("above", True))
    if kind == "duration":
        return c("max_duration_ms").between(spec["min_ms"], spec["max_ms"])
    if kind == "service":
        return matches(c("service_name"), spec["match"], spec["values"], spec.get("pattern"))
    if kind == "operation":
        return F.exists("operations", lambda o: matches(o, spec["match"], spec["values"], spec.get("pattern")))
    if kind == "cardinality":
        return c("span_count") > spec["max_spans"]
    if kind == "and":
        return reduce(lambda a, b: a & b, map(condition, spec), F.lit(True))
    if kind == "or":
        return reduce(lambda a, b: a | b, map(condition, spec), F.lit(False))
    if kind == "not":
        return ~condition(spec)
    raise ValueError(f"unknown condition {kind}")


@dataclass
class CustomPolicy:
    """Keeps at a rate if any of its conditions holds."""

    name: str
    conditions: list[dict] = field(default_factory=list)
    rate: float = 1.0
    enabled: bool = True

    def evaluate(self) -> Column:
        if not self.enabled:
            return _result(self.name, F.lit(False), F.lit(False), F.lit(""), "Policy disabled", "")
        return _result(self.name, condition({"or": self.conditions}), drawn(self.rate, self.name), F.lit(f"Matched conditions, sampled at rate {self.rate:.2f}"), "No conditions matched", "custom_condition")


def default_policies(s: Sampling | None = None) -> list[Policy]:
    s = s or Sampling()
    return [ErrorPolicy(s.error_sample_rate), LatencyPolicy(s.latency_threshold_ms, s.latency_sample_rate), CardinalityPolicy(s.max_span_count)]


def results(policies: Sequence[Policy]) -> Column:
    """All policies' results in order."""
    if not policies:
        return F.array().cast("array<struct<policy:string,decision:string,reason:string,matched:array<string>>>")
    return F.array(*[p.evaluate() for p in policies])


def combine(all_results: Column, strategy: str = "any", consensus: float = 0.5) -> Column:
    """keep or drop: any (none: drop), all (none: keep), consensus (share of keeps, none: drop), priority (first keep)."""
    keep = lambda r: r["decision"] == "keep"
    n = F.size(all_results)
    verdict = {
        "any": F.exists(all_results, keep),
        "all": F.forall(all_results, keep),
        "consensus": (n > 0) & (F.size(F.filter(all_results, keep)) >= F.lit(consensus) * n),
        "priority": F.exists(all_results, keep),
    }[strategy]
    return F.when(verdict, "keep").otherwise("drop")
