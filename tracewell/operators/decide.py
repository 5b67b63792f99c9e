"""The decision on each trace: one plan from spans to keep, drop or pending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import Config
from tracewell.operators.lifecycle import with_state
from tracewell.operators.policies import Policy, combine, default_policies, results
from tracewell.operators.rules import Rule, with_rule_action
from tracewell.operators.summary import summarize


def decision(config: Config, policies: Sequence[Policy] | None = None, force: Column | None = None) -> Column:
    """keep, drop or pending, over a summary with a state.

    Errors are kept before any policy is asked; without latency sampling nothing else is. A force_drop rule beats a
    keep. A force_keep rule exports traces that aren't finished; with scope "all" it also rescues dropped ones.
    """
    s = config.sampling
    policies = default_policies(s) if policies is None else policies
    verdict = combine(results(policies), s.strategy, s.consensus) if s.sample_latency else F.lit("drop")
    if s.always_sample_errors:
        verdict = F.when(F.col("has_error"), "keep").otherwise(verdict)
    if force is None:
        return F.when(F.col("state") == "active", "pending").otherwise(verdict)
    kept, dropped = F.coalesce(force == "force_keep", F.lit(False)), F.coalesce(force == "force_drop", F.lit(False))
    done = F.when(dropped, "drop").when(kept, "keep").otherwise(verdict) if s.force_keep_scope == "all" else F.when(dropped, "drop").otherwise(verdict)
    return F.when(F.col("state") == "active", F.when(kept, "keep").otherwise("pending")).otherwise(done)


def decide(spans: DataFrame, now_ms: int | Column, config: Config | None = None, rules: Sequence[Rule] = (), exported: DataFrame | None = None, policies: Sequence[Policy] | None = None) -> DataFrame:
    """Summaries with state and decision; traces in exported (trace_id) are marked for purging instead.

    now_ms is a number, or a column (a subquery) where there are no rules, whose expiry is settled on the driver.
    """
    config = config or Config()
    if rules and config.rules.enabled:
        traces, force = with_rule_action(spans, rules, now_ms), F.col("force")
    else:
        traces, force = summarize(spans).withColumn("force", F.lit(None).cast("string")), None
    out = with_state(traces, now_ms, config.app).withColumn("decision", decision(config, policies, force))
    if exported is not None:
        out = out.join(exported.select("trace_id", F.lit(True).alias("_done")).distinct(), "trace_id", "left")
        out = out.withColumn("decision", F.when(F.col("_done") & (F.col("state") != "active"), "purge").otherwise(F.col("decision"))).drop("_done")
    return out


def totals(decided: DataFrame) -> DataFrame:
    """One row of counters: traces and spans by what was decided."""
    n = lambda d: F.count_if(F.col("decision") == d)
    spans = lambda d: F.coalesce(F.sum(F.when(F.col("decision") == d, F.col("span_count"))), F.lit(0))
    names = {"sampled": "keep", "dropped": "drop", "pending": "pending", "purged": "purge"}
    return decided.agg(*[n(d).alias(f"{k}_traces") for k, d in names.items()], *[spans(d).alias(f"{k}_spans") for k, d in names.items()])


def unexported(traces: DataFrame, exported: DataFrame, now_ms: int | None = None) -> DataFrame:
    """traces that haven't been exported; entries whose expires_at_ms has passed are forgotten."""
    known = exported if now_ms is None else exported.where(F.col("expires_at_ms") > now_ms)
    return traces.join(known.select("trace_id"), "trace_id", "left_anti")


def remember_exported(traces: DataFrame, now_ms: int, ttl_secs: int = 3600) -> DataFrame:
    return traces.select("trace_id", F.lit(now_ms + ttl_secs * 1000).alias("expires_at_ms"))
