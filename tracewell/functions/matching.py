"""Predicates, samplers and normalisers as Spark columns; configuration is compiled on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Labels of span kinds by code, of this engine and of the wire format.
KIND_LABELS = ("Unspecified", "Server", "Client", "Producer", "Consumer")
WIRE_KIND_LABELS = ("Unspecified", "Internal", "Server", "Client", "Producer", "Consumer")

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = r"^(?i)[+-]?(inf|infinity)$"


def kind_label(code: Column, wire: bool = False) -> Column:
    labels = WIRE_KIND_LABELS if wire else KIND_LABELS
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), F.when(code >= 0, code).otherwise(F.lit(None))), F.lit(labels[0]))


def sample_unit(trace_id: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the trace and the salt alone."""
    return F.conv(F.substring(F.md5(F.concat(trace_id, F.lit("|" + salt))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def search(pattern: str) -> str | None:
    """pattern for Java's engine with Unicode classes and \\n as the only line end; None if it isn't a regular expression.

    Look-around, atomic groups and back references are refused: they aren't regular. Java's engine, which runs the
    pattern, is also the judge of all else.
    """
    if re.search(r"\(\?(=|!|<=|<!|>)|(?<!\\)(\\\\)*\\([1-9]|k<)|\(\?P=", pattern):
        return None
    named = re.sub(r"\(\?P<", "(?<", pattern)
    out = "(?dU)" + re.sub(r"(?<!\\)\$(?=$|\)|\|)", r"\\z", named)
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(out)
    except (Py4JJavaError, PySparkException):
        return None
    return out


def matches(column: Column, kind: str, values: Sequence[str], pattern: str | None = None) -> Column:
    """Any of values matches: exact, prefix, suffix, or regex (which carries its own pattern; values only have to be there)."""
    if kind == "regex":
        p = search(pattern or "")
        return F.lit(False) if p is None or not values else F.coalesce(column.rlike(p), F.lit(False))
    one = {"exact": lambda v: column == F.lit(v), "prefix": column.startswith, "suffix": column.endswith}[kind]
    return F.coalesce(reduce(lambda a, b: a | b, [one(v) for v in values], F.lit(False)), F.lit(False))


def number(column: Column) -> Column:
    """A double from text that is a number and nothing else; null otherwise, and for NaN."""
    infinite = F.when(column.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(column.rlike(_NUMBER), column.try_cast("double")).when(column.rlike(_INFINITE), infinite)


def _as_number(value: object) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, str) and (re.match(_NUMBER, value) or re.match(r"^[+-]?(inf|infinity)$", value, re.I)):
        return float(value)
    return None


#: Operators of attribute matchers.
OPERATORS = ("eq", "neq", "contains", "starts_with", "ends_with", "regex", "in", "exists", "gt", "gte", "lt", "lte")


def attribute(attrs: Column, key: str, op: str, value: object = None) -> Column:
    """A matcher over a map of attributes; never null. A missing key fails every operator, neq too.

    Raises ValueError for an unknown operator or a regex that doesn't compile.
    """
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    v = F.try_element_at(attrs, F.lit(key))
    text = value if isinstance(value, str) else None
    if op == "exists":
        found = F.map_contains_key(attrs, F.lit(key))
    elif op == "regex":
        p = search(text) if text is not None else None
        if p is None:
            raise ValueError(f"not a regular expression: {value!r}")
        found = v.rlike(p)
    elif op == "neq":
        found = (v != F.lit(text)) if text is not None else v.isNotNull()
    elif op == "in":
        found = v.isin([str(x) for x in value]) if isinstance(value, (list, tuple)) and value else F.lit(False)
    elif op in ("gt", "gte", "lt", "lte"):
        bound, own = _as_number(value), number(v)
        if bound is None:
            return F.lit(False)
        found = {"gt": own > bound, "gte": own >= bound, "lt": own < bound, "lte": own <= bound}[op]
    elif text is None:
        found = F.lit(False)
    else:
        found = {"eq": v == F.lit(text), "contains": v.contains(text), "starts_with": v.startswith(text), "ends_with": v.endswith(text)}[op]
    return F.coalesce(found, F.lit(False))


def generic_statement(name: Column) -> Column:
    """Literals and digits as ?, white space collapsed, upper case."""
    out = F.regexp_replace(name, r"\p{Nd}+", "?")
    out = F.regexp_replace(out, r"'[^']*'", "?")
    out = F.regexp_replace(out, r'"[^"]*"', "?")
    return F.upper(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")))


def _pattern_test(p: dict) -> Callable[[Column], Column]:
    regex = search(p["pattern"]) if p.get("is_regex") else None
    if regex:
        return lambda c: F.coalesce(c.rlike(regex), F.lit(False))
    return lambda c: F.coalesce(c.contains(p["pattern"]), F.lit(False))


def statement(name: Column, attrs: Column, patterns: Sequence[dict] = ()) -> Column:
    """The name of the first pattern that matches the operation or any attribute value, else the generic form.

    A pattern: {"pattern", "is_regex", "group_name"}; without a group name it changes nothing, and a regex that
    doesn't compile is taken literally.
    """
    out = generic_statement(name)
    for p in reversed([p for p in patterns if p.get("group_name")]):
        test = _pattern_test(p)
        values = F.coalesce(F.exists(F.map_values(attrs), test), F.lit(False))
        out = F.when(test(name) | values, F.lit(p["group_name"])).otherwise(out)
    return out


def operation_type(name: Column, attrs: Column, normalised: Column) -> Column:
    """db.query.{operation}, db.{system}.{verb}, or the plain operation name."""
    operation, system = F.try_element_at(attrs, F.lit("db.operation")), F.try_element_at(attrs, F.lit("db.system"))
    verb = F.lit("query")
    for v in ("DELETE", "UPDATE", "INSERT", "SELECT"):
        verb = F.when(normalised.startswith(v), F.lit(v.lower())).otherwise(verb)
    return (
        F.when(operation.isNotNull(), F.concat(F.lit("db.query."), operation))
        .when(system.isNotNull(), F.concat(F.lit("db."), system, F.lit("."), verb))
        .otherwise(name)
    )
