"""Schemas of spans and of what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPAN = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("span_kind", T.IntegerType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("operation_name", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ]
)

ERROR = 2


def check_spans(df: DataFrame) -> DataFrame:
    """df if it has the span columns with their types; raises otherwise instead of skipping rows."""
    have = dict(df.dtypes)
    wrong = [f"{f.name}: {have.get(f.name)} for {f.dataType.simpleString()}" for f in SPAN if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError("not a table of spans: " + "; ".join(wrong))
    return df
