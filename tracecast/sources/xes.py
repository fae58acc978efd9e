"""XES event logs (XML) through Spark's XML source and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracecast.operators.split import enumerate_rows

#: Attribute that names traces and events (fixed value of the format).
NAME = "concept:name"

#: Traces of a file: a file is read whole by one task.
_FILE_TRACES = 20_000

#: Attribute that times an event (fixed value of the format).
TIME = "time:timestamp"

_ATTRIBUTES = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
_FIELDS = [T.StructField("string", _ATTRIBUTES), T.StructField("date", _ATTRIBUTES)]
XES_SCHEMA = T.StructType([*_FIELDS, T.StructField("event", T.ArrayType(T.StructType(_FIELDS)))])


def _attribute(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value"))


def _named(value: Column) -> Column:
    return _attribute(NAME, value)


def value_of(attributes: Column, key: str) -> Column:
    """Value of the first attribute with this key."""
    return F.get(F.filter(attributes, lambda a: a["_key"] == key), F.lit(0))["_value"]


def _nested(traces: DataFrame, name: str, *keep: str) -> DataFrame:
    events = F.transform("acts", lambda a: F.struct(_named(a).alias("string")))
    return traces.select(*keep, _named(F.col(name)).alias("string"), events.alias("event"))


def write_xes_events(log: DataFrame, path: str, **attributes: str) -> None:
    """An event log with further attributes, one text or timestamp column each; ``__`` in a name stands for ``:``.

    Traces are named by their case; the events of a case are gathered, as a trace is one element of the format.
    """
    keys = {column: name.replace("__", ":") for name, column in attributes.items()}
    kinds = {c: "date" if isinstance(log.schema[c].dataType, T.TimestampType) else "string" for c in keys}
    texts = F.array(*[_attribute(k, F.col(c)) for c, k in keys.items() if kinds[c] == "string"], _named(F.col("activity")))
    dates = F.array(*[_attribute(k, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")) for c, k in keys.items() if kinds[c] == "date"])
    event = F.struct(texts.alias("string"), *([dates.alias("date")] if "date" in kinds.values() else []))
    rows = log.select("case_id", "ord", event.alias("e")).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", "e"))).alias("x"))
    _write(rows.select(F.array(_attribute("concept:source", F.lit("table")), _named(F.col("case_id"))).alias("string"), F.col("x.e").alias("event")), path)


def to_xes_rows(traces: DataFrame) -> DataFrame:
    """Nested rows of the format; traces are named by their rank in case order."""
    return _nested(enumerate_rows(traces, "case_id", "trace_name"), "trace_name")


def write_xes(traces: DataFrame, path: str) -> None:
    _write(to_xes_rows(traces), path)


def write_xes_per_model(variant_rows: DataFrame, path: str) -> None:
    """One folder per ``model_id``; traces are named by their variant."""
    _write(_nested(variant_rows, "variant_id", "model_id"), path, "model_id")


def _write(rows: DataFrame, path: str, *by: str) -> None:
    writer = rows.write.mode("overwrite").format("xml").option("rowTag", "trace").option("rootTag", "log").option("maxRecordsPerFile", _FILE_TRACES)
    writer.partitionBy(*by).save(path)


def read_xes(spark: SparkSession, path: str, **attributes: str) -> DataFrame:
    """``(trace_name, acts)``, and an array per further event attribute (``name="its:key"``).

    Names are the ``concept:name`` attributes; others beside them do not matter.
    """
    rows = spark.read.format("xml").option("rowTag", "trace").schema(XES_SCHEMA).load(path)

    def values(key: str) -> Column:
        return F.transform("event", lambda e: F.coalesce(value_of(e["string"], key), value_of(e["date"], key)))

    return rows.select(
        value_of(F.col("string"), NAME).alias("trace_name"),
        F.transform("event", lambda e: value_of(e["string"], NAME)).alias("acts"),
        *[values(key).alias(name) for name, key in attributes.items()],
    )
