"""Queries over log, error and metric documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from burrow.functions.predicates import Filter, column
from burrow.operators.aggregate import facet
from burrow.operators.retrieve import select


def system_select(logs: DataFrame, where: Filter | None = None, fields: list[str] | None = None, sort: str = "ts desc", limit: int = 100, host: int | None = None) -> DataFrame:
    """The newest matching documents, of all hosts or one."""
    rows = logs if host is None else logs.where(F.col("_host") == host)
    return select(rows, where, fields, sort, limit=limit)


def system_facet(logs: DataFrame, field: str, where: Filter | None = None, prefix: str | None = None, host: int | None = None) -> DataFrame:
    rows = logs if host is None else logs.where(F.col("_host") == host)
    return facet(rows, field, where, prefix)


def error_rows(errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Errors (trace_id_s, ts, message, frames: array of struct) as one log document each and one document a stack frame, in
    order of seq_i."""
    heads = errors.select("trace_id_s", "ts", F.col("message").alias("short_message_t"), F.lit(True).alias("is_error_b"))
    frames = errors.select("trace_id_s", "ts", F.posexplode("frames").alias("seq_i", "frame")).select("trace_id_s", "ts", "seq_i", "frame.*")
    return heads, frames


def trace(frames: DataFrame, trace_id: str) -> DataFrame:
    return select(frames, column(F.col("trace_id_s") == trace_id), sort="seq_i asc")


def last_values(metrics: DataFrame, last: int = 60) -> DataFrame:
    """(name, values): the last values of every metric, newest first, of one moment the largest first."""
    turn = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ts"), F.desc("value_d")))
    recent = metrics.withColumn("_turn", turn).where(F.col("_turn") <= last)
    values = F.array_sort(F.collect_list(F.struct("_turn", "value_d")))
    return recent.groupBy("name").agg(F.transform(values, lambda x: x["value_d"]).alias("values"))
