"""Counts, facets, histograms, cardinalities and reducers. Results are rows; as_map() gives one object."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from burrow.functions import dates
from burrow.functions.predicates import Filter, everything
from burrow.functions.text import path_prefixes, words
from burrow.functions.types import check_filter, field_type


def values_of(df: DataFrame, field: str) -> DataFrame:
    """(value): every value of a field; of lists each element, of full texts each word, of paths each prefix, once a document."""
    check_filter(field)
    c, kind = F.col(f"`{field}`"), field_type(field)
    if kind and kind.name.startswith("text"):
        c = words(c)
    elif kind and kind.name == "path":
        c = path_prefixes(c)
    elif not isinstance(df.schema[field].dataType, T.ArrayType):
        return df.where(c.isNotNull()).select(c.cast("string").alias("value"))
    return df.select(F.explode(F.array_distinct(c).cast("array<string>")).alias("value")).where("value IS NOT NULL")


def count(df: DataFrame, where: Filter | None = None) -> DataFrame:
    """One row: count and the number of matching documents."""
    return df.where((where or everything()).on(df)).agg(F.count("*").alias("count")).select(F.lit("count").alias("value"), "count")


def facet(
    df: DataFrame,
    field: str,
    where: Filter | None = None,
    prefix: str | None = None,
    mincount: int = 1,
    sort: str = "count",
    start: int = 0,
    limit: int = -1,
) -> DataFrame:
    """(value, count) of a field's values among matching documents; by count or by value ("index"), exact at any limit."""
    found = values_of(df.where((where or everything()).on(df)), field)
    if prefix:
        found = found.where(F.col("value").startswith(prefix))
    counts = found.groupBy("value").agg(F.count("*").alias("count")).where(F.col("count") >= mincount)
    by = [F.desc("count"), "value"] if sort == "count" else ["value"]
    counts = counts.orderBy(*by)
    counts = counts.offset(start) if start else counts
    return counts.limit(limit) if limit >= 0 else counts


def value_counts(partials: DataFrame, mincount: int = 0) -> DataFrame:
    """Partial counts (value, count) summed by value."""
    return partials.groupBy("value").agg(F.sum("count").alias("count")).where(F.col("count") >= mincount)


def field_value_counts(partials: DataFrame, mincount: int = 0) -> DataFrame:
    """Partial counts (field, value, count) summed by field and value."""
    return partials.groupBy("field", "value").agg(F.sum("count").alias("count")).where(F.col("count") >= mincount)


def facets(df: DataFrame, fields: list[str], where: Filter | None = None) -> DataFrame:
    """(field, value, count) for several single-valued fields in one pass over the documents."""
    for name in fields:
        check_filter(name)
    found = df.where((where or everything()).on(df))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])
    rows = found.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL")
    return rows.groupBy("field", "value").agg(F.count("*").alias("count"))


def repeated_values(partials: DataFrame) -> DataFrame:
    """One row: how many values have a count above one."""
    return value_counts(partials).agg(F.count_if(F.col("count") > 1).alias("count")).select(F.lit("h2count").alias("value"), "count")


def as_map(counts: DataFrame, key: str = "value", value: str = "count") -> DataFrame:
    """One row with one map; for results of a known small size."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("map"))


def range_facet(df: DataFrame, field: str, start: float, end: float, gap: float, where: Filter | None = None, mincount: int = 1) -> DataFrame:
    """(value, count) of the ranges of a number, named by their lower bounds; a range holds its lower bound only."""
    check_filter(field)
    x = F.col(f"`{field}`")
    found = df.where((where or everything()).on(df)).where((x >= start) & (x < end))
    low = F.floor((x - F.lit(start)) / F.lit(gap)) * F.lit(gap) + F.lit(start)
    return found.groupBy(low.alias("value")).agg(F.count("*").alias("count")).where(F.col("count") >= mincount)


def date_facet(
    df: DataFrame, field: str, start: str, end: str, gap: str, where: Filter | None = None, mincount: int = 1, now: datetime | None = None
) -> DataFrame:
    """(value, count) of ranges of time; gaps such as +1DAY or +1MONTH count from the start, both with date math."""
    check_filter(field)
    first, last = dates.resolve(start, now), dates.resolve(end, now)
    t, (n, unit) = F.col(f"`{field}`").cast("timestamp_ntz"), dates.gap(gap)
    found = df.where((where or everything()).on(df)).where((t >= F.lit(first)) & (t < F.lit(last)))
    low = _bucket_start(t, F.lit(first).cast("timestamp_ntz"), n, unit)
    return found.groupBy(low.alias("value")).agg(F.count("*").alias("count")).where(F.col("count") >= mincount)


def _bucket_start(t: Column, first: Column, n: int, unit: str) -> Column:
    if unit in ("YEAR", "MONTH"):
        months = n * (12 if unit == "YEAR" else 1)
        passed = F.floor(F.timestamp_diff("MONTH", first, t) / months).cast("int")
        return F.timestamp_add("MONTH", passed * months, first)
    seconds = n * {"DAY": 86_400, "HOUR": 3_600, "MINUTE": 60, "SECOND": 1}[unit]
    passed = F.floor(F.timestamp_diff("SECOND", first, t) / seconds)
    return F.timestamp_add("SECOND", passed * seconds, first)


def partition_cardinality(df: DataFrame, field: str, where: Filter | None = None) -> DataFrame:
    """(partition, cardinality): the number of different values of a field in each partition."""
    check_filter(field)
    found = df.where((where or everything()).on(df)).groupBy("partition")
    return found.agg(F.count_distinct(F.col(f"`{field}`")).alias("cardinality"))


def cardinality(df: DataFrame, field: str, where: Filter | None = None) -> DataFrame:
    """One row over the set of different cardinalities of partitions: average, max, min, and by_partition as a map.

    The map holds the fixed number of partitions."""
    c = F.col("cardinality")
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct("partition", "cardinality"))))
    found = partition_cardinality(df, field, where)
    return found.agg(F.expr("avg(DISTINCT cardinality)").alias("average"), F.max(c).alias("max"), F.min(c).alias("min"), by.alias("by_partition"))


def global_cardinality(df: DataFrame, field: str, where: Filter | None = None, error: float | None = None) -> DataFrame:
    """One row: the number of different values, exact or within a relative error."""
    check_filter(field)
    c = F.col(f"`{field}`")
    how = F.count_distinct(c) if error is None else F.approx_count_distinct(c, error)
    return df.where((where or everything()).on(df)).agg(how.alias("cardinality"))


def global_count(df: DataFrame, by: str = "bucket", n_val: int = 2) -> DataFrame:
    """(value, count) by bucket, partition or any field, with every replica counted."""
    return df.groupBy(F.col(f"`{by}`").cast("string").alias("value")).agg((F.count("*") * n_val).alias("count"))


def host_facet(df: DataFrame, field: str, where: Filter | None = None) -> DataFrame:
    """(host, value, count) of a field's values on every host; df has the column _host."""
    found = df.where((where or everything()).on(df)).where(F.col(f"`{field}`").isNotNull())
    return found.groupBy(F.col("_host").alias("host"), F.col(f"`{field}`").cast("string").alias("value")).agg(F.count("*").alias("count"))


def accumulate(df: DataFrame, field: str) -> DataFrame:
    """(value, rows): whole rows gathered by a field, for groups that fit into a row. ordered_rows() has no such bound."""
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    return df.groupBy(F.col(f"`{field}`").cast("string").alias("value")).agg(rows.alias("rows"))


def sorted_accumulate(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """One row with all rows in the order of a field, for small results; none for an empty input."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(by).alias("_by"), F.struct(*df.columns).alias("_row"))), asc=not descending)
    return df.agg(F.transform(rows, lambda x: x["_row"]).alias("data")).where(F.size("data") > 0)


def ordered_rows(df: DataFrame, by: str, group: str | None = None, descending: bool = False) -> DataFrame:
    """The rows in the order of a field, each with its position (from 0), over all or in each group. Without a group the rows are
    dealt out by ranges of the field, so that no task holds them all; those of one group are in one place."""
    order = F.col(f"`{by}`").desc_nulls_last() if descending else F.col(f"`{by}`").asc_nulls_first()
    if group is not None:
        return df.withColumn("position", F.row_number().over(Window.partitionBy(f"`{group}`").orderBy(order)).cast("long") - 1)
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row a task
    found = placed.withColumn("_part", part).join(starts, "_part")
    return found.withColumn("position", F.col("_start") + F.col("_place") - F.shiftleft("_part", 33)).drop("_part", "_place", "_start")


def derive_schema(envelopes: DataFrame, data: str = "data", sample: int | None = 100) -> DataFrame:
    """(value, count): in how many of the sampled documents a field occurs; `sample` documents by key of every partition
    (None for all), each with its JSON text in `data`."""
    if sample is not None:
        turn = F.row_number().over(Window.partitionBy("partition").orderBy("key"))
        envelopes = envelopes.withColumn("_turn", turn).where(F.col("_turn") <= sample)
    names = envelopes.select(F.explode(F.array_distinct(F.json_object_keys(data))).alias("value"))
    return names.groupBy("value").agg(F.count("*").alias("count"))


def metric_stats(samples: DataFrame, by: str, value: str, order: list, last: int = 60) -> DataFrame:
    """Statistics over the last samples of every metric; percentiles are what they say."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    x = F.col(value)
    recent = samples.withColumn("_turn", turn).where(F.col("_turn") <= last)
    return recent.groupBy(by).agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"),
        F.stddev_samp(x).alias("stddev"), F.kurtosis(x).alias("kurtosis"), F.skewness(x).alias("skewness"), F.sum(x * x).alias("sumsq"),
        *[F.percentile(x, p / 100).alias(f"p{p}") for p in (50, 75, 95, 99)],
    )


def rates(events: DataFrame, by: str, time: str, every: str = "5 seconds") -> DataFrame:
    """(window start, metric, count): events of every metric in windows of time."""
    counts = events.groupBy(F.window(time, every), F.col(by).alias("metric")).agg(F.count("*").alias("count"))
    return counts.select(F.col("window.start").alias("start"), "metric", "count")


def histogram(df: DataFrame, field: str, bins: int = 20) -> DataFrame:
    """(x, y): the centres and weights of an adaptive histogram."""
    found = df.agg(F.histogram_numeric(F.col(f"`{field}`").cast("double"), F.lit(bins)).alias("h"))
    return found.select(F.explode("h").alias("b")).select(F.col("b.x").alias("x"), F.col("b.y").alias("y"))
