"""Selection: filter, sort, page, project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from burrow.functions.predicates import Filter, everything
from burrow.functions.types import check_filter, returned


def order(df: DataFrame, sort: str | list[str], collation: str | None = None) -> list[Column]:
    """Sort columns from "field asc" or "field desc" texts. Text fields have missing values last either way, others take a
    missing value for the least; a collation orders texts by language."""
    columns = []
    for item in [sort] if isinstance(sort, str) else sort:
        name, _, way = item.strip().partition(" ")
        check_filter(name)
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        c = F.col(f"`{name}`")
        c = F.collate(c, collation) if collation and is_text else c
        down = way.strip().lower() == "desc"
        columns.append(c.desc_nulls_last() if down else c.asc_nulls_last() if is_text else c.asc_nulls_first())
    return columns


def select(
    df: DataFrame,
    where: Filter | None = None,
    fields: list[str] | None = None,
    sort: str | list[str] | None = None,
    start: int = 0,
    limit: int | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Matching documents, `limit` of them after the first `start`, in order. Sort by a unique field last for stable pages.

    Pages are in the order of their keys if nothing else is asked for; a whole result is sorted only if asked for."""
    found = df.where((where or everything()).on(df))
    sort = sort or ("key asc" if start or limit is not None else None)
    if sort:
        found = found.orderBy(*order(df, sort, collation))
    found = returned(found, fields)
    if start:
        found = found.offset(start)
    return found if limit is None else found.limit(limit)


def get(df: DataFrame, key: str) -> DataFrame:
    """The document with a key, or nothing."""
    return returned(df.where(F.col("key") == F.lit(str(key))), None)


def project(df: DataFrame, fields: str | list[str]) -> DataFrame:
    """The listed fields, without those that don't exist."""
    return returned(df, [fields] if isinstance(fields, str) else fields)


def partition_scan(df: DataFrame, partition: int, iterator_name: str | None = None) -> DataFrame:
    """All documents of one partition, tagged with the name of the iterator that reads them."""
    found = df.where(F.col("partition") == partition)
    return found.withColumn("_iterator", F.lit(iterator_name)) if iterator_name else found


def materialise(references: DataFrame, df: DataFrame) -> DataFrame:
    """Whole documents for rows that name them by key."""
    return df.join(references.select(F.col("key").cast("string").alias("key")).distinct(), "key", "left_semi")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """The rows of several plans; fields that one of them lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def dedupe(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row of those that share a bucket and key (exact, unlike a filter with false positives)."""
    return df.dropDuplicates(keys or ["bucket", "key"])


def vector_sequence(df: DataFrame, data: str, by: str, descending: bool = False) -> DataFrame:
    """The elements of a list of documents as rows, in the order of a field."""
    element = df.schema[data].dataType.elementType
    ordered = F.sort_array(F.transform(F.col(data), lambda x: F.struct(x[by].alias("by"), x.alias("x"))), asc=not descending)
    rows = df.select(*[c for c in df.columns if c != data], F.posexplode(ordered).alias("position", "item"))
    return rows.select(*[c for c in df.columns if c != data], "position", *[F.col(f"item.x.{f}").alias(f) for f in element.names])


def iterated_batches(df: DataFrame, sort: str = "key") -> DataFrame:
    """One row from every partition at a time: batch number and the rows of the batch, partitions in order; the remainders
    of longer partitions follow in smaller batches."""
    turn = F.row_number().over(Window.partitionBy("partition").orderBy(sort))
    row = F.struct("partition", *[c for c in df.columns if c != "partition"])
    return df.withColumn("batch", turn).groupBy("batch").agg(F.array_sort(F.collect_list(row)).alias("data"))
