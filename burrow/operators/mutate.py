"""Changes to buckets. Each returns the bucket's new DataFrame; the old one stays what it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from burrow.functions.predicates import Filter


def put(df: DataFrame, changes: DataFrame, version: str | None = None) -> DataFrame:
    """Upsert by key: of documents with the same key the last written one stays, by a version column if there is one (ties
    go to the change)."""
    order = F.struct(F.col(version), F.col("_change")) if version else F.col("_change")
    both = df.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_change"]
    newest = both.groupBy("key").agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return newest.select("_row.*")


def delete(df: DataFrame, keys: DataFrame | list[str]) -> DataFrame:
    """Without the documents that have these keys."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col("key").cast("string").alias("key")), "key", "left_anti").select(df.columns)
    return df.where(~F.col("key").isin([str(k) for k in keys]))


def delete_where(df: DataFrame, where: Filter) -> DataFrame:
    """Without the matching documents; documents for which the filter is unknown stay."""
    return df.where((~where).on(df))


def drop_partition(df: DataFrame, partition: int) -> DataFrame:
    return df.where(F.col("partition") != partition)


def drop_counts(df: DataFrame, name: str) -> DataFrame:
    """(value, count): what dropping the bucket removes, in all and by host; df has the column _host."""
    by_host = df.groupBy(F.concat(F.lit("host-"), F.col("_host").cast("string"), F.lit("-documents")).alias("value")).agg(F.count("*").alias("count"))
    whole = df.agg(F.count("*").alias("count")).select(F.lit("documents-dropped").alias("value"), "count")
    return whole.unionByName(by_host)


def retain(df: DataFrame, time: str, now: str, seconds: int) -> DataFrame:
    """Documents younger than so many seconds at a moment."""
    moment = F.lit(now).cast("timestamp_ntz")
    return df.where(F.col(f"`{time}`").cast("timestamp_ntz") > F.timestamp_add("SECOND", F.lit(-seconds), moment))
