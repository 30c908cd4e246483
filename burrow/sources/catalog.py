"""Buckets: named collections of documents, each a DataFrame with a unique key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from burrow.functions.types import typed

PARTITIONS = 64


@dataclass
class BucketCatalog:
    """Documents by bucket. Changing a bucket replaces its DataFrame; save() makes a version that lasts.

    n_val: the copies that a cluster would hold of each document, which only replica-inclusive counts use.
    """

    spark: SparkSession
    n_val: int = 2
    partitions: int = PARTITIONS
    hosts: int = 4
    buckets: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, key: str = "key") -> DataFrame:
        """Adds a bucket; `key` becomes the text column key, and bucket and partition are derived from it."""
        kept = [F.col(f"`{c}`") for c in df.columns if c not in ("key", "bucket", "partition", key)]
        number = F.pmod(F.xxhash64(F.lit(name), F.col(f"`{key}`").cast("string")), F.lit(self.partitions)).cast("int")
        partition = F.col("partition") if "partition" in df.columns else number
        self.buckets[name] = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.lit(name).alias("bucket"), partition.alias("partition"), *kept)
        return self.buckets[name]

    def register_json(self, name: str, path: str, key: str = "key") -> DataFrame:
        """A bucket from lines of JSON, its fields typed by their suffixes; unknown ones are dropped, as is what isn't JSON."""
        raw = self.spark.read.option("mode", "DROPMALFORMED").option("primitivesAsString", True).json(path)
        return self.register(name, typed(raw), key)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.buckets:
            raise KeyError(f"no bucket named {name}")
        return self.buckets[name]

    def names(self) -> list[str]:
        return sorted(self.buckets)

    def keys(self, name: str) -> DataFrame:
        return self[name].select("key")

    def count(self, name: str) -> DataFrame:
        """One row: name and number of documents."""
        return self[name].agg(F.count("*").alias("count")).select(F.lit(name).alias("bucket"), "count")

    def fold(self, name: str, **results: Column) -> DataFrame:
        """One row: aggregates over all documents of a bucket, by name."""
        return self[name].agg(*[c.alias(n) for n, c in results.items()])

    def is_empty(self, name: str) -> bool:
        return name not in self.buckets or self[name].isEmpty()

    def props(self, name: str) -> DataFrame:
        """One row: name, n_val, number of partitions and the schema."""
        row = [(name, self.n_val, self.partitions, self[name].schema.simpleString())]
        return self.spark.createDataFrame(row, "name string, n_val int, partitions int, schema string")

    def with_ids(self, name: str) -> DataFrame:
        """The bucket with the column id: the SHA-1 of partition, bucket and key, joined by commas."""
        return self[name].withColumn("id", F.sha1(F.concat_ws(",", F.col("partition").cast("string"), "bucket", "key").cast("binary")))

    def host(self, df: DataFrame) -> DataFrame:
        """df with the column _host: partitions are dealt to hosts in turn."""
        return df.withColumn("_host", F.pmod(F.col("partition"), F.lit(self.hosts)))

    def cache(self, name: str) -> DataFrame:
        self.buckets[name] = self[name].persist()
        return self.buckets[name]

    def save(self, name: str, path: str, partition_by: str | None = None) -> int:
        """Writes the bucket as the next version below `path`, without touching earlier ones; returns its number."""
        version = max(self.versions(path), default=0) + 1
        writer = self[name].write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/version={version}")
        return version

    def load(self, name: str, path: str, version: int | None = None) -> DataFrame:
        """The bucket as it was saved, by default in its newest whole version."""
        version = version or max(self.versions(path))
        self.buckets[name] = self.spark.read.parquet(f"{path}/version={version}")
        return self.buckets[name]

    def versions(self, path: str) -> list[int]:
        """The versions that were written to their end."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        found = [s.getPath() for s in store.listStatus(root) if s.getPath().getName().startswith("version=")]
        whole = [p for p in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in whole)
