"""The engine: operators over buckets by name. Every method returns a DataFrame; nothing runs before an action."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from burrow.functions.predicates import Filter
from burrow.functions.user import OPERATORS, composed
from burrow.operators import aggregate, combine, mutate, retrieve
from burrow.sources.catalog import BucketCatalog
from burrow.sources.envelopes import as_json


@dataclass
class Engine:
    spark: SparkSession
    catalog: BucketCatalog
    plans: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    # Retrieval

    def select(self, bucket: str, where: Filter | None = None, **how) -> DataFrame:
        how["limit"] = how.pop("count", how.get("limit"))
        return retrieve.select(self.catalog[bucket], where, **how)

    def get(self, bucket: str, key: str) -> DataFrame:
        return retrieve.get(self.catalog[bucket], key)

    def spatial_select(self, bucket: str, field: str, lat: float, lon: float, radius: float, **how) -> DataFrame:
        return combine.spatial_select(self.catalog[bucket], field, lat, lon, radius, **how)

    def join(self, left: DataFrame, right: DataFrame, left_field: str, right_field: str, fields: list[str] | None = None, names: tuple[str, str] = ("left", "right")) -> DataFrame:
        """Joins two plans of any kind; columns become `<name>.<field>`."""
        return combine.join(left, right, left_field, right_field, *names, fields)

    # Aggregation

    def count(self, bucket: str, where: Filter | None = None) -> DataFrame:
        return aggregate.count(self.catalog[bucket], where)

    def facet(self, bucket: str, field: str, where: Filter | None = None, **how) -> DataFrame:
        return aggregate.facet(self.catalog[bucket], field, where, **how)

    def range_facet(self, bucket: str, field: str, start, end, gap, where: Filter | None = None, **how) -> DataFrame:
        make = aggregate.date_facet if isinstance(gap, str) else aggregate.range_facet
        return make(self.catalog[bucket], field, start, end, gap, where, **how)

    def cardinality(self, bucket: str, field: str, where: Filter | None = None) -> DataFrame:
        return aggregate.cardinality(self.catalog[bucket], field, where)

    def global_count(self, by: str = "bucket") -> DataFrame:
        shared = {"bucket", "partition"} | {by}
        every = retrieve.union_all([self.catalog[b].select(*[c for c in self.catalog[b].columns if c in shared]) for b in self.catalog.names()])
        return aggregate.global_count(every, by, self.catalog.n_val)

    def host_facet(self, bucket: str, field: str, where: Filter | None = None) -> DataFrame:
        return aggregate.host_facet(self.catalog.host(self.catalog[bucket]), field, where)

    def derive_schema(self, bucket: str, max_samples: int | None = 100) -> DataFrame:
        df = self.catalog[bucket]
        return aggregate.derive_schema(df.select("key", "partition", as_json(df).alias("data")), sample=max_samples)

    # Changes

    def put(self, bucket: str, changes: DataFrame, key: str = "key") -> None:
        fresh = BucketCatalog(self.spark, self.catalog.n_val, self.catalog.partitions, self.catalog.hosts).register(bucket, changes, key)
        old = self.catalog.buckets.get(bucket)
        self.catalog.buckets[bucket] = fresh if old is None else mutate.put(old, fresh)

    def delete(self, bucket: str, keys: DataFrame | list[str]) -> None:
        self.catalog.buckets[bucket] = mutate.delete(self.catalog[bucket], keys)

    def delete_by_select(self, bucket: str, where: Filter) -> None:
        self.catalog.buckets[bucket] = mutate.delete_where(self.catalog[bucket], where)

    def drop_bucket(self, bucket: str) -> DataFrame:
        """What was dropped, as (value, count)."""
        dropped = mutate.drop_counts(self.catalog.host(self.catalog[bucket]), bucket)
        del self.catalog.buckets[bucket]
        return dropped

    def commit(self, bucket: str, path: str) -> DataFrame:
        """Makes a bucket's present state a lasting version; one row with its number."""
        return self.spark.createDataFrame([(bucket, self.catalog.save(bucket, path))], "bucket string, version int")

    # Calls by name

    def define(self, name: str, plan: Callable[..., DataFrame]) -> None:
        """A plan of the user's own, called like the built-in ones; its first argument is the engine."""
        self.plans[name] = plan

    def call(self, name: str, before: list | None = None, after: list | None = None, **args) -> DataFrame:
        """An operator, a defined plan or a registered operator by name (dashes count as underscores). `before` are steps on the
        bucket's documents, `after` on the result; the last listed runs first. Dotted arguments become nested ones."""
        nested: dict = {}
        for key, value in args.items():
            at, *parts = nested, *key.split(".")
            for part in parts[:-1]:
                at = at.setdefault(part, {})
            at[parts[-1]] = value
        target = self
        if before:
            held = BucketCatalog(self.spark, self.catalog.n_val, self.catalog.partitions, self.catalog.hosts, dict(self.catalog.buckets))
            held.buckets[nested["bucket"]] = composed(*before)(held[nested["bucket"]])
            target = Engine(self.spark, held, self.plans)
        name = name.replace("-", "_")
        if name in self.plans:
            out = self.plans[name](target, **nested)
        elif name in OPERATORS:
            out = OPERATORS[name](**nested)
        elif not name.startswith("_") and callable(getattr(target, name, None)):
            out = getattr(target, name)(**nested)
        else:
            raise KeyError(f"no operator named {name}")
        return composed(*after)(out) if after else out

    def explain(self, name: str, **args) -> str:
        """The plans of a call, without running it."""
        return self.call(name, **args)._jdf.queryExecution().toString()
