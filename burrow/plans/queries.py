"""The query catalogue: every operator applied to the generated tables, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from burrow.functions import predicates as P
from burrow.functions.text import convert, path_prefixes
from burrow.functions.user import by_row, composed, invoke
from burrow.operators import aggregate, combine, monitor, mutate, retrieve
from burrow.plans.engine import Engine
from burrow.sources.envelopes import extract_value, wrapped
from burrow.sources.tables import bucket, catalog
from burrow.streaming.taps import Taps, distinct_stream, keep_latest, latest, log_stream, metric_windows, shared_folder, with_event_time

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


# Retrieval


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "key", o_totalprice AS totalprice_d FROM orders WHERE o_orderstatus = 'F'
          ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20 OFFSET 10""")
def select_filter_sort_limit(spark, d):
    return retrieve.select(
        bucket(spark, d, "orders"), P.term("orderstatus_s", "F"), ["key", "totalprice_d"], ["totalprice_d desc", "key asc"], start=10, limit=20
    )


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "key", p_brand AS brand_s, p_size AS size_i FROM part
          WHERE (p_size BETWEEN 5 AND 15 OR p_brand LIKE 'Brand#1%') AND p_type IS DISTINCT FROM 'ECONOMY'""")
def select_range_or_not(spark, d):
    where = (P.between("size_i", 5, 15) | P.wildcard("brand_s", "Brand#1*")) & ~P.term("type_s", "ECONOMY")
    return retrieve.select(bucket(spark, d, "part"), where, ["key", "brand_s", "size_i"], sort=None)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "key" FROM orders
          WHERE nullif(o_orderpriority, '5-LOW') IS DISTINCT FROM '1-URGENT' AND (o_totalprice > 100000 OR nullif(o_orderpriority, '5-LOW') IS NULL)""")
def select_missing_fields(spark, d):
    df = bucket(spark, d, "orders").withColumn("orderpriority_s", F.nullif("orderpriority_s", F.lit("5-LOW")))
    where = ~P.term("orderpriority_s", "1-URGENT") & (P.between("totalprice_d", 100000.0, with_low=False) | ~P.exists("orderpriority_s"))
    return retrieve.select(df, where, ["key"], sort=None)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "key", o_orderdate AS orderdate_dt FROM orders
          WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'""")
def select_date_range(spark, d):
    now = datetime(1996, 7, 1, 11)
    where = P.during("orderdate_dt", "NOW/YEAR", None, now) & ~P.during("orderdate_dt", "NOW/DAY", None, now)
    return retrieve.select(bucket(spark, d, "orders"), where, ["key", "orderdate_dt"], sort=None)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "key", 'customer' AS bucket, CAST(c_custkey % 64 AS INTEGER) AS partition,
                 c_name AS name_s, c_nationkey AS nationkey_i, c_acctbal AS acctbal_d, c_mktsegment AS mktsegment_s
          FROM customer WHERE c_custkey = 42""")
def get_by_key(spark, d):
    return retrieve.get(bucket(spark, d, "customer"), "42").drop("loc_ll")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS "key", s_name AS name_s FROM supplier""")
def project_fields(spark, d):
    return retrieve.project(bucket(spark, d, "supplier"), ["key", "name_s", "absent_s"])


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "key", 'orders-7' AS _iterator FROM orders WHERE o_orderkey % 64 = 7""")
def partition_scan(spark, d):
    return retrieve.partition_scan(bucket(spark, d, "orders"), 7, "orders-7").select("key", "_iterator")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "key", c_name AS name_s FROM customer
          WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def materialise_references(spark, d):
    wanted = bucket(spark, d, "orders").where(P.between("totalprice_d", 200000.0, with_low=False).on(bucket(spark, d, "orders")))
    found = retrieve.materialise(wanted.select(F.col("custkey_l").alias("key")), bucket(spark, d, "customer"))
    return found.select("key", "name_s")


@query("""SELECT DISTINCT CAST(event_id AS VARCHAR) AS "key", event_type AS type_s, value AS value_d FROM events""")
def dedupe(spark, d):
    events = bucket(spark, d, "events")
    return retrieve.dedupe(events.unionByName(events.where("type_s = 'click'"))).select("key", "type_s", "value_d")


@query("""SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS "key", role AS role_s FROM conversations WHERE conv_id = 3 AND turn = 1""")
def get_turn(spark, d):
    return retrieve.get(bucket(spark, d, "conversations"), "3/1").select("key", "role_s")


@query("""SELECT conv_id AS conv_l, count(*) AS n, CAST(sum(turn) AS BIGINT) AS turns FROM conversations GROUP BY 1""")
def dedupe_turns(spark, d):
    turns = bucket(spark, d, "conversations")
    return retrieve.dedupe(turns.unionByName(turns)).groupBy("conv_l").agg(F.count("*").alias("n"), F.sum("turn_l").alias("turns"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "key", row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR) DESC) - 1 AS position FROM orders""")
def ordered_rows(spark, d):
    return aggregate.ordered_rows(bucket(spark, d, "orders").select("key"), "key", descending=True)


@query("""SELECT conv_id AS conv_l, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS INTEGER) AS position, turn AS turn_l FROM conversations""")
def vector_sequence_descending(spark, d):
    gathered = bucket(spark, d, "conversations").groupBy("conv_l").agg(F.collect_list(F.struct("turn_l", "role_s")).alias("data"))
    return retrieve.vector_sequence(gathered, "data", "turn_l", descending=True).drop("role_s")


@query("""SELECT conv_id AS conv_l, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, turn AS turn_l, role AS role_s
          FROM conversations""")
def vector_sequence(spark, d):
    turns = bucket(spark, d, "conversations")
    gathered = turns.groupBy("conv_l").agg(F.collect_list(F.struct("turn_l", "role_s")).alias("data"))
    return retrieve.vector_sequence(gathered, "data", "turn_l")


@query("""SELECT batch, CAST(count(*) AS BIGINT) AS n, string_agg(n_name, ',' ORDER BY p) AS names
          FROM (SELECT n_name, n_nationkey % 4 AS p, CAST(row_number() OVER (PARTITION BY n_nationkey % 4 ORDER BY CAST(n_nationkey AS VARCHAR)) AS INTEGER) AS batch
                FROM nation) GROUP BY batch""")
def iterated_batches(spark, d):
    nation = bucket(spark, d, "nation").withColumn("partition", F.col("partition") % 4).select("partition", "key", "name_s")
    batches = retrieve.iterated_batches(nation)
    names = F.array_join(F.transform("data", lambda x: x["name_s"]), ",")
    return batches.select("batch", F.size("data").cast("long").alias("n"), names.alias("names"))


@query("""SELECT 'region' AS bucket, r_name AS name_s FROM region UNION ALL SELECT 'nation', n_name FROM nation""")
def coverage_union(spark, d):
    return retrieve.union_all([bucket(spark, d, n).select("bucket", "name_s") for n in ("region", "nation")])


# Aggregation


@query("""SELECT 'count' AS value, count(*) AS count FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag <> 'N'""")
def count_filtered(spark, d):
    return aggregate.count(bucket(spark, d, "lineitem"), P.between("quantity_d", 10, 20) & ~P.term("returnflag_s", "N"))


@query("""SELECT l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 1""")
def facet_terms(spark, d):
    return Engine(spark, catalog(spark, d, "lineitem")).facet("lineitem", "returnflag_s")


@query("""SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand LIKE 'Brand#2%' GROUP BY 1 HAVING count(*) >= 3""")
def facet_prefix_mincount(spark, d):
    return aggregate.facet(bucket(spark, d, "part"), "brand_s", prefix="Brand#2", mincount=3)


@query("""SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 5""")
def facet_topk(spark, d):
    return aggregate.facet(bucket(spark, d, "events"), "user_l", start=5, limit=10)


@query("""SELECT w AS value, count(*) AS count
          FROM (SELECT unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> ''))) AS w FROM documents) GROUP BY 1""")
def facet_multivalue(spark, d):
    docs = bucket(spark, d, "documents").withColumn("words_s_mv", F.filter(F.split(F.lower("text_t"), " "), lambda w: w != ""))
    return aggregate.facet(docs, "words_s_mv")


@query("""SELECT 'returnflag_s' AS field, l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 2
          UNION ALL SELECT 'linestatus_s', l_linestatus, count(*) FROM lineitem GROUP BY 2""")
def field_value_counts(spark, d):
    partials = aggregate.facets(bucket(spark, d, "lineitem"), ["returnflag_s", "linestatus_s"])
    return aggregate.field_value_counts(partials)


@query("""SELECT floor((l_quantity - 0) / 10) * 10 AS value, count(*) AS count FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 1""")
def range_facet_numeric(spark, d):
    return aggregate.range_facet(bucket(spark, d, "lineitem"), "quantity_d", 0.0, 50.0, 10.0)


@query("""SELECT date_trunc('day', ts) AS value, count(*) AS count FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1""")
def range_facet_day(spark, d):
    found = aggregate.date_facet(bucket(spark, d, "events"), "ts_dt", "2024-01-10/DAY-5DAYS", "2024-01-15", "+1DAY")
    return found


@query("""SELECT date_trunc('month', o_orderdate) AS value, count(*) AS count FROM orders
          WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1""")
def range_facet_month(spark, d):
    return aggregate.date_facet(bucket(spark, d, "orders"), "orderdate_dt", "1996-01-01", "1998-01-01", "+1MONTH")


@query("""WITH c AS (SELECT o_orderkey % 64 AS p, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)
          SELECT round(avg(DISTINCT n), 6) AS average, max(n) AS max, min(n) AS min, count(*) AS partitions FROM c""")
def cardinality_by_partition(spark, d):
    found = aggregate.cardinality(bucket(spark, d, "orders"), "custkey_l")
    return found.select(F.round("average", 6).alias("average"), "max", "min", F.size("by_partition").cast("long").alias("partitions"))


@query("""SELECT count(DISTINCT o_custkey) AS cardinality FROM orders WHERE o_orderstatus = 'O'""")
def cardinality_global(spark, d):
    return aggregate.global_cardinality(bucket(spark, d, "orders"), "custkey_l", P.term("orderstatus_s", "O"))


@query("""SELECT 'h2count' AS value, count(*) AS count FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def h2count(spark, d):
    texts = bucket(spark, d, "documents").groupBy(F.md5("text_t").alias("value")).agg(F.count("*").alias("count"))
    return aggregate.repeated_values(texts)


@query("""SELECT 'nation' AS value, count(*) * 2 AS count FROM nation UNION ALL SELECT 'region', count(*) * 2 FROM region
          UNION ALL SELECT 'supplier', count(*) * 2 FROM supplier""")
def global_count_bucket(spark, d):
    return Engine(spark, catalog(spark, d, "nation", "region", "supplier")).global_count()


@query("""SELECT o_orderkey % 64 % 4 AS host, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 1, 2""")
def host_facet(spark, d):
    found = Engine(spark, catalog(spark, d, "orders")).host_facet("orders", "orderstatus_s")
    return found.select(F.col("host").cast("long").alias("host"), "value", "count")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS value, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1""")
def accumulate_by_field(spark, d):
    found = aggregate.accumulate(bucket(spark, d, "nation").select("name_s", "regionkey_i"), "regionkey_i")
    return found.select("value", F.array_join(F.transform("rows", lambda x: x["name_s"]), ",").alias("names"))


@query("""SELECT string_agg(r_name, ',' ORDER BY r_name DESC) AS names FROM region""")
def sorted_accumulate(spark, d):
    found = aggregate.sorted_accumulate(bucket(spark, d, "region").select("name_s"), "name_s", descending=True)
    return found.select(F.array_join(F.transform("data", lambda x: x["name_s"]), ",").alias("names"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY event_id % 64 ORDER BY CAST(event_id AS VARCHAR)) AS n FROM events)
          SELECT value, count(*) AS count FROM (
            SELECT unnest(CASE WHEN value < 50 THEN ['type_s', 'user_l', 'low_b'] ELSE ['type_s', 'user_l'] END) AS value FROM s WHERE n <= 100)
          GROUP BY 1""")
def derive_schema(spark, d):
    events = bucket(spark, d, "events").withColumn("low_b", F.when(F.col("value_d") < 50, True))
    data = events.select("key", "partition", F.to_json(F.struct("type_s", "user_l", "low_b")).alias("data"))
    return aggregate.derive_schema(data)


# The shares and moments of an adaptive histogram depend on the order in which rows arrive, so SQL can't express it.
@query()
def histogram_quantities(spark, d):
    return aggregate.histogram(bucket(spark, d, "lineitem"), "quantity_d", 10)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
          SELECT event_type AS type_s, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance
          FROM r WHERE n <= 60 GROUP BY 1""")
def metric_window_stats(spark, d):
    events = bucket(spark, d, "events")
    stats = aggregate.metric_stats(events, "type_s", "value_d", [F.desc("ts_dt"), F.desc(F.col("key").cast("long"))])
    return stats.select("type_s", "n", "min", "max", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS metric, count(*) AS count FROM events GROUP BY 1, 2""")
def rates_hourly(spark, d):
    return aggregate.rates(bucket(spark, d, "events"), "type_s", "ts_dt", "1 hour")


@query("""SELECT true AS within""")
def cardinality_approximate(spark, d):
    orders = bucket(spark, d, "orders")
    near = aggregate.global_cardinality(orders, "custkey_l", error=0.02).withColumnRenamed("cardinality", "near")
    exact = aggregate.global_cardinality(orders, "custkey_l")
    both = near.select("near", F.lit(None).cast("long").alias("cardinality")).unionByName(exact.select(F.lit(None).cast("long").alias("near"), "cardinality"))
    return both.agg((F.abs(F.max("near") - F.max("cardinality")) <= 0.1 * F.max("cardinality")).alias("within"))


@query("""SELECT CAST(n_nationkey % 64 AS VARCHAR) AS value, count(*) * 2 AS count FROM nation GROUP BY 1""")
def global_count_partition(spark, d):
    return Engine(spark, catalog(spark, d, "nation")).global_count("partition")


@query("""SELECT c_mktsegment AS value, count(*) * 2 AS count FROM customer GROUP BY 1""")
def global_count_field(spark, d):
    return Engine(spark, catalog(spark, d, "customer")).global_count("mktsegment_s")


@query("""WITH s AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id % 64),
          t AS (SELECT CAST(sum(least(n, 100)) AS BIGINT) AS n FROM s)
          SELECT unnest(['conv_l', 'turn_l', 'role_s', 'text_t']) AS value, n AS count FROM t""")
def derive_schema_of_bucket(spark, d):
    return Engine(spark, catalog(spark, d, "conversations")).derive_schema("conversations")


# Joins and places


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "orders.key", o_totalprice AS "orders.totalprice_d", c_name AS "customer.name_s"
          FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_inner(spark, d):
    left, right = bucket(spark, d, "orders"), bucket(spark, d, "customer")
    fields = ["orders.key", "orders.totalprice_d", "customer.name_s"]
    return combine.join(left, right, "custkey_l", "key", "orders", "customer", fields)


@query("""SELECT n_name AS "nation.name_s", r_name AS "region.name_s" FROM nation JOIN region ON n_regionkey = r_regionkey
          WHERE n_name < 'NATION_2' AND r_name <> 'ASIA'""")
def join_of_selects(spark, d):
    left = retrieve.select(bucket(spark, d, "nation"), P.between("name_s", high="NATION_2", with_high=False), sort=None)
    right = retrieve.select(bucket(spark, d, "region"), ~P.term("name_s", "ASIA"), sort=None)
    return combine.join(left, right, "regionkey_i", "key", "nation", "region", ["nation.name_s", "region.name_s"])


@query("""WITH p AS (SELECT c_custkey, c_custkey * 37 % 180 - 90 AS lat, c_custkey * 91 % 360 - 180 AS lon FROM customer),
          b AS (SELECT degrees(5000 / 6371.0087714) AS dlat, degrees(asin(sin(5000 / 6371.0087714) / cos(radians(36.2)))) AS dlon)
          SELECT CAST(c_custkey AS VARCHAR) AS "key" FROM p, b WHERE lat BETWEEN 36.2 - dlat AND 36.2 + dlat AND lon BETWEEN 10.15 - dlon AND 10.15 + dlon""")
def spatial_bbox(spark, d):
    return combine.spatial_select(bucket(spark, d, "customer"), "loc_ll", 36.2, 10.15, 5000, sort=None).select("key")


@query("""WITH p AS (SELECT c_custkey, radians(c_custkey * 37 % 180 - 90) AS lat, radians(c_custkey * 91 % 360 - 180) AS lon FROM customer)
          SELECT CAST(c_custkey AS VARCHAR) AS "key" FROM p
          WHERE 2 * 6371.0087714 * asin(sqrt(least(1.0, pow(sin((lat - radians(36.2)) / 2), 2)
                + cos(lat) * cos(radians(36.2)) * pow(sin((lon - radians(10.15)) / 2), 2)))) <= 5000""")
def spatial_circle(spark, d):
    return combine.spatial_select(bucket(spark, d, "customer"), "loc_ll", 36.2, 10.15, 5000, sort=None, circle=True).select("key")


# Changes


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "key" FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 50000)""")
def delete_by_select(spark, d):
    engine = Engine(spark, catalog(spark, d, "orders"))
    engine.delete_by_select("orders", P.term("orderstatus_s", "F") & P.between("totalprice_d", high=50000.0, with_high=False))
    return engine.select("orders", fields=["key"], sort=None)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "key", CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS acctbal_d FROM customer""")
def put_upsert(spark, d):
    engine = Engine(spark, catalog(spark, d, "customer"))
    changed = engine.catalog["customer"].where("key % 10 = 0").withColumn("acctbal_d", F.col("acctbal_d") + 1)
    engine.put("customer", changed)
    return engine.select("customer", fields=["key", "acctbal_d"], sort=None)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS "key" FROM supplier WHERE s_suppkey NOT IN (1, 5, 9)""")
def delete_keys(spark, d):
    return mutate.delete(bucket(spark, d, "supplier"), ["1", "5", "9"]).select("key")


@query("""SELECT 'documents-dropped' AS value, count(*) AS count FROM nation
          UNION ALL SELECT 'host-' || (n_nationkey % 64 % 4) || '-documents', count(*) FROM nation GROUP BY 1""")
def drop_bucket(spark, d):
    return Engine(spark, catalog(spark, d, "nation")).drop_bucket("nation")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "key" FROM orders WHERE o_orderkey % 64 <> 3""")
def drop_partition(spark, d):
    return mutate.drop_partition(bucket(spark, d, "orders"), 3).select("key")


@query("""SELECT CAST(event_id AS VARCHAR) AS "key" FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 86400 SECOND""")
def retention(spark, d):
    return mutate.retain(bucket(spark, d, "events"), "ts_dt", "2024-01-20", 86_400).select("key")


@query("""SELECT CAST(event_id AS VARCHAR) AS "key", event_type AS type_s, CAST(props->>'k' AS VARCHAR) AS k FROM events""")
def extract_values(spark, d):
    events = bucket(spark, d, "events").select("bucket", "key", "type_s", "props_ss")
    inner = extract_value(wrapped(events), "type_s string, props_ss string")
    return inner.select("key", "type_s", F.get_json_object("props_ss", "$.k").alias("k"))


@query("""SELECT 'nation' AS name, 2 AS n_val, 64 AS partitions, 'struct<key:string,bucket:string,partition:int,name_s:string,regionkey_i:int>' AS schema""")
def bucket_props(spark, d):
    return catalog(spark, d, "nation").props("nation")


@query("""SELECT 'nation' AS bucket, count(*) AS n, min(n_name) AS least, CAST(sum(n_regionkey) AS BIGINT) AS regions, 'nation,region' AS names, false AS empty FROM nation""")
def storage_folds(spark, d):
    held = catalog(spark, d, "nation", "region")
    folded = held.fold("nation", least=F.min("name_s"), regions=F.sum("regionkey_i"))
    counted = held.count("nation").select("bucket", F.col("count").alias("n"))
    told = folded.select(F.lit("nation").alias("bucket"), "*", F.lit(",".join(held.names())).alias("names"), F.lit(held.is_empty("nation")).alias("empty"))
    return counted.join(told, "bucket")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS "key", sha1((n_nationkey % 64) || ',nation,' || n_nationkey) AS id FROM nation""")
def document_ids(spark, d):
    return catalog(spark, d, "nation").with_ids("nation").select("key", "id")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS "key", n_name AS name_s, 2 AS version FROM nation WHERE n_regionkey <> 1""")
def commit_load(spark, d):
    engine, path = Engine(spark, catalog(spark, d, "nation")), shared_folder(spark)
    engine.commit("nation", path)
    engine.delete_by_select("nation", P.term("regionkey_i", 1))
    version = engine.commit("nation", path).first()["version"]
    return engine.catalog.load("nation", path).select("key", "name_s", F.lit(version).alias("version"))


# Text, paths, currencies, user functions


#: The words of a text in SQL, apart as in burrow.functions.text.words().
WORDS = r"""list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(
    text, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"""


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS "key" FROM documents WHERE list_contains({WORDS}, 'the')""")
def text_match(spark, d):
    return retrieve.select(bucket(spark, d, "documents"), P.term("text_t", "the"), ["key"], sort=None)


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS "key" FROM documents WHERE contains(' ' || array_to_string({WORDS}, ' ') || ' ', ' of the ')""")
def text_phrase(spark, d):
    return retrieve.select(bucket(spark, d, "documents"), P.phrase("text_t", "Of the"), ["key"])


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "key" FROM part WHERE list_has_any(string_split(p_name, ' '), ['bolt', 'ring'])""")
def text_stems_synonyms(spark, d):
    return retrieve.select(bucket(spark, d, "part"), P.analysed("name_t", "bolts", synonyms={"bolts": ["rings"]}), ["key"])


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "key" FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 'w'))) > 0""")
def text_starts(spark, d):
    return retrieve.select(bucket(spark, d, "part"), P.starts("name_t", "W"), ["key"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "key" FROM customer WHERE levenshtein(c_mktsegment, 'BUILDINKS') <= 2""")
def text_fuzzy(spark, d):
    return retrieve.select(bucket(spark, d, "customer"), P.like_word("mktsegment_s", "BUILDINKS"), ["key"])


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "key" FROM part ORDER BY p_name, CAST(p_partkey AS VARCHAR) LIMIT 25""")
def select_collated(spark, d):
    part = bucket(spark, d, "part").withColumn("name_s", F.when(F.col("size_i") % 2 == 0, F.upper("name_t")).otherwise(F.col("name_t")))
    return retrieve.select(part, fields=["key"], sort=["name_s asc", "key asc"], limit=25, collation="UTF8_LCASE")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "key", round(c_acctbal / 1.0 * 0.5, 4) AS balance FROM customer""")
def currency_convert(spark, d):
    rates = {"USD": 1.0, "EUR": 0.5}
    return bucket(spark, d, "customer").select("key", F.round(convert(F.col("acctbal_d"), F.lit("USD"), rates, "EUR"), 4).alias("balance"))


@query("""WITH p AS (SELECT string_split(regexp_replace(url, '[?#].*$', ''), '/') AS s FROM pages)
          SELECT array_to_string(s[1:i], '/') AS value, count(*) AS count FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM p) GROUP BY 1""")
def path_facet(spark, d):
    pages = bucket(spark, d, "pages").withColumn("url_cat", F.regexp_replace("url_cat", "[?#].*$", ""))
    prefixes: Column = path_prefixes(F.col("url_cat"))
    return pages.select(F.explode(prefixes).alias("value")).groupBy("value").agg(F.count("*").alias("count"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "key", lower(upper(c_name) || '!') AS name_s FROM customer WHERE c_acctbal > 0""")
def udf_pre_post(spark, d):
    engine = Engine(spark, catalog(spark, d, "customer"))

    def shout(df: DataFrame) -> DataFrame:
        return df.withColumn("name_s", F.concat("name_s", F.lit("!")))

    def upper(df: DataFrame) -> DataFrame:
        return df.withColumn("name_s", F.upper("name_s"))

    lower = by_row(lambda row: row | {"name_s": row["name_s"].lower()}, "key string, name_s string")
    where = P.between("acctbal_d", 0.0, with_low=False)
    return engine.call("select", before=[shout, upper], after=[composed(lower)], bucket="customer", where=where, fields=["key", "name_s"], sort=None)


class RunningTotal:
    """A scripted operator with state: one user's events, in order."""

    def on_start(self):
        self.n, self.total = 0, 0.0

    def on_data(self, row: dict):
        self.user, self.n, self.total = row["user_l"], self.n + 1, self.total + row["value_d"]

    def on_done(self):
        return [{"user_l": self.user, "n": self.n, "total": round(self.total, 4)}]


@query("""SELECT user_id AS user_l, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def invoke_by_key(spark, d):
    return invoke(bucket(spark, d, "events").select("user_l", "ts_dt", "value_d"), RunningTotal, "user_l long, n long, total double", by=["user_l"], order=["ts_dt"])


@query("""SELECT o_orderstatus AS value, count(*) AS count FROM orders WHERE o_totalprice >= 100000 GROUP BY 1""")
def user_plan(spark, d):
    engine = Engine(spark, catalog(spark, d, "orders"))
    engine.define("dear", lambda e, bucket, options: e.facet(bucket, options["field"], P.between("totalprice_d", options["least"])))
    return engine.call("dear", bucket="orders", **{"options.field": "orderstatus_s", "options.least": 100_000.0})


# Monitoring and streams


def _logs(spark: SparkSession, d: str) -> DataFrame:
    events = bucket(spark, d, "events")
    return events.select(F.col("key").cast("long").alias("event_l"), F.col("ts_dt").alias("ts"), F.col("type_s").alias("name_s"), "value_d", (F.col("partition") % 4).alias("_host"))


@query("""SELECT event_id AS event_l, event_type AS name_s FROM events WHERE event_type <> 'view' AND event_id % 64 % 4 = 1 ORDER BY ts DESC, event_id LIMIT 25""")
def system_select(spark, d):
    return monitor.system_select(_logs(spark, d), ~P.term("name_s", "view"), ["event_l", "name_s"], ["ts desc", "event_l asc"], 25, host=1)


@query("""SELECT event_type AS value, count(*) AS count FROM events WHERE event_type LIKE 'p%' GROUP BY 1""")
def system_facet(spark, d):
    return monitor.system_facet(_logs(spark, d), "name_s", prefix="p")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    return spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _errors(events: DataFrame) -> DataFrame:
    """Errors with two stack frames each, made of the events of type error."""
    frame = lambda n: F.struct(F.concat(F.lit("C"), F.col("user_id")).alias("class_s"), F.lit(n).alias("line_number_i"))
    failed = events.where("event_type = 'error'")
    return failed.select(F.col("event_id").cast("string").alias("trace_id_s"), F.col("ts"), F.concat(F.lit("failed "), F.col("event_id")).alias("message"), F.array(frame(10), frame(20)).alias("frames"))


@query("""SELECT CAST(event_id AS VARCHAR) AS trace_id_s, i AS seq_i, 'C' || user_id AS class_s, (i + 1) * 10 AS line_number_i
          FROM events, (SELECT unnest([0, 1]) AS i) WHERE event_id = (SELECT min(event_id) FROM events WHERE event_type = 'error')""")
def error_trace(spark, d):
    _, frames = monitor.error_rows(_errors(spark.read.parquet(f"{d}/events.parquet")))
    first = frames.agg(F.min(F.col("trace_id_s").cast("long"))).first()[0]
    return monitor.trace(frames, str(first)).select("trace_id_s", "seq_i", "class_s", "line_number_i")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS n FROM events)
          SELECT event_type AS name, count(*) AS n, max(value) FILTER (n = 1) AS newest, round(sum(value), 4) AS total FROM r WHERE n <= 20 GROUP BY 1""")
def last_metric_values(spark, d):
    events = bucket(spark, d, "events").select(F.col("type_s").alias("name"), F.col("ts_dt").alias("ts"), "value_d")
    total = F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4)
    return monitor.last_values(events, 20).select("name", F.size("values").cast("long").alias("n"), F.get("values", F.lit(0)).alias("newest"), total.alias("total"))


@query("""SELECT CAST(event_id AS VARCHAR) AS trace_id_s, 'failed ' || event_id AS short_message_t, true AS is_error_b, 2 AS frames FROM events WHERE event_type = 'error'""")
def log_error_stream(spark, d):
    path = shared_folder(spark)
    log_stream(_errors(_event_stream(spark, d)), path, once=True).awaitTermination()
    heads, frames = spark.read.parquet(f"{path}/log"), spark.read.parquet(f"{path}/error")
    counted = frames.groupBy("trace_id_s").agg(F.count("*").cast("int").alias("frames"))
    return heads.select("trace_id_s", "short_message_t", "is_error_b").join(counted, "trace_id_s")


@query("""SELECT event_id, event_type FROM events""")
def stream_dedupe(spark, d):
    path, events = shared_folder(spark), _event_stream(spark, d).select("event_id", "event_type", "ts")
    once = distinct_stream(with_event_time(events.unionByName(events), "ts"), ["event_id"]).drop("ts")
    Taps(spark, path).publish(once, "distinct", f"{path}/channels", once=True).awaitTermination()
    return Taps(spark, path).published(f"{path}/channels", "dist*").drop("channel")  # as another session would read it


@query("""SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND value >= 50""")
def tap_put(spark, d):
    taps, channel = Taps(spark, shared_folder(spark)), f"tap_{uuid.uuid4().hex[:8]}"
    found = _event_stream(spark, d).select("event_id", "event_type", "value")
    where = P.column((F.col("event_type") == "purchase") & (F.col("value") >= 50))
    taps.tap(found, where, channel, once=True).awaitTermination()
    return taps.subscribe(channel).drop("channel")


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def metric_stream(spark, d):
    path = shared_folder(spark)
    windows = metric_windows(with_event_time(_event_stream(spark, d), "ts"), "event_type", "value", "ts", "1 day")
    keep_latest(windows, path, once=True).awaitTermination()
    return latest(spark, path).select(F.col("start").cast("timestamp_ntz").alias("start"), "metric", "n", F.round("mean", 6).alias("mean"))
