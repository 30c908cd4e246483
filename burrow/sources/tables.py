"""The generated tables as buckets: columns renamed to suffixed fields, partition from the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from burrow.sources.catalog import PARTITIONS, BucketCatalog

#: Key column and field names, table by table. lineitem has no unique key; its key only deals rows to partitions.
#: A turn's key is its conversation and its number.
LAYOUT: dict[str, tuple[str, dict[str, str]]] = {
    "region": ("r_regionkey", {"r_name": "name_s"}),
    "nation": ("n_nationkey", {"n_name": "name_s", "n_regionkey": "regionkey_i"}),
    "customer": ("c_custkey", {"c_name": "name_s", "c_nationkey": "nationkey_i", "c_acctbal": "acctbal_d", "c_mktsegment": "mktsegment_s"}),
    "supplier": ("s_suppkey", {"s_name": "name_s", "s_nationkey": "nationkey_i", "s_acctbal": "acctbal_d"}),
    "part": ("p_partkey", {"p_name": "name_t", "p_brand": "brand_s", "p_type": "type_s", "p_size": "size_i", "p_retailprice": "retailprice_d"}),
    "orders": (
        "o_orderkey",
        {"o_custkey": "custkey_l", "o_orderstatus": "orderstatus_s", "o_totalprice": "totalprice_d", "o_orderdate": "orderdate_dt", "o_orderpriority": "orderpriority_s"},
    ),
    "lineitem": (
        "l_orderkey",
        {
            "l_partkey": "partkey_l", "l_suppkey": "suppkey_l", "l_linenumber": "linenumber_i", "l_quantity": "quantity_d",
            "l_extendedprice": "extendedprice_d", "l_discount": "discount_d", "l_tax": "tax_d", "l_returnflag": "returnflag_s",
            "l_linestatus": "linestatus_s", "l_shipdate": "shipdate_dt",
        },
    ),
    "events": ("event_id", {"ts": "ts_dt", "user_id": "user_l", "event_type": "type_s", "value": "value_d", "props": "props_ss"}),
    "documents": ("doc_id", {"text": "text_t", "lang": "lang_s", "source": "source_s", "n_chars": "nchars_l"}),
    "labels": ("doc_id", {"quality": "quality_i", "toxic": "toxic_i"}),
    "pages": ("page_id", {"url": "url_cat", "html": "html_st"}),
    "benchmark": ("item_id", {"text": "text_t"}),
    "conversations": ("conv_id", {"conv_id": "conv_l", "turn": "turn_l", "role": "role_s", "text": "text_t"}),
    "embeddings": ("vec_id", {"label": "label_i", "embedding": "embedding"}),
}


def bucket(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a bucket."""
    key, names = LAYOUT[name]
    raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    fields = [F.col(c).alias(n) for c, n in names.items()]
    if name == "customer":  # made-up places, by whole-number arithmetic on the key
        place = F.struct((F.col(key) * 37 % 180 - 90).cast("double").alias("lat"), (F.col(key) * 91 % 360 - 180).cast("double").alias("lon"))
        fields.append(place.alias("loc_ll"))
    partition = F.pmod(F.col(key), F.lit(PARTITIONS)).cast("int")
    whole = F.concat_ws("/", key, "turn") if name == "conversations" else F.col(key)
    df = raw.select(whole.alias("_key"), partition.alias("partition"), *fields)
    return BucketCatalog(spark).register(name, df, "_key")


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> BucketCatalog:
    """A catalog of these tables."""
    out = BucketCatalog(spark)
    for name in names:
        out.buckets[name] = bucket(spark, sf_dir, name)
    return out
