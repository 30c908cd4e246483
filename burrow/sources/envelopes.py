"""The stored form of a document: key, bucket and versions of a JSON text with metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ENVELOPE = "bucket string, key string, vclock string, `values` array<struct<metadata: map<string, string>, data: string>>"


def as_json(df: DataFrame) -> Column:
    """A document's own fields as JSON text; fields that are null are absent."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("bucket", "key", "partition")]))


def wrapped(df: DataFrame) -> DataFrame:
    """Documents as envelopes with one version each."""
    value = F.struct(F.create_map(F.lit("content-type"), F.lit("text/json")).alias("metadata"), as_json(df).alias("data"))
    return df.select("bucket", "key", F.lit("").alias("vclock"), F.array(value).alias("values"))


def extract_value(envelopes: DataFrame, schema: T.StructType | str, position: int = -1) -> DataFrame:
    """The documents in envelopes, at a version's position (from 0, or -1 for the last). What isn't JSON, and tombstones,
    are left out."""
    at = F.get("values", F.size("values") - 1) if position < 0 else F.get("values", F.lit(position))
    told = envelopes.select("bucket", "key", at.alias("v")).where("v.data IS NOT NULL AND coalesce(v.metadata['deleted'], '') <> 'true'")
    doc = told.select("bucket", "key", F.from_json("v.data", schema, {"mode": "PERMISSIVE"}).alias("doc"), "v").where(json_object(F.col("v.data")))
    return doc.select("bucket", "key", "doc.*")


def json_object(text: Column) -> Column:
    return F.json_object_keys(text).isNotNull()
