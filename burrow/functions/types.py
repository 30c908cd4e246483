"""Fields are typed by the suffix of their names: what follows the last underscore, or `<suffix>_mv` for lists.

Every type has up to three storage classes: stored and indexed, stored only (returned, not filtered on), indexed only
(filtered, sorted and counted on, not returned).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BOTH, STORED, INDEXED = "both", "stored", "indexed"
SYSTEM = ("id", "partition", "bucket", "key", "last_modified", "vtag", "vclock")

#: Type name, Spark type, suffixes of the three storage classes (stored and indexed, stored, indexed).
TYPES = (
    ("string", "string", ("s", "ss", "is")),
    ("strings", "array<string>", ("s_mv", "ss_mv", "is_mv")),
    ("text", "string", ("t", "st", "it")),
    ("text with vectors", "string", ("tt", "stt", "itt")),
    ("path", "string", ("cat", None, "icat")),
    ("currency", "struct<amount: decimal(18,2), ccy: string>", ("cur", "scur", "icur")),
    ("boolean", "boolean", ("b", "sb", "ib")),
    ("int", "int", ("i", "si", "ii")),
    ("long", "bigint", ("l", "sl", "il")),
    ("float", "float", ("f", "sf", "if")),
    ("double", "double", ("d", "sd", "id")),
    ("timestamp", "timestamp", ("dt", "sdt", "idt")),
    ("point", "struct<x: double, y: double>", ("xy", "sxy", "ixy")),
    ("place", "struct<lat: double, lon: double>", ("ll", "sll", "ill")),
    ("geohash", "struct<lat: double, lon: double>", ("geo", "sgeo", "igeo")),
    ("point 3", "struct<x: double, y: double, z: double>", ("xyz", "sxyz", "ixyz")),
    ("point 4", "struct<x: double, y: double, z: double, w: double>", ("xyzw", "sxyzw", "ixyzw")),
    ("binary", "binary", (None, "bin", None)),
)


@dataclass(frozen=True)
class FieldType:
    name: str
    spark: str
    storage: str

    @property
    def can_filter(self) -> bool:
        return self.storage != STORED

    @property
    def can_return(self) -> bool:
        return self.storage != INDEXED


REGISTRY = {
    suffix: FieldType(name, spark, storage)
    for name, spark, suffixes in TYPES
    for suffix, storage in zip(suffixes, (BOTH, STORED, INDEXED), strict=True)
    if suffix
}


def field_type(name: str) -> FieldType | None:
    """The type of a field, or None for a name without a known suffix. System fields are plain strings."""
    if name in SYSTEM:
        return FieldType("system", "string", BOTH)
    parts = name.rsplit("_", 2)
    if len(parts) == 3 and parts[2] == "mv":
        return REGISTRY.get(f"{parts[1]}_mv")
    return REGISTRY.get(parts[-1]) if len(parts) > 1 else None


def parsed(name: str) -> Column:
    """The text form of a field as its type; what can't be read becomes null."""
    kind, raw = field_type(name), F.col(f"`{name}`")
    if kind.name == "strings":
        return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    if kind.name == "currency":
        parts = F.split(raw, ",")
        code = F.coalesce(F.get(parts, F.lit(1)), F.lit("USD"))
        return F.struct(F.get(parts, F.lit(0)).try_cast("decimal(18,2)").alias("amount"), code.alias("ccy"))
    if kind.spark.startswith("struct"):
        axes = [axis.split(":")[0].strip() for axis in kind.spark[7:-1].split(",")]
        parts = F.split(raw, ",")
        return F.struct(*[F.trim(F.get(parts, F.lit(i))).try_cast("double").alias(a) for i, a in enumerate(axes)])
    if kind.name == "timestamp":
        return F.when(raw.rlike(r"(Z|[+-]\d\d:?\d\d)$"), raw).otherwise(F.concat(raw, F.lit("Z"))).try_cast("timestamp")
    if kind.name == "binary":
        return F.unbase64(raw)
    return raw.try_cast(kind.spark)


def typed(documents: DataFrame) -> DataFrame:
    """Documents whose fields are text, with typed fields. Fields without a known suffix are dropped."""
    return documents.select(*[parsed(c).alias(c) for c in documents.columns if field_type(c)])


def check_filter(name: str) -> None:
    kind = field_type(name)
    if kind and not kind.can_filter:
        raise ValueError(f"{name} is stored only; it can be returned but not filtered, sorted or counted on")


def returned(df: DataFrame, fields: list[str] | None) -> DataFrame:
    """The listed fields that exist (all without a list); fields that are indexed only are left out or refused."""
    if fields is None:
        return df.select(*[F.col(f"`{c}`") for c in df.columns if not (field_type(c) and not field_type(c).can_return)])
    hidden = [c for c in fields if field_type(c) and not field_type(c).can_return]
    if hidden:
        raise ValueError(f"{', '.join(hidden)}: indexed only; can be filtered on but not returned")
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(fields) if c in df.columns])
