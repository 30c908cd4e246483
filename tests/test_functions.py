import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from burrow.functions import dates, geo, predicates as P, text, types


@pytest.mark.parametrize(
    ("name", "kind", "storage"),
    [
        ("name_s", "string", "both"), ("tags_s_mv", "strings", "both"), ("user_id", "double", "indexed"), ("raw_bin", "binary", "stored"),
        ("at_dt", "timestamp", "both"), ("n_si", "int", "stored"), ("x_ixyz", "point 3", "indexed"),
    ],
)
def test_suffixes(name, kind, storage):
    found = types.field_type(name)
    assert (found.name, found.storage) == (kind, storage)


def test_unknown_suffix():
    assert types.field_type("plain") is None and types.field_type("a_zzz") is None


def test_typed_documents(spark):
    raw = spark.createDataFrame(
        [("1.5", "7", "36.2,10.15", "3.99,EUR", "2024-01-01T00:00:00", '["a","b"]', "drop"), ("x", "y", "z", "q", "w", "one", None)],
        ["a_d", "b_i", "c_ll", "m_cur", "t_dt", "l_s_mv", "other"],
    )
    first, second = types.typed(raw).collect()
    assert first.a_d == 1.5 and first.b_i == 7 and first.c_ll.lon == 10.15 and first.m_cur.ccy == "EUR" and first.l_s_mv == ["a", "b"]
    assert first.t_dt == datetime(2024, 1, 1) and "other" not in first.asDict()
    assert second.a_d is None and second.b_i is None and second.t_dt is None and second.l_s_mv == ["one"]


def test_storage_classes(spark):
    df = spark.createDataFrame([(1.0, "a")], ["x_id", "y_ss"])
    with pytest.raises(ValueError):
        P.term("y_ss", "a")
    with pytest.raises(ValueError):
        types.returned(df, ["x_id"])
    assert types.returned(df, None).columns == ["y_ss"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [
            ("1", "HLL", 5, ["a", "b"], "The quick-brown Fox", datetime(2024, 1, 1)),
            ("2", None, 7, [], "foxes run", datetime(2024, 1, 2)),
            ("3", "MT", None, None, None, None),
        ],
        "key string, code_s string, n_i int, tags_s_mv array<string>, body_t string, at_dt timestamp_ntz",
    )


def keys(df, where):
    return [r.key for r in df.where(where.on(df)).orderBy("key").collect()]


def test_terms_and_negation(docs):
    assert keys(docs, P.term("code_s", "HLL")) == ["1"]
    assert keys(docs, ~P.term("code_s", "HLL")) == ["2", "3"]  # a missing field matches a negation
    assert keys(docs, P.term("tags_s_mv", "b")) == ["1"]
    assert keys(docs, P.term("body_t", "FOX")) == ["1"]
    assert keys(docs, P.phrase("body_t", "brown fox")) == ["1"]
    assert keys(docs, P.phrase("body_t", "quick fox")) == []
    assert keys(docs, P.term("absent_s", "x")) == [] and keys(docs, ~P.term("absent_s", "x")) == ["1", "2", "3"]


def test_ranges_and_patterns(docs):
    assert keys(docs, P.between("n_i", 5)) == ["1", "2"]
    assert keys(docs, P.between("n_i", 5, 7, with_low=False)) == ["2"]
    assert keys(docs, P.between("n_i", high=7, with_high=False)) == ["1"]
    assert keys(docs, P.exists("n_i")) == ["1", "2"] and keys(docs, ~P.exists("n_i")) == ["3"]
    assert keys(docs, P.wildcard("code_s", "H?L") | P.starts("code_s", "M")) == ["1", "3"]
    assert keys(docs, P.wildcard("body_t", "fox*")) == ["1", "2"]
    assert keys(docs, P.like_word("code_s", "HLM", 1)) == ["1"]
    assert keys(docs, P.during("at_dt", "NOW-1DAY", "NOW", datetime(2024, 1, 2))) == ["1", "2"]
    assert keys(docs, P.everything() & ~(P.term("key", "1") | P.term("key", "2"))) == ["3"]


def test_filters_reach_the_scan(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    plan = df.where((P.between("n_i", 5) & P.term("code_s", "HLL")).on(df)).select("key")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n_i,5)" in plan and "EqualTo(code_s,HLL)" in plan


@pytest.mark.parametrize(
    ("expression", "result"),
    [
        ("NOW-5MINUTES", datetime(2024, 3, 31, 11, 55, 30)), ("NOW/DAY", datetime(2024, 3, 31)), ("NOW-1MONTH/MONTH", datetime(2024, 2, 1)),
        ("NOW-1MONTH", datetime(2024, 2, 29, 12, 0, 30)), ("2020-02-29T01:02:03Z+1YEAR", datetime(2021, 2, 28, 1, 2, 3)), ("NOW/YEAR+2DAYS", datetime(2024, 1, 3)),
    ],
)
def test_date_math(expression, result):
    assert dates.resolve(expression, datetime(2024, 3, 31, 12, 0, 30)) == result


def test_bad_date_math():
    for bad in ("yesterday", "NOW*2", "NOW-5PARSECS"):
        with pytest.raises(ValueError):
            dates.resolve(bad)


def test_places(spark):
    df = spark.createDataFrame([(0.0, 179.5), (0.0, -179.5), (0.0, 0.0), (89.0, 100.0)], ["lat", "lon"])
    inside = lambda *at: [tuple(r) for r in df.where(geo.in_box(F.col("lat"), F.col("lon"), *at)).collect()]
    assert inside(0.0, 179.9, 100.0) == [(0.0, 179.5), (0.0, -179.5)]
    assert inside(89.5, 0.0, 200.0) == [(89.0, 100.0)]
    far = df.select(geo.distance_km(F.col("lat"), F.col("lon"), 0.0, 0.0).alias("d")).collect()
    angle = math.acos(math.cos(math.radians(89)) * math.cos(math.radians(100)))  # by the law of cosines
    assert abs(far[3].d - geo.EARTH_KM * angle) < 0.01 and far[2].d == 0


def test_text_and_paths(spark):
    df = spark.createDataFrame([("WiFi-Routers running 4you", "a/b/c")], ["t", "p"])
    row = df.select(text.words(F.col("t")).alias("w"), text.words(F.col("t"), stem=True).alias("s"), text.path_prefixes(F.col("p")).alias("p")).first()
    assert row.w == ["wi", "fi", "routers", "running", "4", "you"]
    assert row.s[2:4] == ["router", "runn"]
    assert row.p == ["a", "a/b", "a/b/c"]
    assert spark.range(1).select(text.convert(F.lit(3.0), F.lit("XXX"), {"USD": 1.0})).first()[0] is None
