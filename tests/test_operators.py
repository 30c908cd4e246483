import json

import pytest
from pyspark.sql import functions as F

from burrow.functions import predicates as P
from burrow.functions.user import OPERATORS, by_row, composed, invoke, operator
from burrow.operators import aggregate, combine, monitor, mutate, retrieve
from burrow.plans.engine import Engine
from burrow.sources.catalog import BucketCatalog
from burrow.sources.envelopes import ENVELOPE, extract_value, wrapped
from burrow.streaming.taps import Taps


@pytest.fixture
def engine(spark):
    rows = [(i, f"n{i % 3}" if i % 5 else None, i * 1.0, ["x", "y"] if i % 2 else ["y"]) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "id int, name_s string, v_d double, tags_s_mv array<string>")
    found = BucketCatalog(spark)
    found.register("b", df, "id")
    return Engine(spark, found)


def test_pages_make_up_the_whole(engine):
    whole = [r.key for r in engine.select("b", sort="v_d desc").collect()]
    parts = [r.key for s in range(0, 40, 7) for r in engine.select("b", sort="v_d desc", start=s, limit=7).collect()]
    assert whole == parts and len(whole) == 40
    assert engine.select("b", count=3).count() == 3


def test_missing_values_come_last_in_texts(engine):
    for way in ("asc", "desc"):
        names = [r.name_s for r in engine.select("b", sort=[f"name_s {way}", "key asc"]).collect()]
        assert names[-8:] == [None] * 8


def test_facets_sum_to_documents(engine):
    assert sum(r["count"] for r in engine.facet("b", "name_s").collect()) == 32
    assert {r.value: r["count"] for r in engine.facet("b", "tags_s_mv").collect()} == {"x": 20, "y": 40}
    assert [tuple(r) for r in engine.facet("b", "tags_s_mv", sort="index", limit=1).collect()] == [("x", 20)]
    assert engine.facet("b", "tags_s_mv", mincount=21).count() == 1
    assert aggregate.as_map(engine.facet("b", "tags_s_mv")).first().map == {"x": 20, "y": 40}


def test_delete_and_select_split_a_bucket(engine):
    where = P.between("v_d", 10.0, 20.0)
    hit = engine.select("b", where).count()
    engine.delete_by_select("b", where)
    assert hit == 11 and engine.count("b").first()["count"] == 29


def test_put_get_delete_drop(engine, spark):
    engine.put("b", spark.createDataFrame([(1, "new"), (99, "more")], "id int, name_s string"), "id")
    assert engine.get("b", "1").first().name_s == "new" and engine.get("b", "99").count() == 1 and engine.count("b").first()["count"] == 41
    engine.delete("b", ["99"])
    assert engine.get("b", "99").count() == 0
    dropped = {r.value: r["count"] for r in engine.drop_bucket("b").collect()}
    assert dropped["documents-dropped"] == 40 == sum(v for k, v in dropped.items() if k.startswith("host-"))
    with pytest.raises(KeyError):
        engine.select("b")


def test_put_takes_the_newest_version(spark):
    old = spark.createDataFrame([("a", 5, "old")], "key string, v int, t string")
    new = spark.createDataFrame([("a", 4, "late"), ("b", 1, "new")], "key string, v int, t string")
    assert {r.key: r.t for r in mutate.put(old, new, "v").collect()} == {"a": "old", "b": "new"}
    assert {r.key: r.t for r in mutate.put(old, new).collect()} == {"a": "late", "b": "new"}


def test_versions(engine, tmp_path):
    path = str(tmp_path / "b")
    assert engine.commit("b", path).first().version == 1
    engine.delete("b", ["1"])
    assert engine.catalog.save("b", path) == 2 and engine.catalog.versions(path) == [1, 2]
    assert engine.catalog.load("b", path, 1).count() == 40 and engine.catalog.load("b", path).count() == 39


def test_json_buckets(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"key": "k1", "n_i": 3, "zzz": 1}\nnot json\n{"key": "k2", "n_i": "x"}\n')
    rows = BucketCatalog(spark).register_json("j", str(tmp_path)).orderBy("key").collect()
    assert [(r.key, r.n_i) for r in rows] == [("k1", 3), ("k2", None)] and "zzz" not in rows[0].asDict()


def test_join_multiplies_equal_keys(spark):
    left = spark.createDataFrame([("1", 9), ("2", 9), ("3", 10)], "key string, k_i int")
    right = spark.createDataFrame([("9", "a"), ("9", "b")], "k_s string, v_s string")
    rows = combine.join(left, right, "k_i", "k_s", "l", "r").collect()
    assert len(rows) == 4 and set(rows[0].asDict()) == {"l.key", "l.k_i", "r.k_s", "r.v_s"}


def test_envelopes(spark):
    df = spark.createDataFrame([("b", "k", 1, None)], "bucket string, key string, n_i int, m_s string")
    assert json.loads(wrapped(df).first()["values"][0].data) == {"n_i": 1}
    value = lambda data, **meta: {"metadata": meta, "data": data}
    raw = [("b", "1", "", [value('{"n_i": 1}'), value('{"n_i": 2}')]), ("b", "2", "", [value("{}", deleted="true")]), ("b", "3", "", [value("no")]), ("b", "4", "", [])]
    rows = spark.createDataFrame(raw, ENVELOPE)
    assert [(r.key, r.n_i) for r in extract_value(rows, "n_i int").collect()] == [("1", 2)]
    assert [(r.key, r.n_i) for r in extract_value(rows, "n_i int", 0).collect()] == [("1", 1)]


def test_histograms(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 9.9, 10.0, 25.0, 30.0)], ["v_d"])
    assert {r.value: r["count"] for r in aggregate.range_facet(df, "v_d", 0.0, 30.0, 10.0).collect()} == {0.0: 2, 10.0: 1, 20.0: 1}
    assert sum(r.y for r in aggregate.histogram(df, "v_d", 3).collect()) == 5


def test_cardinality(engine):
    row = engine.cardinality("b", "name_s").first()
    assert row.max == 3 or row.max <= 3 and row.min >= 0 and len(row.by_partition) >= 1
    assert aggregate.global_cardinality(engine.catalog["b"], "name_s").first().cardinality == 3


def test_empty_results(engine):
    none = P.term("name_s", "nobody")
    assert engine.facet("b", "name_s", none).count() == 0 and engine.count("b", none).first()["count"] == 0
    assert aggregate.sorted_accumulate(engine.catalog["b"].where("false"), "key").count() == 0


def test_calls_by_name(engine):
    @operator("ones")
    def ones(df):
        return df.select(F.lit(1).alias("one"))

    engine.define("names", lambda e, bucket, options: e.facet(bucket, options["field"]))
    assert engine.call("names", bucket="b", **{"options.field": "name_s"}).count() == 3
    assert engine.call("range-facet", bucket="b", field="v_d", start=0.0, end=41.0, gap=41.0).first()["count"] == 40
    assert engine.call("ones", df=engine.catalog["b"]).count() == 40 and "ones" in OPERATORS
    assert "Physical Plan" in engine.explain("count", bucket="b")
    with pytest.raises(KeyError):
        engine.call("_hidden")


def test_user_functions(engine):
    a = composed(lambda df: df.withColumn("s", F.concat("s", F.lit("b"))), lambda df: df.withColumn("s", F.lit("a")))
    assert a(engine.catalog["b"]).first().s == "ab"  # the last listed runs first
    even = by_row(lambda r: {"key": r["key"]} if int(r["key"]) % 2 == 0 else None, "key string")
    assert even(engine.catalog["b"].select("key")).count() == 20

    class Sum:
        def __init__(self):
            self.total = 0.0

        def on_data(self, row):
            self.total += row["v_d"]

        def on_done(self):
            return [{"total": self.total}]

    assert sum(r.total for r in invoke(engine.catalog["b"].select("v_d"), Sum, "total double").collect()) == 820.0


def test_error_traces(spark):
    errors = spark.sql("SELECT 't1' AS trace_id_s, timestamp'2024-01-01' AS ts, 'boom' AS message, array(named_struct('method_s','f'), named_struct('method_s','g')) AS frames")
    heads, frames = monitor.error_rows(errors)
    assert heads.first().is_error_b and [r.method_s for r in monitor.trace(frames, "t1").collect()] == ["f", "g"]
    metrics = spark.createDataFrame([("m", i, float(i)) for i in range(5)], "name string, ts int, value_d double")
    assert monitor.last_values(metrics, 3).first()["values"] == [4.0, 3.0, 2.0]


def test_taps_run_side_by_side(spark, tmp_path):
    spark.createDataFrame([(1, "put"), (2, "delete"), (3, "put")], "n_i int, change string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n_i int, change string").parquet(str(tmp_path / "in"))
    taps = Taps(spark, str(tmp_path / "cp"))
    taps.tap(stream, P.between("n_i", 2), "ch_a", once=True).awaitTermination()
    taps.tap(stream, P.everything(), "ch_b", kind="delete", once=True).awaitTermination()
    assert [r.n_i for r in taps.subscribe("ch_a").collect()] == [3] and [r.n_i for r in taps.subscribe("ch_b").collect()] == [2]
    assert taps.channels("ch_*") == ["ch_a", "ch_b"] and taps.subscribe("ch_*").count() == 2


def test_iterated_batches_keep_remainders(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "key string, partition int")
    assert sorted((r.batch, [x.key for x in r.data]) for r in retrieve.iterated_batches(df).collect()) == [(1, ["a", "c"]), (2, ["b"])]


def test_tapped_rows_go_to_files_not_to_the_driver(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    taps = Taps(spark, str(tmp_path / "cp"))
    running = taps.tap(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), channel="ch_files", once=True)
    running.awaitTermination()
    assert "FileSink" in running.lastProgress.sink.description and not spark.catalog.tableExists("ch_files")
    assert sorted(r.id for r in taps.subscribe("ch_files").collect()) == [0, 1, 2, 3, 4]
