"""Search, mixing, order, media, packing and the pipeline."""

import hashlib
import io
import math
import os
import random
import struct
import time
import wave
import zipfile
import zlib
from collections import Counter, defaultdict
from gzip import compress

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from burrow.llm import media, mixing, packing, topk, training_order
from burrow.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from burrow.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "it's '''s", "ΑΣ ΑΣΑ", "x\x1cy", "<|endoftext|>a", "日本語 テキスト", "é ́a İ ſ", "long " * 30_000, "a　b\x85c"]


def test_ids_are_the_tokenizers():
    draw, letters = random.Random(1), "aéΣ ß'sdt<|>½1²́ \n\x1c_-日‍"
    texts = [t or "" for t in ODD] + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 30))) for _ in range(2000)]
    plain = Tokenizer.from_file(tokenizer_path())
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert Encoder(tokenizer_path(), memo=50).encode(texts) == want
    whole = Encoder(public_tokenizers.path("byte_bpe_50k.json"))  # spaces belong to its tokens
    assert not whole.split and whole.encode(["a  b", None]) == [np.array(whole.tokenizer.encode("a  b").ids, "<u4").tobytes(), b""]
    with pytest.raises(ValueError):
        Encoder(tokenizer_path(), width=1)


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_packing_loses_nothing(spark, bins):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(i, f"text number {i} " * (i % 90)) for i in range(100, 400)] + [(7, "twice"), (7, "twice"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(2)
    found = packing.pack(docs, tokenizer_path(), capacity=512, bins=bins, look_ahead=50).collect()
    plain, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for doc, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 512):
            part = ids[at : at + 512]
            want[(doc, at // 512, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 512
    if bins == 4096:  # few bins close before they are full
        assert len(places) <= math.ceil(sum(r.length for r in found) / 512) * 1.02 + 2
    assert packing.pack(docs.where("false"), tokenizer_path()).count() == 0


def test_best_fit_takes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4, 9, 8, 7)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (4, 0)]
    assert fit.place(3) == (4, 7) and fit.place(2) == (3, 8)


@pytest.mark.parametrize("large", [1.0, 1e6])
def test_top_k(spark, large):
    draw = random.Random(4)
    rows = [(i, [draw.choice([-0.5, 0.25, 0.7, large]) for _ in range(6)]) for i in range(150)] + [(10, [0.25] * 6), (10, [0.7] * 6), (11, [1.0] * 6), (11, [1.0] * 6)]
    rows += [(1000, None), (1002, [1.0, None]), (1004, [float("nan")]), (1006, [float("inf")]), (1008, []), (None, [1.0] * 6), (None, [large] * 6), (1010, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, block_rows=20, query_rows=4, pivots=8).fillna({"vec_id": -1}).collect())
    held = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, a) in enumerate(held):
        if q is not None and q % 10 == 0:
            others = [(-sum(x * y for x, y in zip(a, b, strict=False)), i is None, i or 0) for m, (i, b) in enumerate(held) if m != n]
            want += [(q, rank, -1 if null else i, -score) for rank, (score, null, i) in enumerate(sorted(others)[:5], 1)]
    assert found == sorted(want)
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(df.where("vec_id = 20"), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(1, [1e15])], "vec_id long, embedding array<double>"), F.lit(True))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096, 5000])
def test_feistel_permutes(n):
    assert sorted(training_order.feistel(np.arange(n), n, 9)) == list(range(n))
    assert n < 10 or (training_order.feistel(np.arange(n), n, 9) != training_order.feistel(np.arange(n), n, 8)).any()


def test_training_order_round_trip(spark, tmp_path):
    texts = [*ODD, *(f"words of text {i} " * (i % 17) for i in range(60)), "twice", "twice"]
    for part in (0, 1):  # two files of many row groups
        pq.write_table(pa.table({"doc_id": range(len(texts[part::2])), "text": texts[part::2], "n": [0] * len(texts[part::2])}), f"{tmp_path}/{part}.parquet", row_group_size=5)
    docs = spark.read.parquet(f"{tmp_path}/0.parquet", f"{tmp_path}/1.parquet")
    how = {"length": 64, "shard_sequences": 10, "end_id": 49407}
    folder, count = training_order.materialise(docs, tokenizer_path(), f"file://{tmp_path}/out", **how)
    rows = training_order.read_shards(spark, folder, 64, 10).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(count)) and all(r.n_bytes == 128 and r.crc32 == zlib.crc32(r.ids) for r in rows)
    stream = np.concatenate([np.frombuffer(rows[s].ids, "<u2") for s in training_order.feistel(np.arange(count), count, 20_240_229)])
    encoded = np.concatenate([np.frombuffer(x + b"\xff\xc0", "<u2") for x in Encoder(tokenizer_path(), 2).encode(texts[::2] + texts[1::2])])
    assert count == math.ceil(len(encoded) / 64) and (stream[: len(encoded)] == encoded).all() and not stream[len(encoded) :].any()
    for first in (0, 1, 9, 10, 37, count - 1, count, count + 30):  # resumed anywhere
        again = training_order.read_shards(spark, folder, 64, 10, first=first, with_ids=False).orderBy("slot").collect()
        assert [tuple(r) for r in again] == [tuple(r)[:5] for r in rows[first:]]
    with pytest.raises(ValueError):
        training_order.materialise(docs.unionByName(docs), tokenizer_path(), f"file://{tmp_path}/twice", **how)
    assert training_order.materialise(docs.where("false"), tokenizer_path(), f"file://{tmp_path}/none")[1] == 0


def test_training_order_is_the_same_on_any_cluster(spark, tmp_path):
    rows = [(i % 50, f"text {i % 60} " * (i % 23)) for i in range(300)] + [(None, None), (None, "x"), (7, "tie"), (7, "tie")]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), f"{tmp_path}/docs.parquet", row_group_size=7)
    read, seen = lambda: spark.read.parquet(f"{tmp_path}/docs.parquet"), {}
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, size, docs, order in [
        ("one", usual, read, None), ("many", "2k", read, None),
        ("sorted 2", usual, lambda: read().repartition(2), ["doc_id"]), ("sorted 5", "2k", lambda: read().repartition(5, "text"), ["doc_id"]),
    ]:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            folder, count = training_order.materialise(docs(), tokenizer_path(), f"file://{tmp_path}/{name[:6]}{name[-1]}", order_by=order, length=32, shard_sequences=8)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
        files = sorted(f for f in os.listdir(folder.removeprefix("file://")) if f.endswith(".bin"))
        seen[name] = (count, [open(f"{folder.removeprefix('file://')}/{f}", "rb").read() for f in files])
    assert seen["one"] == seen["many"] and seen["sorted 2"] == seen["sorted 5"] and len(seen["one"][1]) > 3
    with pytest.raises(ValueError):
        training_order.materialise(spark.createDataFrame(rows, "doc_id int, text string"), tokenizer_path(), f"file://{tmp_path}/x")


def test_sniffing():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + b"\0" * 9 + b"\x02\x02\x44\x01\0\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04cd\xff\xda\x00\x03e" + b"data\xff\x00more" + b"\xff\xd9"
    pdf = b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF"
    wav = media.wave_of(b"abc")
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 28
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", "hello")
    kinds = {"image/png": png, "image/gif": gif, "image/jpeg": jpeg, "application/pdf": pdf, "audio/wav": wav, "image/bmp": bmp, "application/zip": box.getvalue(), "application/gzip": compress(b"x" * 1000)}
    for kind, data in kinds.items():
        assert media.sniff(data) == [(0, len(data), kind)], kind
        assert media.sniff(b"junk" + data + b"tail") == [(4, len(data), kind)], kind
        assert all(k != kind or n < len(data) for _, n, k in media.sniff(data[:-1])), kind
    joined = b"".join(kinds.values())
    assert [k for _, _, k in media.sniff(joined)] == list(kinds)
    inner = media.wave_of(pdf + png)  # nested, and nested again
    outer = media.wave_of(b"x" + inner)
    assert media.sniff(outer) == [(0, len(outer), "audio/wav"), (45, len(inner), "audio/wav"), (89, len(pdf), "application/pdf"), (89 + len(pdf), len(png), "image/png")]
    started = time.monotonic()
    assert media.sniff(b"PK\x03\x04" * 40_000 + box.getvalue()) == [(160_000, len(box.getvalue()), "application/zip")]
    assert time.monotonic() - started < 1
    for junk in (b"", b"RIFF", b"BM", b"%PDF-", b"GIF89a", b"PK\x03\x04", b"OggS" * 50, b"\x1f\x8b\x08" * 9, b"\xff\xd8\xff" * 9, b"\x89PNG\r\n\x1a\n"):
        assert media.sniff(junk) == []


def test_media_columns(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "it's '''s"), (None, "x" * 64), (50, "RIFF BM GIF89a %PDF-1.4"), (51, "see %PDF-1.4 startxref %%EOF")]
    docs = spark.createDataFrame([(*r, b"q") for r in rows], "doc_id long, text string, media binary")
    stored = media.store_texts(docs).withColumn("declared", F.lit("image/png"))
    sniffed = media.sniff_media(stored, declared_col="declared")
    assert {(r.sniffed_type, r.corrected) for r in sniffed.collect()} == {("audio/wav", True)}
    back = media.read_back(sniffed)
    found = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in back.collect())
    want = Counter()
    for doc, text in rows:
        raw = (text or "").encode()
        whole = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        file = io.BytesIO()
        with wave.open(file, "wb") as f:  # an independent writer
            f.setnchannels(1), f.setsampwidth(1), f.setframerate(8000), f.writeframes(whole)
        held = file.getvalue()
        feature = f"audio/wav*;mean={sum(whole) / len(whole):.3f};max={max(whole)};embedded={int(doc == 51)}"
        want[(doc, len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(held), hashlib.sha256(held).hexdigest(), feature)] += 1
    assert found == want
    assert [bytes(r.carved) for r in media.carve(sniffed).collect()] == [b"%PDF-1.4 startxref %%EOF"]
    blob = spark.createDataFrame([(1, b"xx" + media.wave_of(b"abcd") + b"yy"), (2, None), (3, b"")], "k int, media binary")
    assert [bytes(r.carved) for r in media.carve(media.sniff_media(blob)).collect()] == [media.wave_of(b"abcd")]
    assert media.read_back(media.sniff_media(media.store_texts(docs.where("false")))).count() == 0


def test_mixing(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(0, 30), draw.choice(["a"] * 12 + ["b"] * 3 + ["c", None])) for i in range(600)]
    rows += [(1, "same row", "b"), (1, "same row", "b"), (None, None, "empty"), (700, "", "empty"), (701, "long " * 50_000, "a")]
    docs = spark.createDataFrame([(*r, "x", i % 7, "y") for i, r in enumerate(rows)], "doc_id long, text string, source string, epoch string, __turn int, c0 string")
    found = mixing.mix(docs, repetition_limit=3.0).collect()
    assert found[0].asDict().keys() == {*docs.columns, "turn"}
    # The buckets are only a way to sort less.
    assert Counter(found) == Counter(mixing.mix(docs, repetition_limit=3.0, bucket_rows=1e-6).collect())
    uses, words = defaultdict(Counter), Counter()
    for r in found:
        uses[r.source][(r.doc_id, r.text)] += 1
        words[r.source] += len((r.text or "").split())
    totals, largest = Counter(), Counter()
    for i, t, s in rows:
        n = len((t or "").split())
        totals[s] += n
        largest[s] = max(largest[s], n)
        assert uses[s][(i, t)] >= 1  # no document is left out
    times = {s: words[s] / totals[s] for s in totals if totals[s]}
    assert abs(times["a"] - 1) < 1e-9 and max(times.values()) <= 3.0 + max(largest[s] / totals[s] for s in times)
    assert sorted(times, key=lambda s: -times[s])[0] == min((s for s in times), key=lambda s: totals[s])
    assert mixing.mix(docs.where("false")).count() == 0


def test_entropy_target(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    plan = mixing.plan(totals, target_entropy=0.8, repetition_limit=None).collect()
    assert abs(-sum(r.weight * math.log(r.weight) for r in plan) - 0.8) < 1e-4 and abs(sum(r.weight for r in plan) - 1) < 1e-9
    with pytest.raises(ValueError):
        mixing.plan(totals, 0.8, 2.0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables here")
class TestQueries:
    @pytest.mark.parametrize("name", sorted(ORACLE_SQL))
    def test_sql(self, spark, name):
        con = duckdb.connect()
        for file in os.listdir(DATA):
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
        df = QUERIES[name](spark, DATA)
        cursor = con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert Counter(map(str, df.select(*columns).toPandas().astype(object).itertuples(index=False, name=None))) == Counter(
            map(str, con.execute(ORACLE_SQL[name]).fetchdf().astype(object).itertuples(index=False, name=None))
        )

    def test_held_out_accuracy(self, spark):
        sf = "/root/testdata/sf0.01"
        rows = QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
        assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93

    def test_pipeline(self, spark):
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = kept
            kept = stage(spark, kept, DATA)
            assert kept.columns == docs.columns and kept.join(before, "doc_id", "left_anti").count() == 0
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
        assert packed.where("piece = 0").count() == kept.count()
        assert Counter(map(tuple, corpus_pipeline.run(spark, DATA).drop("sequence_id", "offset").collect())) == Counter(map(tuple, packed.drop("sequence_id", "offset").collect()))
