"""Training-order materialisation (operator 7).

All documents' tokens, in the order of a running offset, are cut into sequences of one length. A keyed Feistel
permutation with cycle-walking gives every sequence its global slot, so the shuffled order needs no shuffle state
and can be recomputed from the key. Range partitions of slots write shards of a fixed stride: sequence s of the run
is at byte (s mod shard) * stride of shard s div shard, which makes reads sequential and resumable at any slot.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from burrow.llm.store import new_path, written
from burrow.llm.tokens import encoder, id_width


def feistel(values: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1: balanced Feistel rounds over the next even number of bits, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(zlib.crc32(f"{key}|{r}".encode()) << 32 | zlib.crc32(f"{r}|{key}".encode())) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return left << np.uint64(half) | right

    out = once(values.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def in_order(docs: DataFrame, text_col: str, order_by: list[str] | None) -> DataFrame:
    """(file, place, text): every row with the file that holds it and its number there.

    Without `order_by` these are the files that docs reads, however they are split; else the rows are written in this order
    first, ties by text. Files are ordered by name, which also orders the parts of one write.
    """
    text = F.col(text_col).cast("string").alias("text")
    if order_by is not None:
        keyed = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)], text)
        keys = [*(f"k{i}" for i in range(len(order_by))), "text"]
        docs, text = written(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("text"), "ordered"), F.col("text")
    try:
        return docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), text)
    except AnalysisException as error:
        raise ValueError("docs isn't a plain read of Parquet files: name the columns to order it by") from error


def token_table(rows: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """(file, first, place, before, n, ids) of rows (file, place, text): each document's ids and the end id, as little-endian
    unsigned numbers of `width` bytes. first: where the run of rows began that was read in one go; before: the tokens in it
    before this document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(path, width)
        ids_of, end = held.encode, end_id.to_bytes(width, "little")
        last: tuple = (None, -1)
        first = before = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [x + end for x in ids_of(part.column(2).to_pylist())]
                files, places = part.column(0).to_pylist(), part.column(1).to_pylist()
                out = []
                for file, place, x in zip(files, places, ids, strict=True):
                    if (file, place - 1) != last:
                        first, before = place, 0
                    last, n = (file, place), len(x) // width
                    out.append((first, place, before, n))
                    before += n
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True)), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "first", "place", "before", "n", "ids"])
        held.rest()

    return rows.mapInArrow(run, "file string, first long, place long, before long, n long, ids binary")


def located(tokens: DataFrame) -> tuple[DataFrame, int]:
    """(n, ids, at): tokens with the global offset of each document, and the number of all tokens.

    A total of each run of rows and a running total over runs, in the order of files and rows, give a run's start: no row
    moves, and how files were split doesn't matter. There is a run for each split of the input; Spark broadcasts their
    table if it's small, and joins by key if not. Rows that don't come from a plain read are refused, as places in files
    don't order them.
    """
    totals = tokens.groupBy("file", "first").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.max("place").alias("last"))
    order = Window.orderBy(F.length("file"), "file", "first")
    start = F.sum("total").over(order) - F.col("total")
    clash = (F.lag("file").over(order) == F.col("file")) & (F.lag("last").over(order) >= F.col("first")) | (F.col("last") - F.col("first") + 1 != F.col("rows"))
    starts = written(totals.select("file", "first", "total", start.alias("start"), F.coalesce(clash, F.lit(False)).alias("clash")), "run-starts")
    total, wrong = starts.agg(F.sum("total"), F.count_if("clash")).first()
    if wrong:
        raise ValueError("docs repeats rows of its files: name the columns to order it by")
    placed = tokens.join(starts, ["file", "first"]).select("n", "ids", (F.col("start") + F.col("before")).alias("at"))
    return placed, total or 0


def materialise(
    docs: DataFrame,
    tokenizer_path: str,
    out: str | None = None,
    text_col: str = "text",
    order_by: list[str] | None = None,
    length: int = 1024,
    shard_sequences: int = 1024,
    key: int = 20_240_229,
    end_id: int = 0,
    pad_id: int = 0,
) -> tuple[str, int]:
    """Writes all documents' tokens as shuffled sequences; returns the folder and the number of sequences.

    Documents follow each other in the order of their files and of the rows there, or of the columns `order_by`, ties by
    text; neither the cluster nor the splits of the input matter, so a run can be repeated or resumed elsewhere. Each
    has `end_id` after it; the last sequence is filled with `pad_id`. Ids take 16 bits if all of the tokenizer's do, else
    32. Null and empty texts are one end id; repeated rows are documents like any other; other columns are not read. An
    empty table writes no shard. A shard that was already written whole is written again with the same bytes, so lost
    tasks can be run again.
    """
    spark = docs.sparkSession
    out = out or new_path(spark, "shards")
    width = id_width(tokenizer_path)
    tokens = written(token_table(in_order(docs, text_col, order_by), tokenizer_path, end_id, width), "tokens", "zstd")
    placed, total = located(tokens)
    count = math.ceil(total / length)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for batch in batches:
            seq, place, part = [], [], []
            for n, ids, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in range(at // length, (at + n - 1) // length + 1):
                    first, last = max(at, s * length), min(at + n, (s + 1) * length)
                    seq.append(s)
                    place.append(first - s * length)
                    part.append(compress(ids[width * (first - at) : width * (last - at)]))
            slot = feistel(np.array(seq, np.int64), count, key)
            shard = slot // shard_sequences
            columns = [pa.array(shard), pa.array(slot), pa.array(place, pa.int32()), pa.array(part, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", "place", "part"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(out)
        stride = width * length
        blank = pad_id.to_bytes(width, "little") * length
        shard, held = None, bytearray()
        expand = zstandard.ZstdDecompressor().decompress

        def close() -> pa.RecordBatch:
            name = f"{folder}/shard-{shard:08d}.bin"
            with store.open_output_stream(f"{name}.{zlib.crc32(held):08x}.part") as f:
                f.write(bytes(held))
            store.move(f"{name}.{zlib.crc32(held):08x}.part", name)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(held)], pa.int64())], ["shard", "bytes"])

        store.create_dir(folder, recursive=True)
        for batch in batches:
            for of, slot, place, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != shard:
                    if shard is not None:
                        yield close()
                    shard, held = of, bytearray()
                at = (slot - of * shard_sequences) * stride
                if len(held) < at + stride:
                    held += blank * ((at + stride - len(held)) // stride)
                ids = expand(part)
                held[at + width * place : at + width * place + len(ids)] = ids
        if shard is not None:
            yield close()

    if count:
        parts = placed.mapInArrow(pieces, "shard long, slot long, place int, part binary")
        shards = math.ceil(count / shard_sequences)
        tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(width * total / 2**26)))
        # Slots are spread evenly, so equal ranges of shards need no sampling to be equal in size.
        dealt = parts.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int"))
        dealt = dealt.sortWithinPartitions("shard", "slot", "place")
        size = dealt.mapInArrow(write, "shard long, bytes long").agg(F.sum("bytes")).first()[0]
        assert size == width * length * count, "the shards don't hold every sequence once"
    return out, count


def read_shards(spark, folder: str, length: int = 1024, shard_sequences: int = 1024, width: int = 2, first: int = 0, with_ids: bool = True) -> DataFrame:
    """(slot, shard, offset, n_bytes, crc32, ids): the sequences in the bytes of the shards, by file, from slot `first` on.

    Shards before the one that holds `first` are not opened; a `first` at or after the end gives no rows. with_ids: False
    leaves the last column out, for checks."""
    stride, start = width * length, first // shard_sequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, whole = _shard_of(path), memoryview(content)
                offsets = list(range(stride * (first % shard_sequences) if shard == start else 0, len(whole), stride))
                ids = [whole[o : o + stride] for o in offsets]
                columns = [
                    pa.array([shard * shard_sequences + o // stride for o in offsets], pa.int64()), pa.array([shard] * len(ids), pa.int64()),
                    pa.array(offsets, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()),
                ]
                columns += [pa.array(map(bytes, ids), pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    schema = "slot long, shard long, offset long, n_bytes long, crc32 long" + ", ids binary" * with_ids
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().toString() for s in store.listStatus(root)] if first and store.exists(root) else []
    wanted = [n for n in names if n.endswith(".bin") and _shard_of(n) >= start] if first else folder
    if not wanted:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(wanted).select("path", "content")
    return files.mapInArrow(run, schema)


def _shard_of(path: str) -> int:
    return int(path.rsplit("shard-", 1)[1].split(".")[0])
