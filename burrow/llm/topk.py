"""Exact top-k inner products by a pivot table (operator 5).

Inner-product search becomes distance search by one more coordinate that gives all candidates the same norm. The
pivots are the same for the whole table: every vector's distances to them are computed once and stored with it, and
give every pair the lower bound max over pivots of |d(q, p) - d(x, p)|. Candidates are evaluated in the order of that
bound until the next bound can't reach the k-th best score.

Candidates and queries meet in blocks of bounded size. A query meets one block first; its k-th best score there is
where every other block starts from. Each block returns its best k a query, and a window keeps the best k of those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from burrow.llm.store import written

FOUND = "query_row long, query_id long, vec_id long, score long"
NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes after all others


def usable(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, vec_id, asks, v, norm): floor(scale * x) of every component as a whole double, and the squared length. Null
    vectors and vectors with null or non-finite components are left out."""
    v = F.col("raw")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(good).select(F.monotonically_increasing_id().alias("row"), "vec_id", "asks", ints.alias("v"))
    return rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of lists as one matrix; shorter vectors are filled with zeros, which add nothing to a product."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def fitted(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def pivot_distances(v: np.ndarray, norm: np.ndarray, asks: np.ndarray, pivots: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances of candidates and, where they ask, of queries to the pivots. `most`: the largest squared length; a
    candidate's extra coordinate makes its length that of the longest, a query's is zero."""
    width = max(v.shape[1], pivots.shape[1])
    products = fitted(v, width) @ fitted(pivots, width).T
    extra = np.sqrt(np.maximum(most - norm, 0))
    p_extra = np.sqrt(np.maximum(most - (pivots**2).sum(1), 0))
    own = np.sqrt(np.maximum(2 * most - 2 * (products + np.outer(extra, p_extra)), 0))
    return own, np.sqrt(np.maximum(norm[:, None] + most - 2 * products, 0)) * asks[:, None]


def search_block(x: dict[str, np.ndarray], q: dict[str, np.ndarray], k: int, most: float, exact: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) as places in q and x: the k best candidates of a block for each query, ties to smaller ids.

    x: row, id, v, table; q: row, v, norm, table and `least`, the k-th best score that is known so far. exact: whether
    doubles hold all products; else they are computed in whole numbers.
    """
    if not len(x["row"]):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    width = max(x["v"].shape[1], q["v"].shape[1])
    xv, qv = fitted(x["v"], width), fitted(q["v"], width)
    if not exact:
        xv, qv = xv.astype(np.int64), qv.astype(np.int64)
    table = np.ascontiguousarray(x["table"].T)
    bound, apart = np.empty(len(xv)), np.empty(len(xv))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(qv)):
        bound.fill(0.0)
        for distances, d in zip(table, q["table"][i], strict=True):
            np.maximum(bound, np.abs(np.subtract(distances, d, out=apart), out=apart), out=bound)
        # The most that a product can be at this distance; the slack covers rounding in the tables.
        norm = q["norm"][i]
        reach = (norm + most - bound**2) / 2 + 1e-6 * (norm + most) + 1
        reach[x["row"] == q["row"][i]] = -np.inf
        least = q["least"][i] if exact else q["least"][i] - 1e-12 * np.nan_to_num(abs(q["least"][i]), posinf=0.0)  # it came here as a double
        turn = np.flatnonzero((reach >= least) & (reach > -np.inf))
        turn = turn[np.argsort(-reach[turn], kind="stable")]
        held, best = np.zeros(0, np.int64), np.zeros(0, xv.dtype)
        at, size = 0, step
        while at < len(turn) and reach[turn[at]] >= least:
            part = turn[at : at + size]
            score = xv[part] @ qv[i]
            good = score >= least
            best, held = np.concatenate((best, score[good])), np.concatenate((held, part[good]))
            top = np.lexsort((x["id"][held], -best))[:k]
            best, held = best[top], held[top]
            if len(best) == k:
                least = max(least, best[-1])
            at, size = at + size, 2 * size
        out.append((np.full(len(best), i), held, best.astype(np.int64)))
    return tuple(np.concatenate([o[j] for o in out] or [np.zeros(0, np.int64)]) for j in range(3))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    pivots: int = 32,
    block_rows: int = 8192,
    query_rows: int = 8192,
) -> DataFrame:
    """The k highest integer inner products for every row for which `is_query` (a Column over vectors) holds.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, null ids last. A query's own row is no
    candidate, every other row is, those with the same id or a null one too; fewer rows if there are fewer candidates. Rows
    that repeat a query's id ask for themselves. Vectors that are null or hold null or non-finite components take no
    part; shorter vectors, empty ones too, count as filled with zeros. Other columns are not read. An empty table gives
    no rows. A ValueError says so if components are so large that a score might not fit into 64 bits.
    """
    rows = written(usable(vectors, is_query, id_col, vector_col, scale), "vectors")
    n, asked, most = rows.agg(F.count("*"), F.count_if("asks"), F.max("norm")).first()
    most = float(most or 0.0)
    if most >= 2**62:
        raise ValueError("scores of such large components don't fit into 64 bits")
    chosen = rows.select("v").orderBy(F.xxhash64("v", "row")).limit(pivots).toArrow()
    points = matrix(chosen.column("v"))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, vec_id, asks, v, norm = batch.columns
            own, asking = pivot_distances(matrix(v), norm.to_numpy(), asks.to_numpy(zero_copy_only=False), points, most)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(t), pa.list_(pa.float64())) for t in (own, asking))], names=[*batch.schema.names, "table", "q_table"])

    told = rows.mapInArrow(distances, "row long, vec_id long, asks boolean, v array<double>, norm double, table array<double>, q_table array<double>")
    told = written(told, "pivot-table")
    blocks, groups = max(1, math.ceil(n / block_rows)), max(1, math.ceil(asked / query_rows))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    candidates = told.select(block.alias("block"), "row", "vec_id", "v", "table")
    queries = told.where("asks").select(
        block.alias("first"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int").alias("asks"), "row", "vec_id", "v", "norm", F.col("q_table").alias("table")
    )
    exact = most < 2**53

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        ids = pc.fill_null(x.column("vec_id"), NO_ID).to_numpy()
        asks = {"row": q.column("row").to_numpy(), "v": matrix(q.column("v")), "norm": q.column("norm").to_numpy(), "table": matrix(q.column("table")), "least": q.column("least").to_numpy()}
        at, held, score = search_block({"row": x.column("row").to_numpy(), "id": ids, "v": matrix(x.column("v")), "table": matrix(x.column("table"))}, asks, k, most, exact)
        columns = [q.column("row").take(at), q.column("vec_id").take(at), x.column("vec_id").take(held), pa.chunked_array([pa.array(score, pa.int64())])]
        return pa.table([c.combine_chunks() for c in columns], ["query_row", "query_id", "vec_id", "score"])

    def met(x: DataFrame, q: DataFrame) -> DataFrame:
        keys = ("block", "asks")
        return x.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, FOUND)

    dealt = candidates.withColumn("asks", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    first = written(met(dealt, queries.withColumnRenamed("first", "block").withColumn("least", F.lit(float("-inf")))), "first-block")
    known = first.groupBy("query_row").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("least"))
    started = queries.join(known, queries["row"] == known["query_row"], "left").drop("query_row")
    started = written(started.withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "started")
    others = started.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block != first").drop("first")
    found = first.unionByName(met(dealt, others)) if blocks > 1 else first
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
