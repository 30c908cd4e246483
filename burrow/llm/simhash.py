"""SimHash near-duplicate groups over BK-trees (operator 2).

Distinct fingerprints are dealt to shards by choices of bits on which they agree. A shard is a BK-tree whose children
are keyed by their integer Hamming distance to the parent; a search follows only edges within the radius. Shards of
more than `shard_rows` fingerprints are cut into chunks, and every chunk's tree is sent to each of the shard's chunks
of queries, so no task holds a whole hot shard. Trees travel by exchange, not by a broadcast to all executors, whose
size nothing would bound.

Two fingerprints that differ in at most r of b blocks agree on some b - r whole blocks, so with a shard for every such
choice no link is lost.

keep_one() removes near duplicates by similarity, which fingerprints only estimate: their links are proposals there, each is
verified on the whole shingle sets, and burrow.llm.jaccard adds the similar pairs whose fingerprints are further apart.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from burrow.llm.components import components
from burrow.llm.jaccard import hashes, similar_groups
from burrow.llm.store import bucketed, discard, renamed, written

WAYS = 129  # distances that two words of 64 bits can have


def fingerprint(text: str | None, shingle: int = 4, words: int = 1) -> list[int]:
    """The SimHash of a whole text in 64-bit words, zero without shingles. Later words vote with remixed hashes."""
    counts, n = np.zeros((words, 64), np.int64), 0
    for h in hashes(text, shingle):
        n += len(h)
        for w in range(words):
            h = h if w == 0 else (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            bits = np.unpackbits((h ^ (h >> np.uint64(29)) if w else h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[w] += bits.sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(c * 2 > n, bitorder="little").tobytes(), "little") for c in counts]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, fp, fp2): the fingerprint of every row as signed longs; fp2 is 0 if there is one word. Null and empty
    texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, 2), np.uint64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                found[i, :words] = fingerprint(text, shingle, words)
            signed = found.view(np.int64).T.copy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed[0]), pa.array(signed[1])], ["doc_id", "fp", "fp2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, fp2 long")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class BKForest:
    """BK-trees of many shards at once: node i's children have the distances at which a search may enter them."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        """fp: rows of words, distinct within a shard; shard: of each, in ascending order."""
        n = len(fp)
        self.fp = fp
        self.shard_ids, roots = np.unique(shard, return_index=True)
        self.roots = roots
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.setdiff1d(np.arange(n), roots, assume_unique=True)
        at = roots[np.searchsorted(self.shard_ids, shard[rest])]
        while len(rest):
            key = at * WAYS + differing(fp[rest], fp[at])
            slots, first, slot = np.unique(key, return_index=True, return_inverse=True)
            nodes = rest[first]  # the first at each distance becomes the child there, and the others go below it
            parent[nodes], edge[nodes] = slots // WAYS, slots % WAYS
            below = np.ones(len(rest), bool)
            below[first] = False
            at, rest = nodes[slot][below], rest[below]
        order = np.lexsort((edge, parent))
        order = order[parent[order] >= 0]
        self.child, self.child_key = order, parent[order] * WAYS + edge[order]

    def within(self, query: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, node) of all nodes of the query's shard within the radius."""
        where = np.searchsorted(self.shard_ids, shard)
        known = (where < len(self.shard_ids)) & (self.shard_ids[np.minimum(where, len(self.shard_ids) - 1)] == shard)
        q, node = np.flatnonzero(known), self.roots[where[known]]
        found_q, found_node = [], []
        while len(q):
            d = differing(query[q], self.fp[node])
            hit = d <= radius
            found_q.append(q[hit])
            found_node.append(node[hit])
            low = np.searchsorted(self.child_key, node * WAYS + np.maximum(d - radius, 0))
            high = np.searchsorted(self.child_key, node * WAYS + np.minimum(d + radius, WAYS - 1), side="right")
            count = high - low
            q = np.repeat(q, count)
            node = self.child[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_node])


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each of n items' group, given links in portions."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            a, b = label[a], label[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def _search(shard: np.ndarray, node: np.ndarray, fp: np.ndarray, role: np.ndarray, radius: int, step: int = 1024):
    """Links (a, b) that connect, within these whole shards, what the trees (role 0 or 2) find for queries (1 or 2)."""
    in_tree, asks = role != 1, role != 0
    forest = BKForest(fp[in_tree], shard[in_tree])
    values, place = np.unique(node, return_inverse=True)
    tree_place, ask_place, ask_fp, ask_shard = place[in_tree], place[asks], fp[asks], shard[asks]

    def portions():
        for at in range(0, len(ask_fp), step):
            q, found = forest.within(ask_fp[at : at + step], ask_shard[at : at + step], radius)
            yield ask_place[at + q], tree_place[found]

    label = spanning(len(values), portions())
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def _links(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b) of keyed: (shard, part, node, fp, fp2, role), whole (shard, part) groups in a partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts):
            shard, part, node, fp, fp2, role = (np.concatenate(x) for x in zip(*parts, strict=True))
            group = np.zeros(len(shard), np.int64)
            group[1:] = (np.diff(shard) != 0) | (np.diff(part) != 0)
            a, b = _search(np.cumsum(group), node, np.stack((fp, fp2), axis=1).view(np.uint64), role, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut == 0 and held and (held[-1][0][-1], held[-1][1][-1]) != (now[0][0], now[1][0]):
                yield found(held)
                held, rows = [], 0
            if cut and rows + cut >= 20_000:
                yield found([*held, tuple(c[:cut] for c in now)])
                held, rows, now = [], 0, tuple(c[cut:] for c in now)
            held.append(now)
            rows += len(now[0])
        if held:
            yield found(held)

    return keyed.mapInArrow(run, "a long, b long")


def block_keys(n: int, radius: int, fill: int = 4096) -> list[int]:
    """Bit masks, one for each choice of blocks that agree; more blocks, as long as shards would hold over `fill`."""
    for blocks in range(radius + 1, 65):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
        chosen = [sum(c) for c in itertools.combinations(masks, blocks - radius)]
        if n <= fill << min(m.bit_count() for m in chosen) or len(chosen) > 70:
            break
    return chosen


def tree_links(distinct: DataFrame, radius: int, shard_rows: int, masks_for=None) -> DataFrame:
    """(a, b) of distinct: (node, fp, fp2), distinct fingerprints: links that connect all that differ in `radius` bits or fewer."""
    low = (1 << 64) - 1
    masks = (masks_for or (lambda n: block_keys(n, radius)))(distinct.count())
    keys = [
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m & low))), F.col("fp2").bitwiseAND(F.lit(_signed(m >> 64))))
        for i, m in enumerate(masks)
    ]
    keyed = written(distinct.select(F.explode(F.array(*keys)).alias("shard"), "node", "fp", "fp2"), "keyed")
    sizes = keyed.groupBy("shard").count().where("count > 1")
    sizes = written(sizes.select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("chunks")), "sizes")
    shared = keyed.join(sizes, "shard")
    cut = (
        shared.withColumn("own", F.pmod(F.xxhash64("node", "shard"), "chunks").cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .withColumn("part", F.least("own", "other") * F.col("chunks") + F.greatest("own", "other"))
        .select("shard", "part", "node", "fp", "fp2", F.expr("CASE WHEN own < other THEN 0 WHEN own > other THEN 1 ELSE 2 END").alias("role"))
    )
    return _links(cut.repartition("shard", "part").sortWithinPartitions("shard", "part", "fp"), radius)


def groups(prints: DataFrame, masks_for, radius: int, shard_rows: int) -> DataFrame:
    """(fp, fp2, component_id) of every distinct fingerprint of prints (doc_id, fp, fp2)."""
    distinct = prints.groupBy("fp", "fp2").agg(F.min("doc_id").alias("first_id"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = components(tree_links(distinct, radius, shard_rows, masks_for), "a", "b").select("node", "component")
    named = distinct.join(found, "node", "left").select("fp", "fp2", "first_id", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    # Written, so that the join below is one of two tables and a hot component can be split.
    least = written(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "least-ids")
    return written(named.join(least, "component").select("fp", "fp2", "component_id"), "groups")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
    shard_rows: int = 4096,
) -> DataFrame:
    """Groups of documents whose fingerprints are linked, directly or over others.

    Links are at most `radius` differing bits of 64. Returns a row per input row: doc_id, fingerprint (16 hex digits),
    component_id (the least doc_id of the group). Null, empty and blank texts have fingerprint zero and are linked like
    any other; texts of fewer words than a shingle are one shingle. Rows with equal ids are each returned; null ids are
    returned and never name a group that has another id. Other columns are not read. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = groups(prints, lambda n: block_keys(n, radius), radius, shard_rows)
    return prints.join(named, ["fp", "fp2"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def proposals(prints: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(a, b) of prints (row, fp): rows with equal fingerprints and what the trees find, as links that connect them all."""
    distinct = written(prints.groupBy("fp").agg(F.min("row").alias("node")).withColumn("fp2", F.lit(0).cast("long")), "distinct")
    equal = prints.join(distinct.select("fp", "node"), "fp").where("row != node").select(F.col("row").alias("a"), F.col("node").alias("b"))
    return equal.unionByName(tree_links(distinct, radius, shard_rows))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 4, shard_rows: int = 4096
) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the least id, of equal ids the first in the input.

    Texts are linked if the exact Jaccard similarity of their shingle sets is at least `similarity`; `radius` only says
    how many of these links the fingerprints propose. All columns stay, whatever their names. Null ids come before others. Rows with empty or null texts are one group. An empty table stays empty.
    """
    plain, id_col, text_col = renamed(docs, id_col, text_col)
    rows = bucketed(plain.withColumn("__row", F.monotonically_increasing_id()), "rows", "__row")
    found = similar_groups(rows, "__row", text_col, shingle, similarity, lambda prints: proposals(prints, radius, shard_rows)).withColumnRenamed("row", "__row")
    member = found.join(rows.select("__row", F.col(id_col).alias("id")), "__row")
    kept = member.groupBy("component_id").agg(F.min(F.struct("id", "__row")).alias("first")).select(F.col("first.__row").alias("__row"))
    kept = written(kept, "kept")
    discard(found)
    return rows.join(kept.hint("shuffle_hash"), "__row", "left_semi").drop("__row").toDF(*docs.columns)
