"""Groups of texts by the exact Jaccard similarity of their shingle sets.

Candidates come from prefixes: all sets are put in one order, and two sets of at least this similarity share one of
their first n - ceil(similarity * n) + 1 shingles. No link is lost, whatever the order and the size of the corpus; the
order only decides how many candidates there are. Shingles that a sample of the texts shows to be common come last,
the others are ordered by hash.

Every link is verified on the whole sets. Pairs that are connected already need no look: texts with a common shingle
are compared with one of them first, and only what these stars leave apart is compared pair by pair. Sizes and
parities rule pairs out beforehand, by bounds that no similar pair exceeds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from burrow.llm.components import components
from burrow.llm.store import discard, written

SEED = 42  # of the shingles' XXH64, as in Spark's xxhash64
PARITY = 256  # bits of a set's parity()


def hashes(text: str | None, shingle: int, block: int = 200_000) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of the whole text, in portions: A-Z lower-cased, split at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        if words:
            yield np.array([xxh64_intdigest(joined, SEED)], "<u8")
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, len(starts), block):
        pairs = zip(starts[at : at + block], ends[at : at + block], strict=True)
        yield np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in pairs], "<u8")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as signed hashes, in ascending order."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(h.view(np.int64) for h in hashes(text, shingle))]))


def prefix(found: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many shingles of a set that any set of at least this similarity has one of them in its own prefix.

    common: hashes in ascending order that come last, by their counts.
    """
    if not len(found):
        return found
    rank = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))][: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]


def parity(found: np.ndarray) -> np.ndarray:
    """Of each of PARITY classes of hashes whether a set has an odd number. Two sets differ in at least as many shingles
    as there are classes in which these bits differ."""
    odd = np.bincount(found & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def spread(found: np.ndarray) -> np.ndarray:
    """How many hashes of a set are in each class. Two sets differ in at least as many shingles as these numbers differ,
    summed up. There are a quarter to half as many classes as hashes, always a power of two: a pair whose sizes a similar
    pair can have has at most twice as many on one side."""
    classes = 1 << min(14, max(4, (len(found) // 4).bit_length()))
    return np.minimum(np.bincount((found >> 8) & (classes - 1), minlength=classes), np.iinfo(np.int16).max).astype(np.int16)


def vote(found: np.ndarray) -> int:
    """The SimHash of a set: the bits that are set in over half of its hashes, as a signed number."""
    counts = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view(np.int64)[0])


def _mapped(rows: DataFrame, make: Callable[[np.ndarray], tuple], shingle: int, schema: pa.Schema, ddl: str) -> DataFrame:
    """Of rows (row, text): the row and what is made of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [make(shingle_set(t.as_py(), shingle)) for t in part.column(1)]
                columns = [pa.array([m[i] for m in made], schema.types[i + 1]) for i in range(len(schema) - 1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *columns], schema=schema)

    return rows.mapInArrow(run, ddl)


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    schema = pa.schema([("row", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    return _mapped(rows, lambda s: (s,), shingle, schema, "row long, shingles array<long>")


def common_shingles(rows: DataFrame, shingle: int, sample: int = 4096, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles in three or more of the sampled texts (one of 64, or `sample` in small tables),
    and in how many. They only order the shingles: what the sample doesn't show costs time and no link."""
    every = max(1, min(64, rows.count() // sample))
    some = _sets(rows.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0), shingle)
    counted = some.select(F.explode("shingles").alias("h")).groupBy("h").count().where("count > 2")
    found = counted.orderBy(F.desc("count"), "h").limit(most).toArrow().sort_by("h")
    return found["h"].to_numpy(), found["count"].to_numpy()


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that spread() doesn't rule out."""
    of = nodes.select("row", "n", "spread")
    both = pairs.join(of.toDF("a", "n_a", "of_a"), "a").join(of.toDF("b", "n_b", "of_b"), "b")
    both = both.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6)
    classes = F.least(F.size("of_a"), F.size("of_b"))

    def folded(name: str):
        halves = F.zip_with(F.slice(name, F.lit(1), classes), F.slice(name, classes + 1, classes), lambda x, y: x.cast("int") + y.cast("int"))
        return F.when(F.size(name) > classes, halves).otherwise(F.col(name).cast("array<int>"))

    apart = F.aggregate(F.zip_with(folded("of_a"), folded("of_b"), lambda x, y: F.abs(x - y)), F.lit(0), lambda held, x: held + x)
    most = (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6
    return both.where(apart <= most).select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of rows whose sets are similar."""
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "asked")
    # The rows asked for are few beside the texts: a hash table of them in every partition spares sorting the texts.
    sets = written(_sets(rows.join(asked.hint("shuffle_hash"), "row", "left_semi").select("row", "text"), shingle), "sets")
    both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    shared, sizes = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    out = written(both.where(shared * (1 + similarity) >= similarity * sizes - 1e-6).select("a", "b"), "verified")
    discard(asked, sets)
    return out


def _apart(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Blocks with the component of each row, without blocks that are one component."""
    named = written(components(links, "a", "b").toDF("row", "found"), "components")
    known = blocks.drop("component").join(named, "row", "left").withColumn("component", F.coalesce("found", "row")).drop("found")
    block = Window.partitionBy("h")
    several = F.min("component").over(block) < F.max("component").over(block)
    return written(known.withColumn("several", several).where("several").drop("several"), "apart")


def similar_links(nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float, proposed: DataFrame | None = None) -> DataFrame:
    """(a, b) with a similarity of at least this, that connect all that are connected by such pairs.

    nodes: (row, n, odd, spread, prefix) of distinct sets of n shingles, odd: parity(); rows: (row, text) with at least these
    rows. proposed: pairs (a, b) of rows to be looked at first; the better they are, the fewer pairs are left.
    """
    block = Window.partitionBy("h")
    dealt = nodes.select("row", F.explode("prefix").alias("h")).select("h", "row", F.count("*").over(block).alias("m"))
    dealt = written(dealt.where("m > 1"), "blocks")
    # A text with many neighbours is the centre that leaves the fewest apart.
    weights = dealt.groupBy("row").agg(F.sum("m").alias("weight")).join(nodes.select("row", "n", "odd"), "row")
    blocks = dealt.select("h", "row").join(written(weights, "weights"), "row").withColumn("component", F.col("row"))
    apart = blocks = written(blocks, "members")
    differ = " + ".join(f"bit_count(l.odd[{i}] ^ r.odd[{i}])" for i in range(PARITY // 64))
    near = f"l.h = r.h AND l.component != r.component AND least(l.n, r.n) >= {similarity} * greatest(l.n, r.n) - 1e-6"
    near = f"{near} AND {differ} <= {(1 - similarity) / (1 + similarity)} * (l.n + r.n) + 1e-6"
    links = tested = None
    for order in (F.struct(-F.col("weight"), "row"), None):
        other = apart
        if order is not None:
            centre = F.row_number().over(block.orderBy(order))
            other = written(apart.withColumn("at", centre).where("at = 1").drop("at"), "centres")
        pairs = apart.alias("l").join(other.alias("r"), F.expr(near if order is not None else f"{near} AND l.row < r.row"))
        pairs = pairs.select(F.least("l.row", "r.row").alias("a"), F.greatest("l.row", "r.row").alias("b"))
        if order is not None and proposed is not None:
            pairs = pairs.unionByName(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        pairs = pairs.distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        possible = written(_possible(pairs, nodes, similarity), "possible")
        now = _verified(possible, rows, shingle, similarity)
        discard(possible)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = now if links is None else links.unionByName(now)
        if order is not None:
            discard(other)
            apart = _apart(blocks, links)
    discard(dealt, blocks, apart)
    return links


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, propose: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(row, component_id) per row: groups of texts linked, directly or over others, by an exact Jaccard similarity of
    at least this between their shingle sets; the least id names the group. Texts without words are one group, texts of
    fewer words than a shingle are one shingle. Ids that aren't null must be distinct. propose: makes pairs (a, b) to be
    looked at first from (row, fp), the SimHash of every distinct set."""
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    common, counts = common_shingles(rows, shingle)

    def sketch(found: np.ndarray) -> tuple:
        one, two = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64).tolist()
        return one, two, len(found), vote(found), parity(found), spread(found), prefix(found, similarity, common, counts)

    fields = [("row", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("odd", pa.list_(pa.int64())), ("spread", pa.list_(pa.int16())), ("prefix", pa.list_(pa.int64()))]
    ddl = "row long, one long, two long, n long, fp long, odd array<long>, spread array<short>, prefix array<long>"
    sketches = written(_mapped(rows, sketch, shingle, pa.schema(fields), ddl), "sketches")
    # Equal sets are one node, their least row.
    nodes = written(sketches.groupBy("one", "two").agg(F.min("row").alias("node")), "nodes")
    first = sketches.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select("row", "n", "fp", "odd", "spread", "prefix")
    proposed = written(propose(first.select("row", "fp")), "proposed") if propose else None
    links = similar_links(first.drop("fp"), rows, shingle, similarity, proposed)
    found = components(links, "a", "b").select(F.col("node"), F.col("component").alias("component_id"))
    named = nodes.join(found, "node", "left").select("one", "two", F.coalesce("component_id", "node").alias("component_id"))
    named = written(named, "named")
    out = written(sketches.select("row", "one", "two").join(named, ["one", "two"]).select("row", "component_id"), "groups")
    discard(sketches, nodes, named)
    return out
