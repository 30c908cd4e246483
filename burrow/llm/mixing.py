"""Mixing sources to target weights (operator 6), with DataFrame operations alone.

Temperature mixing: a source's weight is its token share raised to an exponent between 0 (all alike) and 1 (as they
are). The exponent is found by bisection, the largest at which the weights reach a target entropy, or the smallest at
which no source is repeated more often than a limit. The weights become token budgets. A source's budget is spent on
whole permutations of its documents, one after another, and the front of one more: a keyed hash of (source, epoch,
document) orders each permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from burrow.llm.store import renamed, written

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 64  # points that one pass over the sources tries


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def exponent(totals: DataFrame, target_entropy: float | None, repetition_limit: float | None) -> float:
    """Bisection over a table (source, tokens) of any size; each pass narrows the range to a 64th.

    Entropy (in nats) falls and repetition falls as the exponent grows, so both meet their target at one point; beyond
    the ends the nearer end is taken.
    """
    low, high = 0.0, 1.0
    held = totals.where("tokens > 0")
    top = held.agg(F.max("tokens"), F.min("tokens")).first()
    if top[0] is None:
        return 1.0
    for _ in range(4):
        tried = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        if target_entropy is None:
            # The largest source is seen once; the smallest is repeated most.
            met = [(top[0] / top[1]) ** (1 - a) <= repetition_limit for a in tried]
            at = met.index(True) if True in met else STEPS
            low, high = tried[max(0, at - 1)], tried[at]
        else:
            share = F.col("tokens") / F.lit(float(top[0]))
            power = F.pow(share, F.col("a"))
            spread = held.withColumn("a", F.explode(F.array(*map(F.lit, tried))))
            rows = spread.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("s")).collect()
            entropy = [r.s for r in sorted((_Entropy(r.a, r.z, r.s) for r in rows), key=lambda r: r.a)]
            met = [e >= target_entropy for e in entropy]
            at = STEPS - met[::-1].index(True) if True in met else 0
            low, high = tried[at], tried[min(STEPS, at + 1)]
    return high if target_entropy is None else low


class _Entropy:
    def __init__(self, a: float, z: float, s: float):
        from math import log

        self.a, self.s = a, log(z) - s / z


def plan(totals: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None) -> DataFrame:
    """(source, tokens, weight, budget, epochs, rest): how often each source is used.

    Without a `budget` of tokens for the whole mix, it is the smallest at which the source that is repeated least is
    seen once, so no document is left out. epochs: whole permutations; rest: tokens from one more.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give a target entropy or a repetition limit")
    a = exponent(totals, target_entropy, repetition_limit)
    z, t, top = totals.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))), F.sum("tokens"), F.max("tokens")).first()
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    # Repetition is tokens^(a-1) times a constant, least for the largest source.
    times = F.lit(float(budget)) * weight / F.col("tokens") if budget else F.pow(F.lit(float(top or 1)) / F.col("tokens"), F.lit(1 - a))
    told = totals.withColumn("weight", weight).withColumn("times", F.when(F.col("tokens") > 0, F.round(times, 9)).otherwise(1.0))
    told = told.withColumn("budget", F.floor(F.col("times") * F.col("tokens")).cast("long"))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int")
    return told.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("times")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    repetition_limit: float | None = 2.0,
    budget: int | None = None,
    seed: int = 1,
    bucket_rows: float = 4096,
) -> DataFrame:
    """The mix: every use of a document is a row, with all its columns, epoch (from 0) and turn (the order in the epoch).

    Tokens are words between ASCII white space. In a source's last, partial epoch the documents that start within the
    rest of its budget are used, so that it is met to within one document. A null source is a source of its own;
    null and empty texts have no tokens and are used in every whole epoch (sources without tokens once, and in a
    partial epoch where they start within the rest); repeated rows have equal turns and are used like others, null ids
    too. Columns named epoch and turn are replaced, all other names are free. An empty table gives no rows.

    The hash order of a source is cut into so many buckets, 4,096 at least, that the largest source has at most some `bucket_rows`
    documents in each; only the bucket in which a budget ends is sorted. The result doesn't depend on it.
    """
    docs = docs.drop("epoch", "turn")
    plain, id_col, text_col, source_col = renamed(docs, id_col, text_col, source_col)
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    rows = plain.withColumn("__source", source)
    counted = rows.withColumn("__tokens", words_in(text_col))
    totals = written(counted.groupBy(F.col("__source").alias("source")).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("rows")), "totals")
    planned = written(plan(totals, target_entropy, repetition_limit, budget), "plan")
    share = planned.select(F.col("source").alias("__source"), F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"))

    def turn(epoch: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__source"), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))

    bits = min(32, max(12, int((totals.agg(F.max("rows")).first()[0] or 0) / bucket_rows).bit_length()))
    bucket = F.shiftright(F.conv(F.substring("__turn", 1, 8), 16, 10).cast("long"), 32 - bits)
    # The partial epoch: only the bucket in which the rest ends is ordered.
    last = counted.join(share, "__source").where("__rest > 0").withColumn("__turn", turn(F.col("__epochs"))).withColumn("__bucket", bucket)
    sums = last.groupBy("__source", "__bucket", "__rest").agg(F.sum("__tokens").alias("n"))
    start = F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket")) - F.col("n")
    cut = sums.withColumn("start", start).where(F.col("start") < F.col("__rest")).groupBy("__source")
    cut = written(cut.agg(F.max("__bucket").alias("__cut"), F.max("start").alias("__start")), "cuts")
    use = share.join(cut, "__source", "left")
    use = written(use, "use")

    def with_use(df: DataFrame) -> DataFrame:
        return df.join(use, "__source")

    whole = with_use(rows).withColumn("__turn", turn(F.col("__epochs"))).withColumn("__bucket", bucket)
    more = F.when(F.col("__bucket") < F.col("__cut"), F.col("__epochs") + 1).otherwise(F.col("__epochs"))
    whole = whole.where(more > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), more - 1)))
    part = with_use(counted).where("__cut IS NOT NULL").withColumn("__turn", turn(F.col("__epochs"))).withColumn("__bucket", bucket).where("__bucket = __cut")
    before = Window.partitionBy("__source").orderBy("__turn").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("__before", F.col("__start") + F.coalesce(F.sum("__tokens").over(before), F.lit(0)))
    part = part.where("__before < __rest").withColumn("epoch", F.col("__epochs"))
    out = [*rows.columns, "epoch"]
    both = whole.select(*out).unionByName(part.select(*out))
    return both.withColumn("turn", turn(F.col("epoch"))).drop("__source").toDF(*docs.columns, "epoch", "turn")
