"""Line dedup by suffix ranks over line ids (operator 9), with DataFrame operations alone.

Every document is a sequence of line ids (blank lines apart). A run of lines is repeated if the same ids follow each
other at an earlier place. Repeated runs are the longest-common-prefix intervals of the suffix array over all
sequences: suffixes that start with the same m lines are one interval. Prefix doubling builds the ranks: level k ranks
the windows of 2^k lines by the pair of their halves' ranks, in sorted order, and drops windows that occur once, so
every level holds repeated text only. A window of any length m is named by the ranks of the two windows of
2^floor(log2 m) lines that cover it.

A line goes if it lies in a run of at least `min_words` words that also stands at an earlier place. It's enough to
look at the shortest qualifying windows that start at a line and those that end at one: a longer repeated run is the
union of such windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from burrow.llm.store import discard, renamed, written

WORD = r"[^\x20\x09-\x0D]+"


def lines_of(docs: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """(row, first, i, line, id, words) of every line that isn't blank; i counts these, line counts all."""
    split = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x, n: F.struct(n.alias("line"), x.alias("text")))
    told = F.filter(split, lambda x: x.text.rlike(WORD))
    rows = docs.select("__row", F.col(order_col).cast("long").alias("first"), F.posexplode(told).alias("i", "x"))
    return rows.select(
        F.col("__row").alias("row"), "first", "i", F.col("x.line").alias("line"),
        F.unhex(F.md5(F.col("x.text"))).alias("id"), F.regexp_count(F.col("x.text"), F.lit(WORD)).alias("words"),
    )


def ranked(windows: DataFrame, *keys: str) -> DataFrame:
    """(keys, rank): the order number of every combination of keys that occurs more than once.

    Range partitions are sorted each for itself; the number of rows in those before gives a partition its first number.
    """
    repeated = windows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    sorted_ = repeated.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    placed = written(sorted_, "sorted").withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    inside = F.col("place") - F.shiftleft(F.col("part"), 33)
    return placed.join(starts, "part").select(*keys, (F.col("start") + inside).alias("rank"))


def suffix_ranks(lines: DataFrame, longest: int) -> list[DataFrame]:
    """Tables (level, row, i, rank): for each level up to floor(log2(longest)), the ranks of the repeated windows of 2^level
    lines. Windows with equal lines have equal ranks; ranks sort windows by their line ids."""
    ranks = ranked(lines.select("id"), "id")
    now = written(lines.join(ranks, "id").select("row", "i", "rank"), "level")
    levels = [now.select(F.lit(0).alias("level"), "row", "i", "rank")]
    level = 0
    while 2 << level <= longest:
        # Value at i + 2^level, or null if that window isn't there.
        ahead = Window.partitionBy("row").orderBy("i").rangeBetween(1 << level, 1 << level)
        pairs = now.withColumn("next", F.first("rank").over(ahead)).where("next IS NOT NULL").withColumnRenamed("rank", "half")
        ranks = ranked(pairs, "half", "next")
        now = written(pairs.join(ranks, ["half", "next"]).select("row", "i", "rank"), "level")
        level += 1
        levels.append(now.select(F.lit(level).alias("level"), "row", "i", "rank"))
    return levels


def shortest_windows(active: DataFrame, min_words: int) -> DataFrame:
    """(row, first, i, m): the shortest windows of at least `min_words` words from each line forward and back, inside
    stretches of active lines without a gap."""
    by_line = Window.partitionBy("row").orderBy("i")
    stretch = active.withColumn("stretch", F.col("i") - F.row_number().over(by_line))
    whole = Window.partitionBy("row", "stretch").orderBy("i")
    told = stretch.withColumn("until", F.sum("words").over(whole)).withColumn("before", F.col("until") - F.col("words"))
    told = told.withColumn("all", F.sum("words").over(Window.partitionBy("row", "stretch"))).where(F.col("all") >= min_words)
    told = written(told.select("row", "first", "stretch", "i", "until", "before"), "stretches")
    keys = ["row", "first", "stretch"]
    # Ends and wishes on one axis of words: the next end at or after a wish, the last start at or before one.
    ends = told.select(*keys, F.col("until").alias("at"), F.col("i").alias("mark"), F.lit(None).cast("int").alias("wish"))
    starts = told.select(*keys, F.col("before").alias("at"), F.col("i").alias("mark"), F.lit(None).cast("int").alias("wish"))
    none = F.lit(None).cast("int").alias("mark")
    from_here = told.select(*keys, (F.col("before") + min_words).alias("at"), none, F.col("i").alias("wish"))
    up_to_here = told.select(*keys, (F.col("until") - min_words).alias("at"), none, F.col("i").alias("wish"))
    down = Window.partitionBy("row", "stretch").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("row", "stretch").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    forward = ends.unionByName(from_here).withColumn("j", F.min("mark").over(down)).where("wish IS NOT NULL AND j IS NOT NULL")
    back = starts.unionByName(up_to_here).withColumn("j", F.max("mark").over(up)).where("wish IS NOT NULL AND j IS NOT NULL")
    both = forward.select("row", "first", F.col("wish").alias("i"), (F.col("j") - F.col("wish") + 1).alias("m")).unionByName(
        back.select("row", "first", F.col("j").alias("i"), (F.col("wish") - F.col("j") + 1).alias("m"))
    )
    return both.distinct()


def repeated_lines(lines: DataFrame, min_words: int) -> DataFrame:
    """(row, lines): the numbers of each document's lines that lie in a later copy of a run."""
    # Written, so that the join below is one of two tables and its hot lines can be split.
    counts = written(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    active = written(lines.join(counts, "id", "left_semi"), "active")
    windows = written(shortest_windows(active, min_words), "windows")
    longest = windows.agg(F.max("m")).first()[0]
    if longest is None:
        return lines.sparkSession.createDataFrame([], "row long, lines array<int>")
    levels = suffix_ranks(active, longest)
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.unionByName(more)
    level = F.floor(F.log2(F.col("m").cast("double")) + 1e-9).cast("int")
    head = windows.withColumn("level", level).withColumn("tail", (F.col("i") + F.col("m") - F.pow(F.lit(2.0), level)).cast("int"))
    named = head.join(ranks.withColumnRenamed("rank", "a"), ["level", "row", "i"]).join(
        ranks.select("level", "row", F.col("i").alias("tail"), F.col("rank").alias("b")), ["level", "row", "tail"]
    )
    named = written(named.select("row", "first", "i", "m", "a", "b"), "named")
    place = F.struct("first", "row", "i")
    earliest = named.groupBy("m", "a", "b").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    earliest = written(earliest.select("m", "a", "b", "earliest"), "intervals")
    later = named.join(earliest, ["m", "a", "b"]).where(place > F.col("earliest")).select("row", "i", "m")
    covered = later.select("row", F.explode(F.expr("sequence(i, i + m - 1)")).alias("i")).distinct()
    gone = covered.join(active.select("row", "i", "line"), ["row", "i"])
    out = written(gone.groupBy("row").agg(F.collect_set("line").alias("lines")), "gone")
    discard(active, windows, named, earliest, *levels)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs without the later copies of repeated runs of lines, and with the column lines_removed.

    Lines end at line feeds. A run counts if it has at least `min_words` words; of equal runs the first stays, by id, then
    by the row's place in the input, then by line. Runs don't cross documents; blank lines neither count nor break a
    run, and are never removed. Whole copies become empty or blank texts; no row is dropped. Null texts stay null; null
    ids come first; repeated rows are copies like others. All columns stay, whatever their names (one named lines_removed
    is replaced). An empty table stays empty.
    """
    docs = docs.drop("lines_removed")
    plain, id_col, text_col = renamed(docs, id_col, text_col)
    rows = written(plain.withColumn("__row", F.monotonically_increasing_id()), "rows")
    lines = written(lines_of(rows, text_col, id_col), "lines")
    gone = repeated_lines(lines, min_words)
    discard(lines)
    # Deletions grow with the corpus, and the size of a file of coded lists is no bound for their size in memory: they are
    # dealt with the texts at any size, never broadcast. A partition's deletions are few beside its texts, which aren't sorted.
    told = gone.select(F.col("row").alias("__row"), F.col("lines").alias("__gone"))
    joined = rows.join(told.hint("shuffle_hash"), "__row", "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone")), lambda n: F.get(parts, n))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone"))
    done = joined.withColumn(text_col, text).withColumn("lines_removed", removed).drop("__row", "__gone")
    return done.toDF(*docs.columns, "lines_removed")
