"""Line dedup: a suffix array over sequences of line ids, sorted by distributed prefix doubling.

Every non-blank line is an id (the 64-bit hash of its text); a document is the sequence of its ids. Doubling
sorts suffixes by their first 1, 2, 4 ... lines: the rank of a suffix at depth 2h is the rank of the pair (its
rank at depth h, the rank at depth h of the suffix h lines on). Ranks come from one range-partitioned sort of the
distinct pairs that occur twice or more; a suffix whose pair occurs once has no common prefix of that depth with any
other and leaves. Doubling ends when no suffix is left. Suffixes of one rank are neighbours in the order, an interval with a
common prefix of that depth. The deepest interval in which a suffix isn't the first gives the lines that
start there as a later copy; where such stretches touch or overlap they make one maximal repeated run.

Defined results: a line is deleted if it lies in a run of min_lines or more consecutive non-blank lines that also
occurs earlier, by (doc_id, line); with min_words also if it has that many words and occurs earlier by itself, in a run
of any length. Blank lines stay and do not break a run. A null text counts as empty and stays
null. Documents with equal doc_id are told apart by their texts; rows with equal doc_id and text are one
document, each row of which gets the same result. A null doc_id is one like others and comes first. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written


def _sequences(docs: DataFrame, min_words: int | None) -> DataFrame:
    """(doc_id, th, line, pos, r, long): each non-blank line, its number in the text, its number in the sequence, its id,
    whether it has min_words words."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    long = lambda x: F.lit(False) if min_words is None else F.size(words(x)) >= min_words
    tagged = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("r"), long(x).alias("long"), x.rlike(r"[^\x20\x09-\x0D]").alias("ink")))
    df = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.filter(tagged, lambda x: x["ink"])).alias("pos", "x"))
    return df.select("doc_id", "th", "pos", F.col("x.line").alias("line"), F.col("x.r").alias("r"), F.col("x.long").alias("long"))


def _ranked(suffixes: DataFrame) -> DataFrame:
    """Of suffixes with (a, b): those whose pair occurs twice or more, with the pair's rank as r."""
    pairs = suffixes.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("first")).where("n > 1")
    # after a range sort the ids that Spark numbers rows with rise with (a, b); writing fixes them
    ranks = written(pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("r"), "first"))
    return written(suffixes.join(ranks, ["a", "b"]).select("doc_id", "th", "pos", "line", "long", "r", "first"))


def _moved(suffixes: DataFrame, by: int) -> DataFrame:
    """Suffixes with a, their rank, and b, that of the suffix so many lines on in the same document."""
    on = suffixes.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__of"), (F.col("pos") - by).alias("__pos"), F.col("r").alias("b"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__of")) & (F.col("pos") == F.col("__pos"))
    return suffixes.withColumnRenamed("r", "a").drop("first").join(on, same).drop("__doc", "__of", "__pos")


def later_copies(docs: DataFrame, *, min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """(doc_id, th, pos, n): where n lines start that also start earlier, th the text's hash; of the depths looked at
    (min_lines, its doubles) the greatest, or 1 where only the line alone has an earlier copy and min_words words."""
    later = F.struct("doc_id", "th", "pos") != F.col("first")
    # the same rows twice are one document
    found = _ranked(_sequences(docs, min_words).dropDuplicates(["doc_id", "th", "pos"]).withColumnRenamed("r", "a").withColumn("b", F.lit(0)))
    copies = found.where(later & F.col("long")).select("doc_id", "th", "pos", F.lit(1).alias("n"))
    depth = 1
    while not found.isEmpty():
        if depth >= min_lines:
            copies = copies.union(found.where(later).select("doc_id", "th", "pos", F.lit(depth).alias("n")))
        # below min_lines no further than there: two overlapping stretches of depth lines make min_lines
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        found = _ranked(_moved(found, step))
        depth += step
    return copies.groupBy("doc_id", "th", "pos").agg(F.max("n").alias("n"))


def maximal_runs(docs: DataFrame, *, min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """(doc_id, th, start, n): the maximal stretches of lines, by their numbers in the sequence, that are later copies."""
    w = Window.partitionBy("doc_id", "th").orderBy("pos")
    df = later_copies(docs, min_lines=min_lines, min_words=min_words).withColumn("end", F.col("pos") + F.col("n"))
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("new", F.when(before >= F.col("pos"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return df.groupBy("doc_id", "th", "run").agg(F.min("pos").alias("start"), (F.max("end") - F.min("pos")).alias("n")).drop("run")


def line_dedup(docs: DataFrame, *, min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """docs with later copies of repeated line runs, and of single lines of min_words words, cut from text, and n_lines (non-blank), n_removed, n_runs."""
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    runs = maximal_runs(docs, min_lines=min_lines, min_words=min_words)
    gone = runs.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))
    each = F.flatten(F.transform("runs", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__of"), each.alias("__gone"), F.size("runs").alias("__runs"))
    df = docs.withColumn("__th", F.xxhash64("text"))
    df = df.join(gone, df["doc_id"].eqNullSafe(gone["__doc"]) & (df["__th"] == gone["__of"]), "left").drop("__doc", "__of", "__th")
    df = df.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    # __ink: the line numbers of the sequence's members
    df = df.withColumn("__ink", F.filter(F.transform("__lines", lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull()))
    df = df.withColumn("__cut", F.transform("__gone", lambda p: F.get("__ink", p)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__cut"), lambda i: F.get("__lines", i))
    df = df.withColumn("n_lines", F.size("__ink").cast("long")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    df = df.withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long"))).withColumn("n_runs", F.coalesce("__runs", F.lit(0)).cast("long"))
    df = df.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return df.select(*docs.columns, "n_lines", "n_removed", "n_runs")
