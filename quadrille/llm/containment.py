"""Benchmark decontamination: size-partitioned MinHash containment search for short items inside long documents.

An item of m distinct shingles is found in a document that holds need = ceil(num * m / den) of them. Its sketch is
its m - need + 1 smallest shingle hashes, its bottom-k MinHash: whoever holds enough of the item misses fewer than that,
so holds one of the sketch, however long it is. Items are partitioned by size (powers of two); a partition has a hash
threshold, the largest hash of its sketches, and the size of the smallest document that can hold one of its items. A
document is sketched by its shingle hashes below the largest threshold of the partitions that it is large enough for, and looked
up there; that gives all candidates, no scaling of the estimate and no miss. Candidates are verified by exact containment of the shingles themselves.

Only DataFrame functions run here. Sketches and items are broadcast only below a checked size.

Defined results: texts are lower-cased, words split at ASCII white space; an item with fewer words than a shingle is one
shingle of that many words; null or wordless items and texts match nothing. Rows with equal doc_id and text count once,
null doc_ids being equal, and so do items with equal item_id and text. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough, words, written

#: Rows of sketches, of items' shingles and of candidates that may be broadcast.
MAX_BROADCAST = 500_000


def _starts(w: Column, size: int) -> Column:
    """The first word of each window of so many words."""
    return F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))


def _hashes(w: Column, size: int) -> Column:
    return F.transform(_starts(w, size), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, size))))


def _shingles(w: Column, size: int) -> Column:
    """Windows of words as texts, each once."""
    return F.array_distinct(F.transform(_starts(w, size), lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + k) for k in range(1, size)))))


def _items(benchmark: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """item_id, size (words in its shingles), shingles, m, need, part."""
    df = benchmark.select("item_id", words(F.lower("text")).alias("w")).where(F.size("w") > 0).distinct()
    df = df.withColumn("size", F.least(F.size("w"), F.lit(size)))
    each = F.lit(None).cast("array<string>")
    for k in range(1, size + 1):
        each = F.when(F.col("size") == k, _shingles(F.col("w"), k)).otherwise(each)
    df = df.withColumn("shingles", each).withColumn("m", F.size("shingles"))
    return df.withColumn("need", F.ceil(num * F.col("m") / F.lit(den)).cast("int")).withColumn("part", F.floor(F.log2("m")).cast("int")).drop("w")


def _hashes_of(shingles: str, size: int) -> Column:
    """The hashes of shingles given as texts, equal to those of _hashes."""

    def one(shingle):
        parts = F.split(shingle, " ")
        return F.xxhash64(*(F.get(parts, k) for k in range(size)))

    return F.transform(shingles, one)


def matches(docs: DataFrame, benchmark: DataFrame, *, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, th (the text's hash), item_id, n_shared and n_item (shingles) for each item that a document contains."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    items = written(_items(benchmark, size, num, den))
    few_items = small_enough(items.select(F.explode("shingles")), MAX_BROADCAST)
    found = None
    for k in [r["size"] for r in items.select("size").distinct().collect()]:  # at most `size` of them
        own = items.where(F.col("size") == k)
        bottom = F.slice(F.array_sort(_hashes_of("shingles", k)), 1, F.col("m") - F.col("need") + 1)
        sketch = own.select("item_id", "part", "need", F.explode(bottom).alias("h"))
        part = sketch.groupBy("part").agg(F.max("h").alias("tau"), F.min("need").alias("least"))
        sketch = sketch.join(F.broadcast(part), "part")  # one row for each power of two
        # a document is sketched by its hashes below the threshold of the partitions that it is large enough for
        w = docs.withColumn("w", words(F.lower("text"))).withColumn("n", F.size("w") - (k - 1))
        limits = [F.when(F.col("n") >= r["least"], F.lit(r["tau"])) for r in part.collect()]
        limit = F.col("limit")
        w = w.withColumn("limit", F.greatest(*limits, F.lit(None), F.lit(None)))
        # named twice in the function, the limit stays a column, worked out once a document
        seen = w.select("doc_id", "th", "n", F.explode(F.filter(_hashes(F.col("w"), k), lambda h: limit.isNotNull() & (h <= limit))).alias("h"))
        sketch = F.broadcast(sketch) if few_items else sketch
        hits = seen.join(sketch, "h").where((F.col("n") >= F.col("least")) & (F.col("h") <= F.col("tau"))).select("doc_id", "th", "item_id").distinct()
        found = hits if found is None else found.union(hits)
    none = "doc_id bigint, th bigint, item_id bigint, n_shared bigint, n_item bigint"
    if found is None:
        return docs.sparkSession.createDataFrame([], none)
    found = written(found.groupBy("doc_id", "th").agg(F.collect_set("item_id").alias("items")))
    listed = F.broadcast(found) if small_enough(found, MAX_BROADCAST) else found
    listed = listed.withColumnsRenamed({"doc_id": "__doc", "th": "__th"})
    w = docs.join(listed, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th"))).dropDuplicates(["doc_id", "th"]).withColumn("w", words(F.lower("text")))
    sizes = [r["size"] for r in items.select("size").distinct().collect()]
    w = w.select("doc_id", "th", "items", *(_shingles(F.col("w"), k).alias(f"s{k}") for k in sizes))
    held = F.lit(None).cast("array<string>")
    for k in sizes:
        held = F.when(F.col("size") == k, F.col(f"s{k}")).otherwise(held)
    pairs = w.select("doc_id", "th", F.explode("items").alias("item_id"), *(f"s{k}" for k in sizes)).join(F.broadcast(items) if few_items else items, "item_id")
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect("shingles", held)))
    return pairs.where(F.col("n_shared") >= F.col("need")).select("doc_id", "th", "item_id", F.col("n_shared").cast("long").alias("n_shared"), F.col("m").cast("long").alias("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that contain an item; columns as they came."""
    bad = matches(docs, benchmark, **how).select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).distinct()
    bad = written(bad)
    bad = F.broadcast(bad) if small_enough(bad, MAX_BROADCAST) else bad
    same = docs["doc_id"].eqNullSafe(bad["__doc"]) & (F.xxhash64(docs["text"]) == bad["__th"])
    return docs.join(bad, same, "left_anti")
