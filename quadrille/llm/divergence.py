"""Quality rules: base counts of a text, and how far its histograms lie from those of its language.

Only DataFrame functions run here. One pass over the corpus builds the language references (its shuffle
carries partial counts of short words), a second pass judges every document within its own row: no shuffle.

Defined results: a null or empty text has no words and fails the base rule; a null language is a language of
its own; texts or languages too short for a histogram (min_words, min_language_words) are judged by the base
rule only; columns that the caller has besides doc_id, text and lang pass through untouched, whatever their
names. Repeated rows are judged alike.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, small_enough, words, written

#: Character classes of the histogram, in order.
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")
#: A letter for each common word of a language.
LETTERS = string.digits + string.ascii_letters
#: Languages whose references may be broadcast: about 40 short words each, so 8 MB at most.
MAX_BROADCAST_LANGUAGES = 4096


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words of __words: words covered by 5-word windows that the text has twice or more.

    Windows are compared by their 64-bit hash; the positions are only sorted where a hash repeats.
    """
    w = F.col("__words")
    n = F.size(w)
    at = lambda i, k: F.get(w, i + k)
    windows = F.when(n >= 5, F.transform(F.slice(w, 1, F.greatest(n - 4, F.lit(0))), lambda x, i: F.xxhash64(x, at(i, 1), at(i, 2), at(i, 3), at(i, 4))))
    df = df.withColumn("__windows", windows)
    h = F.col("__windows")
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("__sorted")
    twice = lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.when(i > 0, F.get(s, i - 1))["h"])
    df = df.withColumn("__at", F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"])))
    p = F.col("__at")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _with_class_counts(df: DataFrame, name: str) -> DataFrame:
    """Adds the counts of CLASSES in __text, one array of doubles.

    The classes share no character, so each is taken out of what the ones before it left: only the first regular
    expression reads the whole text, the second what isn't lower case, the others hardly anything.
    """
    left, counts = "__text", {}
    for c, p in {"lower": r"\p{Ll}+", "space": WHITE, "upper": r"\p{Lu}+", "digit": "[0-9]+", "symbol": r"[#*$%&|<>]+"}.items():
        df = df.withColumn(f"__no_{c}", F.regexp_replace(left, p, ""))
        counts[c] = F.length(left) - F.length(f"__no_{c}")
        left = f"__no_{c}"
    df = df.withColumn(name, F.array(*((counts | {"other": F.length(left)})[c] for c in CLASSES)).cast("array<double>"))
    return df.drop(*(f"__no_{c}" for c in counts))


def _with_base(df: DataFrame) -> DataFrame:
    """Adds __text, __words, __classes (their counts) and the base columns; symbols and space are classes, counted once."""
    df = _with_class_counts(df.withColumn("__text", F.coalesce("text", F.lit(""))), "__classes")
    df = _repeat_words(df.withColumn("__words", words(F.col("text")))).drop("__windows", "__sorted", "__at")
    count = lambda c: F.get("__classes", CLASSES.index(c)).cast("long")
    df = df.withColumn("n_words", F.size("__words").cast("long")).withColumn("word_chars", F.length("__text") - count("space"))
    df = df.withColumn("n_symbols", count("symbol")).withColumn("n_dup_lines", _dup_lines(F.col("__text")))
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _with_shares(df: DataFrame, counts: str) -> DataFrame:
    """Turns an array of counts into shares; the sum is a column of its own, else each element would sum anew."""
    df = df.withColumn("__sum", F.greatest(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), F.lit(1.0)))
    return df.withColumn(counts, F.transform(counts, lambda x: x / F.col("__sum"))).drop("__sum")


def jensen_shannon(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares: root of the divergence to base 2, 0 to 1."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    each = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x)))


def language_references(docs: DataFrame, *, n_common: int = 40, max_word: int = 5, min_share: float = 0.001) -> DataFrame:
    """One row a language, from all documents: lang, words (its n_common most frequent words of up to max_word
    characters, none a comma, with at least min_share of its words), word_shares (theirs and, last, of all other words),
    class_shares, total (its words)."""
    if n_common > len(LETTERS):
        raise ValueError(f"{n_common} common words; there are {len(LETTERS)} letters")
    df = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("__text"))
    by_class = (
        _with_class_counts(df, "c")
        .select("lang", "c", F.size(words(F.col("__text"))).alias("n"))
        .groupBy("lang")
        .agg(*(F.sum(F.col("c")[i]).alias(c) for i, c in enumerate(CLASSES)), F.sum("n").alias("total"))
    )
    short = df.select("lang", F.explode(words(F.col("__text"))).alias("word")).where((F.length("word") <= max_word) & ~F.contains("word", F.lit(","))).groupBy("lang", "word").count()
    # a row a language; written, since it is needed twice
    totals = _with_shares(by_class.select("lang", "total", F.array(*CLASSES).alias("class_shares")), "class_shares")
    totals = written(totals)
    # at most 1 / min_share words of a language pass, so the list below is bounded
    frequent = short.join(totals.select("lang", "total"), "lang").where(F.col("count") >= min_share * F.col("total"))
    ranked = frequent.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), "word"))), 1, n_common).alias("top"))
    out = totals.join(ranked, "lang", "left").withColumn("top", F.coalesce("top", F.array().cast("array<struct<k:bigint,word:string>>")))
    out = out.withColumn("counts", F.transform("top", lambda x: (-x["k"]).cast("double")))
    rest = F.col("total") - F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    out = _with_shares(out.withColumn("word_shares", F.concat("counts", F.array(rest))), "word_shares")
    return out.select("lang", F.transform("top", lambda x: x["word"]).alias("words"), "word_shares", "class_shares", "total")


def judge(
    docs: DataFrame, references: DataFrame | None = None, *, max_class_distance: float = 0.28, max_word_distance: float = 0.5, min_words: int = 50, min_language_words: int = 1000
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    kept: the base rule passes, and neither histogram is farther from its language than the limit; the
    distances are null, and not held against a text, below min_words or min_language_words.
    """
    references = written(language_references(docs)) if references is None else references
    longest = F.array_max(F.transform("words", F.octet_length))
    ref = references.select(F.col("lang").alias("__lang"), F.struct("words", F.array_join("words", ",").alias("list"), longest.alias("longest"), "word_shares", "class_shares", "total").alias("__ref"))
    if small_enough(ref, MAX_BROADCAST_LANGUAGES):
        ref = F.broadcast(ref)
    df = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
    df = _with_base(df.withColumn("__lang", F.coalesce("lang", F.lit("")))).join(ref, "__lang", "left")
    r = F.col("__ref")
    judged = (F.col("n_words") >= min_words) & (r["total"] >= min_language_words)
    df = _with_shares(df, "__classes")
    df = df.withColumn("class_distance", F.when(judged, jensen_shannon(F.col("__classes"), r["class_shares"])))
    # each common word as its letter, the others dropped, those longer than all common words without a search; then how
    # often each letter occurs
    letters = F.array(F.lit(None).cast("string"), *map(F.lit, LETTERS))
    letter = lambda w: F.when(F.octet_length(w) <= r["longest"], F.get(letters, F.find_in_set(w, r["list"])))
    df = df.withColumn("__which", F.when(judged, F.array_join(F.transform("__words", letter), "")))
    known = F.col("__which")
    counts = F.transform(r["words"], lambda w, i: (F.octet_length(known) - F.octet_length(F.replace(known, F.substr(F.lit(LETTERS), i + 1, F.lit(1)), F.lit("")))).cast("double"))
    df = df.withColumn("__counts", F.concat(counts, F.array((F.col("n_words") - F.octet_length(known)).cast("double"))))
    df = _with_shares(df, "__counts").withColumn("word_distance", F.when(judged, jensen_shannon(F.col("__counts"), r["word_shares"])))
    far = F.coalesce((F.col("class_distance") > max_class_distance) | (F.col("word_distance") > max_word_distance), F.lit(False))
    # an expression that Spark takes for nondeterministic: a caller's filter on the verdict stays above it, instead of
    # repeating all of this below, inside the functions that run over arrays
    df = df.withColumn("kept", ~F.col("base_failed") & ~far & (F.monotonically_increasing_id() >= 0))
    return df.drop("__lang", "__text", "__words", "__ref", "__which", "__classes", "__counts")
