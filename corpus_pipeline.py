"""A corpus pipeline out of the operators of quadrille.llm: each stage is written as Parquet and read again.

Each stage takes all rows that the one before it kept. Null texts count as empty and fail the quality rules, so later
stages see none; a null doc_id is one like others, and documents with equal doc_id are told apart by their texts; rows
with equal doc_id and text are one document, of which the third stage leaves one row; an empty table gives an empty table; columns besides doc_id, text, lang and n_chars pass through, whatever their names (but those that begin with two underscores
are the operators' own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import containment, divergence, jaccard, line_runs, maxplus
from quadrille.llm.common import shared_dir, table, written
from quadrille.llm.queries import tokenizer_file

#: A line of so many words is a passage: its later copies go even where the lines around it differ.
LONG_LINE = 50


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator reads, and the others as one, so that no name clashes with what the operator adds."""
    others = [c for c in docs.columns if c not in columns]
    return docs.select(*columns, *([F.struct(*others).alias("__others")] if others else []))


def _unpacked(df: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """The columns of docs out of what an operator made of _packed(docs, *columns)."""
    return df.select(*(F.col(c) if c in columns else F.col("__others")[c].alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rule and lie near their language, as they came.

    Null and empty texts go, as they have no words; a null lang is a language of its own; repeated rows fare alike; texts of any length
    are read whole; an empty table stays one; other columns, whatever their names, and null doc_ids pass through.
    """
    read = ("lang", "text")
    return _unpacked(divergence.judge(_packed(docs, *read)).where("kept"), docs, *read)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated line runs, and of single lines of LONG_LINE words, out of texts; a document of which
    nothing is left goes; n_chars follows the text.

    The first place by (doc_id, line) keeps its lines, null doc_ids come first; rows with equal doc_id and text are one document
    and fare alike; null and empty texts have no lines and stay; other columns, whatever their names, pass through.
    """
    read = ("doc_id", "text")
    cut = line_runs.line_dedup(_packed(docs, *read), min_words=LONG_LINE).where((F.col("n_removed") == 0) | (F.col("n_lines") > F.col("n_removed")))
    out = _unpacked(cut, docs, *read)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near duplicates (5-word shingles, 0.8) one row: that with the smallest doc_id, nulls
    last, of those the smallest text hash, of equal rows the smallest as JSON.

    Texts without words, null ones too, are near nothing and stay; texts of any length are compared whole; an empty table stays one; other
    columns, whatever their names, pass through."""
    rows = jaccard.classes(docs).where("label is not null").groupBy("doc_id", "th", "label").agg(F.count("*").alias("n"))
    rows = written(rows)
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    first = first.select(F.col("label").alias("__label"), F.col("first.doc_id").alias("__first"), F.col("first.th").alias("__of"))
    is_first = F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("th") == F.col("__of"))
    marked = written(rows.join(first, F.col("label") == F.col("__label")).select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), "n", is_first.alias("kept")))
    same = docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__th"))
    repeated = marked.where("kept and n > 1").drop("n", "kept")
    if repeated.isEmpty():
        return docs.join(marked.where("not kept"), same, "left_anti").select(*docs.columns)
    single = docs.join(marked.where("not kept or n > 1"), same, "left_anti").select(*docs.columns)
    each = docs.join(repeated, same, "left_semi").select("doc_id", "text", F.struct(*docs.columns).alias("x"))
    return single.unionByName(each.groupBy("doc_id", "text").agg(F.min_by("x", F.to_json("x")).alias("x")).select("x.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item (0.8 of its 5-word shingles).

    Null and wordless items and texts contain and match nothing; a document goes by its text whatever its doc_id, null too; an
    empty benchmark drops nothing; other columns, whatever their names, pass through.
    """
    return containment.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, the document's pieces; a column of that name is replaced.

    A null text has null ids, an empty one none; equal texts have equal ids; texts of any length are encoded whole.
    """
    return maxplus.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: Pieces and language shares are beyond SQL here; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    where = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{where}/{k}")
    return docs
