"""Relational tables and other inputs as propositions (t1, t2, t3) and as operation logs (space, seq, ord, action, t1, t2, t3)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import strings, terms

LOG = f"space string, seq bigint, ord int, action string, t1 {terms.TERM}, t2 {terms.TERM}, t3 {terms.TERM}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attribute(name: str) -> terms.Keyword:
    return terms.Keyword(f":{name}")


def propositions(df: DataFrame, row_id: Column, columns: list[str], references: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A triple (row id, :column, value) for each value of the columns that isn't null.

    One union member a column: a rule that names the column prunes the others, so it scans one Parquet column.
    references turns a key column into the row id it refers to.
    """
    kinds, references = dict(df.dtypes), references or {}
    parts = []
    for c in columns:
        value = terms.string(references[c](F.col(c))) if c in references else terms.of_type(F.col(c), kinds[c])
        parts.append(df.where(F.col(c).isNotNull()).select(terms.string(row_id).alias("t1"), terms.literal(attribute(c)).alias("t2"), value.alias("t3")))
    return reduce(DataFrame.unionAll, parts)


@dataclass(frozen=True)
class Table:
    """A table whose rows are stars of propositions about one row id each. unique: no id comes twice, so what is found by ids
    needs no distinct."""

    df: DataFrame
    row_id: Column
    columns: tuple[str, ...]
    references: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    unique: bool = False

    def propositions(self) -> DataFrame:
        return propositions(self.df, self.row_id, list(self.columns), self.references)

    def value(self, column: str) -> Column:
        """The column's value as a term."""
        c = F.col(column)
        return terms.string(self.references[column](c)) if column in self.references else terms.of_type(c, dict(self.df.dtypes)[column])

    def equals(self, column: str, value) -> Column:
        """Whether the column's value is the given one; on the plain column where that says the same, so that scans can use it."""
        kind = dict(self.df.dtypes)[column]
        plain = column not in self.references and (type(value) is str and kind == "string" or type(value) is int and kind in ("int", "bigint"))
        return F.col(column) == F.lit(value) if plain else self.value(column)["key"] == terms.literal(value)["key"]


def tagged(table: str) -> Callable[[Column], Column]:
    """The row id of a key: table:key."""
    return lambda key: F.concat(F.lit(f"{table}:"), key.cast("string"))


def operations(df: DataFrame, space: str, seq: Column, ordinal: Column, action: Column, t1: Column, t2: Column, t3: Column) -> DataFrame:
    return df.select(F.lit(space).alias("space"), seq.cast("bigint").alias("seq"), ordinal.cast("int").alias("ord"), action.alias("action"), t1.alias("t1"), t2.alias("t2"), t3.alias("t3"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: (user, :did, k mod 8), retracted by errors, else asserted."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    action = F.when(F.col("event_type") == "error", "retract").otherwise("assert")
    return operations(e, "events", F.col("event_id") + 1, F.lit(0), action, terms.integer(F.col("user_id")), terms.literal(terms.Keyword(":did")), terms.integer(k % 8))


# fixed values: the order of predicates in a file, and those that refer to subjects where nothing is declared
ORDER = ("title owner lead driver source proposed_by created_by created_at updated_at committed do_on valid_until estimate_hours repo part_of depends_on relates_to clarifies amends outcome abandoned").split()
REFERRING = ("depends_on", "part_of", "relates_to", "clarifies", "amends")

_ESCAPES = (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\\\", "\\"))


def unquoted(c: Column) -> Column:
    """The text of a quoted string, its escapes resolved."""
    body = F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)
    parts = F.regexp_extract_all(body, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    one = lambda x: reduce(lambda done, e: done.when(x == e[0], F.lit(e[1])), _ESCAPES[1:], F.when(x == _ESCAPES[0][0], F.lit(_ESCAPES[0][1]))).otherwise(x)
    return F.array_join(F.transform(parts, one), "")


def quoted(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for code, plain in _ESCAPES[:4]:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _spellings(df: DataFrame) -> DataFrame:
    """spelling, name: names and aliases that the propositions (t, k, v) themselves declare for predicates, and the name."""
    declared = df.where(F.col("k").isin("predicate_name", "predicate_alias"))
    name = declared.where("k = 'predicate_name'").groupBy("t").agg(F.max("v").alias("name"))
    return declared.join(name, "t").groupBy(F.col("v").alias("spelling")).agg(F.max("name").alias("name"))


def _kinds(df: DataFrame) -> DataFrame:
    """name, kind: the value kind that the propositions (t, k, v) declare for predicates."""
    return df.where("k = 'value_kind'").select(strings.strip_at(F.col("t")).alias("spelling"), F.col("v").alias("kind")).groupBy("spelling").agg(F.max("kind").alias("kind"))


def _normalised(df: DataFrame) -> DataFrame:
    """(t, k, v) with predicates by their declared names and values of the kind ref with their at sign."""
    names, kinds = _spellings(df), _kinds(df)
    df = df.join(names.withColumnRenamed("spelling", "k"), "k", "left").withColumn("k", F.coalesce("name", strings.strip_at(F.col("k")))).drop("name")
    df = df.join(kinds.withColumnRenamed("spelling", "k"), "k", "left")
    kind = F.coalesce("kind", F.when(F.col("k").isin(*REFERRING), "ref").otherwise("literal"))
    refers = (kind == "ref") & ~F.startswith("v", F.lit("@"))
    return df.select("t", "k", F.when(refers, F.concat(F.lit("@"), F.col("v"))).otherwise(F.col("v")).alias("v"), kind.alias("kind"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Propositions out of files, a subject each (parse_markdown)."""
    return parse_markdown(spark.read.text(path, wholetext=True))


def parse_markdown(texts: DataFrame) -> DataFrame:
    """Propositions out of texts (value): the first line that starts with @ is the subject, each line behind it "predicate value", up
    to a line ---; what follows is the proposition (subject, "body", text). A value in quotes is unquoted.

    Texts without a subject give nothing; lines end at a line feed, a carriage return before it is no part of them.
    """
    files = texts.select(F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value"))
    parts = F.split("value", r"(?m)^[ \t]*---[ \t]*$\n?", 2)
    lines = F.transform(F.split(F.get(parts, F.lit(0)), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    first = F.array_position(F.transform("lines", lambda x: F.startswith(x, F.lit("@"))), F.lit(True)).cast("int")
    df = files.select(lines.alias("lines"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("body")).withColumn("at", first).where("at > 0")
    df = df.select(F.get("lines", F.col("at") - 1).alias("t"), F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0))).alias("lines"), "body")
    each = df.select("t", F.explode("lines").alias("line")).where("line <> ''").select("t", strings.split_kv(F.col("line")).alias("x"))
    value = F.when(F.startswith("x.v", F.lit('"')), unquoted(F.col("x.v"))).otherwise(F.col("x.v"))
    whole = each.select("t", F.col("x.k").alias("k"), value.alias("v")).unionAll(df.where(F.col("body").rlike(r"\S")).select("t", F.lit("body"), "body"))
    return _normalised(whole).select(terms.string(F.col("t")).alias("t1"), terms.string(F.col("k")).alias("t2"), terms.string(F.col("v")).alias("t3"))


def to_markdown(props: DataFrame) -> DataFrame:
    """(subject, text): each subject's string propositions as such a file's text: predicates in a fixed order, others by name,
    a value's line each, the body last. Of several values of a predicate the order is that of the texts."""
    df = props.where((F.col("t1.kind") == terms.STRING) & (F.col("t2.kind") == terms.STRING) & (F.col("t3.kind") == terms.STRING))
    df = _normalised(df.select(F.col("t1.s").alias("t"), F.col("t2.s").alias("k"), F.col("t3.s").alias("v")))
    plain = ~((F.trim("v") == "") | F.col("v").rlike(r"[ \t\n\r]") | F.startswith("v", F.lit("@")) | F.startswith("v", F.lit('"')))
    df = df.withColumn("shown", F.when((F.col("kind") == "ref") | plain, F.col("v")).otherwise(quoted(F.col("v"))))
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("k"))
    line = F.struct(F.when(place > 0, place).otherwise(len(ORDER) + 1).alias("place"), "k", "shown")
    body = F.min(F.when(F.col("k") == "body", F.col("v")))
    each = df.groupBy("t").agg(F.sort_array(F.collect_list(F.when(F.col("k") != "body", line))).alias("lines"), body.alias("body"))
    text = F.concat("t", F.lit("\n"), F.array_join(F.transform("lines", lambda x: F.concat(x["k"], F.lit("  "), x["shown"])), "\n"), F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    return each.select(F.col("t").alias("subject"), text.alias("text"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """file, t1, t2, t3, texts: the facts of streams in which a line "@file name" begins a block and a line
    [a b c] states a fact of numbers, names or quoted strings; other lines are skipped."""
    atom = r'("(?:[^"\\]|\\.)*"|[^\s\[\]"]+)'
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.replace("value", F.lit("\r\n"), F.lit("\n")), r"(?m)^@file ")).alias("block"))
    lines = blocks.select(F.split("block", "\n").alias("lines")).select(F.get("lines", F.lit(0)).alias("file"), F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    fact = rf"^\[\s*{atom}\s+{atom}\s+{atom}\s*\]\s*$"
    part = lambda k: F.regexp_extract("line", fact, k)
    value = lambda x: F.when(F.startswith(x, F.lit('"')), unquoted(x)).otherwise(x)
    return lines.where(F.col("line").rlike(fact)).select("file", *(value(part(k)).alias(f"t{k}") for k in (1, 2, 3)))


def faults(ops: DataFrame) -> DataFrame:
    """space, seq, ord, fault: what a log must not hold: action (neither assert nor retract), term (a part missing), place (no
    place, or below seq 1 and ord 0), repeated (a place taken twice), gap (an ord whose predecessor in its frame is missing)."""
    part = lambda t: F.col(t).isNull() | F.col(f"{t}.key").isNull() | F.col(f"{t}.kind").isNull()
    own = F.array(
        F.when(F.coalesce(~F.col("action").isin("assert", "retract"), F.lit(True)), F.lit("action")),
        F.when(part("t1") | part("t2") | part("t3"), F.lit("term")),
        F.when(F.col("space").isNull() | F.coalesce((F.col("seq") < 1) | (F.col("ord") < 0), F.lit(True)), F.lit("place")),
    )
    each = ops.select("space", "seq", "ord", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("fault"))
    frames = Window.partitionBy("space", "seq").orderBy("ord")
    placed = ops.where("space is not null and seq is not null and ord is not null").groupBy("space", "seq", "ord").agg(F.count("*").alias("n"))
    placed = placed.withColumn("before", F.lag("ord").over(frames))
    wrong = F.array(F.when(F.col("n") > 1, F.lit("repeated")), F.when(F.col("ord") != F.coalesce(F.col("before") + 1, F.lit(0)), F.lit("gap")))
    return each.unionByName(placed.select("space", "seq", "ord", F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("fault")))


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """A log's operations, if it has no faults."""
    ops = read_log(spark, path)
    found = faults(ops).limit(1).collect()
    if found:
        raise QueryError(":log-invalid", repr(found[0]))
    return ops


def append_log(ops: DataFrame, path: str) -> None:
    """Appends operations to a log's table, one partition folder a space."""
    ops.write.mode("append").partitionBy("space").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path).select("space", "seq", "ord", "action", "t1", "t2", "t3")
