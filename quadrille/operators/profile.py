"""Profile lint: rules R1 to R5 over propositions, for spaces that declare them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms

# fixed values: the terms of a declaration, and what vocabulary is
ANCHOR, MEMBERSHIP, ENGINE_PREFIX = terms.Keyword(":kernel/profile"), terms.Keyword(":member_of"), ":kernel/"
KIND, MODE, INCLUDES, RULES, VOCABULARY = "relational", "observe", "includes", ("R1", "R2", "R3", "R4"), "R5"


def relational_errors(t1: Column, t2: Column, t3: Column) -> Column:
    """R1: only atoms; R2, R3: a subject and a predicate are a keyword or a string that isn't empty; R4: an atom for a value."""
    atom = lambda t: t["kind"] != terms.TRIPLE
    name = lambda t: (t["kind"] == terms.KEYWORD) | ((t["kind"] == terms.STRING) & (t["s"] != ""))
    rules = {"R1": atom(t1) & atom(t2) & atom(t3), "R2": name(t1), "R3": name(t2), "R4": atom(t3)}
    return F.filter(F.array(*(F.when(~ok, F.lit(r)) for r, ok in rules.items())), lambda r: r.isNotNull())


def lint(props: DataFrame, *, vocabulary: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """t1, t2, t3, rule for each violation, anchors apart; with vocabulary also R5: a namespaced predicate needs a membership
    triple in the same space, by naming the columns that tell spaces apart."""
    props = props.where(F.col("t2.key") != terms.literal(ANCHOR)["key"])
    found = props.select(*by, "t1", "t2", "t3", F.explode(relational_errors(F.col("t1"), F.col("t2"), F.col("t3"))).alias("rule"))
    if not vocabulary:
        return found
    spaced = (F.col("t2.kind") == terms.KEYWORD) & F.contains(F.col("t2.s"), F.lit("/")) & ~F.startswith(F.col("t2.s"), F.lit(ENGINE_PREFIX))
    members = props.where(F.col("t2.key") == terms.literal(MEMBERSHIP)["key"]).select(*by, F.col("t1.key").alias("__m")).distinct()
    loose = props.where(spaced).withColumn("__m", F.col("t2.key")).join(members, [*by, "__m"], "left_anti")
    return found.unionByName(loose.select(*by, "t1", "t2", "t3", F.lit(VOCABULARY).alias("rule")))


def declared(props: DataFrame) -> DataFrame:
    """space, vocabulary: the spaces of props (space, t1, t2, t3) that declare the relational profile, all of R1 to R4, in a
    triple (space, :kernel/profile, (profile, kind, mode)), and whether it includes R5."""
    rules = props.where((F.col("t2.kind") == terms.STRING) & (F.col("t2.s") == INCLUDES) & (F.col("t3.kind") == terms.STRING))
    rules = rules.groupBy("space", F.col("t1.key").alias("profile")).agg(*(F.bool_or(F.col("t3.s") == r).alias(r) for r in (*RULES, VOCABULARY)))
    rules = rules.where(" and ".join(RULES))
    header = terms.triple_key(F.col("profile"), terms.literal(KIND)["key"], terms.literal(MODE)["key"])
    anchors = props.where((F.col("t2.key") == terms.literal(ANCHOR)["key"]) & (F.col("t1.kind") == terms.STRING) & (F.col("t1.s") == F.col("space")))
    anchors = anchors.select("space", F.col("t3.key").alias("__header"))
    found = rules.withColumn("__header", header).join(anchors, ["space", "__header"])
    return found.groupBy("space").agg(F.bool_or(VOCABULARY).alias("vocabulary"))


def validate(props: DataFrame) -> DataFrame:
    """space, t1, t2, t3, rule: the violations of every space that declares the profile, of R5 where it is included."""
    spaces = declared(props)
    bound = props.join(spaces, "space")
    found = lint(bound, vocabulary=True, by=("space", "vocabulary"))
    return found.where((F.col("rule") != VOCABULARY) | F.col("vocabulary")).drop("vocabulary")
