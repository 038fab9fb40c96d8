"""The predicate registry: names, aliases and cardinalities of predicates as propositions, and lookups through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import terms
from . import history

# fixed values: the registry's own predicates
NAME, ALIAS, CARDINALITY, VALUE_KIND, LABEL = "predicate_name", "predicate_alias", "cardinality", "value_kind", "name"


def of_predicate(live: DataFrame, predicate: str) -> DataFrame:
    return live.where(F.col("t2")["key"] == terms.literal(predicate)["key"])


def registry(live: DataFrame) -> DataFrame:
    """predicate (key), name, aliases, cardinality (multi unless declared), value_kind: a row a registered predicate."""
    pick = lambda p, c: F.max_by(F.when(F.col("t2.s") == p, F.col("t3.s")), F.when(F.col("t2.s") == p, F.struct("seq", "ord"))).alias(c)
    known = live.where(F.col("t2.s").isin(NAME, ALIAS, CARDINALITY, VALUE_KIND) & (F.col("t2.kind") == terms.STRING))
    out = known.groupBy(F.col("t1.key").alias("predicate")).agg(pick(NAME, "name"), pick(CARDINALITY, "cardinality"), pick(VALUE_KIND, "value_kind"), F.sort_array(F.collect_set(F.when(F.col("t2.s") == ALIAS, F.col("t3.s")))).alias("aliases"))
    return out.withColumn("cardinality", F.coalesce("cardinality", F.lit("multi"))).where("name is not null")


def resolved(live: DataFrame, spelling: str) -> str | None:
    """The key of the predicate of that name or alias; two are a collision."""
    found = [r["predicate"] for r in registry(live).where((F.col("name") == spelling) | F.array_contains("aliases", spelling)).select("predicate").limit(2).collect()]
    if len(found) > 1:
        raise QueryError(":schema/name-collision", spelling)
    return found[0] if found else None


def lookup_all(live: DataFrame, subject: Column | None, predicate_key: str) -> DataFrame:
    """The live values of a predicate, of one subject or of all, in commit order by seq and ord."""
    df = live.where(F.col("t2.key") == predicate_key)
    return df if subject is None else df.where(F.col("t1.key") == subject["key"])


def lookup(live: DataFrame, predicate_key: str) -> DataFrame:
    """The first value in commit order of each subject."""
    df = lookup_all(live, None, predicate_key)
    return df.groupBy("t1").agg(F.min_by("t3", F.struct("seq", "ord")).alias("t3"))


def find_by(live: DataFrame, predicate_key: str, value) -> DataFrame:
    """Subjects that have the value."""
    return lookup_all(live, None, predicate_key).where(F.col("t3.key") == terms.literal(value)["key"]).select("t1").distinct()


def names(live: DataFrame) -> DataFrame:
    """subject, name: the first name of each."""
    df = of_predicate(live, LABEL)
    return df.groupBy(F.col("t1").alias("subject")).agg(F.min_by(F.col("t3.s"), F.struct("seq", "ord")).alias("name"))


def single_valued(live: DataFrame) -> DataFrame:
    """Live propositions with a predicate declared single keep, of each subject, the newest value only."""
    single = registry(live).where("cardinality = 'single'").select(F.col("predicate").alias("__p"))
    one = live.join(single, live["t2"]["key"] == single["__p"], "left_semi")
    many = live.join(single, live["t2"]["key"] == single["__p"], "left_anti")
    return many.unionByName(history.newest(one, "t1", "t2").select(*live.columns))


def _spelled(live: DataFrame) -> DataFrame:
    """spelling, id (term): every name and alias of a registered predicate."""
    known = live.where(F.col("t2.s").isin(NAME, ALIAS) & (F.col("t2.kind") == terms.STRING) & (F.col("t3.kind") == terms.STRING))
    return known.select(F.col("t3.s").alias("spelling"), F.col("t1").alias("id")).distinct()


def _proposition(subject: Column, predicate: str, value: Column) -> Column:
    return F.struct(subject.alias("t1"), terms.literal(predicate).alias("t2"), terms.string(value).alias("t3"))


def resolve_all(live: DataFrame, spellings: DataFrame) -> DataFrame:
    """spelling, id, n: the predicate of each spelling, null if none, and how many have it; more than one is a collision."""
    found = spellings.select("spelling").distinct().join(_spelled(live), "spelling", "left")
    return found.groupBy("spelling").agg(F.min("id").alias("id"), F.count("id").alias("n"))


def registrations(live: DataFrame, spellings: DataFrame) -> DataFrame:
    """spelling, refused, propositions: what registers each spelling: its name, and :name as an alias, where they are missing.

    A spelling, or the alias, that another predicate has is refused: collision.
    """
    own = resolve_all(live, spellings)
    names = registry(live).select(F.col("predicate").alias("__id"), F.col("name").alias("__name"))
    own = own.join(names, own["id"]["key"] == names["__id"], "left").drop("__id")
    own = own.withColumn("alias", F.concat(F.lit(":"), F.coalesce("__name", "spelling")))
    alias = _spelled(live).groupBy(F.col("spelling").alias("alias")).agg(F.min("id.key").alias("has"), F.count("*").alias("many"))
    df = own.join(alias, "alias", "left")
    taken = F.col("many").isNotNull() & ((F.col("many") > 1) | ~F.col("has").eqNullSafe(F.col("id.key")))
    subject = F.coalesce(F.col("id"), terms.string(F.col("spelling")))
    new = F.array(F.when(F.col("__name").isNull(), _proposition(subject, NAME, F.col("spelling"))), F.when(F.col("many").isNull(), _proposition(subject, ALIAS, F.col("alias"))))
    refused = F.when(F.col("n") > 1, "predicate spelling collision").when(taken, "predicate alias collision")
    return df.select("spelling", refused.alias("refused"), F.when(refused.isNull(), F.filter(new, lambda x: x.isNotNull())).otherwise(F.array().cast(new_type())).alias("propositions"))


def new_type() -> str:
    return f"array<struct<t1:{terms.TERM},t2:{terms.TERM},t3:{terms.TERM}>>"


def renames(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """spelling, new_name, refused, action, t1, t2, t3: what renames predicates (spelling, new_name), the old name kept as an
    alias and :new_name added. One row a proposition; a refused rename, or one that changes nothing, has none.

    A new name, or its alias, that another predicate has is refused.
    """
    spelled = _spelled(live)
    of = lambda c, to: spelled.groupBy(F.col("spelling").alias(c)).agg(F.min("id").alias(to), F.count("*").alias(f"n_{to}"))
    df = wanted.select("spelling", "new_name").distinct().withColumn("colon", F.concat(F.lit(":"), F.col("new_name")))
    df = df.join(of("spelling", "id"), "spelling", "left").join(of("new_name", "named"), "new_name", "left").join(of("colon", "coloned"), "colon", "left")
    names = registry(live).select(F.col("predicate").alias("__id"), F.col("name").alias("old"), F.col("aliases").alias("__aliases"))
    df = df.join(names, df["id"]["key"] == names["__id"], "left")
    other = lambda c: F.col(f"n_{c}").isNotNull() & ((F.col(f"n_{c}") > 1) | ~F.col(f"{c}.key").eqNullSafe(F.col("id.key")))
    refused = F.when(F.col("id").isNull(), "unknown predicate").when(F.col("n_id") > 1, "predicate spelling collision").when(other("named"), "predicate spelling collision").when(other("coloned"), "predicate alias collision")
    act = lambda action, p, v: F.struct(F.lit(action).alias("action"), F.col("id").alias("t1"), terms.literal(p).alias("t2"), terms.string(v).alias("t3"))
    has = lambda v: F.array_contains("__aliases", v)
    steps = F.array(
        F.when(~has(F.col("old")), act("assert", ALIAS, F.col("old"))),
        act("retract", NAME, F.col("old")),
        act("assert", NAME, F.col("new_name")),
        F.when(F.col("coloned").isNull(), act("assert", ALIAS, F.col("colon"))),
    )
    steps = F.when(refused.isNull() & (F.col("old") != F.col("new_name")), F.filter(steps, lambda x: x.isNotNull()))
    return df.select("spelling", "new_name", refused.alias("refused"), F.posexplode_outer(steps).alias("step", "x")).select("spelling", "new_name", "refused", "step", "x.*")


def subjects_named(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, subject: for each wanted name the first subject, in commit order, that has it."""
    df = of_predicate(live, LABEL).select(F.col("t3.s").alias("name"), "t1", "seq", "ord").join(wanted.select("name").distinct(), "name", "left_semi")
    return df.groupBy("name").agg(F.min_by("t1", F.struct("seq", "ord")).alias("subject"))


def replacements(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """place, action, t1, t2, t3: what leaves wanted (t1, t2, t3) the only values of their subjects and predicates: each live
    value retracted, newest first, then the new one asserted; a join, whatever the number of values."""
    keys = wanted.select(F.col("t1.key").alias("__s"), F.col("t2.key").alias("__p")).distinct()
    old = live.join(keys, (live["t1"]["key"] == keys["__s"]) & (live["t2"]["key"] == keys["__p"]), "left_semi")
    old = old.select((-F.col("seq")).alias("a"), (-F.col("ord")).alias("b"), F.lit("retract").alias("action"), "t1", "t2", "t3")
    new = wanted.select(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit("assert").alias("action"), "t1", "t2", "t3")
    return old.unionByName(new).select(F.struct("a", "b").alias("place"), "action", "t1", "t2", "t3")
