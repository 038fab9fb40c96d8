"""The log of signed operations: liveness, withdrawals, snapshots, scans. All of it windows, filters and joins.

An assert pushes its proposition; a retract withdraws the newest live equal one, or nothing. Per proposition, in the order
of (seq, ord), depth = running sum - min(0, running minimum) is the height of that stack; operations at one level
alternate, so a retract's target is the row before it there, and an assert lives if none follows. A proposition's own
history meets in one task; it is as long as that proposition was toggled, not as the log.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import terms
from ..sources.shared import written

TX, ORDINAL = terms.Keyword(":kernel/tx-sequence"), terms.Keyword(":kernel/op-ordinal")


def proposition(df: DataFrame | None = None) -> Column:
    return terms.triple(F.col("t1"), F.col("t2"), F.col("t3"))


def coordinate(space: Column, seq: Column, ordinal: Column) -> Column:
    """An occurrence's coordinate as a term."""
    return terms.triple(terms.triple(terms.string(space), terms.literal(TX), terms.integer(seq)), terms.literal(ORDINAL), terms.integer(ordinal))


#: Rows with long keys that a task sorts.
TASK_ROWS = 200_000


def _dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by columns so that a task has about TASK_ROWS; left to Spark if that takes no more tasks than there are cores."""
    return df.repartition(-(-rows // TASK_ROWS), *by) if rows > TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism else df


def folded(ops: DataFrame) -> DataFrame:
    """ops with live (asserts only), and target_seq, target_ord of each retract that withdraws something."""
    df = ops.withColumn("__p", terms.triple_key(F.col("t1.key"), F.col("t2.key"), F.col("t3.key")))
    df = _dealt(df, ops.count(), "space", "__p")
    w = Window.partitionBy("space", "__p").orderBy("seq", "ord")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__s", F.sum(F.when(F.col("action") == "assert", 1).otherwise(-1)).over(up))
    df = df.withColumn("__d", F.col("__s") - F.least(F.lit(0), F.min("__s").over(up)))
    above = F.lag("__d").over(w)
    df = df.withColumn("__l", F.when(F.col("action") == "assert", F.col("__d")).when(above > 0, above))
    v = Window.partitionBy("space", "__p", "__l").orderBy("seq", "ord")
    matched = (F.col("action") == "retract") & F.col("__l").isNotNull()
    df = df.withColumn("target_seq", F.when(matched, F.lag("seq").over(v))).withColumn("target_ord", F.when(matched, F.lag("ord").over(v)))
    live = (F.col("action") == "assert") & (F.coalesce(F.lead("action").over(v), F.lit("assert")) != "retract")
    return df.withColumn("live", live).drop("__p", "__s", "__d", "__l")


def live_occurrences(ops: DataFrame) -> DataFrame:
    """One row for each live assertion, equal ones repeated."""
    return folded(ops).where("live").select("space", "seq", "ord", "t1", "t2", "t3")


def live_propositions(ops: DataFrame) -> DataFrame:
    return live_occurrences(ops).select("t1", "t2", "t3")


def withdrawals(ops: DataFrame) -> DataFrame:
    return folded(ops).where("target_seq is not null").select("space", "seq", "ord", "target_seq", "target_ord")


def head(ops: DataFrame) -> int:
    return ops.agg(F.max("seq")).collect()[0][0] or 0


@dataclass(frozen=True)
class Snapshot:
    """What a query sees of a log: up to `upper`, and after `lower`."""

    ops: DataFrame
    upper: int | None = None
    lower: int = 0

    def prefix(self) -> DataFrame:
        return self.ops if self.upper is None else self.ops.where(F.col("seq") <= self.upper)

    def after(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("seq") > self.lower) if self.lower else df

    def live(self) -> DataFrame:
        """Live at the upper bound, asserted after the lower."""
        return self.after(live_occurrences(self.prefix()))

    def triple(self) -> DataFrame:
        """The set of live propositions."""
        return self.live().select("t1", "t2", "t3").distinct()

    def occurrence(self) -> DataFrame:
        ops = self.after(self.prefix())
        return ops.select(coordinate(F.col("space"), F.col("seq"), F.col("ord")).alias("c0"), terms.keyword(F.concat(F.lit(":"), "action")).alias("c1"), proposition().alias("c2"))

    def withdrawal(self) -> DataFrame:
        """(retraction, assertion), by when the retraction happened; its target may lie before the lower bound."""
        w = self.after(withdrawals(self.prefix()))
        return w.select(coordinate(F.col("space"), F.col("seq"), F.col("ord")).alias("c0"), coordinate(F.col("space"), F.col("target_seq"), F.col("target_ord")).alias("c1"))


def current(ops: DataFrame) -> Snapshot:
    return Snapshot(ops)


def as_of(ops: DataFrame, upper: int, last: int | None = None) -> Snapshot:
    if upper < 0 or upper > (head(ops) if last is None else last):
        raise QueryError(":query-invalid-snapshot", f"as of {upper}")
    return Snapshot(ops, upper)


def since(ops: DataFrame, lower: int, upper: int | None = None, last: int | None = None) -> Snapshot:
    last = head(ops) if last is None else last
    if lower < 0 or lower > (last if upper is None else upper) or (upper or 0) > last:
        raise QueryError(":query-invalid-snapshot", f"since {lower} to {upper}")
    return Snapshot(ops, upper, lower)


def matching(df: DataFrame, t1=None, t2=None, t3=None) -> DataFrame:
    """Rows whose slots equal the given terms; None leaves a slot open."""
    for slot, value in (("t1", t1), ("t2", t2), ("t3", t3)):
        if value is not None:
            df = df.where(F.col(slot)["key"] == terms.literal(value)["key"])
    return df


def frames(ops: DataFrame, lower: int, upper: int) -> DataFrame:
    """seq and its operations, for the frames in (lower, upper]."""
    df = ops.where((F.col("seq") > lower) & (F.col("seq") <= upper))
    return df.groupBy("space", "seq").agg(F.sort_array(F.collect_list(F.struct("ord", "action", "t1", "t2", "t3"))).alias("operations"))


def newest(df: DataFrame, *by: str) -> DataFrame:
    """The latest row for each value of the columns."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("seq", "ord")).alias("x")).select(*by, "x.*")


def in_order(ops: DataFrame, *, newest_first: bool = False) -> DataFrame:
    """All operations by (seq, ord)."""
    return ops.orderBy(F.desc("seq"), F.desc("ord")) if newest_first else ops.orderBy("seq", "ord")


def at(ops: DataFrame, places: DataFrame) -> DataFrame:
    """The operations at places (space, seq, ord), with live, whether they are live assertions."""
    return folded(ops).join(places.select("space", "seq", "ord").distinct(), ["space", "seq", "ord"], "left_semi").drop("target_seq", "target_ord")


def subjects(live: DataFrame) -> DataFrame:
    return live.select("t1").distinct()


def withdrawals_between(ops: DataFrame, lower: int, upper: int) -> DataFrame:
    """Retracts in (lower, upper] and what they withdrew, which may lie before."""
    return withdrawals(ops.where(F.col("seq") <= upper)).where(F.col("seq") > lower)


def from_frames(frames: DataFrame) -> DataFrame:
    """The operations of frames (space, seq, operations)."""
    return frames.select("space", "seq", F.inline("operations"))


def receipts(ops: DataFrame) -> DataFrame:
    """space, seq, ord, changed: whether each operation changed what is live; a retract that finds nothing doesn't."""
    return folded(ops).select("space", "seq", "ord", ((F.col("action") == "assert") | F.col("target_seq").isNotNull()).alias("changed"))


def status(ops: DataFrame) -> DataFrame:
    """space, version, live: the last sequence and the number of live occurrences of each space."""
    return folded(ops).groupBy("space").agg(F.max("seq").alias("version"), F.count_if("live").alias("live"))


def withdrawable(ops: DataFrame, targets: DataFrame) -> DataFrame:
    """space, seq, ord, decision of targets (space, seq, ord): ok, or why that very occurrence can't be withdrawn. A retract
    takes the newest live equal proposition, so only that one can be."""
    place = ["space", "seq", "ord"]
    state = folded(ops)
    newest_live = state.where("live").withColumn("__p", proposition()["key"]).groupBy("space", "__p").agg(F.max(F.struct("seq", "ord")).alias("top"))
    known = state.select(*place, "action", "live", proposition()["key"].alias("__p"))
    df = targets.select(*place).distinct().join(known, place, "left").join(newest_live, ["space", "__p"], "left")
    why = (
        F.when(F.col("action").isNull(), "unknown-occurrence")
        .when(F.col("action") != "assert", "not-assertion-occurrence")
        .when(~F.col("live"), "occurrence-not-live")
        .when(F.struct("seq", "ord") != F.col("top"), "withdrawal-target-not-current")
        .otherwise("ok")
    )
    return df.select(*place, why.alias("decision"))


def with_metadata(live: DataFrame) -> DataFrame:
    """Live occurrences with recorded_at and asserted_by (terms): the latest live statement about the occurrence's
    coordinate, else that about its transaction's."""
    names = {"recorded_at": RECORDED_AT, "asserted_by": ASSERTED_BY}
    live = written(live)  # read three times
    rows = live.count()
    keys = {name: terms.literal(predicate)["key"] for name, predicate in names.items()}
    latest = lambda key: F.max_by("t3", F.when(F.col("t2.key") == key, F.struct("seq", "ord")))
    said = live.where(reduce(lambda a, b: a | b, (F.col("t2.key") == key for key in keys.values()))).withColumn("__of", F.col("t1.key"))
    said = _dealt(said, rows, "__of").groupBy("__of").agg(*(latest(key).alias(name) for name, key in keys.items()))
    out = live.withColumn("__c", coordinate(F.col("space"), F.col("seq"), F.col("ord"))["key"])
    out = out.withColumn("__x", terms.triple(terms.string(F.col("space")), terms.literal(TX), terms.integer(F.col("seq")))["key"])
    for column, prefix in (("__c", "__own"), ("__x", "__all")):
        by = said.select(F.col("__of").alias(column), *(F.col(name).alias(f"{prefix}_{name}") for name in names))
        out = _dealt(out, rows, column).join(_dealt(by, rows, column), column, "left")
    return out.select(*live.columns, *(F.coalesce(f"__own_{name}", f"__all_{name}").alias(name) for name in names))


def selections(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """The propositions (t1, t2, t3) that make views select occurrences: of wanted (view, a term, space, seq, ord) those that
    are live and not selected yet."""
    place = ["space", "seq", "ord"]
    there = wanted.select("view", *place).distinct().join(live.select(*place), place, "left_semi")
    new = there.select(F.col("view").alias("t1"), terms.literal(SELECTS).alias("t2"), coordinate(F.col("space"), F.col("seq"), F.col("ord")).alias("t3"))
    old = live.where(F.col("t2.key") == terms.literal(SELECTS)["key"]).select(F.col("t1.key").alias("__v"), F.col("t3.key").alias("__c"))
    return new.join(old, (new["t1"]["key"] == old["__v"]) & (new["t3"]["key"] == old["__c"]), "left_anti")


def staged(ops: DataFrame, more: DataFrame) -> DataFrame:
    """A log with operations that aren't committed yet."""
    return ops.unionByName(more)


# fixed values: statements about coordinates
SUPERSEDES, SELECTS = terms.Keyword(":kernel/supersedes"), terms.Keyword(":kernel/selects")
RECORDED_AT, ASSERTED_BY, SOURCE_FRAME = terms.Keyword(":kernel/recorded-at"), terms.Keyword(":kernel/asserted-by"), terms.Keyword(":kernel/source-frame")


def _coordinates(live: DataFrame) -> DataFrame:
    return live.withColumn("__c", coordinate(F.col("space"), F.col("seq"), F.col("ord"))["key"])


def not_superseded(live: DataFrame) -> DataFrame:
    """Live occurrences without those that a live (new, :kernel/supersedes, old) names as old, by coordinate."""
    hidden = live.where(F.col("t2.key") == terms.literal(SUPERSEDES)["key"]).select(F.col("t3.key").alias("__old"))
    df = _coordinates(live)
    return df.join(hidden, df["__c"] == hidden["__old"], "left_anti").drop("__c")


def view_occurrences(live: DataFrame) -> DataFrame:
    """view (t1's key) and the live occurrences whose coordinates it selects."""
    picks = live.where(F.col("t2.key") == terms.literal(SELECTS)["key"]).select(F.col("t1.key").alias("view"), F.col("t3.key").alias("__p")).distinct()
    df = _coordinates(live)
    return df.join(picks, df["__c"] == picks["__p"]).drop("__c", "__p")


def page(df: DataFrame, limit: int, after: tuple[int, int] | None = None) -> DataFrame:
    """The next rows in commit order behind a place (seq, ord): a keyset, so no page counts the ones before it."""
    if after is not None:
        df = df.where((F.col("seq") > after[0]) | ((F.col("seq") == after[0]) & (F.col("ord") > after[1])))
    return df.orderBy("seq", "ord").limit(limit)
