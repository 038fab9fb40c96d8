"""Claims: which view selected a claim last decides its verdict; evidence, versions of slots, and what to verify again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_family(view: Column, root: str) -> Column:
    """Whether a view is root or root:agent."""
    return (view == root) | F.startswith(view, F.lit(f"{root}:"))


def verdicts(selections: DataFrame, *, verified: str = "verified", rejected: str = "rejected") -> DataFrame:
    """claim, verdict, seq, view, writer: of selections (claim, view, seq, ord, perhaps writer) the latest by a view of the
    verifying or the rejecting family."""
    said = F.when(in_family(F.col("view"), verified), "verified").when(in_family(F.col("view"), rejected), "rejected")
    df = selections if "writer" in selections.columns else selections.withColumn("writer", F.lit(None).cast("string"))
    df = df.withColumn("verdict", said).where("verdict is not null")
    last = df.groupBy("claim").agg(F.max_by(F.struct("verdict", "seq", "view", "writer"), F.struct("seq", "ord")).alias("x"))
    return last.select("claim", "x.*")


def statuses(claims: DataFrame, selections: DataFrame, evidence: DataFrame, **families: str) -> DataFrame:
    """claim, status of claims (claim, live): superseded unless live, else the verdict, else pending if it has evidence."""
    v = verdicts(selections, **families).select("claim", "verdict")
    e = evidence.select("claim").distinct().withColumn("has", F.lit(True))
    df = claims.join(v, "claim", "left").join(e, "claim", "left")
    return df.select("claim", F.when(~F.col("live"), "superseded").otherwise(F.coalesce("verdict", F.when(F.col("has"), "pending"))).alias("status"))


def verifiers(selections: DataFrame, **families: str) -> DataFrame:
    """claim, by: who verified each claim that is verified now."""
    return verdicts(selections, **families).where("verdict = 'verified'").select("claim", F.col("writer").alias("by"))


def rejections(selections: DataFrame, reasons: DataFrame, **families: str) -> DataFrame:
    """claim, reason, by, seq: of each claim that is rejected now, with its first reason (claim, reason, seq)."""
    first = reasons.groupBy("claim").agg(F.min_by("reason", "seq").alias("reason"))
    v = verdicts(selections, **families).where("verdict = 'rejected'").select("claim", F.col("writer").alias("by"), "seq")
    return v.join(first, "claim", "left").select("claim", "reason", "by", "seq")


def provenance(evidence: DataFrame, attributes: DataFrame) -> DataFrame:
    """claim, node, source, region, fingerprint, world: each claim's evidence (claim, node) with the first value of each
    attribute (node, attribute, value, seq)."""
    # fixed values: what is recorded of a piece of evidence
    names = ("source", "region", "fingerprint", "world")
    own = attributes.where(F.col("attribute").isin(*names)).groupBy("node").agg(*(F.min_by(F.when(F.col("attribute") == n, F.col("value")), F.when(F.col("attribute") == n, F.col("seq"))).alias(n) for n in names))
    return evidence.select("claim", "node").distinct().join(own, "node", "left").select("claim", "node", *names)


def resolved_slots(chain: DataFrame, overlays: DataFrame) -> DataFrame:
    """version, slot, value: what each version sees of overlays (version, slot, value; a null value deletes).

    chain (version, ancestor, distance) lists each version's ancestors, itself at 0; the nearest overlay of a slot wins.
    """
    o = overlays.withColumnRenamed("version", "ancestor").withColumn("gone", F.col("value").isNull())
    seen = chain.join(o, "ancestor").groupBy("version", "slot").agg(F.min_by(F.struct("value", "gone"), "distance").alias("x"))
    return seen.where("not x.gone").select("version", "slot", F.col("x.value").alias("value"))


def chain_slots(overlays: DataFrame) -> DataFrame:
    """version, slot, value: as resolved_slots, of overlays (chain, place, version, slot, value) in linear chains.

    A version sees the last overlay of each slot up to its place; rows are versions times slots of a chain, not pairs.
    """
    versions, slots = overlays.select("chain", "place", "version").distinct(), overlays.select("chain", "slot").distinct()
    o = overlays.select("chain", "version", "slot", F.struct("value").alias("x"))
    upto = Window.partitionBy("chain", "slot").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    seen = versions.join(slots, "chain").join(o, ["chain", "version", "slot"], "left").withColumn("x", F.last("x", ignorenulls=True).over(upto))
    return seen.select("version", "slot", F.col("x.value").alias("value")).where("value is not null")


def changed_slots(slots: DataFrame, steps: DataFrame) -> DataFrame:
    """from, to, slot: for steps (from, to) the slots of the first version that the second lacks or has another value in."""
    a = slots.select(F.col("version").alias("from"), "slot", F.col("value").alias("x"))
    b = slots.select(F.col("version").alias("to"), "slot", F.col("value").alias("y"))
    both = steps.select("from", "to").distinct().join(a, "from").join(b, ["to", "slot"], "left")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("from", "to", "slot")


def to_verify_again(changed: DataFrame, evidence: DataFrame, attributes: DataFrame, selections: DataFrame, live: DataFrame, *, verified: str = "verified") -> DataFrame:
    """from, to, claim: live (claim) claims that a view of the verifying family selects and whose evidence was taken in the
    world `from` out of a slot that changed (from, to, slot)."""
    p = provenance(evidence, attributes).select("claim", F.col("world").alias("from"), F.col("source").alias("slot"))
    picked = selections.where(in_family(F.col("view"), verified)).select("claim")
    return p.join(changed, ["from", "slot"]).join(picked, "claim", "left_semi").join(live.select("claim"), "claim", "left_semi").select("from", "to", "claim").distinct()
