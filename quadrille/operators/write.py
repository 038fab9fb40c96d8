"""Writes: transactions against a log's table, with versions, leases and single-valued replacement.

A commit is one appended batch with its own sequence. Only the few propositions that a commit names are looked up.
One writer a space is assumed, as an append to a plain table can't compare and swap; expected_version finds lost races.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import terms
from ..functions.terms import Instant, Keyword, Triple
from ..sources.tables import LOG, append_log, read_log
from . import history

LEASE, EXPIRES = Keyword(":kernel/lease"), Keyword(":kernel/expires-at")
MINT = Keyword(":mint-ordinal")
MAX_BATCH = 247


@dataclass(frozen=True)
class Lease:
    holder: object
    expires_ms: int
    epoch: int


def rows(spark: SparkSession, space: str, seq: int, actions: list[tuple[str, Triple]], first: int = 0) -> DataFrame:
    """The operations of one frame."""
    if not actions:
        return spark.createDataFrame([], LOG)
    # one row with an array of all, exploded: a frame is one small plan
    each = F.array(*(F.struct(F.lit(first + i).alias("ord"), F.lit(a).alias("action"), *(terms.literal(x).alias(f"t{k}") for k, x in enumerate((p.t1, p.t2, p.t3), 1))) for i, (a, p) in enumerate(actions)))
    return spark.range(1).select(F.explode(each).alias("x")).select(F.lit(space).alias("space"), F.lit(seq).cast("bigint").alias("seq"), F.col("x.ord").cast("int").alias("ord"), "x.action", "x.t1", "x.t2", "x.t3")


class Log:
    """A space's log in a table."""

    def __init__(self, spark: SparkSession, path: str, space: str):
        if not space:
            raise QueryError(":rpc/space-mismatch", "a space needs a name")
        self.spark, self.path, self.space = spark, path, space

    def ops(self) -> DataFrame:
        try:
            return read_log(self.spark, self.path).where(F.col("space") == self.space)
        except Exception as e:  # no commit yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], LOG)
            raise

    def version(self) -> int:
        return history.head(self.ops())

    def status(self) -> dict[str, int]:
        return {"version": self.version(), "live": history.live_occurrences(self.ops()).count()}

    def scan(self, t1=None, t2=None, t3=None) -> DataFrame:
        """Live propositions that agree with the given terms, equal ones repeated, in commit order."""
        return history.matching(history.live_occurrences(self.ops()), t1, t2, t3).orderBy("seq", "ord")

    def commit(self, actions: list[tuple[str, Triple]], *, expected_version: int | None = None, subject: str = "any", fence: tuple | None = None, now_ms: int = 0) -> dict:
        """Appends (assert | retract, triple) as one frame; later actions see earlier ones. Returns version and what changed."""
        if not 1 <= len(actions) <= MAX_BATCH:
            raise QueryError(":rpc/batch-size", str(len(actions)))
        ops, version = self.ops(), self.version()
        if expected_version is not None and expected_version != version:
            raise QueryError(":rpc/conflict", f"at {version}, not {expected_version}")
        if fence is not None:
            resource, holder, epoch = fence
            lease = self.lease(resource)
            if lease is None or (lease.holder, lease.epoch) != (holder, epoch) or lease.expires_ms <= now_ms:
                raise QueryError(":rpc/lease-fence-mismatch")
        frame = rows(self.spark, self.space, version + 1, actions)
        named = frame.select("t1").distinct()
        if subject == "existing":
            known = history.live_occurrences(ops).select(F.col("t1.key").alias("k"))
            if not named.join(known, named["t1"]["key"] == known["k"], "left_anti").isEmpty():
                raise QueryError(":rpc/subject-not-found")
        # a retract changes something if the fold over the named propositions' history matches it
        keys = frame.select(*(F.col(f"{t}.key").alias(f"__{t}") for t in ("t1", "t2", "t3"))).distinct()
        past = ops.join(F.broadcast(keys), (ops["t1"]["key"] == keys["__t1"]) & (ops["t2"]["key"] == keys["__t2"]) & (ops["t3"]["key"] == keys["__t3"]), "left_semi")
        fold = history.folded(past.unionByName(frame)).where(F.col("seq") == version + 1)
        changed = [r[0] for r in fold.orderBy("ord").select((F.col("action") == "assert") | F.col("target_seq").isNotNull()).collect()]
        append_log(frame.coalesce(1), self.path)
        return {"version": version + 1, "changed": changed}

    def assert_(self, p: Triple, **how) -> dict:
        return self.commit([("assert", p)], **how)

    def retract(self, p: Triple, **how) -> dict:
        return self.commit([("retract", p)], **how)

    def replace_actions(self, t1, t2, t3) -> list[tuple[str, Triple]]:
        """Actions that leave (t1, t2, t3) the only value: each live one retracted, newest first, then the new asserted."""
        live = self.scan(t1, t2).orderBy(F.desc("seq"), F.desc("ord")).select("t3").collect()
        return [("retract", Triple(t1, t2, python(r["t3"]))) for r in live] + [("assert", Triple(t1, t2, t3))]

    def lease(self, resource) -> Lease | None:
        """The live lease on a resource, its epoch the sequence that made it."""
        x = self.scan(resource, LEASE).orderBy(F.desc("seq"), F.desc("ord")).limit(1).collect()
        if not x:
            return None
        held = parse_key(x[0]["t3"]["key"])
        return Lease(held.t1, held.t3, x[0]["seq"])

    def acquire(self, resource, holder, ttl_ms: int, now_ms: int) -> Lease:
        old = self.lease(resource)
        if old is not None and old.expires_ms > now_ms and old.holder != holder:
            raise QueryError(":rpc/lease-held", repr(old.holder))
        self.commit(self.replace_actions(resource, LEASE, Triple(holder, EXPIRES, now_ms + ttl_ms)))
        return self.lease(resource)

    def renew(self, resource, holder, epoch: int, ttl_ms: int, now_ms: int) -> Lease:
        self.check(resource, holder, epoch, now_ms)
        return self.acquire(resource, holder, ttl_ms, now_ms)

    def release(self, resource, holder, epoch: int) -> None:
        old = self.lease(resource)
        if old is None or (old.holder, old.epoch) != (holder, epoch):
            raise QueryError(":rpc/lease-fence-mismatch")
        self.retract(Triple(resource, LEASE, Triple(old.holder, EXPIRES, old.expires_ms)))

    def check(self, resource, holder, epoch: int, now_ms: int) -> Lease:
        old = self.lease(resource)
        if old is None or (old.holder, old.epoch) != (holder, epoch) or old.expires_ms <= now_ms:
            raise QueryError(":rpc/lease-fence-mismatch")
        return old


def decisions(intents: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """intents with decision: what a commit of each plan's intents does, in the order of index.

    intents has index, predicate, single, base_version, expected_version, live_values (array), expected_value, cycle, and the
    columns by that tell plans apart. conflict: a single value changed since the expected version; cycle; idempotent: one
    of several values is there already; else write. If one intent conflicts or closes a cycle, the plan is refused: the first
    such keeps its decision and the others get refused.
    """
    conflict = F.col("single") & (F.col("base_version") > F.col("expected_version"))
    there = ~F.col("single") & F.array_contains("live_values", F.col("expected_value"))
    own = F.when(F.coalesce(conflict, F.lit(False)), "conflict").when(F.col("cycle"), "cycle").when(F.coalesce(there, F.lit(False)), "idempotent").otherwise("write")
    df = intents.withColumn("decision", own)
    bad = F.when(F.col("decision").isin("conflict", "cycle"), F.col("index"))
    first = df.groupBy(*by).agg(F.min(bad).alias("__first"))
    df = df.join(first, [*by]) if by else df.crossJoin(F.broadcast(first))  # a row
    refused = F.col("__first").isNotNull() & (F.col("index") != F.col("__first"))
    return df.withColumn("decision", F.when(refused, "refused").otherwise(F.col("decision"))).drop("__first")


class Builder:
    """A transaction under construction: mints ids, collects actions, commits once."""

    def __init__(self, log: Log):
        self.log, self.sequence, self.actions, self.minted = log, log.version() + 1, [], 0

    def mint(self) -> Triple:
        self.minted += 1
        return Triple(Triple(self.log.space, history.TX, self.sequence), MINT, self.minted - 1)

    def assert_(self, p: Triple) -> Builder:
        self.actions.append(("assert", p))
        return self

    def retract(self, p: Triple) -> Builder:
        self.actions.append(("retract", p))
        return self

    def replace(self, t1, t2, t3) -> Builder:
        self.actions += self.log.replace_actions(t1, t2, t3)
        return self

    def commit(self) -> dict:
        return self.log.commit(self.actions, expected_version=self.sequence - 1)


def parse_key(key: str):
    """The Python value of a term's key."""
    value, end = _parse(key, 0)
    if end != len(key):
        raise ValueError(f"more than one key: {key!r}")
    return value


def _parse(key: str, at: int):
    kind = key[at]
    if kind in "skt":
        colon = key.index(":", at)
        a, b = colon + 1, colon + 1 + int(key[at + 1 : colon])
        body = key[a:b]
        if kind == "t":
            parts, i = [], 0
            for _ in range(3):
                c = body.index(":", i)
                n = int(body[i:c])
                parts.append(parse_key(body[c + 1 : c + 1 + n]))
                i = c + 1 + n
            return Triple(*parts), b
        return (Keyword(body) if kind == "k" else body), b
    end = key.index(";", at)
    body = key[at + 1 : end]
    if kind == "i":
        return int(body), end + 1
    if kind == "f":
        return float({"Infinity": "inf", "-Infinity": "-inf"}.get(body, body)), end + 1
    if kind == "b":
        return body == "1", end + 1
    if kind == "m":
        s, n = body.split(":")
        return Instant(int(s), int(n)), end + 1
    raise ValueError(f"no key: {key!r}")


def python(term):
    """The Python value of a collected term."""
    return parse_key(term["key"])
