"""N-gram Jaccard join with a token-group matrix: which documents link, at a threshold num/den, and their components.

1. Documents with equal shingle sets are one class (a 64-bit id of the set); everything below works on classes.
2. All sets are read in one order of tokens: rare ones first by hash, frequent ones last by how frequent they are. Two
   sets that link share a number of tokens within the first part of each (the prefix), so only prefixes are
   exchanged; and what a copy has changed stands first in it.
3. Each class has a sketch: one bit a token, set if an odd number of tokens fall on it. What two sets share cancels
   out, so the bits in which two sketches differ are a lower bound of the tokens in which the sets differ.
4. Similar classes are gathered in groups: those with the same smallest hash (under two hashes in turn) are
   compared with the one among them that has the fewest rare tokens, their leader; who links with a leader joins its group.
   A group's radius is the greatest difference between a member and its leader.
5. The token-group matrix holds (token, group) for each token in the union of a group's prefixes. A class looks up the
   groups whose unions hold its prefix tokens, where places and sizes let the needed overlap be reached. Of these it is
   compared with the leader; where that left the two apart, and the difference to the leader less the radius is
   small enough for a link with a member, the group is opened: first with a member that stands for the group, twice, as a
   link of any two connects all; then with all its members whose sketches let them link.
6. Comparisons are exact intersections of the sets. The links and the groups give the components.

No token is capped or dropped: frequency only decides the order, and any order gives the same links.

Defined results: a null or wordless text has an empty set and no links; a text with fewer words than a shingle is one
shingle; equal sets link, so repeated rows and equal doc_ids are in one component if their sets link; a component of
null doc_ids alone has none. Columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small_enough, written
from .components import connected
from .shingles import mix, shingle_sets

#: Each task counts the tokens of so many at a time and passes on those that occur twice or more (lossy counting: a total
#: is short by one for each such block at most); so many of the most frequent, in at least so many sets, go last.
BLOCK, MAX_FREQUENT, FREQUENT = 2_000_000, 1_000_000, 24
#: Ids that may be broadcast.
MAX_BROADCAST_IDS = 500_000
#: A prefix row holds a set's size and a token's place in one number: the place in so many low bits.
PLACE = 31
#: Members that stand for a group before it is opened to all.
DEPUTIES = 2


def _class_id(s: np.ndarray) -> int:
    return int(mix(mix(s + np.uint64(7)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else 0


def _need(n, num: int, den: int):
    """The least overlap that a set of n tokens needs to link."""
    return -(-num * n // den)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - _need(n, num, den) + 1


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens on each of len(s) bits or more, a power of two, as 64-bit words."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


_KINDS = {"doc_id": "long", "th": "long", "n": "long", "cid": "long", "key0": "long", "key1": "long", "bits": "array<long>", "token": "array<long>", "count": "array<long>"}


def class_sets(docs: DataFrame, size: int, fold_case: bool) -> DataFrame:
    """Rows of two kinds: doc_id, th (the text's hash), n, cid, keys (the least hash under two functions) and the sketch of each document, and token, count,
    lists of a block's repeated tokens."""
    names = list(_KINDS)

    def lists(held: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0] + [len(x) for x in held])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*held, np.zeros(0, np.int64)])))

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        token, count = token[count > 1], count[count > 1]
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(6)), pa.nulls(1, pa.list_(pa.int64())), lists([token.view(np.int64)]), lists([count])], names)

    def run(batches):
        held, m = [], 0
        for batch in batches:
            n, cid, keys, bits = [], [], [], []
            for s in shingle_sets(batch.column("text"), size, fold_case=fold_case):
                n.append(len(s))
                cid.append(_class_id(s))
                keys.append((s[0], mix(s ^ np.uint64(0x5851F42D4C957F2D)).min()) if len(s) else (0, 0))
                bits.append(sketch(s))
                held.append(s)
                m += len(s)
                if m > BLOCK:
                    yield counted(held)
                    held, m = [], 0
            none = pa.nulls(len(n), pa.list_(pa.int64()))
            two = (pa.array(np.array(k, np.uint64).view(np.int64)) for k in (zip(*keys, strict=True) if keys else ((), ())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), *two, lists(bits), none, none], names)
        if held:
            yield counted(held)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in _KINDS.items()))


def _frequent(sets: DataFrame) -> np.ndarray:
    """The most frequent tokens, rarest first; a bounded number."""
    each = sets.where("token is not null").select(F.explode(F.arrays_zip("token", "count")).alias("x")).select("x.*")
    counts = each.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).select("token").toPandas()["token"].to_numpy()
    return top.astype(np.int64)[::-1].copy().view(np.uint64)


def prefixes(docs: DataFrame, size: int, fold_case: bool, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """token, cid, x for the prefix of each set, x its size and the token's place; and a row with -1 - x its rare tokens."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        last = held.value
        rank = np.argsort(last, kind="stable")
        known = last[rank]
        for batch in batches:
            tokens, cids, xs = [], [], []
            for s in shingle_sets(batch.column("text"), size, fold_case=fold_case):
                if not len(s):
                    continue
                p, cid, n = prefix_length(len(s), num, den), _class_id(s), len(s)
                rare = n
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = known[at] == s
                    rare = n - int(often.sum())
                    s = np.concatenate([s[~often], s[often][np.argsort(rank[at[often]])]]) if rare < p else s[~often]
                s = s[:p]
                tokens += [s, mix(np.array([cid], np.int64).view(np.uint64))]
                cids.append(np.full(len(s) + 1, cid, np.int64))
                xs += [(n << PLACE) + np.arange(len(s)), np.array([-1 - rare])]
            if tokens:
                yield pa.RecordBatch.from_pydict({"token": np.concatenate(tokens).view(np.int64), "cid": np.concatenate(cids), "x": np.concatenate(xs).astype(np.int64)})

    return docs.select("text").mapInArrow(run, "token long, cid long, x long")


def _whole_sets(docs: DataFrame, wanted: DataFrame, size: int, fold_case: bool) -> DataFrame:
    """cid, h (all tokens) for the wanted (doc_id, cid)."""

    def run(batches):
        for batch in batches:
            found, ends = [], [0]
            for s in shingle_sets(batch.column("text"), size, fold_case=fold_case):
                found.append(s)
                ends.append(ends[-1] + len(s))
            cids = [_class_id(s) for s in found]
            flat = np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["cid", "h"])

    ids = wanted.select("doc_id").distinct()
    if small_enough(ids, MAX_BROADCAST_IDS):
        ids = F.broadcast(ids)
    ids = ids.withColumnRenamed("doc_id", "__doc")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
    sets = texts.select("text").mapInArrow(run, "cid long, h array<long>")
    return sets.join(wanted.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])


def _differ(x: Column, y: Column) -> Column:
    """A lower bound of the tokens in which two sets differ, by their sketches; the longer is folded to the other's length.

    Sets that can link have sketches of equal lengths or one twice the other; of others nothing is claimed.
    """

    def folded(a, b):
        half = (F.size(a) / 2).cast("int")
        upper = F.slice(a, F.greatest(half, F.lit(1)) + 1, F.greatest(half, F.lit(1)))
        return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, 1, F.greatest(half, F.lit(1))), upper, lambda p, q: p.bitwiseXOR(q))).otherwise(a)

    each = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda s, d: s + d), F.lit(0)).cast("long")


def _close(differ: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """Whether sets of n and m tokens that differ in so many link: shared = (n + m - differ) / 2."""
    return (num + den) * (n + m - differ) >= 2 * num * (n + m)


def _linked(pairs: DataFrame, docs: DataFrame, by_class: DataFrame, size: int, fold_case: bool, num: int, den: int) -> DataFrame:
    """The written pairs (a, b) of classes whose sets link, by the exact intersection of the sets, and differ, the tokens
    that one of the two has."""
    pairs = written(pairs.select("a", "b").distinct())
    wanted = written(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct().join(by_class.select("cid", "doc_id"), "cid"))
    sets = written(_whole_sets(docs, wanted, size, fold_case))
    x, y = sets.select(F.col("cid").alias("a"), F.col("h").alias("x")), sets.select(F.col("cid").alias("b"), F.col("h").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("x", "y")).cast("long"))
    both = both.withColumn("all", F.size("x") + F.size("y") - F.col("both")).where(den * F.col("both") >= num * F.col("all"))
    out = written(both.select("a", "b", (F.col("all") - F.col("both")).alias("differ")))
    forget(pairs, wanted, sets)
    return out


def _fits(n: Column, low: Column, high: Column, num: int, den: int) -> Column:
    """Whether a set of n tokens can link to one of low to high tokens."""
    return (num * n <= den * high) & (num * low <= den * n)


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, label) once more links (a, b) are known."""
    tag = lambda c, to: label.select(F.col("node").alias(c), F.col("label").alias(to))
    between = links.join(tag("a", "x"), "a", "left").join(tag("b", "y"), "b", "left")
    above = connected(between.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    above = above.select(F.col("node").alias("label"), F.col("label").alias("top"))
    known = label.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("node").agg(F.min("label").alias("label"))
    return written(known.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label")))


def classes(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100, fold_case: bool = True) -> DataFrame:
    """doc_id, th (the text's hash), n (tokens), cid (its class), component (the smallest doc_id it reaches) and label (the
    component's own id, null without words) of every row."""
    sets = written(class_sets(docs, size, fold_case))
    frequent = _frequent(sets)
    sets = sets.where("cid is not null").drop("token", "count")
    by_class = written(sets.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("n", "key0", "key1", "bits")).alias("x")).select("cid", "doc_id", "x.*"))
    # one exchange by token serves both the distinct and the count
    held = prefixes(docs, size, fold_case, num, den, frequent).repartition("token").dropDuplicates(["token", "cid"])
    held = written(held.withColumn("k", F.count("*").over(Window.partitionBy("token"))).where("k > 1 or x < 0").drop("k"))
    shared = held.where("x >= 0").select("token", "cid", F.shiftright("x", PLACE).alias("n"), F.col("x").bitwiseAND((1 << PLACE) - 1).alias("pos"))

    able = shared.select("cid").distinct().join(held.where("x < 0").select("cid", (-1 - F.col("x")).alias("rare")), "cid")
    able = written(able.join(by_class.drop("doc_id"), "cid"))  # classes that share a prefix token
    how = (docs, by_class, size, fold_case, num, den)
    bound = lambda radius=0: _close(F.greatest(_differ(F.col("bits"), F.col("others")) - radius, F.lit(0)), F.col("n"), F.col("m"), num, den)

    # groups: all with the same key against the one with the fewest rare tokens
    near = None
    for k in range(2):
        keyed = able.select("cid", "rare", "n", "bits", F.col(f"key{k}").alias("key"))
        leaders = keyed.groupBy("key").agg(F.min_by(F.struct("cid", "n", "bits"), F.struct("rare", "cid")).alias("b"), F.count("*").alias("k")).where("k > 1")
        # written, so that the join reads a plain table: broadcast if it is small, else Spark can split a frequent key
        leaders = written(leaders.select("key", F.col("b.cid").alias("b"), F.col("b.n").alias("m"), F.col("b.bits").alias("others")))
        pairs = keyed.join(leaders, "key").where((F.col("cid") != F.col("b")) & _fits(F.col("n"), F.col("m"), F.col("m"), num, den) & bound())
        pairs = pairs.select(F.col("cid").alias("a"), "b")
        near = pairs if near is None else near.union(pairs)
    near = _linked(near, *how)
    # a leader with followers stays in its own group, others join the nearest of their leaders
    followers = near.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    follows = followers.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("x")).select(F.col("a").alias("__a"), "x.*")
    group = able.join(follows, F.col("cid") == F.col("__a"), "left").select("cid", "n", "bits", F.coalesce("b", "cid").alias("leader"), F.coalesce("differ", F.lit(0)).alias("differ"))
    group = written(group)

    # the matrix, and the groups that each class qualifies for
    placed = written(shared.join(group.select("cid", "leader"), "cid").select("token", "cid", "n", "pos", "leader"))
    matrix = placed.groupBy("token", F.col("leader").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("room"))
    # no token before the first shared one is shared, so n - pos and room bound the overlap there; a pair that no shared
    # token lets reach the needed overlap is out, and the others leave only rows that do
    need = num * (F.col("n") + F.col("low"))
    first = ((num + den) * (F.col("n") - F.col("pos")) >= need) & ((num + den) * F.col("room") >= need)
    found = placed.join(matrix, "token").where((F.col("leader") > F.col("other")) & _fits(F.col("n"), F.col("low"), F.col("high"), num, den) & first)
    found = found.select("cid", "other").distinct()
    # m: the greatest size in the group; the difference to the leader less the radius bounds that to any member
    span = group.groupBy("leader").agg(F.max("n").alias("m"), F.max("differ").alias("radius"), F.count("*").alias("members"))
    span = span.join(group.select(F.col("cid").alias("leader"), F.col("n").alias("of_leader"), F.col("bits").alias("others")), "leader").withColumnRenamed("leader", "other")
    open_ = found.join(group.select("cid", "n", "bits"), "cid").join(span, "other").where(bound(F.col("radius")))
    open_ = written(open_.select("cid", "other", "members", _close(_differ(F.col("bits"), F.col("others")), F.col("n"), F.col("of_leader"), num, den).alias("leads")))
    by_leader = _linked(open_.where("leads").select(F.col("cid").alias("a"), F.col("other").alias("b")), *how)
    forget(held, placed)
    label = connected(near.select("a", "b").union(by_leader.select("a", "b")))

    # groups of several that are still apart
    apart = open_.where("members > 1").select("cid", "other")
    sized = group.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("others"), F.col("leader").alias("other"))
    for turn in range(DEPUTIES + 1):
        tag = lambda c, to: label.select(F.col("node").alias(c), F.col("label").alias(to))  # noqa: E731, B023
        apart = apart.join(tag("cid", "mine"), "cid", "left").join(tag("other", "theirs"), "other", "left")
        apart = written(apart.where(F.coalesce("mine", "cid") != F.coalesce("theirs", "other")).select("cid", "other"))
        if apart.isEmpty():
            break
        members = sized.where("b <> other")
        if turn < DEPUTIES:  # another member each turn
            members = members.groupBy("other").agg(F.min_by(F.struct("b", "m", "others"), F.xxhash64("b", F.lit(turn))).alias("x")).select("other", "x.*")
        mine = apart.join(group.select("cid", "n", "bits"), "cid")
        pairs = mine.join(members, (mine["other"] == members["other"]) & _fits(F.col("n"), F.col("m"), F.col("m"), num, den) & bound())
        label = _merged(label, _linked(pairs.select(F.col("cid").alias("a"), "b"), *how).select("a", "b"))

    smallest = by_class.select("cid", "doc_id").join(label, by_class["cid"] == label["node"], "left").select("cid", "doc_id", F.coalesce("label", "cid").alias("label"))
    of_label = smallest.groupBy("label").agg(F.min("doc_id").alias("component"))
    out = smallest.select("cid", "label").join(of_label, "label").select("cid", "label", "component")
    return sets.select("doc_id", "th", "n", "cid").join(out, "cid", "left").select("doc_id", "th", "n", "cid", F.coalesce("component", "doc_id").alias("component"), "label")
