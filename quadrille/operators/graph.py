"""Analyses of a graph of edges (src, dst): reach with depth, dead nodes, degrees, rank correlation, nested pulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..sources.shared import Grown, written


def reach(edges: DataFrame, roots: DataFrame, max_depth: int = 32) -> DataFrame:
    """node, depth: what the roots (node) reach in at most max_depth steps, each at its first visit."""
    first = roots.select("node").distinct().withColumn("depth", F.lit(0))
    seen = Grown(edges.sparkSession, first.schema)
    front = seen.add(first)
    for depth in range(1, max_depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = seen.add(step.join(seen.all().select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
    return seen.all()


def reach_each(edges: DataFrame, roots: DataFrame, max_depth: int = 32) -> DataFrame:
    """root, node, depth: what each root (node) reaches, itself left out unless a cycle leads back to it."""
    e = edges.select("src", "dst").distinct()
    first = roots.select(F.col("node").alias("root")).distinct().join(e, F.col("root") == e["src"]).select("root", F.col("dst").alias("node")).withColumn("depth", F.lit(1))
    seen = Grown(edges.sparkSession, first.schema)
    front = seen.add(first)
    for depth in range(2, max_depth + 1):
        step = front.join(e, front["node"] == e["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = seen.add(step.join(seen.all().select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
    return seen.all()


def blast(edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """callee, caller: the transitive callers of each node over edges (src calls dst), a row each; group by callee for a count,
    a list may be as long as the graph."""
    pairs = reach_each(edges, edges.select(F.col("src").alias("node")), max_depth)
    return pairs.select(F.col("node").alias("callee"), F.col("root").alias("caller"))


def references(calls: DataFrame, definitions: DataFrame, direction: str) -> DataFrame:
    """of, other, file, direction: the calls (caller, callee, file) that lead into definitions (id), out of them, or both."""
    d = definitions.select(F.col("id").alias("of")).distinct()
    ends = {"inbound": ("callee", "caller"), "outbound": ("caller", "callee")}
    if direction not in (*ends, "both"):
        raise QueryError(":invalid-direction", direction)
    parts = [calls.select(F.col(a).alias("of"), F.col(b).alias("other"), "file", F.lit(k).alias("direction")).join(d, "of", "left_semi") for k, (a, b) in ends.items() if direction in (k, "both")]
    return reduce(DataFrame.unionAll, parts)


def occurrences(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """id, kind, owner, file: where each definition (id, file) stands and where it is called, in the order of file and kind."""
    own = definitions.select("id", F.lit("definition").alias("kind"), F.col("id").alias("owner"), "file")
    called = references(calls, definitions, "inbound").select(F.col("of").alias("id"), F.lit("reference").alias("kind"), F.col("other").alias("owner"), "file")
    return own.unionAll(called)


def context(impacts: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """root, node, depth, tokens: of what each root reaches (root, node, depth) the nearest, by depth and name, as long as their
    sizes (node, tokens) fit a budget together. The window holds one root's reach."""
    w = Window.partitionBy("root").orderBy("depth", "node").rowsBetween(Window.unboundedPreceding, 0)
    df = impacts.join(sizes, "node").withColumn("__sum", F.sum("tokens").over(w))
    return df.where(F.col("__sum") <= budget).select("root", "node", "depth", "tokens")


def dead(edges: DataFrame, nodes: DataFrame, roots: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """Nodes that no root reaches."""
    return nodes.select("node").distinct().join(reach(edges, roots, max_depth).select("node"), "node", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out over distinct edges."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(e.select("dst", F.lit(1), F.lit(0)))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def average_rank(df: DataFrame, column: str) -> DataFrame:
    """df with rank_<column>: equal values share the mean of their places. Values are counted first, so ties don't gather; the
    counts are sorted in ranges, and only a sum a range meets in one task."""
    counts = df.groupBy(column).agg(F.count("*").alias("__n")).repartitionByRange(column)
    counts = written(counts.withColumn("__range", F.spark_partition_id()))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.groupBy("__range").agg(F.sum("__n").alias("__all")).withColumn("__before", F.sum("__all").over(upto) - F.col("__all"))
    inside = Window.partitionBy("__range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.join(F.broadcast(sums), "__range").withColumn("__below", F.col("__before") + F.sum("__n").over(inside) - F.col("__n"))
    return df.join(ranks.select(column, (F.col("__below") + (F.col("__n") + 1) / 2).alias(f"rank_{column}")), column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, rho: the correlation of the average ranks."""
    ranked = average_rank(average_rank(df, a), b)
    return ranked.agg(F.corr(f"rank_{a}", f"rank_{b}").alias("rho"))


def resolved_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """caller, callee: a call (file, caller, name) means the definition (file, name, id) of its file, else the only one of that name."""
    d = definitions.select(F.col("file").alias("dfile"), "name", "id").distinct()
    same = calls.join(d, (calls["name"] == d["name"]) & (calls["file"] == d["dfile"])).select("caller", calls["name"].alias("name"), calls["file"].alias("file"), F.col("id").alias("callee"))
    single = d.groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("callee")).where("n = 1")
    rest = calls.join(same.select("file", "name").distinct(), ["file", "name"], "left_anti")
    return same.select("caller", "callee").unionByName(rest.join(single, "name").select("caller", "callee"))


def pull(live: DataFrame, roots: DataFrame, predicates: list[str], depth: int = 2) -> DataFrame:
    """root, depth, node, predicate, value: the propositions of the roots (node: a term's key) and of what they refer to.

    Level by level, each node at its first visit, so cycles end; values are keys of terms.
    """
    edges = live.where(F.col("t2.s").isin(predicates)).select(F.col("t1.key").alias("src"), F.col("t2.s").alias("predicate"), F.col("t3.key").alias("value"))
    front = written(roots.select(F.col("node").alias("root"), "node"))
    seen, out = Grown(live.sparkSession, front.schema), None
    front = seen.add(front)
    for level in range(depth):
        found = written(front.join(edges, front["node"] == edges["src"]).select("root", F.lit(level).alias("depth"), "node", "predicate", "value"))
        out = found if out is None else out.unionByName(found)
        step = found.select("root", F.col("value").alias("node")).distinct()
        front = seen.add(step.join(seen.all(), ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
    return out


def _valid(element) -> bool:
    if isinstance(element, dict):
        return bool(element) and all(isinstance(k, str) and k.strip() and (x == "..." or isinstance(x, int) and not isinstance(x, bool) and x > 0 or isinstance(x, list) and all(map(_valid, x))) for k, x in element.items())
    return isinstance(element, str) and bool(element.strip())


def pull_pattern(live: DataFrame, roots: DataFrame, pattern: list, *, max_depth: int = 5) -> DataFrame:
    """root, path, node, attribute, value, mark: what a pattern asks of the roots (node: a term's key), a row a value.

    live has t1, t2, t3 (and whatever more, kept as is: with seq and ord, or history.with_metadata, that is a value's
    provenance; of an older snapshot, the pull as of then). An element is a predicate; _predicate, its subjects; *, all
    predicates; or {predicate: further} with further a pattern, a number of levels, or "..." for as many as max_depth.
    path (keys of the nodes from the root to node) tells places apart; mark is cycle where the value stands on its own path,
    truncated where a deeper level isn't followed any more, else null. Single values: schema.single_valued(live) first.
    """
    if not isinstance(pattern, list) or not all(map(_valid, pattern)) or max_depth < 1:
        raise QueryError(":invalid-pattern", repr(pattern))
    facts = live.withColumnsRenamed({"t1": "__s", "t2": "__p", "t3": "__o"})
    more = [c for c in facts.columns if c not in ("__s", "__p", "__o")]
    out: list[DataFrame] = []

    def step(front: DataFrame, name: str, deeper: bool, level: int) -> DataFrame:
        """The rows of one attribute, and, if deeper, the nodes that it leads to."""
        back = name.startswith("_")
        here, there = ("__o", "__s") if back else ("__s", "__o")
        wanted = facts if name == "*" else facts.where(F.col("__p.s") == name.removeprefix("_"))
        rows = front.join(wanted, front["node"] == wanted[here]["key"])
        attribute = F.col("__p.s") if name == "*" else F.lit(name)
        value = F.col(there)["key"]
        mark = F.when(F.array_contains("path", value), "cycle").when(F.lit(deeper and level >= max_depth), "truncated") if deeper else F.lit(None).cast("string")
        rows = written(rows.select("root", "path", "node", attribute.alias("attribute"), value.alias("value"), mark.alias("mark"), *more))
        out.append(rows)
        return rows.where("mark is null").select("root", F.concat("path", F.array("value")).alias("path"), F.col("value").alias("node")).distinct()

    def walk(front: DataFrame, elements: list, level: int) -> None:
        for element in elements:
            for name, further in element.items() if isinstance(element, dict) else [(element, None)]:
                below = step(front, name, further is not None, level)
                if isinstance(further, int):
                    further = [{name: further - 1}] if further > 1 else []
                elif further == "...":
                    further = [{name: "..."}]
                if further and level < max_depth and not below.isEmpty():
                    walk(below, further, level + 1)

    walk(roots.select(F.col("node").alias("root"), F.array("node").alias("path"), "node"), pattern, 1)
    return reduce(DataFrame.unionAll, out)


# fixed values: how facts describe a program's nodes
KIND, VALUE, SYMBOL, BINDING_HEADS = "kind", "v", "symbol", ("defn", "definline", "def-", "defonce", "defn-", "def")


def symbols(facts: DataFrame) -> DataFrame:
    """file, node, name: the nodes that are symbols, of facts (file, t1, t2, t3, texts) as tables.read_facts gives them."""
    kinds = facts.where((F.col("t2") == KIND) & (F.col("t3") == SYMBOL)).select("file", F.col("t1").alias("node")).distinct()
    values = facts.where(F.col("t2") == VALUE).select("file", F.col("t1").alias("node"), F.col("t3").alias("name"))
    return values.join(kinds, ["file", "node"], "left_semi")


def module_bindings(facts: DataFrame) -> DataFrame:
    """file, node, name: what each file binds: nodes whose first child is a symbol that binds, by their second child's name."""
    child = lambda field, to: facts.where(F.col("t2") == field).select("file", F.col("t1").alias("node"), F.col("t3").alias(to))
    named = lambda to, name: symbols(facts).select("file", F.col("node").alias(to), F.col("name").alias(name))
    heads = child("f0", "__h").join(named("__h", "__head").where(F.col("__head").isin(*BINDING_HEADS)), ["file", "__h"])
    return heads.join(child("f1", "__c"), ["file", "node"]).join(named("__c", "name"), ["file", "__c"]).select("file", "node", "name").distinct()


def rename_operations(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """file, action, t1, t2, t3: what gives the nodes of targets (file, node, new_name) their new names: each symbol's value
    retracted and the new one asserted; nodes that are no symbols stay, and so do those that have the name."""
    found = symbols(facts).join(targets.select("file", "node", "new_name").distinct(), ["file", "node"]).where("name <> new_name")
    steps = F.array(*(F.struct(F.lit(action).alias("action"), F.col(c).alias("t3")) for action, c in (("retract", "name"), ("assert", "new_name"))))
    return found.select("file", F.col("node").alias("t1"), F.explode(steps).alias("x")).select("file", "x.action", "t1", F.lit(VALUE).alias("t2"), "x.t3")


def name_collisions(definitions: DataFrame) -> DataFrame:
    """name, n_files: names that more than one file defines, of definitions (file, name)."""
    return definitions.groupBy("name").agg(F.count_distinct("file").alias("n_files")).where("n_files > 1")


def collision_precision(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """name, id, n_callers, n_by_name, precision: of definitions (file, name, id) whose name several files define and that have
    callers (caller, callee): how many call it, and how many call any definition of its name."""
    names = name_collisions(definitions).select("name")
    d = definitions.select("name", "id").distinct().join(names, "name", "left_semi")
    each = d.join(calls.select("caller", F.col("callee").alias("id")).distinct(), "id")
    own = each.groupBy("name", "id").agg(F.count("*").alias("n_callers"))
    every = each.groupBy("name").agg(F.count_distinct("caller").alias("n_by_name"))
    return own.join(every, "name").select("name", "id", "n_callers", "n_by_name", (F.col("n_callers") / F.col("n_by_name")).alias("precision"))


def jurisdictions(definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """from_regime, to_regime, n: edges (src, dst) between definitions (id, regime), counted by regime."""
    a, b = definitions.select(F.col("id").alias("src"), F.col("regime").alias("from_regime")), definitions.select(F.col("id").alias("dst"), F.col("regime").alias("to_regime"))
    return edges.join(a, "src").join(b, "dst").groupBy("from_regime", "to_regime").agg(F.count("*").alias("n"))
