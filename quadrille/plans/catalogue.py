"""The registered queries of the triple engine, each a plan or an operator over the test tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings, terms
from ..functions.terms import Keyword
from ..operators import claims, graph, history, profile, schema, write
from ..sources.tables import Table, event_log, faults, operations, parse_markdown, read, tagged, to_markdown
from .evaluate import Source, page, run

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# the tables as propositions

_IDS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "documents": "doc_id"}
_REFERENCES = {"o_custkey": "customer", "c_nationkey": "nation", "s_nationkey": "nation", "n_regionkey": "region"}


def facts(spark: SparkSession, sf_dir: str, *wanted: str) -> Source:
    """The propositions of columns, given as table.column; row ids are unique, so no row comes twice."""
    by_table: dict[str, list[str]] = {}
    for x in wanted:
        by_table.setdefault(x.split(".")[0], []).append(x.split(".")[1])
    out = []
    for t, columns in by_table.items():
        row_id = F.concat_ws("-", F.lit("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey") if t == "lineitem" else tagged(t)(F.col(_IDS[t]))
        out.append(Table(read(spark, sf_dir, t), row_id, tuple(columns), {c: tagged(_REFERENCES[c]) for c in columns if c in _REFERENCES}, t in _IDS))
    return Source.from_tables(*out)


def v(name: str) -> dict:
    return {"var": name}


def has(subject, column: str, value) -> dict:
    return {"rel": "triple", "args": [subject, Keyword(f":{column}"), value]}


def rule(name: str, args: list, *body: dict) -> dict:
    return {"head": {"rel": name, "args": args}, "body": list(body)}


def scalars(df: DataFrame, **columns: str) -> DataFrame:
    """name="c0.s": the payload as a plain column."""
    return df.select(*(F.col(x).alias(n) for n, x in columns.items()))


# joins, union, negation


@query("join_kind_title", "select 'orders:' || o_orderkey as order_id, o_totalprice as total from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def flagship(spark, sf_dir):
    plan = {"find": "out", "rules": [rule("out", [v("o"), v("t")], has(v("c"), "c_mktsegment", "BUILDING"), has(v("o"), "o_custkey", v("c")), has(v("o"), "o_totalprice", v("t")))]}
    return scalars(run(plan, facts(spark, sf_dir, "customer.c_mktsegment", "orders.o_custkey", "orders.o_totalprice"), spark), order_id="c0.s", total="c1.f")


@query("join_path", "select c_name as customer, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def join_path(spark, sf_dir):
    plan = {"find": "out", "rules": [rule("out", [v("n"), v("r")], has(v("c"), "c_name", v("n")), has(v("c"), "c_nationkey", v("x")), has(v("x"), "n_regionkey", v("y")), has(v("y"), "r_name", v("r")))]}
    return scalars(run(plan, facts(spark, sf_dir, "customer.c_name", "customer.c_nationkey", "nation.n_regionkey", "region.r_name"), spark), customer="c0.s", region="c1.s")


@query("cross_pairs", "select a.n_name as a, b.r_name as b from nation a, region b")
def cross_pairs(spark, sf_dir):
    plan = {"find": "out", "rules": [rule("out", [v("a"), v("b")], has(v("x"), "n_name", v("a")), has(v("y"), "r_name", v("b")))]}
    return scalars(run(plan, facts(spark, sf_dir, "nation.n_name", "region.r_name"), spark), a="c0.s", b="c1.s")


@query("rule_union", "select c_name as name from customer where c_nationkey = 7 union select s_name from supplier where s_nationkey = 7")
def rule_union(spark, sf_dir):
    plan = {"find": "out", "rules": [rule("out", [v("n")], has(v("x"), "c_nationkey", "nation:7"), has(v("x"), "c_name", v("n"))), rule("out", [v("n")], has(v("x"), "s_nationkey", "nation:7"), has(v("x"), "s_name", v("n")))]}
    return scalars(run(plan, facts(spark, sf_dir, "customer.c_nationkey", "customer.c_name", "supplier.s_nationkey", "supplier.s_name"), spark), name="c0.s")


@query("intersect_rules", "select 'nation:' || c_nationkey as nation from customer where c_mktsegment = 'BUILDING' intersect select 'nation:' || s_nationkey from supplier")
def intersect_rules(spark, sf_dir):
    plan = {
        "find": "both",
        "strata": [
            [rule("a", [v("n")], has(v("x"), "c_mktsegment", "BUILDING"), has(v("x"), "c_nationkey", v("n"))), rule("b", [v("n")], has(v("y"), "s_nationkey", v("n")))],
            [rule("both", [v("n")], {"rel": "a", "args": [v("n")]}, {"rel": "b", "args": [v("n")]})],
        ],
    }
    return scalars(run(plan, facts(spark, sf_dir, "customer.c_mktsegment", "customer.c_nationkey", "supplier.s_nationkey"), spark), nation="c0.s")


@query("negation_except", "select 'customer:' || c_custkey as customer from customer where c_custkey not in (select o_custkey from orders)")
def negation_except(spark, sf_dir):
    plan = {"find": "out", "strata": [[rule("buys", [v("c")], has(v("o"), "o_custkey", v("c")))], [rule("out", [v("c")], has(v("c"), "c_name", v("n")), {"rel": "buys", "args": [v("c")], "neg": True})]]}
    return scalars(run(plan, facts(spark, sf_dir, "orders.o_custkey", "customer.c_name"), spark), customer="c0.s")


@query("self_unify", "select distinct 'lineitem-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as line, l_partkey as k from lineitem where l_partkey = l_suppkey")
def self_unify(spark, sf_dir):
    plan = {
        "find": "out",
        "strata": [
            [rule("pair", [v("l"), v("p"), v("s")], has(v("l"), "l_partkey", v("p")), has(v("l"), "l_suppkey", v("s")))],
            [rule("out", [v("l"), v("x")], {"rel": "pair", "args": [v("l"), v("x"), v("x")]})],
        ],
    }
    return scalars(run(plan, facts(spark, sf_dir, "lineitem.l_partkey", "lineitem.l_suppkey"), spark), line="c0.s", k="c1.i")


@query("theta_join", "select 'part:' || a.p_partkey as a, 'part:' || b.p_partkey as b from part a join part b on a.p_type = b.p_type and a.p_size = b.p_size and a.p_retailprice < b.p_retailprice")
def theta_join(spark, sf_dir):
    body = [has(v(x), c, v(y)) for x, c, y in (("a", "p_type", "t"), ("a", "p_size", "s"), ("a", "p_retailprice", "p"), ("b", "p_type", "t"), ("b", "p_size", "s"), ("b", "p_retailprice", "q"))]
    plan = {"find": "out", "rules": [rule("out", [v("a"), v("b")], *body, {"pred": "lt", "args": [v("p"), v("q")]})]}
    return scalars(run(plan, facts(spark, sf_dir, "part.p_type", "part.p_size", "part.p_retailprice"), spark), a="c0.s", b="c1.s")


# comparisons and arithmetic


def _compared(op: str) -> Query:
    def q(spark, sf_dir):
        plan = {"find": "out", "rules": [rule("out", [v("p"), v("s")], has(v("p"), "p_size", v("s")), {"pred": op, "args": [v("s"), 25]})]}
        return scalars(run(plan, facts(spark, sf_dir, "part.p_size"), spark), part="c0.s", size="c1.i")

    return q


for _op, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    query(f"cmp_{_op}", f"select 'part:' || p_partkey as part, p_size::bigint as size from part where p_size {_sign} 25")(_compared(_op))


def _computed(op: str, payload: str) -> Query:
    def q(spark, sf_dir):
        body = [has(v("p"), "p_size", v("s")), {"fn": "-", "args": [v("s"), 20], "bind": "d"}, {"fn": op, "args": [v("d"), 7], "bind": "x"}, {"fn": op, "args": [7, v("d")], "bind": "y"}]
        plan = {"find": "out", "rules": [rule("out", [v("p"), v("x"), v("y")], *body)]}
        return scalars(run(plan, facts(spark, sf_dir, "part.p_size"), spark), part="c0.s", x=f"c1.{payload}", y=f"c2.{payload}")

    return q


_D = "(p_size - 20)::bigint"
for _name, _op, _payload, _x, _y, _keep in (
    ("add", "+", "i", f"{_D} + 7", f"7 + {_D}", "true"),
    ("sub", "-", "i", f"{_D} - 7", f"7 - {_D}", "true"),
    ("mul", "*", "i", f"{_D} * 7", f"7 * {_D}", "true"),
    ("div", "/", "f", f"{_D}::double / 7", f"7::double / {_D}", "p_size <> 20"),
    ("mod", "mod", "i", f"(({_D} % 7) + 7) % 7", f"((7 % {_D}) + {_D}) % {_D}", "p_size <> 20"),
):
    query(f"arith_{_name}", f"select 'part:' || p_partkey as part, {_x} as x, {_y} as y from part where {_keep}")(_computed(_op, _payload))


@query("arith_chain", "select 'part:' || p_partkey as part, (p_size * 2 + p_partkey)::bigint as x from part where p_size * 2 + p_partkey > 500")
def arith_chain(spark, sf_dir):
    source = facts(spark, sf_dir, "part.p_size", "part.p_partkey")
    body = [has(v("p"), "p_size", v("s")), has(v("p"), "p_partkey", v("k")), {"fn": "*", "args": [v("s"), 2], "bind": "d"}, {"fn": "+", "args": [v("d"), v("k")], "bind": "x"}, {"pred": "gt", "args": [v("x"), 500]}]
    return scalars(run({"find": "out", "rules": [rule("out", [v("p"), v("x")], *body)]}, source, spark), part="c0.s", x="c1.i")


# aggregates, order, limit

_BRAND = [rule("sized", [v("b"), v("p"), v("s")], has(v("p"), "p_brand", v("b")), has(v("p"), "p_size", v("s")))]


def _aggregate(agg: list[dict], group=(0,), **more) -> dict:
    return {"find": {"rel": "sized", "group": list(group), "agg": agg, **more}, "rules": _BRAND}


def _aggregated(op: str, payload: str) -> Query:
    def q(spark, sf_dir):
        agg = {"op": op} if op == "count" else {"op": op, "arg": 2}
        return scalars(run(_aggregate([agg]), facts(spark, sf_dir, "part.p_brand", "part.p_size"), spark), brand="c0.s", x=f"c1.{payload}")

    return q


for _op, _payload, _x in (("count", "i", "count(*)"), ("count-distinct", "i", "count(distinct p_size)"), ("sum", "i", "sum(p_size)::bigint"), ("avg", "f", "sum(p_size)::double / count(*)"), ("min", "i", "min(p_size)::bigint"), ("max", "i", "max(p_size)::bigint")):
    query(f"agg_{_op.replace('-', '_')}", f"select p_brand as brand, {_x} as x from part group by 1")(_aggregated(_op, _payload))


@query("agg_having", "select p_brand as brand, count(*) as n, sum(p_size)::bigint as total from part group by 1 having count(*) >= 80 and sum(p_size) < 2300")
def agg_having(spark, sf_dir):
    plan = _aggregate([{"op": "count"}, {"op": "sum", "arg": 2}], having=[{"op": "ge", "agg": 0, "val": 80}, {"op": "lt", "agg": 1, "val": 2300}])
    return scalars(run(plan, facts(spark, sf_dir, "part.p_brand", "part.p_size"), spark), brand="c0.s", n="c1.i", total="c2.i")


@query("agg_global", "select count(*) as n, min(p_size)::bigint as low, max(p_size)::bigint as high from part")
def agg_global(spark, sf_dir):
    plan = _aggregate([{"op": "count"}, {"op": "min", "arg": 2}, {"op": "max", "arg": 2}], group=())
    return scalars(run(plan, facts(spark, sf_dir, "part.p_brand", "part.p_size"), spark), n="c0.i", low="c1.i", high="c2.i")


@query("agg_empty", "select count(*) as n from part where p_size < 0 having count(*) > 0")
def agg_empty(spark, sf_dir):
    plan = {"find": {"rel": "none", "group": [], "agg": [{"op": "count"}]}, "rules": [rule("none", [v("p")], has(v("p"), "p_size", v("s")), {"pred": "lt", "args": [v("s"), 0]})]}
    return scalars(run(plan, facts(spark, sf_dir, "part.p_size"), spark), n="c0.i")


@query("agg_topk", "select p_brand as brand, sum(p_size)::bigint as total from part group by 1 order by 2 desc, 1 limit 5")
def agg_topk(spark, sf_dir):
    plan = _aggregate([{"op": "sum", "arg": 2}]) | {"order-by": [{"column": 1, "direction": "desc"}, {"column": 0, "direction": "asc"}], "limit": 5}
    return scalars(run(plan, facts(spark, sf_dir, "part.p_brand", "part.p_size"), spark), brand="c0.s", total="c1.i")


@query("agg_join_lines", "select o_orderpriority as priority, count(*) as n, sum(l_quantity) as quantity from orders join (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem) on l_orderkey = o_orderkey group by 1")
def agg_join_lines(spark, sf_dir):
    """The line's order as a reference, so that lines join their orders; quantities are whole, so sums are exact."""
    row_id = F.concat_ws("-", F.lit("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = Table(read(spark, sf_dir, "lineitem"), row_id, ("l_orderkey", "l_quantity"), {"l_orderkey": tagged("orders")})
    source = Source.from_tables(lines, *facts(spark, sf_dir, "orders.o_orderpriority").tables)
    body = [has(v("l"), "l_orderkey", v("o")), has(v("l"), "l_quantity", v("q")), has(v("o"), "o_orderpriority", v("p"))]
    plan = {"find": {"rel": "out", "group": [0], "agg": [{"op": "count"}, {"op": "sum", "arg": 2}]}, "rules": [rule("out", [v("p"), v("l"), v("q")], *body)]}
    return scalars(run(plan, source, spark), priority="c0.s", n="c1.i", quantity="c2.f")


@query("order_topk", "select 'orders:' || o_orderkey as order_id, o_totalprice as total from orders order by o_totalprice desc, o_orderkey limit 10")
def order_topk(spark, sf_dir):
    plan = {"find": "out", "rules": [rule("out", [v("o"), v("t")], has(v("o"), "o_totalprice", v("t")))], "order-by": [{"column": 1, "direction": "desc"}], "limit": 10}
    return scalars(run(plan, facts(spark, sf_dir, "orders.o_totalprice"), spark), order_id="c0.s", total="c1.f")


@query("order_mixed", "select p_brand as brand, p_size::bigint as size, 'part:' || p_partkey as part from part order by p_brand desc, p_size, 3 limit 50")
def order_mixed(spark, sf_dir):
    order = [{"column": 0, "direction": "desc"}, {"column": 2, "direction": "asc"}, {"column": 1, "direction": "asc"}]
    return scalars(run({"find": "sized", "rules": _BRAND, "order-by": order, "limit": 50}, facts(spark, sf_dir, "part.p_brand", "part.p_size"), spark), brand="c0.s", size="c2.i", part="c1.s")


# recursion

_EDGE_SQL = "select distinct user_id as src, cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as bigint) % 15 as dst from events"


def _edges(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.get_json_object("props", "$.k").cast("bigint") % 15).alias("dst")).distinct()


def _edge_facts(spark, sf_dir) -> Source:
    e = _edges(spark, sf_dir)
    return Source(e.select(terms.integer(F.col("src")).alias("t1"), terms.literal(Keyword(":edge")).alias("t2"), terms.integer(F.col("dst")).alias("t3")), distinct=True)


@query("closure_users", f"with recursive e as ({_EDGE_SQL}), r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst) select src, dst from r where src <> dst")
def closure_users(spark, sf_dir):
    """Linear recursion over a graph with cycles."""
    rules = [rule("reach", [v("a"), v("b")], has(v("a"), "edge", v("b"))), rule("reach", [v("a"), v("c")], {"rel": "reach", "args": [v("a"), v("b")]}, has(v("b"), "edge", v("c")))]
    plan = {"find": "out", "strata": [rules, [rule("out", [v("a"), v("b")], {"rel": "reach", "args": [v("a"), v("b")]}, {"pred": "ne", "args": [v("a"), v("b")]})]]}
    return scalars(run(plan, _edge_facts(spark, sf_dir), spark), src="c0.i", dst="c1.i")


@query("closure_nonlinear", f"with recursive e as ({_EDGE_SQL}), r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst) select src, dst from r")
def closure_nonlinear(spark, sf_dir):
    reach = lambda a, b: {"rel": "reach", "args": [v(a), v(b)]}
    rules = [rule("reach", [v("a"), v("b")], has(v("a"), "edge", v("b"))), rule("reach", [v("a"), v("c")], reach("a", "b"), reach("b", "c"))]
    return scalars(run({"find": "reach", "rules": rules}, _edge_facts(spark, sf_dir), spark), src="c0.i", dst="c1.i")


@query("reach_region", "select 'customer:' || c_custkey as a, 'region:' || n_regionkey as b from customer join nation on c_nationkey = n_nationkey union all select 'customer:' || c_custkey, 'nation:' || c_nationkey from customer union all select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation")
def reach_region(spark, sf_dir):
    up = lambda a, b: {"rel": "up", "args": [v(a), v(b)]}
    first = [rule("up", [v("a"), v("b")], has(v("a"), c, v("b"))) for c in ("c_nationkey", "n_regionkey")]
    plan = {"find": "within", "strata": [first, [rule("within", [v("a"), v("b")], up("a", "b")), rule("within", [v("a"), v("c")], {"rel": "within", "args": [v("a"), v("b")]}, up("b", "c"))]]}
    return scalars(run(plan, facts(spark, sf_dir, "customer.c_nationkey", "nation.n_regionkey"), spark), a="c0.s", b="c1.s")


@query("dead_nodes", f"with recursive e as ({_EDGE_SQL}), n as (select src as node from e union select dst from e), r as (select 0::bigint as node union select e.dst from r join e on e.src = r.node where e.dst <= r.node + 2) select node from n where node not in (select node from r)")
def dead_nodes(spark, sf_dir):
    """Nodes that node 0 doesn't reach over edges that rise by two at most."""
    e = _edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    roots = spark.range(1).select(F.lit(0).cast("bigint").alias("node"))
    return graph.dead(e.where("dst <= src + 2"), nodes, roots)


@query("bfs_depth", f"with recursive e as ({_EDGE_SQL}), r as (select 0::bigint as node, 0 as depth union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 6 and e.dst <= r.node + 3) select node, min(depth) as depth from r group by 1")
def bfs_depth(spark, sf_dir):
    roots = spark.range(1).select(F.lit(0).cast("bigint").alias("node"))
    return graph.reach(_edges(spark, sf_dir).where("dst <= src + 3"), roots, 6)


@query("degrees", f"with e as ({_EDGE_SQL}) select node, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out from (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by 1")
def degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(
    "spearman_degree",
    "with d as (select o_custkey as k, count(*) as n, count(distinct o_orderpriority) as m from orders group by 1), r as (select rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0 as a, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2.0 as b from d) select round(corr(a, b), 9) as rho from r",
)
def spearman_degree(spark, sf_dir):
    d = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("m"))
    return graph.spearman(d, "n", "m").select(F.round("rho", 9).alias("rho"))


# history

_OPS = """with ops as (select event_id + 1 as seq, case when event_type = 'error' then 'retract' else 'assert' end as action, user_id as u,
  cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint) % 8 as k from events {where}),
a as (select *, sum(case when action = 'assert' then 1 else -1 end) over (partition by u, k order by seq) as s from ops),
b as (select *, s - least(0, min(s) over (partition by u, k order by seq rows unbounded preceding)) as d from a),
c as (select *, case when action = 'assert' then d else nullif(lag(d) over (partition by u, k order by seq), 0) end as l from b),
f as (select *, case when action = 'retract' and l is not null then lag(seq) over w end as target, action = 'assert' and coalesce(lead(action) over w, 'assert') <> 'retract' as live
  from c window w as (partition by u, k, l order by seq)) """


def _plain(df: DataFrame) -> DataFrame:
    return df.select("seq", F.col("t1.i").alias("u"), F.col("t3.i").alias("k"))


@query("ops_live", _OPS.format(where="") + "select seq, u, k from f where live")
def ops_live(spark, sf_dir):
    return _plain(history.live_occurrences(event_log(spark, sf_dir)))


@query("ops_live_asof", _OPS.format(where="where event_id + 1 <= 700") + "select seq, u, k from f where live")
def ops_live_asof(spark, sf_dir):
    return _plain(history.as_of(event_log(spark, sf_dir), 700).live())


@query("ops_since", _OPS.format(where="where event_id + 1 <= 900") + "select distinct u, k from f where live and seq > 400")
def ops_since(spark, sf_dir):
    """What is live at 900 and was asserted after 400, as a set, by a plan."""
    plan = {"find": "out", "rules": [rule("out", [v("u"), v("k")], has(v("u"), "did", v("k")))]}
    return scalars(run(plan, history.since(event_log(spark, sf_dir), 400, 900), spark), u="c0.i", k="c1.i")


@query("ops_withdrawals", _OPS.format(where="") + "select seq, target as target_seq from f where target is not null")
def ops_withdrawals(spark, sf_dir):
    return history.withdrawals(event_log(spark, sf_dir)).select("seq", "target_seq")


@query("ops_withdrawn_by_plan", _OPS.format(where="") + "select g.u, g.k, count(*) as n from f join f g on f.target = g.seq group by 1, 2")
def ops_withdrawn_by_plan(spark, sf_dir):
    """withdrawal joined with occurrence on coordinates, counted by what was withdrawn."""
    log = event_log(spark, sf_dir)
    body = [{"rel": "withdrawal", "args": [v("r"), v("a")]}, {"rel": "occurrence", "args": [v("a"), Keyword(":assert"), v("p")]}]
    plan = {"find": {"rel": "out", "group": [1], "agg": [{"op": "count"}]}, "rules": [rule("out", [v("r"), v("p")], *body)]}
    found = run(plan, history.current(log), spark)
    props = log.select(history.proposition()["key"].alias("key"), F.col("t1.i").alias("u"), F.col("t3.i").alias("k")).distinct()
    return found.join(props, found["c0"]["key"] == props["key"]).select("u", "k", F.col("c1.i").alias("n"))


@query("scan_t2", _OPS.format(where="") + "select u, k from f where live")
def scan_t2(spark, sf_dir):
    return _plain(history.matching(history.live_occurrences(event_log(spark, sf_dir)), t2=Keyword(":did"))).drop("seq")


@query("scan_t12", _OPS.format(where="") + "select seq, k from f where live and u = 3")
def scan_t12(spark, sf_dir):
    return _plain(history.matching(history.live_occurrences(event_log(spark, sf_dir)), t1=3, t2=Keyword(":did"))).drop("u")


@query("scan_t23", _OPS.format(where="") + "select seq, u from f where live and k = 5")
def scan_t23(spark, sf_dir):
    return _plain(history.matching(history.live_occurrences(event_log(spark, sf_dir)), t2=Keyword(":did"), t3=5)).drop("k")


@query("frames_between", "select event_id + 1 as seq, 1 as n from events where event_id + 1 > 100 and event_id + 1 <= 300")
def frames_between(spark, sf_dir):
    return history.frames(event_log(spark, sf_dir), 100, 300).select("seq", F.size("operations").alias("n"))


@query("lookup_single", _OPS.format(where="") + "select u, arg_max(k, seq) as k from f where live group by 1")
def lookup_single(spark, sf_dir):
    """A single-valued reading: the newest live value of each subject."""
    return history.newest(history.live_occurrences(event_log(spark, sf_dir)), "t1", "t2").select(F.col("t1.i").alias("u"), F.col("t3.i").alias("k"))


@query("rename_predicate", "select 'part:' || p_partkey as part, p_size::bigint as size from part")
def rename_predicate(spark, sf_dir):
    """Values found by a predicate's alias, through the registry."""
    p = read(spark, sf_dir, "part")
    own = operations(p, "s", F.col("p_partkey") + 10, F.lit(0), F.lit("assert"), terms.string(tagged("part")(F.col("p_partkey"))), terms.literal("p1"), terms.integer(F.col("p_size")))
    names = spark.createDataFrame([(1, "p1", schema.NAME, "p_size"), (2, "p1", schema.ALIAS, "size"), (3, "p1", schema.CARDINALITY, "single")], "seq long, a string, b string, c string")
    named = operations(names, "s", F.col("seq"), F.lit(0), F.lit("assert"), terms.string(F.col("a")), terms.string(F.col("b")), terms.string(F.col("c")))
    live = history.live_occurrences(own.unionByName(named))
    return schema.lookup(live, schema.resolved(live, "size")).select(F.col("t1.s").alias("part"), F.col("t3.i").alias("size"))


@query("lease_current", "select 'res:' || (event_id % 11) as resource, arg_max(user_id, event_id) as holder, max(event_id) + 1 as epoch from events group by 1")
def lease_current(spark, sf_dir):
    """The holder of each resource's latest lease, its epoch the sequence."""
    e = read(spark, sf_dir, "events")
    log = operations(e, "s", F.col("event_id") + 1, F.lit(0), F.lit("assert"), terms.string(F.concat(F.lit("res:"), (F.col("event_id") % 11).cast("string"))), terms.literal(Keyword(":kernel/lease")), terms.integer(F.col("user_id")))
    return history.newest(log, "t1").select(F.col("t1.s").alias("resource"), F.col("t3.i").alias("holder"), F.col("seq").alias("epoch"))


@query("claims_verdict", "select doc_id % 50 as claim, case when arg_max(quality, doc_id) = 1 then 'verified' else 'rejected' end as verdict from labels group by 1")
def claims_verdict(spark, sf_dir):
    """Labels as selections of a claim by two views; the last one decides."""
    view = F.when(F.col("quality") == 1, "verified").otherwise("rejected")
    picks = read(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("claim"), view.alias("view"), F.col("doc_id").alias("seq"), F.lit(0).alias("ord"))
    return claims.verdicts(picks).select("claim", "verdict")


@query("lint_profile", "select 'part:' || p_partkey as part, 'R3' as rule from part where p_size <= 5 union all select 'part:' || p_partkey, 'R2' from part where p_size > 45")
def lint_profile(spark, sf_dir):
    """Small parts get an empty predicate, large ones a number for a subject."""
    p = read(spark, sf_dir, "part")
    row_id = tagged("part")(F.col("p_partkey"))
    t1 = F.when(F.col("p_size") > 45, terms.integer(F.col("p_partkey"))).otherwise(terms.string(row_id))
    t2 = F.when(F.col("p_size") <= 5, terms.literal("")).otherwise(terms.literal("size"))
    found = profile.lint(p.select(t1.alias("t1"), t2.alias("t2"), terms.integer(F.col("p_size")).alias("t3")))
    return found.select(F.coalesce("t1.s", F.concat(F.lit("part:"), F.col("t1.i").cast("string"))).alias("part"), "rule")


@query("pull_nested", "select 'customer:' || c_custkey as root, 0 as depth, 'c_nationkey' as predicate from customer union all select 'customer:' || c_custkey, 1, 'n_regionkey' from customer")
def pull_nested(spark, sf_dir):
    source = facts(spark, sf_dir, "customer.c_nationkey", "nation.n_regionkey").of
    roots = read(spark, sf_dir, "customer").select(terms.string(tagged("customer")(F.col("c_custkey")))["key"].alias("node"))
    out = graph.pull(source, roots, [":c_nationkey", ":n_regionkey"], 3)
    return out.select(F.regexp_extract("root", r"^s\d+:(.*)$", 1).alias("root"), "depth", F.substring("predicate", 2, 100).alias("predicate"))


@query("call_resolution", "select 'customer:' || c_custkey as caller, 'nation:' || c_nationkey as callee from customer where c_nationkey <> 3 or c_custkey % 2 = 0")
def call_resolution(spark, sf_dir):
    """A name defined in the caller's file wins; else the only definition; nation 3 is defined in both files, customers with even keys in the first."""
    n = read(spark, sf_dir, "nation").select(F.lit("f0").alias("file"), F.col("n_name").alias("name"), tagged("nation")(F.col("n_nationkey")).alias("id"))
    twice = n.where("id = 'nation:3'")
    definitions = n.unionAll(twice.select(F.lit("f9"), "name", F.lit("nation:other")))
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    file = F.when(F.col("c_custkey") % 2 == 0, "f0").otherwise("f1")
    return graph.resolved_calls(c.select(file.alias("file"), tagged("customer")(F.col("c_custkey")).alias("caller"), F.col("n_name").alias("name")), definitions)


def _marks(spark, sf_dir, predicate: Keyword, t1: Column, where: str = "true") -> DataFrame:
    """Statements, in a space of their own, about the coordinates of the events (seq) for which where holds."""
    e = read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq")).where(where)
    return operations(e, "marks", F.col("seq"), F.lit(0), F.lit("assert"), t1, terms.literal(predicate), history.coordinate(F.lit("events"), F.col("seq"), F.lit(0)))


@query("superseded_view", _OPS.format(where="") + "select seq, u, k from f where live and seq % 2 = 0")
def superseded_view(spark, sf_dir):
    """All odd occurrences are superseded."""
    log = event_log(spark, sf_dir).unionByName(_marks(spark, sf_dir, history.SUPERSEDES, terms.literal("new"), "seq % 2 = 1"))
    return _plain(history.not_superseded(history.live_occurrences(log)).where("space = 'events'"))


@query("view_occurrences", _OPS.format(where="") + "select 'v' || (seq % 2) as view, seq from f where live")
def view_occurrences(spark, sf_dir):
    """All occurrences are selected, by two views."""
    view = terms.string(F.concat(F.lit("v"), (F.col("seq") % 2).cast("string")))
    out = history.view_occurrences(history.live_occurrences(event_log(spark, sf_dir).unionByName(_marks(spark, sf_dir, history.SELECTS, view))))
    return out.select(F.regexp_extract("view", "^s[0-9]+:(.*)$", 1).alias("view"), "seq")


@query("scan_page", _OPS.format(where="") + "select seq, u, k from f where live and seq > 300 order by seq limit 50")
def scan_page(spark, sf_dir):
    return _plain(history.page(history.live_occurrences(event_log(spark, sf_dir)), 50, (300, 0)))


@query("name_collisions", "select p_brand as name, count(distinct p_type) as n_files from part group by 1 having count(distinct p_type) > 1")
def name_collisions(spark, sf_dir):
    return graph.name_collisions(read(spark, sf_dir, "part").select(F.col("p_type").alias("file"), F.col("p_brand").alias("name")))


@query("jurisdictions", "select a.n_regionkey as from_regime, b.n_regionkey as to_regime, count(*) as n from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join nation a on a.n_nationkey = c_nationkey join nation b on b.n_nationkey = s_nationkey group by 1, 2")
def jurisdictions(spark, sf_dir):
    """Lines as edges from customers to suppliers, counted by region."""
    regime = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("regime"))
    c = read(spark, sf_dir, "customer").select(tagged("customer")(F.col("c_custkey")).alias("id"), F.col("c_nationkey").alias("k"))
    s = read(spark, sf_dir, "supplier").select(tagged("supplier")(F.col("s_suppkey")).alias("id"), F.col("s_nationkey").alias("k"))
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.select(tagged("customer")(F.col("o_custkey")).alias("src"), tagged("supplier")(F.col("l_suppkey")).alias("dst"))
    return graph.jurisdictions(c.union(s).join(regime, "k").select("id", "regime"), edges)


_DAILY = """with e as (select event_id, user_id, cast(ts as date) as day, 's' || (cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint) % 8) as slot from events),
s as (select distinct user_id, day, slot from e),
g as (select a.event_id, s.slot, last_value(b.event_id ignore nulls) over (partition by a.user_id, a.day, s.slot order by a.event_id rows unbounded preceding) as value
  from e a join s on a.user_id is not distinct from s.user_id and a.day is not distinct from s.day left join e b on b.event_id = a.event_id and b.slot = s.slot)
select 'v' || event_id as version, slot, value from g where value % 5 <> 0"""


@query("resolved_slots", _DAILY)
def resolved_slots(spark, sf_dir):
    """Each user's events of a day as a chain of versions, each of which sets a slot; every fifth deletes it."""
    return claims.chain_slots(_versions(spark, sf_dir))


def _versions(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    slot = F.concat(F.lit("s"), (F.get_json_object("props", "$.k").cast("bigint") % 8).cast("string"))
    version, value = F.concat(F.lit("v"), F.col("event_id").cast("string")), F.when(F.col("event_id") % 5 != 0, F.col("event_id"))
    chain = F.to_json(F.struct("user_id", F.to_date("ts").alias("day")))
    return e.select(chain.alias("chain"), F.col("event_id").alias("place"), version.alias("version"), slot.alias("slot"), value.alias("value"))


@query(
    "changed_slots",
    _DAILY[: _DAILY.index("select 'v'")].rstrip()
    + """,
r as (select event_id, slot, value from g where value % 5 <> 0), n as (select event_id, lead(event_id) over (partition by user_id, day order by event_id) as next from e)
select 'v' || n.event_id as "from", 'v' || n.next as "to", a.slot from n join r a on a.event_id = n.event_id left join r b on b.event_id = n.next and b.slot = a.slot
where n.next is not null and a.value is distinct from b.value""",
)
def changed_slots(spark, sf_dir):
    """What each version's successor in its chain has changed or deleted."""
    v = _versions(spark, sf_dir)
    steps = v.select(F.col("version").alias("from"), F.lead("version").over(Window.partitionBy("chain").orderBy("place")).alias("to")).where("`to` is not null")
    return claims.changed_slots(claims.chain_slots(v), steps)


# text


def _documents(spark, sf_dir) -> Source:
    return facts(spark, sf_dir, "documents.text", "documents.lang")


def _text(relation: str, needle: str, *rest) -> Query:
    def q(spark, sf_dir):
        args = [v("d"), Keyword(":text"), needle, *(v(x) for x in rest)]
        out = run({"find": "out", "rules": [rule("out", [v("d"), *(v(x) for x in rest)], {"rel": relation, "args": args})]}, _documents(spark, sf_dir), spark)
        return scalars(out, doc="c0.s", **{x: f"c{k}.i" for k, x in enumerate(rest, 1)})

    return q


_TOKENS = r"list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{Nd}]+'), lambda x: x <> ''), lambda x: lower(x))"
_HIT = "select 'documents:' || doc_id as doc from documents where "
query("text_match", _HIT + f"list_has_all({_TOKENS}, ['reou', 'the'])")(_text("text-match", "The, reou"))
query("text_phrase", _HIT + f"contains('|' || array_to_string({_TOKENS}, '|') || '|', '|of|the|')")(_text("text-phrase", "of the"))
query("text_substring", _HIT + "contains(lower(text), 'tion. th')")(_text("text-substring", "tion. Th"))
query("text_missing", _HIT + "false")(_text("text-match", "zzyzx quux"))
_STEMS = f"""with t as (select doc_id, text, {_TOKENS} as ws from documents), w as (select doc_id, unnest(ws) as w from t),
d as (select distinct w from w union select unnest([{{needle}}])),
a as (select w, case when length(w) > 4 and w like '%ies' then left(w, -3) || 'y' when w like '%sses' then left(w, -2) when length(w) > 3 and regexp_matches(w, '[^sui]s$') then left(w, -1) else w end as s from d),
b as (select *, case when length(s) > 5 and s like '%ing' then left(s, -3) when length(s) > 4 and s like '%ed' then left(s, -2) when length(s) > 4 and s like '%ly' then null when length(s) > 4 and s like '%er' then left(s, -2)
  when length(s) > 5 and s like '%est' then left(s, -3) end as base from a),
st as (select w, case when length(s) > 4 and s like '%ied' then left(s, -3) || 'y' when base is null and length(s) > 4 and s like '%ly' then left(s, -2) when base is null or not regexp_matches(base, '[aeiou]') then s
  when length(base) > 1 and right(base, 1) = left(right(base, 2), 1) and right(base, 1) not in ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') then left(base, -1)
  when regexp_matches(base, '[^aeiou][aeiou][^aeiouwxy]$') then base || 'e' else base end as stem from b),
n as (select unnest([{{needle}}]) as nw), ns as (select nw, stem as nstem from n join st on st.w = nw),
k as (select w.doc_id, nw, count(*) filter (w.w = nw) as times, bool_or(st.stem = nstem) as rooted from w join st using (w), ns group by 1, 2),
f as (select doc_id, bool_and(rooted) as every, sum(case when times > 0 then 100 when rooted then 60 else 0 end + 5 * least(3, times)) as points from k group by 1) """
query("text_stem", _STEMS.replace("{needle}", "'thes', 'reou'") + "select 'documents:' || doc_id as doc from f where every")(_text("text-stem", "thes reou"))
query(
    "text_search",
    _STEMS.replace("{needle}", "'the', 'reou', 'of'")
    + """, x as (select doc_id, every, points, contains(lower(text), 'the reou of') as hit, lower(text) = 'the reou of' as same, contains('|' || array_to_string(ws, '|') || '|', '|the|reou|of|') as phrase, len(ws) as n from f join t using (doc_id))
select 'documents:' || doc_id as doc, greatest(1, points + case when phrase then 250 else 0 end + case when hit then 80 else 0 end + case when same then 400 else 0 end - least(40, greatest(0, n - 3)))::bigint as score from x where hit or every""",
)(_text("text-search", "the reou of", "score"))


@query("text_needle_variable", f"select w as needle, count(*) as n from (select unnest(['la', 'und', 'with']) as w) n join documents d on list_contains({_TOKENS}, n.w) group by 1")
def text_needle_variable(spark, sf_dir):
    """Needles from a relation, one row each, counted over the documents that have them."""
    needles = spark.createDataFrame([("q1", "la"), ("q2", "und"), ("q3", "with")], "q string, w string")
    more = needles.select(terms.string(F.col("q")).alias("t1"), terms.literal(Keyword(":needle")).alias("t2"), terms.string(F.col("w")).alias("t3"))
    body = [has(v("q"), "needle", v("n")), {"rel": "text-match", "args": [v("d"), Keyword(":text"), v("n")]}]
    plan = {"find": {"rel": "out", "group": [0], "agg": [{"op": "count"}]}, "rules": [rule("out", [v("n"), v("d")], *body)]}
    return scalars(run(plan, Source(_documents(spark, sf_dir).of.unionAll(more), distinct=True), spark), needle="c0.s", n="c1.i")


@query(
    "string_helpers",
    r"""select p_partkey as part, coalesce(nullif(rtrim(substr(trim(regexp_replace(lower(p_name || p_type), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60), '_'), ''), 'untitled') as slug, regexp_replace(p_brand, '[^0-9]', '', 'g') as digits,
  substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) || '-' || substr(d, 9, 6) as dashed, repeat(p_type, p_size % 3) as thrice, nullif(instr(p_name, 'e'), 0) - 1 as first_e
from (select *, lpad(p_partkey::varchar, 14, '7') as d from part)""",
)
def string_helpers(spark, sf_dir):
    d = F.lpad(F.col("p_partkey").cast("string"), 14, "7")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"),
        strings.slugify(F.concat("p_name", "p_type")).alias("slug"),
        strings.digits(F.col("p_brand")).alias("digits"),
        strings.dashed_id(d).alias("dashed"),
        strings.repeated(F.col("p_type"), F.col("p_size") % 3).alias("thrice"),
        strings.index_of(F.col("p_name"), F.lit("e")).alias("first_e"),
    )


@query(
    "classify_helpers",
    """select c_custkey as customer, x as reference, substr(x, 2) as bare, x not like '% %' as is_reference, case when c_name like '% %' then c_name else '@' || c_name end as made, c_name as holder, c_custkey as expires, (c_nationkey % 4 = 0 or c_nationkey % 4 = 3) as single
from (select *, '@' || c_name || case when c_custkey % 7 = 0 then ' x' else '' end as x from customer)""",
)
def classify_helpers(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("x", F.concat(F.lit("@"), "c_name", F.when(F.col("c_custkey") % 7 == 0, " x").otherwise("")))
    lease = strings.decoded_lease(strings.encoded_lease(F.col("c_name"), F.col("c_custkey"), F.col("c_nationkey")))
    k = F.col("c_nationkey") % 4
    single = strings.is_single(F.when(k == 0, "title").when(k == 3, "emoji_x").otherwise("tag"), F.when(k == 1, "multi"), F.lit(False))
    return c.select(F.col("c_custkey").alias("customer"), F.col("x").alias("reference"), strings.strip_at(F.col("x")).alias("bare"), strings.is_reference(F.col("x")).alias("is_reference"), strings.as_reference(F.col("c_name"), F.lit("ref")).alias("made"), lease["holder"].alias("holder"), lease["expires"].alias("expires"), single.alias("single"))


# the log, more closely


@query("occurrences_ordered", "select event_id + 1 as seq, case when event_type = 'error' then 'retract' else 'assert' end as action from events order by event_id desc limit 500")
def occurrences_ordered(spark, sf_dir):
    """The newest 500 operations, newest first."""
    return history.in_order(event_log(spark, sf_dir), newest_first=True).limit(500).select("seq", "action")


@query("occurrence_at", _OPS.format(where="") + "select seq, action, live from f where seq % 3 = 0")
def occurrence_at(spark, sf_dir):
    """Every third place looked up: what happened there and whether it lives."""
    log = event_log(spark, sf_dir)
    return history.at(log, log.where("seq % 3 = 0")).select("seq", "action", "live")


@query("withdrawals_between", _OPS.format(where="where event_id + 1 <= 900") + "select seq, target as target_seq from f where target is not null and seq > 400")
def withdrawals_between(spark, sf_dir):
    return history.withdrawals_between(event_log(spark, sf_dir), 400, 900).select("seq", "target_seq")


@query("live_subjects", _OPS.format(where="") + "select distinct u from f where live")
def live_subjects(spark, sf_dir):
    return history.subjects(history.live_occurrences(event_log(spark, sf_dir))).select(F.col("t1.i").alias("u"))


@query("frames_folded", _OPS.format(where="") + "select seq, u, k from f where live")
def frames_folded(spark, sf_dir):
    """The log cut into frames, put together from them and folded."""
    log = event_log(spark, sf_dir)
    return _plain(history.live_occurrences(history.from_frames(history.frames(log, 0, history.head(log)))))


@query("staged_overlay", _OPS.format(where="").replace("from events ),", "from events union all select 100000000 + user_id, 'retract', user_id, 0 from (select distinct user_id from events) ),") + "select seq, u, k from f where live")
def staged_overlay(spark, sf_dir):
    """One more retract of (user, did, 0) for each user, not committed yet."""
    log = event_log(spark, sf_dir)
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    more = operations(users, "events", F.col("user_id") + 100_000_000, F.lit(0), F.lit("retract"), terms.integer(F.col("user_id")), terms.literal(Keyword(":did")), terms.integer(F.lit(0)))
    return _plain(history.live_occurrences(history.staged(log, more)))


@query("commit_receipts", _OPS.format(where="") + "select seq, action = 'assert' or target is not null as changed from f")
def commit_receipts(spark, sf_dir):
    return history.receipts(event_log(spark, sf_dir)).select("seq", "changed")


@query("log_status", _OPS.format(where="") + "select 'events' as space, max(seq) as version, count(*) filter (live) as live from f")
def log_status(spark, sf_dir):
    return history.status(event_log(spark, sf_dir))


@query("occurrence_page", "select event_id + 1 as seq, user_id as u, case when event_type = 'error' then 'retract' else 'assert' end as action from events where event_id + 1 > 300 order by seq limit 50")
def occurrence_page(spark, sf_dir):
    """The next 50 operations behind a place, whatever became of them."""
    return history.page(event_log(spark, sf_dir), 50, (300, 0)).select("seq", F.col("t1.i").alias("u"), "action")


@query(
    "withdraw_decisions",
    _OPS.format(where="") + """, t as (select u, k, max(seq) as top from f where live group by 1, 2)
select seq, case when action = 'retract' then 'not-assertion-occurrence' when not live then 'occurrence-not-live' when seq <> top then 'withdrawal-target-not-current' else 'ok' end as decision
from f left join t using (u, k) union all select 0 - event_id, 'unknown-occurrence' from events where event_id > 0""",
)
def withdraw_decisions(spark, sf_dir):
    """Every operation as a target, and as many places where nothing is."""
    log = event_log(spark, sf_dir)
    targets = log.select("space", "seq", "ord")
    nowhere = targets.where("seq > 1").withColumn("seq", 1 - F.col("seq"))
    return history.withdrawable(log, targets.union(nowhere)).select("seq", "decision")


@query("occurrence_metadata", _OPS.format(where="") + "select seq, 'agent' || (seq % 3) as agent, case when seq % 2 = 0 then seq * 10 end as at from f where live")
def occurrence_metadata(spark, sf_dir):
    """Who asserted each occurrence, said of its transaction, and when, said of even ones."""
    log = event_log(spark, sf_dir)
    seq = F.col("seq")
    tx = terms.triple(terms.string(F.lit("events")), terms.literal(history.TX), terms.integer(seq))
    who = operations(log.select("seq"), "marks", seq, F.lit(0), F.lit("assert"), tx, terms.literal(history.ASSERTED_BY), terms.string(F.concat(F.lit("agent"), (seq % 3).cast("string"))))
    when = operations(log.select("seq").where("seq % 2 = 0"), "marks", seq, F.lit(1), F.lit("assert"), history.coordinate(F.lit("events"), seq, F.lit(0)), terms.literal(history.RECORDED_AT), terms.integer(seq * 10))
    out = history.with_metadata(history.live_occurrences(log.unionByName(who).unionByName(when)))
    return out.where("space = 'events'").select("seq", F.col("asserted_by.s").alias("agent"), F.col("recorded_at.i").alias("at"))


@query("view_selections", _OPS.format(where="") + "select seq from f where live and seq % 2 = 1")
def view_selections(spark, sf_dir):
    """A view that has all even occurrences selects all: what is new."""
    log = event_log(spark, sf_dir)
    live = history.live_occurrences(log.unionByName(_marks(spark, sf_dir, history.SELECTS, terms.literal("v"), "seq % 2 = 0")))
    new = history.selections(live, log.select(terms.literal("v").alias("view"), "space", "seq", "ord"))
    place = log.select("seq", history.coordinate(F.col("space"), F.col("seq"), F.col("ord"))["key"].alias("__c"))
    return new.join(place, new["t3"]["key"] == place["__c"]).select("seq")


@query(
    "commit_decisions",
    """with i as (select event_id // 4 as plan, event_id % 4 as idx, event_type = 'click' as single, user_id as base, 7 as expected, event_type = 'signup' and user_id % 5 = 0 as cyc, [user_id % 3, 4] as vals from events),
d as (select *, case when single and base > expected then 'conflict' when cyc then 'cycle' when not single and list_contains(vals, 1) then 'idempotent' else 'write' end as own from i),
m as (select plan, min(idx) filter (own in ('conflict', 'cycle')) as bad from d group by 1)
select plan, idx, case when bad is not null and bad <> idx then 'refused' else own end as decision from d join m using (plan)""",
)
def commit_decisions(spark, sf_dir):
    """Events as intents, four to a plan."""
    e = read(spark, sf_dir, "events")
    x = e.select(
        F.floor(F.col("event_id") / 4).alias("plan"), (F.col("event_id") % 4).alias("index"), F.lit("p").alias("predicate"), (F.col("event_type") == "click").alias("single"), F.col("user_id").alias("base_version"),
        F.lit(7).cast("bigint").alias("expected_version"), F.array(F.col("user_id") % 3, F.lit(4).cast("bigint")).alias("live_values"), F.lit(1).cast("bigint").alias("expected_value"),
        ((F.col("event_type") == "signup") & (F.col("user_id") % 5 == 0)).alias("cycle"),
    )
    return write.decisions(x, by=("plan",)).select("plan", F.col("index").alias("idx"), "decision")


# the registry


def _registry(spark, sf_dir) -> DataFrame:
    """Part types as registered predicates, ids p:<type>, with :<type> as an alias."""
    t = read(spark, sf_dir, "part").select("p_type").distinct()
    pid = terms.string(F.concat(F.lit("p:"), "p_type"))
    one = lambda o, p, x: operations(t, "s", F.lit(1), F.lit(o), F.lit("assert"), pid, terms.literal(p), terms.string(x))
    return history.live_occurrences(one(0, schema.NAME, F.col("p_type")).unionByName(one(1, schema.ALIAS, F.concat(F.lit(":"), "p_type"))))


@query("registry_resolve", "select p_type as spelling, 'p:' || p_type as id, 1::bigint as n from part group by p_type union all select p_brand, null, 0 from part group by p_brand")
def registry_resolve(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    wanted = p.select(F.col("p_type").alias("spelling")).union(p.select("p_brand"))
    return schema.resolve_all(_registry(spark, sf_dir), wanted).select("spelling", F.col("id.s").alias("id"), "n")


@query("registry_register", "select p_brand as spelling, null::varchar as refused, 2 as n from part group by 1 union all select p_type, null, 0 from part group by 1")
def registry_register(spark, sf_dir):
    """Brands aren't registered yet, types are."""
    p = read(spark, sf_dir, "part")
    wanted = p.select(F.col("p_type").alias("spelling")).union(p.select("p_brand"))
    return schema.registrations(_registry(spark, sf_dir), wanted).select("spelling", "refused", F.size("propositions").alias("n"))


@query(
    "registry_rename",
    """with t as (select distinct p_type as x from part)
select x as spelling, x || ' new' as new_name, null::varchar as refused, s as step, a as action, v as value from (
  select x, 0 as s, 'assert' as a, x as v from t union all select x, 1, 'retract', x from t union all select x, 2, 'assert', x || ' new' from t union all select x, 3, 'assert', ':' || x || ' new' from t)
union all select min(x), max(x), 'predicate spelling collision', null, null, null from t""",
)
def registry_rename(spark, sf_dir):
    """All types renamed; and one to the name that another has."""
    t = read(spark, sf_dir, "part").select(F.col("p_type").alias("spelling")).distinct()
    wanted = t.select("spelling", F.concat("spelling", F.lit(" new")).alias("new_name")).unionByName(t.agg(F.min("spelling").alias("spelling"), F.max("spelling").alias("new_name")))
    return schema.renames(_registry(spark, sf_dir), wanted).select("spelling", "new_name", "refused", "step", "action", F.col("t3.s").alias("value"))


@query("names_resolved", "select n_name as name, 'nation:' || n_nationkey as subject from nation")
def names_resolved(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    named = operations(n, "s", F.col("n_nationkey") + 1, F.lit(0), F.lit("assert"), terms.string(tagged("nation")(F.col("n_nationkey"))), terms.literal(schema.LABEL), terms.string(F.col("n_name")))
    return schema.subjects_named(history.live_occurrences(named), n.select(F.col("n_name").alias("name"))).select("name", F.col("subject.s").alias("subject"))


@query("replacements", _OPS.format(where="") + "select 'retract' as action, u, k from f where live union all select 'assert', user_id, 99 from events group by user_id")
def replacements(spark, sf_dir):
    """99 as the only value of every user."""
    live = history.live_occurrences(event_log(spark, sf_dir))
    wanted = read(spark, sf_dir, "events").select("user_id").distinct().select(terms.integer(F.col("user_id")).alias("t1"), terms.literal(Keyword(":did")).alias("t2"), terms.literal(99).alias("t3"))
    return schema.replacements(live, wanted).select("action", F.col("t1.i").alias("u"), F.col("t3.i").alias("k"))


@query("validate_spaces", "select p_brand as space, p_partkey as part, 'R3' as rule from part where p_size <= 5 and p_brand <> (select min(p_brand) from part) union all select p_brand, p_partkey, 'R5' from part where p_size > 45 and p_brand = (select max(p_brand) from part)")
def validate_spaces(spark, sf_dir):
    """A space a brand; the first doesn't declare the profile, the last includes the vocabulary rule. Small parts get an
    empty predicate, large ones a namespaced predicate that is no member."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("space"), "p_partkey", "p_size")
    row_id, size = terms.string(tagged("part")(F.col("p_partkey"))), terms.integer(F.col("p_partkey"))
    t2 = F.when(F.col("p_size") <= 5, terms.literal("")).when(F.col("p_size") > 45, terms.literal(Keyword(":a/b"))).otherwise(terms.literal("size"))
    own = p.select("space", row_id.alias("t1"), t2.alias("t2"), size.alias("t3"))
    spaces = p.select("space").distinct()
    ends = spaces.agg(F.min("space").alias("__low"), F.max("space").alias("__high"))
    spaces = spaces.join(F.broadcast(ends), F.col("space") > F.col("__low"))
    profile_id = terms.string(F.concat(F.lit("profile "), "space"))
    header = terms.triple(profile_id, terms.literal(profile.KIND), terms.literal(profile.MODE))
    anchors = spaces.select("space", terms.string(F.col("space")).alias("t1"), terms.literal(profile.ANCHOR).alias("t2"), header.alias("t3"))
    rules = spaces.select("space", "__high", F.explode(F.array(*map(F.lit, (*profile.RULES, profile.VOCABULARY)))).alias("r")).where((F.col("r") != profile.VOCABULARY) | (F.col("space") == F.col("__high")))
    rules = rules.select("space", profile_id.alias("t1"), terms.literal(profile.INCLUDES).alias("t2"), terms.string(F.col("r")).alias("t3"))
    found = profile.validate(own.unionByName(anchors).unionByName(rules))
    return found.select("space", F.col("t3.i").alias("part"), "rule")


@query(
    "admission",
    """with p as (select *, 'part:' || p_partkey as part from part)
select part, 'R1' as rule from p where p_size % 5 = 0 union all select part, 'R2' from p where p_size % 3 = 0 union all select part, 'R3' from p where p_size % 7 = 0 union all select part, 'R4' from p where p_size % 5 = 0""",
)
def admission(spark, sf_dir):
    """What a commit of each proposition would violate: some have a number for a subject, no predicate, a triple for a value."""
    p = read(spark, sf_dir, "part").select(tagged("part")(F.col("p_partkey")).alias("part"), "p_size")
    size = terms.integer(F.col("p_size"))
    t1 = F.when(F.col("p_size") % 3 == 0, size).otherwise(terms.string(F.col("part")))
    t2 = F.when(F.col("p_size") % 7 == 0, terms.literal("")).otherwise(terms.literal(Keyword(":size")))
    t3 = F.when(F.col("p_size") % 5 == 0, terms.triple(size, size, size)).otherwise(size)
    return p.select("part", F.explode(profile.relational_errors(t1, t2, t3)).alias("rule"))


@query(
    "log_faults",
    """select event_id + 1 as seq, 0 as ord, 'action' as fault from events where event_id % 50 = 0 union all select event_id + 1, 0, 'term' from events where event_id % 70 = 0
union all select event_id + 1, 0, 'repeated' from events where event_id % 90 = 0 union all select event_id + 1, 2, 'gap' from events where event_id % 110 = 0 union all select 0 - event_id, 0, 'place' from events where event_id % 130 = 0""",
)
def log_faults(spark, sf_dir):
    """The log of the events with broken actions, missing terms, repeated places, gaps and places before the first."""
    log = event_log(spark, sf_dir).withColumn("e", F.col("seq") - 1)
    log = log.withColumn("action", F.when(F.col("e") % 50 == 0, "other").otherwise(F.col("action"))).withColumn("t3", F.when(F.col("e") % 70 != 0, F.col("t3")))
    good = F.lit("assert").alias("action"), "t1", "t2", F.col("t1").alias("t3")
    more = log.where("e % 90 = 0").select("space", "seq", "ord", *good)
    more = more.unionAll(log.where("e % 110 = 0").select("space", "seq", F.lit(2).alias("ord"), *good))
    more = more.unionAll(log.where("e % 130 = 0").select("space", (-F.col("e")).alias("seq"), "ord", *good))
    return faults(log.drop("e").unionByName(more)).select("seq", "ord", "fault")


def _threads(spark, sf_dir) -> DataFrame:
    """Nations as subjects of strings: a title in words, the region, and a body of two lines."""
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("@n"), F.col("n_nationkey").cast("string")).alias("t"), "n_name", F.concat(F.lit("@r"), F.col("n_regionkey").cast("string")).alias("r"))
    each = F.array(*(F.struct(F.lit(k).alias("k"), x.alias("v")) for k, x in (("title", F.concat(F.lit("the "), "n_name")), ("part_of", F.col("r")), ("code", F.col("n_name")), ("body", F.concat("n_name", F.lit("\n---\n"), "r")))))
    return n.select(terms.string(F.col("t")).alias("t1"), F.explode(each).alias("x")).select("t1", terms.string(F.col("x.k")).alias("t2"), terms.string(F.col("x.v")).alias("t3"))


@query(
    "markdown_export",
    """select '@n' || n_nationkey as subject, '@n' || n_nationkey || chr(10) || 'title  "the ' || n_name || '"' || chr(10) || 'part_of  @r' || n_regionkey || chr(10) || 'code  ' || case when n_name like '% %' then '"' || n_name || '"' else n_name end
  || chr(10) || '---' || chr(10) || n_name || chr(10) || '---' || chr(10) || '@r' || n_regionkey as text from nation""",
)
def markdown_export(spark, sf_dir):
    return to_markdown(_threads(spark, sf_dir))


@query(
    "markdown_import",
    """select '@n' || n_nationkey as subject, unnest(['title', 'part_of', 'code', 'body']) as predicate, unnest(['the ' || n_name, '@r' || n_regionkey, n_name, n_name || chr(10) || '---' || chr(10) || '@r' || n_regionkey]) as value from nation""",
)
def markdown_import(spark, sf_dir):
    """What the exported texts give when they are read again."""
    back = parse_markdown(to_markdown(_threads(spark, sf_dir)).select(F.col("text").alias("value")))
    return scalars(back, subject="t1.s", predicate="t2.s", value="t3.s")


# claims


def _selections(spark, sf_dir) -> DataFrame:
    agent = F.concat(F.lit(":a"), (F.col("doc_id") % 3).cast("string"))
    view = F.concat(F.when(F.col("quality") == 1, "verified").otherwise("rejected"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(agent))
    odd = F.when(F.col("doc_id") % 11 == 0, "verifiedly").otherwise(view)
    return read(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("claim"), odd.alias("view"), F.col("doc_id").alias("seq"), F.lit(0).alias("ord"), F.concat(F.lit("w"), (F.col("doc_id") % 7).cast("string")).alias("writer"))


_PICKS = """with p as (select doc_id % 50 as claim, quality, doc_id, 'w' || (doc_id % 7) as w from labels where doc_id % 11 <> 0),
l as (select claim, arg_max(quality, doc_id) as q, arg_max(w, doc_id) as w, max(doc_id) as seq from p group by 1) """


@query("claims_verifiers", _PICKS + """select claim, w as "by" from l where q = 1""")
def claims_verifiers(spark, sf_dir):
    """Views verified, verified:a1 and so on; verifiedly is of no family."""
    return claims.verifiers(_selections(spark, sf_dir))


@query("claims_rejections", _PICKS + """select claim, case when claim % 2 = 0 then 'because ' || claim end as reason, w as "by", seq from l where q = 0""")
def claims_rejections(spark, sf_dir):
    picks = _selections(spark, sf_dir)
    reasons = picks.select("claim").distinct().where("claim % 2 = 0").select("claim", F.concat(F.lit("because "), F.col("claim").cast("string")).alias("reason"), F.lit(1).alias("seq"))
    return claims.rejections(picks, reasons)


@query(
    "claims_statuses",
    _PICKS + ", c as (select distinct doc_id % 60 as claim from labels) select claim, case when claim % 9 = 0 then 'superseded' when q = 1 then 'verified' when q = 0 then 'rejected' when claim % 4 = 1 then 'pending' end as status from c left join l using (claim)",
)
def claims_statuses(spark, sf_dir):
    c = read(spark, sf_dir, "labels").select((F.col("doc_id") % 60).alias("claim")).distinct().withColumn("live", F.col("claim") % 9 != 0)
    return claims.statuses(c, _selections(spark, sf_dir), c.where("claim % 4 = 1"))


_EVIDENCE = "select doc_id % 50 as claim, doc_id as node, 's' || (doc_id % 10) as source, 'v' || (doc_id % 2) as world from labels"


def _evidence(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    x = read(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("claim"), F.col("doc_id").alias("node"), F.concat(F.lit("s"), (F.col("doc_id") % 10).cast("string")).alias("source"), F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("world"))
    own = x.select("node", F.explode(F.create_map(F.lit("source"), "source", F.lit("world"), "world")).alias("attribute", "value")).withColumn("seq", F.lit(1))
    return x, own.unionByName(own.withColumn("value", F.lit("later")).withColumn("seq", F.lit(2)))


@query("claims_provenance", f"select claim, node, source, null::varchar as region, null::varchar as fingerprint, world from ({_EVIDENCE})")
def claims_provenance(spark, sf_dir):
    return claims.provenance(*_evidence(spark, sf_dir))


@query(
    "claims_reverify",
    f"""with e as ({_EVIDENCE}), v as (select distinct doc_id % 50 as claim from labels where quality = 1 and doc_id % 11 <> 0)
select distinct 'v0' as "from", 'v1' as "to", claim from e join v using (claim) where world = 'v0' and source in ('s2', 's4') and claim % 9 <> 0""",
)
def claims_reverify(spark, sf_dir):
    """Between v0 and v1 the slots s2 and s4 changed."""
    changed = spark.createDataFrame([("v0", "v1", "s2"), ("v0", "v1", "s4")], "`from` string, `to` string, slot string")
    picks = _selections(spark, sf_dir)
    evidence, attributes = _evidence(spark, sf_dir)
    return claims.to_verify_again(changed, evidence, attributes, picks, picks.where("claim % 9 <> 0"))


# programs: customers' nations as files, orders as calls of the customer's definition by suppliers of the lines


def _calls(spark, sf_dir) -> DataFrame:
    e = _edges(spark, sf_dir)
    return e.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.concat(F.lit("f"), (F.col("src") % 4).cast("string")).alias("file"))


_CALLS = f"with e as ({_EDGE_SQL}), c as (select src as caller, dst as callee, 'f' || (src % 4) as file from e), d as (select distinct caller as id, 'f' || (caller % 4) as file, 'n' || (caller % 6) as name from c) "


def _definitions(spark, sf_dir) -> DataFrame:
    return _calls(spark, sf_dir).select(F.col("caller").alias("id"), "file", F.concat(F.lit("n"), (F.col("caller") % 6).cast("string")).alias("name")).distinct()


@query("find_references", _CALLS + "select callee as of, caller as other, c.file, 'inbound' as direction from c where callee in (select id from d) union all select caller, callee, file, 'outbound' from c")
def find_references(spark, sf_dir):
    return graph.references(_calls(spark, sf_dir), _definitions(spark, sf_dir), "both")


@query("occurrence_history", _CALLS + "select id, 'definition' as kind, id as owner, file from d union all select callee, 'reference', caller, c.file from c where callee in (select id from d)")
def occurrence_history(spark, sf_dir):
    return graph.occurrences(_calls(spark, sf_dir), _definitions(spark, sf_dir))


_RISING = f"with recursive e as (select * from ({_EDGE_SQL}) where dst > src and dst <= src + 4), r as (select src as root, dst as node, 1 as depth from e union select r.root, e.dst, r.depth + 1 from r join e on e.src = r.node), m as (select root, node, min(depth) as depth from r group by 1, 2) "


@query("trace_impact", _RISING + "select * from m")
def trace_impact(spark, sf_dir):
    """What each node reaches over edges that rise by four at most."""
    e = _edges(spark, sf_dir).where("dst > src and dst <= src + 4")
    return graph.reach_each(e, e.select(F.col("src").alias("node")))


@query("blast_closure", _RISING + "select node as callee, root as caller from m")
def blast_closure(spark, sf_dir):
    return graph.blast(_edges(spark, sf_dir).where("dst > src and dst <= src + 4"))


@query("program_context", _RISING + ", w as (select *, node % 5 + 3 as tokens from m) select root, node, depth, tokens from (select *, sum(tokens) over (partition by root order by depth, node) as s from w) where s <= 20")
def program_context(spark, sf_dir):
    """The nearest of what each node reaches, within 20 tokens."""
    e = _edges(spark, sf_dir).where("dst > src and dst <= src + 4")
    sizes = e.select(F.col("dst").alias("node")).distinct().withColumn("tokens", F.col("node") % 5 + 3)
    return graph.context(graph.reach_each(e, e.select(F.col("src").alias("node"))), sizes, 20)


@query(
    "collision_precision",
    _CALLS + ", n as (select name from d group by 1 having count(distinct file) > 1), x as (select d.name, d.id, c.caller from d join n using (name) join c on c.callee = d.id), t as (select name, count(distinct caller) as n_by_name from x group by 1) select name, id, count(distinct caller) as n_callers, any_value(n_by_name) as n_by_name, count(distinct caller)::double / any_value(n_by_name) as precision from x join t using (name) group by 1, 2",
)
def collision_precision(spark, sf_dir):
    return graph.collision_precision(_definitions(spark, sf_dir), _calls(spark, sf_dir))


def _program(spark, sf_dir) -> DataFrame:
    """Parts as forms: a node with two children, the first defn or let, the second the part's name, most of them symbols."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey") * 3
    node = lambda d: (k + d).cast("string")
    rows = [(node(0), "f0", node(1)), (node(0), "f1", node(2)), (node(1), "kind", F.lit("symbol")), (node(1), "v", F.when(F.col("p_size") % 2 == 0, "defn").otherwise("let"))]
    rows += [(node(2), "kind", F.when(F.col("p_size") % 3 == 0, "string").otherwise("symbol")), (node(2), "v", F.col("p_name"))]
    each = F.array(*(F.struct(a.alias("t1"), F.lit(b).alias("t2"), c.alias("t3")) for a, b, c in rows))
    return p.select(F.col("p_type").alias("file"), F.explode(each).alias("x")).select("file", "x.*")


@query("module_bindings", "select p_type as file, (p_partkey * 3)::varchar as node, p_name as name from part where p_size % 2 = 0 and p_size % 3 <> 0")
def module_bindings(spark, sf_dir):
    return graph.module_bindings(_program(spark, sf_dir))


@query("rename_operations", "select p_type as file, a as action, (p_partkey * 3 + 2)::varchar as node, case a when 'assert' then p_name || ' new' else p_name end as value from part, (values ('retract'), ('assert')) x(a) where p_size % 3 <> 0")
def rename_operations(spark, sf_dir):
    """Every second child renamed; those that are no symbols stay."""
    facts = _program(spark, sf_dir)
    values = facts.where((F.col("t2") == graph.VALUE) & ~F.col("t3").isin("defn", "let"))
    targets = values.select("file", F.col("t1").alias("node"), F.concat("t3", F.lit(" new")).alias("new_name"))
    return graph.rename_operations(facts, targets).select("file", "action", F.col("t1").alias("node"), F.col("t3").alias("value"))


@query(
    "pull_pattern",
    """with c as (select 'customer:' || c_custkey as root, 'nation:' || c_nationkey as n, c_nationkey as k from customer)
select root, root as node, ':c_nationkey' as attribute, n as value, null::varchar as mark from c
union all select root, n, ':n_regionkey', 'region:' || n_regionkey, 'truncated' from c join nation on n_nationkey = k
union all select root, root, '_:o_custkey', 'orders:' || o_orderkey, null from c join orders on root = 'customer:' || o_custkey""",
)
def pull_pattern(spark, sf_dir):
    """Each customer's nation, and its region beyond the depth; and the orders that refer to the customer."""
    source = facts(spark, sf_dir, "customer.c_nationkey", "nation.n_regionkey", "orders.o_custkey").of
    roots = read(spark, sf_dir, "customer").select(terms.string(tagged("customer")(F.col("c_custkey")))["key"].alias("node"))
    out = graph.pull_pattern(source, roots, [{":c_nationkey": [{":n_regionkey": []}]}, "_:o_custkey"], max_depth=2)
    plain = lambda c: F.regexp_extract(c, r"^s\d+:(.*)$", 1).alias(c)
    return out.select(plain("root"), plain("node"), "attribute", plain("value"), "mark")


# plans, more closely


@query("even_odd", "with r as (select n_nationkey as k from nation) select 'nation:' || k as node, case when k % 2 = 0 then 'even' else 'odd' end as parity from r")
def even_odd(spark, sf_dir):
    """Mutual recursion over nations in the order of their keys, from a fact."""
    n = read(spark, sf_dir, "nation")
    edges = n.where("n_nationkey < 24").select(terms.string(tagged("nation")(F.col("n_nationkey"))).alias("t1"), terms.literal(Keyword(":next")).alias("t2"), terms.string(tagged("nation")(F.col("n_nationkey") + 1)).alias("t3"))
    step = lambda to, of: rule(to, [v("b")], {"rel": of, "args": [v("a")]}, has(v("a"), "next", v("b")))
    first = [rule("even", ["nation:0"]), step("odd", "even"), step("even", "odd")]
    out = [rule("out", [v("x"), k], {"rel": k, "args": [v("x")]}) for k in ("even", "odd")]
    return scalars(run({"find": "out", "strata": [first, out]}, Source(edges, distinct=True), spark), node="c0.s", parity="c1.s")


@query("closure_rising", f"with recursive e as ({_EDGE_SQL}), r as (select src, dst from e where src < dst union select r.src, e.dst from r join e on e.src = r.dst where r.src < e.dst) select src, dst from r")
def closure_rising(spark, sf_dir):
    """A comparison inside the recursion."""
    less = {"pred": "lt", "args": [v("a"), v("c")]}
    rules = [rule("r", [v("a"), v("c")], has(v("a"), "edge", v("c")), less), rule("r", [v("a"), v("c")], {"rel": "r", "args": [v("a"), v("b")]}, has(v("b"), "edge", v("c")), less)]
    return scalars(run({"find": "r", "rules": rules}, _edge_facts(spark, sf_dir), spark), src="c0.i", dst="c1.i")


@query("agg_closure", f"with recursive e as ({_EDGE_SQL}), r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst) select src, count(*) as n from r where dst not in (select src from e where src < 5) group by 1 having count(*) >= 2 order by n desc, src limit 10")
def agg_closure(spark, sf_dir):
    """An aggregate over recursive and negated relations, its limit behind having."""
    reach = [rule("reach", [v("a"), v("b")], has(v("a"), "edge", v("b"))), rule("reach", [v("a"), v("c")], {"rel": "reach", "args": [v("a"), v("b")]}, has(v("b"), "edge", v("c")))]
    low = [rule("low", [v("a")], has(v("a"), "edge", v("b")), {"pred": "lt", "args": [v("a"), 5]})]
    out = [rule("out", [v("a"), v("b")], {"rel": "reach", "args": [v("a"), v("b")]}, {"rel": "low", "args": [v("b")], "neg": True})]
    plan = {"find": {"rel": "out", "group": [0], "agg": [{"op": "count"}], "having": [{"op": "ge", "agg": 0, "val": 2}]}, "strata": [reach + low, out], "order-by": [{"column": 1, "direction": "desc"}, {"column": 0, "direction": "asc"}], "limit": 10}
    return scalars(run(plan, _edge_facts(spark, sf_dir), spark), src="c0.i", n="c1.i")


@query("arith_overflow", "select 'part:' || p_partkey as part, (9223372036854775000::hugeint + p_partkey)::bigint as x from part where p_partkey <= 807")
def arith_overflow(spark, sf_dir):
    """Rows whose sum has more than 64 bits have no result."""
    plan = {"find": "out", "rules": [rule("out", [v("p"), v("x")], has(v("p"), "p_partkey", v("k")), {"fn": "+", "args": [v("k"), 9223372036854775000], "bind": "x"})]}
    return scalars(run(plan, facts(spark, sf_dir, "part.p_partkey"), spark), part="c0.s", x="c1.i")


@query("page_ordered", "select 'part:' || p_partkey as part, p_size::bigint as size from part order by p_size desc, length('part:' || p_partkey)::varchar || ':part:' || p_partkey limit 40 offset 40")
def page_ordered(spark, sf_dir):
    """The second page of an ordered plan, behind the first one's cursor. Equal sizes stand by length and id, which the plan says:
    a page's own last order has the length of the key first."""
    part, name = read(spark, sf_dir, "part"), tagged("part")(F.col("p_partkey"))
    place = F.concat(F.length(name).cast("string"), F.lit(":"), name)
    source = Source.from_tables(Table(part.withColumn("place", place), name, ("p_size", "place"), unique=True))
    order = [{"column": 1, "direction": "desc"}, {"column": 2, "direction": "asc"}]
    plan = {"find": "out", "rules": [rule("out", [v("p"), v("s"), v("x")], has(v("p"), "p_size", v("s")), has(v("p"), "place", v("x")))], "order-by": order}
    _, cursor = page(plan, source, spark, 40)
    rows, _ = page(plan, source, spark, 40, cursor)
    return spark.createDataFrame([(r["c0"]["s"], r["c1"]["i"]) for r in rows], "part string, size long")


@query("page_canonical", "select 'part:' || p_partkey as part from part order by length('s' || length('part:' || p_partkey) || ':part:' || p_partkey)::varchar, length('part:' || p_partkey)::varchar, 'part:' || p_partkey limit 30")
def page_canonical(spark, sf_dir):
    """The first page in canonical order: by the length of the key as text, then the key."""
    rows, _ = page({"find": "out", "rules": [rule("out", [v("p")], has(v("p"), "p_size", v("s")))]}, facts(spark, sf_dir, "part.p_size"), spark, 30)
    return spark.createDataFrame([(r["c0"]["s"],) for r in rows], "part string")


@query("instants", "select o_orderkey as k, epoch(o_orderdate)::bigint + 90 as later, epoch(o_orderdate)::bigint as seconds from orders")
def instants(spark, sf_dir):
    """Instants shifted by 90 seconds, and the seconds between 1970 and them."""
    t = terms.timestamp(F.col("o_orderdate"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), terms.shift_seconds(t, F.lit(90))["i"].alias("later"), terms.seconds_between(terms.literal(terms.Instant(0)), t).alias("seconds"))
