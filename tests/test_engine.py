"""Plans against small facts with known answers, and histories against a stack fold."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.errors import QueryError
from quadrille.functions import terms, text
from quadrille.functions.terms import Instant, Keyword, Triple
from quadrille.operators import claims, graph, history, profile
from quadrille.operators.write import Builder, Log, parse_key, python
from quadrille.plans import catalogue
from quadrille.plans.evaluate import Source, collected, page, run
from quadrille.plans.plan import parse
from quadrille.sources import tables

EDGE = Keyword(":edge")


def props(spark, triples):
    each = F.array(*(F.struct(*(terms.literal(x).alias(f"t{k}") for k, x in enumerate(t, 1))) for t in triples))
    return spark.range(1).select(F.explode(each).alias("x")).select("x.*")


def values(rows):
    return [tuple(python(x) for x in r if hasattr(x, "key")) for r in rows]


def v(x):
    return {"var": x}


def rule(name, args, *body):
    return {"head": {"rel": name, "args": args}, "body": list(body)}


def t(*args):
    return {"rel": "triple", "args": list(args)}


NESTED = Triple("a", Keyword(":b"), Triple(1, 2.5, True))


@pytest.mark.parametrize("value", ["", "é😀", "s3:x", 0, -(1 << 63), 2.5, -0.0, 1e10, True, Keyword(":k/x"), Instant(5, 7), NESTED])
def test_keys_round_trip(spark, value):
    key = spark.range(1).select(terms.literal(value)["key"].alias("k")).collect()[0]["k"]
    assert parse_key(key) == value and type(parse_key(key)) is type(value)


def test_natural_order_and_canonical_order(spark):
    mixed = [NESTED, Instant(1, 2), Keyword(":k"), "b", "a", 2, 1.5, 1, True, False, (1 << 53) + 1, 1 << 53]
    facts = props(spark, [("x", Keyword(":v"), m) for m in mixed])
    plan = {"find": "out", "rules": [rule("out", [v("m")], t("x", Keyword(":v"), v("m")))], "order-by": [{"column": 0, "direction": "asc"}]}
    assert [r[0] for r in values(collected(plan, facts, spark))] == [False, True, 1, 1.5, 2, 1 << 53, (1 << 53) + 1, "a", "b", Keyword(":k"), Instant(1, 2), NESTED]
    # without an order: by key, so 10 characters come before 9
    facts = props(spark, [("x", 1, "y" * 9), ("x", 1, "z" * 10)])
    plan = {"find": "out", "rules": [rule("out", [v("m")], t("x", 1, v("m")))]}
    rows, cursor = page(plan, facts, spark, 1)
    more, end = page(plan, facts, spark, 1, cursor)
    assert sorted(values(rows) + values(more)) == [("y" * 9,), ("z" * 10,)] and end is None


def test_nested_constants_negation_and_closure(spark):
    facts = props(spark, [("n1", EDGE, "n2"), ("n2", EDGE, "n3"), ("n3", EDGE, "n1"), ("m", Keyword(":says"), NESTED), ("m", Keyword(":says"), NESTED)])
    plan = {"find": "out", "rules": [rule("out", [v("x")], t(v("x"), Keyword(":says"), NESTED))]}
    assert values(collected(plan, facts, spark)) == [("m",)]
    reach = [rule("r", [v("a"), v("b")], t(v("a"), EDGE, v("b"))), rule("r", [v("a"), v("c")], {"rel": "r", "args": [v("a"), v("b")]}, t(v("b"), EDGE, v("c")), {"pred": "ne", "args": [v("a"), v("c")]})]
    assert len(collected({"find": "r", "rules": reach}, facts, spark)) == 6
    leaf = {"find": "leaf", "strata": [reach, [rule("leaf", [v("a")], t(v("a"), v("p"), v("b")), {"rel": "r", "args": [v("a"), v("b")], "neg": True})]]}
    assert values(collected(leaf, facts, spark)) == [("m",)]


def test_mutual_recursion_and_facts(spark):
    facts = props(spark, [(i, EDGE, i + 1) for i in range(6)])
    rules = [rule("even", [0]), rule("odd", [v("b")], {"rel": "even", "args": [v("a")]}, t(v("a"), EDGE, v("b"))), rule("even", [v("b")], {"rel": "odd", "args": [v("a")]}, t(v("a"), EDGE, v("b")))]
    assert sorted(values(collected({"find": "even", "rules": rules}, facts, spark))) == [(0,), (2,), (4,), (6,)]


def test_arithmetic_drops_what_has_no_result(spark):
    facts = props(spark, [("a", 1, 7), ("b", 1, "8"), ("c", 1, "x"), ("d", 1, 2.5), ("e", 1, 0)])

    def out(fn, x, y):
        body = [t(v("s"), 1, v("n")), {"fn": fn, "args": [x, y], "bind": "r"}]
        return dict(values(collected({"find": "o", "rules": [rule("o", [v("s"), v("r")], *body)]}, facts, spark)))

    assert out("+", v("n"), 1) == {"a": 8, "b": 9, "d": 3.5, "e": 1}
    assert out("/", 1, v("n")) == {"a": 1 / 7, "b": 0.125, "d": 0.4}
    assert out("mod", v("n"), -3) == {"a": -2, "b": -1, "e": 0}
    assert out("*", v("n"), 1 << 62) == {"d": 2.5 * (1 << 62), "e": 0}
    comparison = {"find": "o", "rules": [rule("o", [v("s")], t(v("s"), 1, v("n")), {"pred": "ge", "args": [v("n"), 7]})]}
    assert sorted(values(collected(comparison, facts, spark))) == [("a",), ("b",)]


def test_aggregates(spark):
    facts = props(spark, [("a", 1, 2), ("a", 1, 3), ("b", 1, 2), ("b", 1, 2.0), ("b", 1, 2)])
    base = [rule("o", [v("s"), v("n")], t(v("s"), 1, v("n")))]
    agg = lambda *ops, **more: {"find": {"rel": "o", "group": [0], "agg": [{"op": o} if o == "count" else {"op": o, "arg": 1} for o in ops], **more}, "rules": base}
    assert sorted(values(collected(agg("count", "count-distinct", "sum", "avg", "max"), facts, spark))) == [("a", 2, 2, 5, 2.5, 3), ("b", 2, 2, 4.0, 2.0, 2)]
    assert values(collected(agg("sum", having=[{"op": "gt", "agg": 0, "val": 4}]), facts, spark)) == [("a", 5)]
    with pytest.raises(QueryError, match="nonnumeric"):
        collected(agg("sum"), props(spark, [("a", 1, "x")]), spark)
    with pytest.raises(QueryError, match="not-pageable"):
        page(agg("count"), facts, spark, 5)
    with pytest.raises(QueryError, match="result-limit"):
        collected({"find": "o", "rules": base}, facts, spark, most=2)


def test_many_needles_find_what_a_few_do(spark, monkeypatch):
    from quadrille.plans import evaluate

    texts = ["The quick brown fox", "foxes run and ran", "a", "ab Quick", "running late, quickly", "ÉCOLE du nord", ""]
    needles = ["fox", "quick", "b", "ab", "run", "École", "brown fox", "n", "the quick", "zzz"]
    facts = props(spark, [(f"d{i}", Keyword(":text"), t) for i, t in enumerate(texts)] + [(f"n{i}", Keyword(":needle"), n) for i, n in enumerate(needles)])
    got = {}
    for few in (100, 0):
        monkeypatch.setattr(evaluate, "FEW_NEEDLES", few)
        for relation, width in (("text-substring", 3), ("text-search", 4), ("text-phrase", 3)):
            score = [v("s")] if width == 4 else []
            body = [{"rel": "triple", "args": [v("q"), Keyword(":needle"), v("n")]}, {"rel": relation, "args": [v("d"), Keyword(":text"), v("n"), *score]}]
            rows = sorted(map(repr, values(collected({"find": "o", "rules": [rule("o", [v("n"), v("d"), *score], *body)]}, facts, spark))))
            assert got.setdefault(relation, rows) == rows and rows
    plain = [repr((n, f"d{i}")) for n in needles for i, t in enumerate(texts) if n.lower() in t.lower()]
    assert got["text-substring"] == sorted(plain)


def test_variable_needles_shuffle_no_texts(spark, monkeypatch):
    """Few needles: nothing but what is found is shuffled; many: words as hashes, so no join by a word has the texts."""
    from quadrille.plans import evaluate

    facts = props(spark, [("d1", Keyword(":text"), "la casa und la"), ("d2", Keyword(":text"), "With İx ΑΣ.Β"), ("q", Keyword(":needle"), "la"), ("q", Keyword(":needle"), "ΑΣ")])
    body = [{"rel": "triple", "args": [v("q"), Keyword(":needle"), v("n")]}, {"rel": "text-match", "args": [v("d"), Keyword(":text"), v("n")]}]
    rows = facts.toDF("c0", "c1", "c2")
    wanted = spark.createDataFrame([("la",), ("ΑΣ",)], "__n string")
    for few in (100, 0):
        monkeypatch.setattr(evaluate, "FEW_NEEDLES", few)
        found = evaluate._candidates(rows, wanted, "text-match")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" in plan and all("c2" not in line for line in plan.splitlines() if "Join" in line and "__w" in line)
        assert ("rightHint=(strategy=broadcast)" in plan or "leftHint=(strategy=broadcast)" in plan) == (few > 0)
        out = collected({"find": "o", "rules": [rule("o", [v("n"), v("d")], *body)]}, facts, spark)
        assert sorted(values(out)) == [("la", "d1"), ("ΑΣ", "d2")]


@pytest.mark.parametrize("relation,needle", [*((r, n) for r in ("text-stem", "text-search") for n in ("thes reou", "king's kings", "İs io", "école ΑΣ", "flies 42")), ("text-search", "...")])
def test_constant_needles_stem_few_words(spark, relation, needle):
    """As the plain expressions say; the words of a text are found once, by one pass."""
    texts = ["The reou, the", "reous bathes", "the quick fox", "THE-quick\nfox foxes", "the quick and fox", "\u212aing's \u212aINGS", "is io İs IO", "École, ΑΣ.Β ας", "ΑΣ École", "fly 42 x", "flying 42s", "X", "", "...", "² it", "𝒜the reou", "kinged is"]
    facts = props(spark, [(f"d{i}", Keyword(":text"), t) for i, t in enumerate(texts)])
    more = [v("s")] if relation == "text-search" else []
    plan = {"find": "o", "rules": [rule("o", [v("d"), *more], {"rel": relation, "args": [v("d"), Keyword(":text"), needle, *more]})]}
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "d string, t string")
    want = df.where(text.stem(F.col("t"), F.lit(needle))).select("d") if not more else df.select("d", text.score(F.col("t"), F.lit(needle)).alias("s")).where("s > 0")
    got = run(plan, Source(facts), spark)
    assert sorted(values(got.collect())) == sorted(map(tuple, want.collect()))
    if needle == "thes reou":
        assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


@pytest.mark.parametrize("relation", ["text-stem", "text-search"])
def test_constant_needles_stem_no_text(spark, relation, monkeypatch):
    """The words with a needle's stems are looked for; a needle of many words gives the same by stemming the texts."""
    from quadrille.plans import evaluate

    texts = ["the reou of", "The Reous; of OF of the, the the", "thes reouing of", "bathe reou often", "a the reou of b " + "x " * 60, "reou of the", "flies flied flyings", "fly", "of", "", "making makes", "maker reou reou", "Make reoued|of|thes"]
    facts = props(spark, [(f"d{i}", Keyword(":text"), t) for i, t in enumerate(texts)])
    more = [v("s")] if relation == "text-search" else []
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "d string, t string")
    for needle in ("The reou of", "fly", "reou make reou", "thes of"):
        want = df.where(text.stem(F.col("t"), F.lit(needle))).select("d") if not more else df.select("d", text.score(F.col("t"), F.lit(needle)).alias("s")).where("s > 0")
        for few in (64, 0):
            monkeypatch.setattr(evaluate, "FEW_WORDS", few, raising=False)
            got = run({"find": "o", "rules": [rule("o", [v("d"), *more], {"rel": relation, "args": [v("d"), Keyword(":text"), needle, *more]})]}, Source(facts), spark)
            assert sorted(values(got.collect())) == sorted(map(tuple, want.collect())) and values(got.collect()), (needle, few)
            assert few == 0 or "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stemming_finds_all_words_of_a_stem(spark):
    bases = "run fly make glass the bus kiss studi hop école ΑΣ x42 lov big see ties ox".split()
    words = {b + m + e + p for b in bases for m in ("", b[-1], "i", "y") for e in ("", "ing", "ed", "ied", "er", "est", "ly", "ies") for p in ("", "s", "es", "ies")}
    df = spark.createDataFrame([(w,) for w in words], "w string").select(F.lower("w").alias("w"))
    stemmed = df.select("w", text.english_stem(F.col("w"))).collect()
    assert len({s for _, s in stemmed}) > 200 and all(w in text.stemming(s) for w, s in stemmed)


def test_recursion_through_a_few_keys_broadcasts_them(spark, monkeypatch):
    """Most rows meet a few hubs: the hubs' rows go to them, and a distinct part is dealt by its first column."""
    from quadrille.plans import evaluate

    edges = {(i, i % 3) for i in range(40)} | {(0, 1), (1, 2), (2, 7), (7, 8)}
    facts = props(spark, [(a, EDGE, b) for a, b in sorted(edges)])
    reach = lambda a, b: {"rel": "r", "args": [v(a), v(b)]}
    rules = [rule("r", [v("a"), v("b")], t(v("a"), EDGE, v("b"))), rule("r", [v("a"), v("c")], reach("a", "b"), reach("b", "c"))]
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    for few in (evaluate.FEW_KEYS, 0):
        monkeypatch.setattr(evaluate, "FEW_KEYS", few)
        assert sorted(values(collected({"find": "r", "rules": rules}, facts, spark))) == sorted(want)
        step = parse({"find": "r", "rules": rules}).strata[0][1]
        known = facts.select(F.col("t1").alias("c0"), F.col("t3").alias("c1"))
        plan = evaluate.derived(step, lambda i, n: known, Source(facts), spark, looping=True)._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (few > 0)


def test_metadata_over_many_tasks(spark, monkeypatch, tmp_path):
    """A log is dealt over as many tasks as its rows need, with the same result."""
    events = spark.range(60).selectExpr("id as event_id", "id % 4 as user_id", "case when id % 5 = 0 then 'error' else 'click' end as event_type", "concat('{\"k\": ', id % 3, '}') as props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    for few in (history.TASK_ROWS, 3):
        monkeypatch.setattr(history, "TASK_ROWS", few)
        got, wanted = _as_sql(spark, tmp_path, "occurrence_metadata", "events")
        assert sorted(got) == sorted(wanted) and got
    plan = history.folded(tables.event_log(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count(", 20") >= 1


def _as_sql(spark, folder, name, *views):
    """A query's rows and those of its SQL over the folder's tables."""
    import duckdb

    db = duckdb.connect()
    for x in views:
        db.execute(f"create view {x} as select * from '{folder}/{x}.parquet/*.parquet'")
    return [tuple(r) for r in catalogue.queries()[name](spark, str(folder)).collect()], db.execute(catalogue.oracle_sql()[name]).fetchall()


def test_ids_of_a_table_need_no_distinct(spark, tmp_path):
    """theta_join's pairs aren't shuffled once more; a rule that drops an id keeps its distinct."""
    part = spark.range(60).selectExpr("id as p_partkey", "'t' || id % 2 as p_type", "cast(id % 3 as int) as p_size", "cast(id % 7 as double) as p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got, wanted = _as_sql(spark, tmp_path, "theta_join", "part")
    assert sorted(got) == sorted(wanted) and got
    assert "Aggregate" not in catalogue.theta_join(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    sizes = {"find": "o", "rules": [rule("o", [v("s")], t(v("p"), Keyword(":p_size"), v("s")))]}
    assert run(sizes, catalogue.facts(spark, str(tmp_path), "part.p_size"), spark).count() == 3


def test_theta_join_writes_few_bytes_a_pair(spark, tmp_path):
    """720,000 pairs of keys that many rows share, the same as its SQL, few texts over and over in each file."""
    import pathlib

    part = spark.range(2400).selectExpr("id as p_partkey", "'t' || id % 2 as p_type", "cast(id % 4 as int) as p_size", "cast(id * 7919 % 2411 as double) as p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    catalogue.theta_join(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got, wanted = spark.read.parquet(f"{tmp_path}/out"), _as_sql(spark, tmp_path, "theta_join", "part")[1]
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and len(wanted) > 700_000
    assert sum(f.stat().st_size for f in pathlib.Path(f"{tmp_path}/out").glob("*.parquet")) < len(wanted)


@pytest.mark.parametrize("op, key, turned", [("lt", True, False), ("le", False, False), ("gt", True, True), ("ge", True, False)])
def test_comparisons_between_rows_hold_in_tiles(spark, monkeypatch, op, key, turned):
    """Equal numbers, numbers as texts, values that are no number, nan, a second comparison, rows without a key in common."""
    from quadrille.plans import evaluate

    for name, n in (("MANY_MET", 1), ("TILE", 6), ("CHUNK", 2), ("SORTED_BY", 2)):
        monkeypatch.setattr(evaluate, name, n)
    df = spark.range(40).selectExpr("id", "id % 3 as k", "case when id % 11 = 5 then 'none' when id % 7 = 3 then null else cast(id % 9 - 4 as string) end as p", "case when id = 8 then double('nan') else id % 5 end as q")
    source = Source.from_tables(tables.Table(df, tables.tagged("x")(F.col("id")), ("id", "k", "p", "q"), unique=True))
    has = lambda *columns: [t(v(x), Keyword(f":{c}"), v(y)) for x, c, y in columns]
    a, b = has(("a", "id", "i"), ("a", "p", "p")), has(("b", "q", "q"), ("b", "id", "j"))
    if key:
        a, b = a + has(("a", "k", "k")), b + has(("b", "k", "k"))
    body = [*(b + a if turned else a + b), {"pred": op, "args": [v("p"), v("q")]}, {"pred": "ne", "args": [v("i"), v("j")]}]
    sign = {"lt": "<", "le": "<=", "gt": ">", "ge": ">="}[op]
    df.createOrReplaceTempView("tiled")
    wanted = spark.sql(f"select concat('x:', a.id), concat('x:', b.id) from tiled a join tiled b on a.id <> b.id and try_cast(a.p as double) {sign} b.q" + key * " and a.k = b.k").collect()
    for head, want in (([v("a"), v("b")], list(map(tuple, wanted))), ([v("a")], {(x,) for x, _ in wanted}), ([1], [(1,)])):
        assert sorted(values(run({"find": "o", "rules": [rule("o", head, *body)]}, source, spark).collect())) == sorted(want) and want


def test_page_ordered_breaks_ties_as_its_sql(spark, tmp_path):
    """Ids of one to five digits, all of one size."""
    spark.range(9990, 10045).union(spark.range(0, 110)).selectExpr("id as p_partkey", "7 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    got, wanted = _as_sql(spark, tmp_path, "page_ordered", "part")
    assert got == wanted and len({len(x) for x, _ in got}) > 1


GOOD = rule("o", [v("x")], t(v("x"), 1, v("y")))
BAD = {
    ":query-invalid-syntax": {"find": "o"},
    ":query-invalid-plan": {"find": "o", "rules": []},
    ":query-unknown-relation": {"find": "o", "rules": [rule("o", [v("x")], {"rel": "nope", "args": [v("x")]})]},
    ":query-arity": {"find": "o", "rules": [rule("o", [v("x")], {"rel": "triple", "args": [v("x")]})]},
    ":query-unbound-variable": {"find": "o", "rules": [rule("o", [v("z")], t(v("x"), 1, v("y")))]},
    ":query-base-shadow": {"find": "triple", "rules": [rule("triple", [v("x")], t(v("x"), 1, 2))]},
    ":query-invalid-comparison": {"find": "o", "rules": [rule("o", [v("x")], t(v("x"), 1, v("y")), {"pred": "like", "args": [v("x"), v("y")]})]},
    ":query-invalid-builtin": {"find": "o", "rules": [rule("o", [v("x")], t(v("x"), 1, v("y")), {"fn": "pow", "args": [v("x"), 2], "bind": "z"})]},
    ":query-recursive-builtin": {"find": "o", "rules": [GOOD, rule("o", [v("z")], {"rel": "o", "args": [v("x")]}, {"fn": "+", "args": [v("x"), 1], "bind": "z"})]},
    ":query-stratification": {"find": "o", "rules": [GOOD, rule("o", [v("x")], t(v("x"), 1, v("y")), {"rel": "o", "args": [v("y")], "neg": True})]},
    ":query-forward-reference": {"find": "o", "strata": [[rule("o", [v("x")], {"rel": "later", "args": [v("x")]})], [rule("later", [v("x")], t(v("x"), 1, 2))]]},
    ":query-invalid-find": {"find": "p", "rules": [GOOD]},
    ":query-invalid-aggregate": {"find": {"rel": "o", "group": [3], "agg": [{"op": "count"}]}, "rules": [GOOD]},
    ":query-invalid-having": {"find": {"rel": "o", "group": [], "agg": [{"op": "count"}], "having": [{"op": "eq", "agg": 1, "val": 2}]}, "rules": [GOOD]},
    ":query-invalid-order": {"find": "o", "rules": [GOOD], "order-by": [{"column": 1, "direction": "asc"}]},
    ":query-invalid-limit": {"find": "o", "rules": [GOOD], "limit": 0},
    ":query-text-negative": {"find": "o", "rules": [rule("o", [v("x")], t(v("x"), 1, v("y")), {"rel": "text-match", "args": [v("x"), 1, "a"], "neg": True})]},
    ":query-text-unbound-needle": {"find": "o", "rules": [rule("o", [v("x")], {"rel": "text-match", "args": [v("x"), 1, v("n")]})]},
    ":query-text-invalid-needle": {"find": "o", "rules": [rule("o", [v("x")], {"rel": "text-match", "args": [v("x"), 1, " . "]})]},
    ":query-invalid-term": {"find": "o", "rules": [rule("o", [v("x")], t(v("x"), 1, [1]))]},
    ":query-invalid-literal": {"find": "o", "rules": [rule("o", [v("x")], {"what": 1})]},
}


@pytest.mark.parametrize("code", BAD)
def test_refused_plans(code):
    with pytest.raises(QueryError) as e:
        parse(BAD[code])
    assert e.value.code == code


def fold(ops):
    stacks, gone = {}, []
    for seq, o, action, p in ops:
        stack = stacks.setdefault(p, [])
        if action == "assert":
            stack.append((seq, o))
        elif stack:
            gone.append((seq, o, *stack.pop()))
    return sorted((s, o, p) for p, stack in stacks.items() for s, o in stack), sorted(gone)


@pytest.mark.parametrize("seed", range(2))
def test_liveness_equals_a_stack_fold(spark, seed):
    rng = random.Random(seed)
    ops = [(i // 3 + 1, i % 3, rng.choice(["assert", "assert", "retract"]), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(ops, "seq long, ord int, action string, p int")
    log = tables.operations(df, "s", F.col("seq"), F.col("ord"), F.col("action"), terms.integer(F.col("p")), terms.literal("p"), terms.literal(1))
    for upper in (None, 60):
        snap = history.Snapshot(log, upper)
        live, gone = fold([o for o in ops if upper is None or o[0] <= upper])
        assert sorted((r.seq, r.ord, r.t1.i) for r in snap.live().collect()) == live
        assert sorted(tuple(r)[1:] for r in history.withdrawals(snap.prefix()).collect()) == gone
    since = history.Snapshot(log, 100, 50)
    live, _ = fold([o for o in ops if o[0] <= 100])
    assert {r.t1.i for r in since.triple().collect()} == {p for s, _, p in live if s > 50}
    with pytest.raises(QueryError, match="invalid-snapshot"):
        history.as_of(log, 10_000)


TEXTS = {"a": "The quick brown fox.", "b": "Quick foxes run", "c": "Café FÉTE", "d": "running runner", "e": "brown the fox quick"}


def test_text_relations(spark):
    facts = props(spark, [(k, "title", x) for k, x in TEXTS.items()] + [("n", "title", 5)])

    def hits(rel, needle):
        return sorted(x[0] for x in values(collected({"find": "o", "rules": [rule("o", [v("e")], {"rel": rel, "args": [v("e"), "title", needle]})]}, facts, spark)))

    assert hits("text-match", "fox QUICK") == ["a", "e"]
    assert hits("text-phrase", "quick brown fox") == ["a"]
    assert hits("text-substring", "OWN FO") == ["a"]
    assert hits("text-substring", "FÉ") == ["c"]
    assert hits("text-stem", "run") == ["b", "d"]
    stems = spark.createDataFrame([(w,) for w in "runs runner running studies making glass bus hopping quickly".split()], "w string").select(text.english_stem(F.col("w")))
    assert [r[0] for r in stems.collect()] == "run run run study make glass bus hop quick".split()
    body = [t(v("q"), "needle", v("n")), {"rel": "text-search", "args": [v("e"), "title", v("n"), v("s")]}]
    found = collected({"find": "o", "rules": [rule("o", [v("e"), v("s")], *body)]}, facts.unionAll(props(spark, [("q", "needle", "quick fox")])), spark)
    assert dict(values(found)) == {"a": 208, "b": 184, "e": 208}


def test_writes_leases_and_replacement(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), "s")
    a = Triple("x", "p", 1)
    assert log.commit([("assert", a), ("retract", a), ("retract", a)])["changed"] == [True, True, False]
    assert log.version() == 1 and log.scan().isEmpty()
    log.assert_(a, expected_version=1)
    with pytest.raises(QueryError, match="conflict"):
        log.assert_(a, expected_version=1)
    with pytest.raises(QueryError, match="subject-not-found"):
        log.assert_(Triple("nobody", "p", 1), subject="existing")
    Builder(log).replace("x", "p", 2).commit()
    assert [python(r["t3"]) for r in log.scan("x", "p").collect()] == [2]
    lease = log.acquire("res", "me", 100, now_ms=0)
    with pytest.raises(QueryError, match="lease-held"):
        log.acquire("res", "you", 100, now_ms=50)
    with pytest.raises(QueryError, match="fence"):
        log.assert_(a, fence=("res", "me", lease.epoch), now_ms=500)
    log.release("res", "me", lease.epoch)
    assert log.lease("res") is None


def test_slots_of_chains(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), i, f"v{i}", f"s{rng.randrange(4)}", None if rng.randrange(4) == 0 else i) for i in range(80)]
    overlays = spark.createDataFrame(rows, "chain int, place int, version string, slot string, value int")
    a, b = overlays.alias("a"), overlays.alias("b")
    pairs = a.join(b, F.expr("a.chain = b.chain and b.place <= a.place")).selectExpr("a.version", "b.version as ancestor", "a.place - b.place as distance")
    want = claims.resolved_slots(pairs, overlays.select("version", "slot", "value"))
    assert sorted(map(tuple, claims.chain_slots(overlays).collect())) == sorted(map(tuple, want.collect()))


def test_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = tables.read(spark, sf, "customer").count()
    assert catalogue.queries()["pull_nested"](spark, sf).groupBy("depth").count().orderBy("depth").collect() == [(0, n), (1, n)]
    live = {r.seq for r in history.live_occurrences(tables.event_log(spark, sf)).collect()}
    assert sorted(map(tuple, catalogue.queries()["view_occurrences"](spark, sf).collect())) == sorted((f"v{s % 2}", s) for s in live)
    assert sorted(r.seq for r in catalogue.queries()["superseded_view"](spark, sf).collect()) == sorted(s for s in live if s % 2 == 0)
    assert max(live) > 200


def strings_of(df):
    return sorted(tuple(x.s for x in r) for r in df.collect())


def test_markdown(spark, tmp_path):
    text = 'head\n@a\nowner  @me\ntag x, y\npart_of b\ntitle "two  words \\"q\\" \\\\ \\n"\nempty\n\n---\nSome text\n---\nmore\n'
    (tmp_path / "a.md").write_text(text)
    (tmp_path / "b.md").write_text("no subject\n---\nbody")
    (tmp_path / "c.md").write_text("@p\npredicate_name kind\npredicate_alias sort\n---\n")
    (tmp_path / "d.md").write_text("@kind\nvalue_kind ref\n---\n \n")
    (tmp_path / "e.md").write_text("@z\r\nsort big\r\n")
    found = tables.read_markdown(spark, str(tmp_path))
    assert strings_of(found) == sorted(
        [
            ("@a", "owner", "@me"), ("@a", "tag", "x, y"), ("@a", "part_of", "@b"), ("@a", "title", 'two  words "q" \\ \n'), ("@a", "empty", ""), ("@a", "body", "Some text\n---\nmore\n"),
            ("@p", "predicate_name", "kind"), ("@p", "predicate_alias", "sort"), ("@kind", "value_kind", "ref"), ("@z", "kind", "@big"),
        ]
    )
    out = {r["subject"]: r["text"] for r in tables.to_markdown(found).collect()}
    assert out["@a"] == '@a\ntitle  "two  words \\"q\\" \\\\ \\n"\nowner  "@me"\npart_of  @b\nempty  ""\ntag  "x, y"\n---\nSome text\n---\nmore\n'
    assert out["@z"] == "@z\nkind  @big\n---\n"
    (tmp_path / "out").mkdir()
    for i, x in enumerate(out.values()):
        (tmp_path / "out" / f"{i}.md").write_text(x)
    assert strings_of(tables.read_markdown(spark, str(tmp_path / "out"))) == strings_of(found)


def test_fact_streams(spark, tmp_path):
    (tmp_path / "x").write_text('[0 a b]\n@file f.clj\n[1 :calls 2]\n[1 :name "a b\\"c"]\n[broken\n@file g.clj\n[3 :name x]\n')
    assert sorted(map(tuple, tables.read_facts(spark, str(tmp_path)).collect())) == [("f.clj", "1", ":calls", "2"), ("f.clj", "1", ":name", 'a b"c'), ("g.clj", "3", ":name", "x")]


def test_logs_with_faults_are_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    log = Log(spark, path, "s")
    log.commit([("assert", Triple("a", "p", 1)), ("retract", Triple("a", "p", 1))])
    assert tables.load_log(spark, path).count() == 2
    tables.append_log(tables.read_log(spark, path).where("ord = 1"), path)
    with pytest.raises(QueryError, match="log-invalid"):
        tables.load_log(spark, path)
    assert tables.faults(tables.read_log(spark, path).limit(0)).count() == 0


def test_string_helpers(spark):
    from quadrille.functions import strings

    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0]["x"]
    slug = lambda x: one(strings.slugify(F.lit(x)))
    assert [slug(x) for x in ("Hello, World!", "  ", "__", "é", "A" * 59 + " b c")] == ["hello_world", "untitled", "untitled", "untitled", "a" * 59]
    assert one(strings.dashed_id(F.lit("20240131120005"))) == "2024-01-31-120005"
    assert [tuple(one(strings.split_kv(F.lit(x)))) for x in (" a  b c ", "a", "")] == [("a", "b c"), ("a", ""), ("", "")]
    assert [one(strings.is_reference(F.lit(x))) for x in ("@a", "@", "a", "@a b", "@a\n")] == [True, False, False, False, False]
    assert [one(strings.decoded_lease(F.lit(x))) is None for x in ("a|1|2", "a|1", "a|b|2", "a|1|2|3")] == [False, True, True, True]
    assert [one(strings.as_reference(F.lit(x), F.lit("ref"))) for x in ("a", "@a", "a b", "")] == ["@a", "@a", "a b", ""]
    assert one(strings.index_of(F.lit("abc"), F.lit("c"))) == 2 and one(strings.index_of(F.lit("abc"), F.lit("x"))) is None
    assert one(strings.repeated(F.lit("ab"), F.lit(-1))) == "" and one(strings.is_iso_datetime(F.lit("2024-01-02T03:04:05")))


def spaced(spark, space, triples):
    return props(spark, triples).withColumn("space", F.lit(space))


def test_profiles(spark):
    kind = lambda p, k=profile.KIND, m=profile.MODE: Triple(p, k, m)
    includes = lambda p, *rules: [(p, "includes", r) for r in rules]
    bad = [("", "p", 1), ("ok", Keyword(":a/b"), 1), ("ok", Keyword(":a/c"), 1), (Keyword(":a/c"), Keyword(":member_of"), "v"), ("ok", Keyword(":kernel/x"), 1)]
    every = [("s1", profile.ANCHOR, kind("p")), *includes("p", "R1", "R2", "R3", "R4", "R5"), *bad]
    four = [("s2", profile.ANCHOR, kind("p")), *includes("p", "R1", "R2", "R3", "R4"), *bad]
    three = [("s3", profile.ANCHOR, kind("p")), *includes("p", "R1", "R2", "R3"), *bad]
    other = [("s4", profile.ANCHOR, kind("p", m="enforce")), ("elsewhere", profile.ANCHOR, kind("p")), *includes("p", "R1", "R2", "R3", "R4"), *bad]
    whole = spaced(spark, "s1", every).unionByName(spaced(spark, "s2", four)).unionByName(spaced(spark, "s3", three)).unionByName(spaced(spark, "s4", other))
    assert sorted(map(tuple, profile.declared(whole).collect())) == [("s1", True), ("s2", False)]
    found = sorted((r["space"], python(r["t1"]), r["rule"]) for r in profile.validate(whole).collect())
    assert found == [("s1", "", "R2"), ("s1", "ok", "R5"), ("s2", "", "R2")]
    nested = profile.lint(props(spark, [(1, 2, NESTED), ("s1", profile.ANCHOR, kind("p"))]))
    assert sorted(r["rule"] for r in nested.collect()) == ["R1", "R2", "R3", "R4"]


def test_pull_patterns(spark):
    facts = [("x", "title", "Ship"), ("x", "tag", "red"), ("x", "tag", "blue"), ("x", "depends_on", "dep"), ("dep", "title", "Design"), ("a", "part_of", "x"), ("b", "part_of", "x")]
    facts += [("c1", "rel", "c2"), ("c2", "rel", "c3"), ("c3", "rel", "c4"), ("k1", "rel", "k2"), ("k2", "rel", "k1")]
    live, key = props(spark, facts), lambda x: f"s{len(x)}:{x}"

    def pulled(root, pattern, **how):
        roots = spark.createDataFrame([(key(root),)], "node string")
        return sorted((parse_key(r.node), r.attribute, parse_key(r.value), r.mark) for r in graph.pull_pattern(live, roots, pattern, **how).collect())

    assert pulled("x", ["title", "_part_of"]) == [("x", "_part_of", "a", None), ("x", "_part_of", "b", None), ("x", "title", "Ship", None)]
    assert pulled("x", [{"depends_on": ["title"]}]) == [("dep", "title", "Design", None), ("x", "depends_on", "dep", None)]
    assert len(pulled("x", ["*"])) == 4
    assert pulled("c1", [{"rel": "..."}], max_depth=2) == [("c1", "rel", "c2", None), ("c2", "rel", "c3", "truncated")]
    assert [r[2] for r in pulled("c1", [{"rel": 3}])] == ["c2", "c3", "c4"] and len(pulled("c1", [{"rel": 2}])) == 2
    assert pulled("k1", [{"rel": "..."}]) == [("k1", "rel", "k2", None), ("k2", "rel", "k1", "cycle")]
    for bad in ("x", [42], [{"a": 0}], [{}], [""], [{"a": [3]}]):
        with pytest.raises(QueryError, match="invalid-pattern"):
            graph.pull_pattern(live, spark.createDataFrame([("s1:x",)], "node string"), bad)


def test_ordered_pages(spark):
    facts = props(spark, [(f"r{i}", Keyword(":v"), x) for i, x in enumerate([3, 1.5, None or "t", Keyword(":k"), 2, 2, True, 3, Instant(4, 5), "t"])])
    plan = {"find": "out", "rules": [rule("out", [v("r"), v("m")], t(v("r"), Keyword(":v"), v("m")))]}
    for direction in ("asc", "desc"):
        ordered = plan | {"order-by": [{"column": 1, "direction": direction}]}
        whole = [r[:2] for r in collected(ordered, facts, spark)]
        for size in (1, 3, 10, 20):
            got, cursor = page(ordered, facts, spark, size)
            while cursor is not None:
                more, cursor = page(ordered, facts, spark, size, cursor)
                assert more
                got += more
            assert [r[:2] for r in got] == whole, (direction, size)
    _, cursor = page(ordered, facts, spark, 3)
    for other in (plan, plan | {"order-by": [{"column": 0, "direction": "desc"}]}):
        with pytest.raises(QueryError, match="cursor"):
            page(other, facts, spark, 3, cursor)
    with pytest.raises(QueryError, match="cursor"):
        page(ordered, facts, spark, 3, "nonsense")
    log = history.Snapshot(spark.createDataFrame([], tables.LOG).unionByName(tables.operations(facts, "s", F.lit(1), F.lit(0), F.lit("assert"), F.col("t1"), F.col("t2"), F.col("t3"))), 1)
    _, cursor = page(ordered, log, spark, 3)
    with pytest.raises(QueryError, match="cursor"):
        page(ordered, history.Snapshot(log.ops, 2), spark, 3, cursor)
    with pytest.raises(QueryError, match="too-large"):
        page(plan, props(spark, [("x" * (1 << 20), Keyword(":v"), 1)]), spark, 3)


def test_limits_of_recursion(spark):
    import time

    from quadrille.plans.evaluate import Limits

    facts = props(spark, [(i, EDGE, i + 1) for i in range(4)])
    plan = {"find": "r", "rules": [rule("r", [v("a"), v("b")], t(v("a"), EDGE, v("b"))), rule("r", [v("a"), v("c")], {"rel": "r", "args": [v("a"), v("b")]}, t(v("b"), EDGE, v("c")))]}
    for limits, code in ((Limits(rounds=1), "work-limit"), (Limits(until=time.monotonic() - 1), "time-limit"), (Limits(cancelled=lambda: True), "cancelled")):
        with pytest.raises(QueryError, match=code):
            run(plan, facts, spark, limits)
    assert run(plan, facts, spark, Limits(until=time.monotonic() + 600)).count() == 10


@pytest.mark.parametrize("broken", [{"order-by": 3}, {"rules": [3]}, {"rules": [rule("o", [v("x")]) | {"body": 3}]}, {"find": {"rel": "o", "group": 3, "agg": [{"op": "count"}]}}, {"find": {"rel": "o", "group": [], "agg": 4}}, {"rules": 5}, {"strata": [7]}])
def test_plans_of_wrong_types_are_refused(broken):
    form = {"find": "o", "rules": [GOOD]} | broken
    if "strata" in broken:
        form.pop("rules")
    with pytest.raises(QueryError):
        parse(form)
    for args in (3, None, "ab", [1]):
        for clause in ({"pred": "lt", "args": args}, {"fn": "+", "args": args, "bind": "z"}, {"rel": "triple", "args": args}):
            with pytest.raises(QueryError):
                parse({"find": "o", "rules": [rule("o", [v("x")], t(v("x"), 1, v("y")), clause)]})


def test_stars_of_tables_give_what_triples_give(spark):
    rows = [(1, "a", 5, "x", None), (2, "a", None, "y", 2.0), (3, "b", 5, "b", 1.0), (4, None, 7, "z", 7.0)]
    df = spark.createDataFrame(rows, "id long, name string, size int, other string, price double")
    table = tables.Table(df, F.concat(F.lit("t:"), F.col("id").cast("string")), ("name", "size", "other", "price"))
    fused, plain = Source.from_tables(table), Source(table.propositions(), distinct=True)
    k = lambda c: Keyword(f":{c}")
    bodies = [
        [t(v("s"), k("name"), v("n")), t(v("s"), k("size"), v("z"))],
        [t(v("s"), k("name"), "a"), t(v("s"), k("price"), v("z"))],
        [t(v("s"), k("name"), v("n")), t(v("s"), k("other"), v("n"))],
        [t(v("s"), k("size"), 5), t(v("r"), k("size"), 5), t(v("s"), k("name"), v("n")), t(v("r"), k("name"), v("z"))],
        [t(v("s"), k("size"), 5.0), t(v("s"), k("nothing"), v("n"))],
        [t(v("s"), v("p"), v("n")), t(v("s"), k("size"), v("z"))],
        [t(v("s"), k("name"), v("n")), t(v("r"), k("name"), v("n")), t(v("r"), k("size"), v("z")), t(v("s"), k("size"), v("y")), {"pred": "lt", "args": [v("y"), v("z")]}],
        [t("t:3", k("name"), v("n"))],
    ]
    for body in bodies:
        names = sorted({a["var"] for c in body for a in c["args"] if isinstance(a, dict)})
        plan = {"find": "o", "rules": [rule("o", [v(n) for n in names], *body)]}
        got, want = (sorted(map(repr, values(collected(plan, s, spark)))) for s in (fused, plain))
        assert got == want, body


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert sorted(map(tuple, graph.reach(edges, roots, 5).collect())) == [(1, 0), (2, 1), (3, 2)]
    assert sorted(r[0] for r in graph.dead(edges, spark.createDataFrame([(i,) for i in range(1, 6)], "node long"), roots).collect()) == [4, 5]


def test_stream_feeds_a_log(spark, tmp_path):
    from quadrille.streaming import ingest

    source, out = str(tmp_path / "in"), str(tmp_path / "log")
    log = Log(spark, source, "s")
    log.commit([("assert", Triple("a", "p", 1))])
    ingest.append(ingest.stream_log(spark, source), out, str(tmp_path / "cp")).awaitTermination(60)
    log.commit([("assert", Triple("b", "p", 1))])
    ingest.append(ingest.stream_log(spark, source), out, str(tmp_path / "cp")).awaitTermination(60)
    plan = {"find": "o", "rules": [rule("o", [v("x")], t(v("x"), "p", 1))]}
    assert values(ingest.follow(spark, out, plan, 1).collect()) == [("b",)]
    assert sorted(values(run(plan, history.current(tables.read_log(spark, out)), spark).collect())) == [("a",), ("b",)]


def test_nothing_outside_imports_llm():
    from pathlib import Path

    root = Path(__file__).parent.parent
    for f in (root / "quadrille").rglob("*.py"):
        assert "llm" in f.parts or "llm" not in f.read_text(), f
