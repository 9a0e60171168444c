import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import intervals as I
from siftwork.functions import scalars as S
from siftwork.operators import clones, graph, ordered, pairs, rewrite, search
from siftwork.operators.components import connected_components


def test_intervals(spark):
    df = spark.range(1)
    iv = lambda a, b, nz=False: I.interval(F.lit(a), F.lit(b), F.lit(nz))
    cols = {
        "meet": I.meet(iv(0, 5), iv(3, 9)), "none": I.meet(iv(0, 2), iv(3, 9)), "hull": I.join(iv(1, 2), iv(-4, -3)), "hull0": I.join(iv(0, 2), iv(-4, -3)), "wz": I.without_zero(iv(0, 0)), "wz2": I.without_zero(iv(0, 4)),
        "widen": I.widen(iv(0, 5), iv(-1, 5)), "neg": I.neg(iv(2, 5)), "abs": I.absolute(iv(-7, 5)), "mul": I.multiply(iv(-2, 3), iv(4, 5)), "div": I.divide(iv(-7, 7), iv(2, 3)), "div0": I.divide(iv(1, 2), iv(-1, 1)),
        "lt": I.less(iv(0, 1), iv(2, 3)), "lt?": I.less(iv(0, 2), iv(2, 3)), "lt!": I.less(iv(3, 4), iv(2, 3)), "eq": I.equal(iv(2, 2), iv(2, 2)), "eq?": I.equal(iv(1, 2), iv(2, 3)), "eq0": I.equal(iv(0, 0), iv(-1, 1, True)), "odd": I.odd(iv(-3, -3)),
        "wrap": I.wrap32(F.lit(2**31)), "muldiv": I.muldiv(F.lit(7), F.lit(10), F.lit(4)), "trunc": I.truncated(F.lit(-7), F.lit(2)), "by0": I.truncated(F.lit(1), F.lit(0)),
    }
    r = df.select(*[c.alias(k) for k, c in cols.items()]).first()
    t = lambda x: tuple(x) if x is not None else None
    assert t(r["meet"]) == (3, 5, False) and r["none"] is None and t(r["hull"]) == (-4, 2, True) and t(r["hull0"]) == (-4, 2, False)
    assert r["wz"] is None and t(r["wz2"]) == (1, 4, False) and t(r["widen"]) == (-(2**31), 5, False) and t(r["neg"]) == (-5, -2, False) and t(r["abs"]) == (0, 7, False)
    assert t(r["mul"]) == (-10, 15, False) and t(r["div"]) == (-3, 3, False) and r["div0"] is None
    assert r["lt"] is True and r["lt?"] is None and r["lt!"] is False and r["eq"] is True and r["eq?"] is None and r["eq0"] is False and r["odd"] is True
    assert r["wrap"] == -(2**31) and r["muldiv"] == 18 and r["trunc"] == -3 and r["by0"] is None


def test_set_lift_at_the_limit(spark):
    df = spark.createDataFrame([(g, v) for g, n in (("few", 8), ("many", 9)) for v in range(n)] + [("few", 3)], "g string, v int")
    got = {r["g"]: [tuple(m) for m in r["members"]] for r in I.set_lift(df, ["g"], "v").collect()}
    assert got["few"] == [(i, i) for i in range(8)] and got["many"] == [(0, 8)]


def test_scalars(spark):
    df = spark.createDataFrame([("The {B}ook, 2nd!", "https://doi.org/10.1/AbC", r"a \% b % c", "Doe, Jane")], "t string, d string, l string, a string")
    r = df.select(S.title_key(F.col("t")), S.doi(F.col("d")), S.doi(F.lit("no slash")), S.uncommented(F.col("l")), S.roman(F.lit(1994)), S.roman(F.lit(0)), S.hex_unescape(S.hex_escape(F.col("t"))), S.to_scaled(F.lit(1), F.lit("in")), S.to_scaled(F.lit(-1.5), F.lit("pt")), S.utf16_length(F.lit("a😀")), F.round(S.contrast(F.lit("000000"), F.lit("FFFFFF")), 2), S.citation_key(F.col("a"), F.lit("1999"), F.col("t")), S.excerpt(F.lit("a  b\nc"), 10), S.to_scaled(F.lit(1), F.lit("zz"))).first()
    assert list(r) == ["thebook2nd", "10.1/abc", None, r"a \% b ", "mcmxciv", "", "The {B}ook, 2nd!", 4736286, -98304, 3, 21.0, "doe1999", "a b c", None]


def test_balance_clamps_and_pairs(spark):
    ops = "())(()("
    df = spark.createDataFrame([(1, i, 1 if c == "(" else -1) for i, c in enumerate(ops)], "k int, i int, s int")
    rows = {r["i"]: (r["depth"], r["surplus"]) for r in ordered.balance(df, ["k"], ["i"], F.col("s")).collect()}
    assert [rows[i] for i in range(7)] == [(1, False), (0, False), (0, True), (1, False), (2, False), (1, False), (2, False)]
    pairs = {(r["open"], r["close"]) for r in ordered.pairs(df, ["k"], ["i"], F.col("s"), "i").collect()}
    assert pairs == {(0, 1), (None, 2), (3, None), (4, 5), (6, None)}


def test_match_kinds(spark):
    df = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "b", 1), (1, 2, "a", -1), (1, 3, "b", -1)], "k int, i int, kind string, step int")
    got = {(r["kind"], r["open"], r["close"]) for r in ordered.match_kinds(df, ["k"], ["i"], "kind", "step", "i").collect()}
    assert got == {("a", 0, 2), ("b", 1, None), ("b", None, 3)}


def test_as_of_and_running_text(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (1, 7, "z")], "k int, t int, v string")
    assert {(r["k"], r["t"], r["v"]) for r in ordered.as_of(left, right, ["k"], "t", ["v"]).collect()} == {(1, 5, "y"), (1, 1, None), (2, 9, None)}
    df = spark.createDataFrame([(1, i, "ab") for i in range(5)] + [(1, 9, None)], "k int, i int, t string")
    assert ordered.running_text(df, ["k"], ["i"], "t", 3).orderBy("i").collect()[-1]["running"] == "bab"


def _random_graph(seed, n=25, m=40):
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


def _reach(edges, start):
    seen, todo = {start}, [start]
    while todo:
        a = todo.pop()
        for x, y in edges:
            if x == a and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_against_brute_force(spark, seed):
    edges = _random_graph(seed)
    df = spark.createDataFrame(sorted(edges), "src long, dst long").withColumn("kind", F.lit(1))
    got = {r["node"] for r in graph.reach(df, spark.createDataFrame([(3,)], "node long")).collect()}
    assert got == _reach(edges, 3)
    at = {v: _reach(edges, v) for e in edges for v in e}
    want = {v: min(u for u in at if u in at[v] and v in at[u]) for v in at if any(u != v and u in at[v] and v in at[u] for u in at)}
    found = graph.cycles(df).collect()
    assert {r["node"]: r["component"] for r in found if r["kind"] == "mutual"} == want
    assert {r["node"] for r in found if r["kind"] == "direct"} == {a for a, b in edges if a == b and a not in want}
    both = edges | {(b, a) for a, b in edges}
    comp = {r["node"]: r["component"] for r in connected_components(df).collect()}
    real = {v for a, b in edges if a != b for v in (a, b)}
    assert comp == {v: min(_reach(both, v)) for v in real}


@pytest.mark.parametrize("together", [1 << 22, 0])
def test_closure_of_cycles_in_few_rounds(spark, monkeypatch, together):
    """A cycle is one step of a closure, however long; blocks of members and both ways to components give the same pairs."""
    monkeypatch.setattr(graph, "TOGETHER", together)
    monkeypatch.setattr(graph, "MEMBERS", 3)
    edges = {(i, (i + 1) % 12) for i in range(12)} | {(5, 20), (20, 21), (21, 20), (21, 30), (30, 30), (40, 0), (41, 40), (50, 51)}
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(sorted(edges), "src long, dst long"), max_rounds=6).collect()]
    starts = {a for a, _ in edges}
    want = {(a, b) for a in starts for x, y in edges if x == a for b in _reach(edges, y)}
    assert len(got) == len(set(got)) and set(got) == want
    names = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), (None, "a")], "src string, dst string")
    assert sorted(tuple(r) for r in graph.closure(names).collect()) == sorted((x, y) for x in "ab" for y in "abc")


@pytest.mark.parametrize("seed", range(4))
def test_closure_against_brute_force(spark, seed):
    edges = _random_graph(seed, 25, 30)
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, c in edges for b in _reach(edges, c)}


def test_near_pairs_of_one_large_group(spark, monkeypatch):
    """One group's pairs are made by many tasks, and values at the bounds, missing and odd ones count as in a plain join."""
    monkeypatch.setattr(pairs, "ROWS", 16)
    monkeypatch.setattr("siftwork.plans.shared.TASK_PAIRS", 500)
    rng = random.Random(3)
    values = [rng.choice([900.0, 900.5, 920.0, 920.5, -1e-20, 20.0, 1e300, float("inf"), float("nan"), None, rng.uniform(0, 100)]) for _ in range(300)]
    df = spark.createDataFrame([(i, "g" if i % 50 else None, v) for i, v in enumerate(values)], "k long, g string, v double").coalesce(1)
    got = pairs.near(df, "k", ["g"], "v", 0.5, 20.0)
    assert got.rdd.getNumPartitions() > 4
    a, b = df.alias("a"), df.alias("b")
    want = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.k") < F.col("b.k"))).filter("abs(a.v - b.v) BETWEEN 0.5 AND 20").select("a.k", "b.k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_masks_limits_and_empty(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (3, 4, 1)], "src long, dst long, kind int")
    start = spark.createDataFrame([(1,)], "node long")
    nodes = lambda **k: {r["node"] for r in graph.reach(df, start, **k).collect()}
    assert nodes() == {1, 2, 3, 4} and nodes(mask=1) == {1, 2} and nodes(limit=3) == {1, 2, 3} and nodes(forward=True) == {1} and nodes(max_depth=1) == {1, 2}
    empty = df.limit(0)
    assert graph.cycles(empty).count() == 0 and connected_components(empty).count() == 0 and graph.closure(empty).count() == 0
    tree = graph.load_tree(spark.createDataFrame([(0, 1, 1), (0, 2, 2), (2, 1, 3), (1, 3, 4)], "src long, dst long, at int"), spark.createDataFrame([(0,)], "node long"))
    assert {(r["node"], r["parent"], r["depth"]) for r in tree.collect()} == {(0, None, 0), (1, 0, 1), (2, 0, 1), (3, 1, 2)}


def test_long_chain_of_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long")
    assert {r["component"] for r in connected_components(df).collect()} == {0}


def test_edits():
    kept, dropped = rewrite.resolve([(0, 3, "x", 1), (2, 4, "y", 0), (3, 3, "z", 0), (3, 3, "w", 1)])
    assert kept == [(0, 3, "x", 1), (3, 3, "z", 0), (3, 3, "w", 1)] and dropped == [(2, 4, "y", 0)]


def test_fix_point_and_rollback(spark):
    docs = spark.createDataFrame([(1, "aaaa b"), (2, "c")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in rewrite.fix_point(docs, rewrite.replacements("aa", "a")).collect()}
    assert out == {1: "a b", 2: "c"}
    worse = lambda d: d.select("doc_id", F.when(F.contains("text", F.lit("aaa b")), 0).when(F.contains("text", F.lit("aaaa b")), 0).otherwise(1).alias("n"))
    out = {r["doc_id"]: r["text"] for r in rewrite.fix_point(docs, rewrite.replacements("aa", "a"), worse).collect()}
    assert out[1] == "aaa b"


def test_line_diff():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(7))] for _ in range(2))
        d = rewrite.line_diff(a, b)
        assert [x for s, x in d if s != "+"] == a and [x for s, x in d if s != "-"] == b
    assert rewrite.line_diff(["x", "a"], ["x", "b"], cells=0) == [(" ", "x"), ("-", "a"), ("+", "b")]


def test_fuzzy(spark):
    df = spark.createDataFrame([("section", "start a section"), ("subsection", ""), ("setcion", ""), ("part", "sections of a book"), ("other", "nothing")], "name string, about string")
    got = {r["name"]: r["tier"] for r in search.fuzzy(df, "section", "name", "about").collect()}
    assert got == {"section": "exact", "subsection": "part", "setcion": "name_fuzzy", "part": "word"}
    assert search.prefix_distance("abcd", "abdcxyz") == 1 and search.prefix_distance("abc", "xabc") == 1


def test_literal_is_no_pattern(spark):
    df = spark.createDataFrame([("1", "a.b"), ("2", "axb")], "id string, t string")
    assert [r["id"] for r in search.literal("a.b", x=(df, "id", "t")).collect()] == ["1"] and search.literal("", x=(df, "id", "t")).count() == 0


def test_clones_past_partial_copies(spark):
    """A passage whose start also stands elsewhere, before and between, is matched whole."""
    w = [f"\\a{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = [" ".join(["\\e", *w[:30]]), " ".join(["\\x", *w]), " ".join([*w[:30], "\\y"]), " ".join(w)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {(r["a_doc"], r["b_doc"], r["a_first"], r["b_first"], r["shared"]) for r in clones.clones(docs).collect()}
    assert rows == {(1, 3, 1, 0, 60)}


def test_clones(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    part = [word() for _ in range(60)]
    other = part[:30] + [word()] + part[31:]
    docs = spark.createDataFrame([(1, " ".join([word() for _ in range(20)] + part)), (2, " ".join([word() for _ in range(9)] + other)), (3, " ".join(word() for _ in range(80))), (4, None)], "doc_id long, text string")
    rows = clones.clones(docs).collect()
    assert len(rows) == 1 and (rows[0]["a_doc"], rows[0]["b_doc"]) == (1, 2) and rows[0]["b_first"] == 9 and rows[0]["b_last"] == 68


def test_windows_travel_packed(spark):
    """Counts of recurring windows against brute force, and not a row a window between the tasks."""
    rng = random.Random(9)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(40))] for _ in range(50)]
    lists = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t array<string>").select("doc_id", F.transform("t", lambda x: F.xxhash64(x)).alias("h"))
    seen = {}
    for t in texts:
        for w in {tuple(t[i : i + 4]) for i in range(len(t) - 3)}:
            seen[w] = seen.get(w, 0) + 1
    again = [n for n in seen.values() if n > 1]
    assert tuple(clones.recurring(lists, 4).first()) == (len(again), sum(again)) and tuple(clones.recurring(lists.limit(0), 4).first()) == (0, None)
    docs = lists.select("doc_id", F.lit("some text").alias("text"))
    plan = clones.recurring(lists, 4)._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning(bucket" in plan and "key#" in plan and clones.clones(docs).count() == 0


@pytest.mark.parametrize("seed, shared", [(3, 7), (3, 9), (7, 5)])
def test_clones_against_brute_force(spark, seed, shared):
    """Runs of matched windows as their definition says, for windows that make up longer ones and for those that don't."""
    rng = random.Random(seed * shared)
    texts = [[rng.choice(["a", "b", "7"]) for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    room, found = int(shared * 0.15 / 0.85) + seed, {}
    for size, gap, first in ((seed, room, False), (shared, 1, True)):
        places = {}
        for d, t in enumerate(texts):
            for i in range(len(t) - size + 1):
                places.setdefault(tuple(t[i : i + size]), []).append((d, i))
        lines = {}
        for p in places.values():
            for k in range(1, len(p)):
                (a, i), (b, j) = p[0 if first else k - 1], p[k]
                if a != b or j - i >= seed:
                    lines.setdefault((a, b, j - i), []).append(j)
        for (a, b, d), js in lines.items():
            run = []
            for j in [*sorted(js), None]:
                if run and (j is None or j - run[-1] > gap):
                    held = size + sum(min(y - x, size) for x, y in zip(run, run[1:]))
                    values = sum(texts[b][x] == "7" for x in run) / len(run)
                    if held >= shared and held >= 0.85 * (run[-1] + size - run[0]) and values <= 0.5:
                        found.setdefault((a, b, d, run[0]), []).append((run[-1] + size - 1, held))
                    run = []
                run.append(j)
    want = {(a, j - d, max(m)[0] - d, b, j, *max(m)) for (a, b, d, j), m in found.items()}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert want and {tuple(r) for r in clones.clones(docs, seed=seed, shared=shared).collect()} == want
