"""The registered queries over the provided tables, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork import fact_queries, sinks
from siftwork.functions import intervals, parsing, scalars
from siftwork.functions.filters import PRESENT, apply_filter
from siftwork.operators import clones, components, graph, ordered, pairs, rewrite, search
from siftwork.plans.shared import spread
from siftwork.sources.tables import table
from siftwork.streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@register("gaps_rollup", """SELECT event_type, count(*) AS total, arg_min(event_id, (ts, event_id)) AS first_site FROM events WHERE event_type <> 'view' AND value > 5 GROUP BY event_type""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_filter(table(spark, sf_dir, "events"), 'event_type != "view" and value > 5')
    return ordered.rollup(rows.withColumn("one", F.lit(1)), "event_type", "one", ["ts", "event_id"], "event_id")


# --- the filter language


def _filtered(name: str, of: str, text: str, columns: list[str], sql: str) -> None:
    register(name, sql)(lambda spark, sf_dir: apply_filter(table(spark, sf_dir, of), text).select(*columns))


_filtered("filter_eq", "documents", "lang = fr", ["doc_id", "source"], "SELECT doc_id, source FROM documents WHERE lang = 'fr'")
_filtered("filter_regex", "documents", "text ~ '[Ll]icen[sc]ed under'", ["doc_id"], "SELECT doc_id FROM documents WHERE regexp_matches(text, '[Ll]icen[sc]ed under')")
_filtered("filter_not_regex", "part", "p_name !~ '^[a-m]'", ["p_partkey"], "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '^[a-m]')")
_filtered("filter_contains", "documents", "text ~= 'token = '", ["doc_id"], "SELECT doc_id FROM documents WHERE contains(text, 'token = ')")
_filtered("filter_numeric", "orders", "o_totalprice >= 250000 && o_orderstatus != F", ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus <> 'F'")
_filtered("filter_nested", "part", "(p_size < 10 or p_size > 45) and not (p_brand ~= '1' || p_type ~ 'STEEL$')", ["p_partkey"], "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size > 45) AND NOT (contains(p_brand, '1') OR regexp_matches(p_type, 'STEEL$'))")
_filtered("filter_text_is_no_number", "part", "not p_name > 5", ["p_partkey"], "SELECT p_partkey FROM part")


@register("filter_ne_missing", """WITH e AS (SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN json_extract_string(props, '$.k') END AS k FROM events)
SELECT event_id FROM e WHERE NOT (event_type <> 'view' AND coalesce(k, '') <> '3') AND NOT (event_type <> 'view' AND contains(coalesce(k, ''), '7'))""")
def filter_ne_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that views lack: every test on it is false for them, so its negation is true."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    held = F.when(F.col("event_type") != "view", F.array(F.lit("k"), F.lit("event_id"))).otherwise(F.array(F.lit("event_id")))
    rows = rows.withColumn("k", F.when(F.col("event_type") != "view", F.col("k"))).withColumn(PRESENT, held)
    return apply_filter(rows, "not k != 3 and not k ~= 7").select("event_id")


# --- roll-ups, joins, duplicates


@register("distribution_counts", "SELECT lang, source, count(*) AS files FROM documents GROUP BY lang, source")
def distribution_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("files"))


@register("undefined_reference", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def undefined_reference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@register("unused_order", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unused_order(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(used, "o_orderkey", "left_anti")


@register("unused_definition", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def unused_definition(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@register("cited_documents", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cited_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@register("dependencies_lookup", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def dependencies_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@register("duplicate_key_sites", "SELECT doc_id, first_site FROM (SELECT doc_id, first_value(doc_id) OVER w AS first_site, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)) WHERE n > 1")
def duplicate_key_sites(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("t"))
    return ordered.rest_of_duplicates(rows, ["t"], ["doc_id"], "doc_id").select("doc_id", "first_site")


@register("duplicate_docs", "SELECT min(doc_id) AS first_site, count(*) AS places FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_docs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("t")).agg(F.min("doc_id").alias("first_site"), F.count(F.lit(1)).alias("places"))
    return rows.filter("places > 1").select("first_site", "places")


@register("duplicate_work", r"""WITH t AS (SELECT doc_id, lower(regexp_replace(string_split(text, chr(10))[1], '[^\p{L}\p{N}]', '', 'g')) AS k FROM documents)
SELECT k AS title, count(*) AS entries, min(doc_id) AS first_site FROM t WHERE strlen(k) > 8 GROUP BY k HAVING count(*) > 1""")
def duplicate_work(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", scalars.title_key(F.substring_index("text", "\n", 1)).alias("title")).filter(F.octet_length("title") > 8)
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("entries"), F.min("doc_id").alias("first_site")).filter("entries > 1")


@register("duplicate_value_earlier", "SELECT p_partkey, first_site FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_size, p_retailprice) AS first_site FROM part) WHERE p_partkey > first_site")
def duplicate_value_earlier(spark, sf_dir):
    return ordered.earlier_equal(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["p_partkey"], "p_partkey").select("p_partkey", "first_site")


@register("conflicting_definition", "SELECT p_name, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def conflicting_definition(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("brands")).filter("brands > 1")


@register("last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ordered.last_wins(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@register("shares_of_total", "SELECT l_returnflag || l_linestatus AS k, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS amount FROM lineitem GROUP BY 1 HAVING sum(cast(l_quantity AS BIGINT)) >= 0.15 * (SELECT sum(cast(l_quantity AS BIGINT)) FROM lineitem)")
def shares_of_total(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), F.col("l_quantity").cast("long").alias("q"))
    return ordered.shares(rows, "k", "q", 0.15).select("k", "amount")


@register("precision_spread", "SELECT l_linenumber, min(cast(round(l_extendedprice * 100) AS BIGINT) % 10) AS lo, max(cast(round(l_extendedprice * 100) AS BIGINT) % 10) AS hi FROM lineitem GROUP BY l_linenumber")
def precision_spread(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") % 10
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.min(cents).alias("lo"), F.max(cents).alias("hi"))


@register("settings_difference", "SELECT coalesce(a.t, b.t) AS event_type, a.n AS low_users, b.n AS high_users FROM (SELECT event_type t, count(*) n FROM events WHERE user_id < 20 GROUP BY 1) a FULL JOIN (SELECT event_type t, count(*) n FROM events WHERE user_id >= 20 GROUP BY 1) b ON a.t = b.t WHERE a.n IS DISTINCT FROM b.n")
def settings_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.filter("user_id < 20").groupBy("event_type").agg(F.count(F.lit(1)).alias("low_users"))
    b = e.filter("user_id >= 20").groupBy("event_type").agg(F.count(F.lit(1)).alias("high_users"))
    return a.join(b, "event_type", "full").filter(~F.col("low_users").eqNullSafe(F.col("high_users")))


@register("near_pairs", "SELECT a.p_partkey AS p_partkey, b.p_partkey AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE abs(a.p_retailprice - b.p_retailprice) BETWEEN 0.5 AND 20")
def near_pairs(spark, sf_dir):
    return pairs.near(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size"], "p_retailprice", 0.5, 20.0)


# --- ordered operators


@register("summary_tags", "SELECT user_id, array_to_string(list(event_type ORDER BY first_at), ',') AS tags FROM (SELECT user_id, event_type, min((ts, event_id)) AS first_at FROM events GROUP BY 1, 2) GROUP BY user_id")
def summary_tags(spark, sf_dir):
    rows = ordered.first_seen_list(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])
    return rows.select("user_id", F.array_join("values", ",").alias("tags"))


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w)).filter("before IS NOT NULL")


_MOVES = "SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS name, event_type AS callee, value FROM events"


@register("calls_distinct", f"SELECT DISTINCT name, callee FROM ({_MOVES}) WHERE name IS NOT NULL")
def calls_distinct(spark, sf_dir):
    return graph.calls(_transitions(spark, sf_dir).select(F.col("before").alias("src"), F.col("event_type").alias("dst"))).select(F.col("src").alias("name"), F.col("dst").alias("callee"))


@register("call_edges_bits", f"SELECT name AS src, callee AS dst, bit_or(1 << cast(least(floor(value / 40), 5) AS INTEGER)) AS kind FROM ({_MOVES}) WHERE name IS NOT NULL GROUP BY 1, 2")
def call_edges_bits(spark, sf_dir):
    kind = F.expr("shiftleft(1, cast(least(floor(value / 40), 5) AS INT))")
    return graph.merge_edges(_transitions(spark, sf_dir).select(F.col("before").alias("src"), F.col("event_type").alias("dst"), kind.alias("kind")))


_STACK = """WITH s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS step FROM events WHERE event_type IN ('signup', 'error')),
r AS (SELECT *, sum(step) OVER w AS total FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, least(0, min(total) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS low FROM r),
b AS (SELECT *, lag(low, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM l)"""


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type IN ('signup', 'error')").withColumn("step", F.when(F.col("event_type") == "signup", 1).otherwise(-1))


@register("unbalanced_stack", _STACK + " SELECT event_id, cast(total - low AS BIGINT) AS depth, low < was AS surplus FROM b")
def unbalanced_stack(spark, sf_dir):
    rows = ordered.balance(_stack(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("step"))
    return rows.select("event_id", F.col("depth").cast("long").alias("depth"), "surplus")


@register("environment_pairs", _STACK + """, d AS (SELECT *, CASE WHEN low < was THEN 0 WHEN step > 0 THEN total - low ELSE total - low + 1 END AS level FROM b),
n AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id, level ORDER BY ts, event_id) AS nxt, lead(step) OVER (PARTITION BY user_id, level ORDER BY ts, event_id) AS nstep FROM d)
SELECT user_id, event_id AS opened, CASE WHEN nstep < 0 THEN nxt END AS closed, cast(level AS BIGINT) AS depth FROM n WHERE step > 0 UNION ALL SELECT user_id, NULL, event_id, 0 FROM n WHERE low < was""")
def environment_pairs(spark, sf_dir):
    rows = ordered.pairs(_stack(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("step"), "event_id")
    return rows.select("user_id", F.col("open").alias("opened"), F.col("close").alias("closed"), F.col("depth").cast("long").alias("depth"))


@register("as_of_definition", "SELECT p.event_id, s.event_id AS signup FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts")
def as_of_definition(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    signups = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup"))
    return ordered.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), signups, ["user_id"], "ts", ["signup"]).select("event_id", "signup")


@register("dead_definition", "SELECT event_id FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE event_type = 'signup' AND nxt = 'signup'")
def dead_definition(spark, sf_dir):
    return ordered.dead_stores(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id")


@register("adjacent_repeats", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b = event_type")
def adjacent_repeats(spark, sf_dir):
    return ordered.adjacent_repeats(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@register("trace_running_text", "SELECT conv_id, turn, right(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 200) AS running FROM conversations WHERE length(text) > 0")
def trace_running_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return ordered.running_text(rows, ["conv_id"], ["turn"], "text").select("conv_id", "turn", "running")


@register("first_missing_end", "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) <> 'assistant'")
def first_missing_end(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))
    return rows.filter("role <> 'assistant'").select("conv_id", "turn")


@register("span_containment", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY")
def span_containment(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("lo"), F.expr("o_orderdate + INTERVAL 30 DAYS").alias("hi"))
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return ordered.containing(points, spans, ["l_orderkey"], "l_shipdate", "lo", "hi").select("l_orderkey", "l_linenumber")


# --- graphs: who buys next


_CHAIN = "WITH RECURSIVE c AS (SELECT user_id AS dst, lag(user_id) OVER (ORDER BY ts, event_id) AS src FROM events WHERE event_type = 'purchase'), e AS (SELECT DISTINCT src, dst FROM c WHERE src IS NOT NULL)"


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a buyer to the next one in time, over the whole stream.

    The row before is found without one partition for all: ranks within days, and the last row of the day before.
    """
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    w = W.partitionBy("day").orderBy("ts", "event_id")
    rows = rows.withColumn("src", F.lag("user_id").over(w))
    last = rows.groupBy("day").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    days = last.select("day", F.lag("last").over(W.orderBy("day")).alias("carried"))  # one row a day
    return rows.join(F.broadcast(days), "day").select(F.coalesce("src", "carried").alias("src"), F.col("user_id").alias("dst")).filter("src IS NOT NULL").distinct()


@register("slice_backward", _CHAIN + ", r AS (SELECT 7::BIGINT AS node UNION SELECT e.dst FROM e JOIN r ON e.src = r.node) SELECT node FROM r")
def slice_backward(spark, sf_dir):
    start = spark.createDataFrame([(7,)], "node long")
    return graph.reach(_chain(spark, sf_dir), start).select("node")


@register("slice_forward", _CHAIN + ", r AS (SELECT 7::BIGINT AS node UNION SELECT e.src FROM e JOIN r ON e.dst = r.node) SELECT node FROM r")
def slice_forward(spark, sf_dir):
    return graph.reach(_chain(spark, sf_dir), spark.createDataFrame([(7,)], "node long"), forward=True).select("node")


@register("slice_limit", _CHAIN + ", r AS (SELECT 7::BIGINT AS node UNION SELECT e.dst FROM e JOIN r ON e.src = r.node WHERE e.dst <= 60) SELECT node FROM r")
def slice_limit(spark, sf_dir):
    return graph.reach(_chain(spark, sf_dir), spark.createDataFrame([(7,)], "node long"), limit=60).select("node")


@register("bounded_walk", _CHAIN + ", r AS (SELECT 7::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM e JOIN r ON e.src = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def bounded_walk(spark, sf_dir):
    return graph.reach(_chain(spark, sf_dir), spark.createDataFrame([(7,)], "node long"), max_depth=3)


@register("recursion_scc", _CHAIN + ", r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), p AS (SELECT DISTINCT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) SELECT node, min(other) AS component, CASE WHEN count(*) > 1 THEN 'mutual' ELSE 'direct' END AS kind FROM p GROUP BY node")
def recursion_scc(spark, sf_dir):
    return graph.cycles(_chain(spark, sf_dir))


@register("transitive_closure", _CHAIN + ", r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def transitive_closure(spark, sf_dir):
    return graph.closure(_chain(spark, sf_dir))


@register("connected_groups", _CHAIN + ", u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a) SELECT node, min(other) AS component FROM r WHERE node IN (SELECT a FROM u WHERE a <> b) GROUP BY node")
def connected_groups(spark, sf_dir):
    return components.connected_components(_chain(spark, sf_dir))


@register("dependency_graph", _CHAIN + " SELECT src AS node, string_agg(cast(dst AS VARCHAR), ',' ORDER BY dst) AS edges FROM e GROUP BY src")
def dependency_graph(spark, sf_dir):
    e = _chain(spark, sf_dir)
    rows = graph.adjacency(e.select(F.col("src").alias("node")).distinct(), e.withColumn("kind", F.lit(1)))
    return rows.select("node", F.array_join(F.transform("edges", lambda x: x["dst"].cast("string")), ",").alias("edges"))


@register("dot_lines", _CHAIN + " SELECT '  n' || src || ' -> n' || dst || ';' AS line FROM e UNION ALL SELECT '  n' || n || ' [label=\"' || n || '\"];' FROM (SELECT src AS n FROM e UNION SELECT dst FROM e) UNION ALL SELECT 'digraph {' UNION ALL SELECT '}'")
def dot_lines(spark, sf_dir):
    e = _chain(spark, sf_dir)
    v = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("name", F.col("node").cast("string"))
    return graph.dot(v, e)


# --- intervals


_IV = "WITH v AS (SELECT p_brand, p_partkey, p_size - 25 AS lo, p_size - 25 + cast(p_partkey % 7 AS INTEGER) AS hi FROM part)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.col("p_size") - 25
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", intervals.interval(lo, lo + F.col("p_partkey") % 7).alias("v"))


@register("interval_join", _IV + ", j AS (SELECT p_brand, min(lo) AS lo, max(hi) AS hi, bool_and(lo > 0 OR hi < 0) AS nz FROM v GROUP BY p_brand) SELECT p_brand, cast(CASE WHEN nz AND lo = 0 THEN 1 ELSE lo END AS BIGINT) AS lo, cast(CASE WHEN nz AND hi = 0 THEN -1 ELSE hi END AS BIGINT) AS hi, nz AND lo < 0 AND hi > 0 AS nz FROM j")
def interval_join(spark, sf_dir):
    return _values(spark, sf_dir).groupBy("p_brand").agg(intervals.join_all(F.col("v")).alias("j")).select("p_brand", "j.*")


@register("interval_meet", _IV + " SELECT p_partkey, cast(greatest(lo, -3) AS BIGINT) AS lo, cast(least(hi, 8) AS BIGINT) AS hi FROM v WHERE greatest(lo, -3) <= least(hi, 8)")
def interval_meet(spark, sf_dir):
    m = intervals.meet(F.col("v"), intervals.interval(F.lit(-3), F.lit(8)))
    return _values(spark, sf_dir).select("p_partkey", m.alias("m")).filter("m IS NOT NULL").select("p_partkey", "m.lo", "m.hi")


@register("interval_compare", _IV + " SELECT p_partkey, CASE WHEN hi < 2 THEN true WHEN lo >= 5 THEN false END AS below, CASE WHEN lo = hi THEN lo % 2 <> 0 END AS odd FROM v")
def interval_compare(spark, sf_dir):
    b = intervals.interval(F.lit(2), F.lit(5))
    return _values(spark, sf_dir).select("p_partkey", intervals.less(F.col("v"), b).alias("below"), intervals.odd(F.col("v")).alias("odd"))


@register("set_lift", "WITH d AS (SELECT p_brand, p_type, count(DISTINCT p_size) AS n, min(p_size) AS lo, max(p_size) AS hi, string_agg(DISTINCT cast(p_size AS VARCHAR), ',' ORDER BY cast(p_size AS VARCHAR)) AS few FROM part GROUP BY 1, 2) SELECT p_brand, p_type, CASE WHEN n <= 4 THEN few ELSE lo || '..' || hi END AS members FROM d")
def set_lift(spark, sf_dir):
    rows = intervals.set_lift(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size"), ["p_brand", "p_type"], "p_size", 4)
    points = F.array_join(F.array_sort(F.transform("members", lambda m: m["lo"].cast("string"))), ",")
    hull = F.concat(F.col("members")[0]["lo"].cast("string"), F.lit(".."), F.col("members")[0]["hi"].cast("string"))
    return rows.select("p_brand", "p_type", F.when((F.size("members") == 1) & (F.col("members")[0]["lo"] != F.col("members")[0]["hi"]), hull).otherwise(points).alias("members"))


@register("fixed_arithmetic", "SELECT o_orderkey, ((o_orderkey * 1234567 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS wrapped, CASE WHEN o_custkey % 5 <> 2 THEN (3 - o_orderkey) // (o_custkey % 5 - 2) END AS quotient FROM orders")
def fixed_arithmetic(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", intervals.wrap32(k * 1234567).alias("wrapped"), intervals.truncated(3 - k, c % 5 - 2).alias("quotient"))


@register("scalar_texts", "SELECT n_nationkey, upper(md5(n_name)) AS digest, hex(encode(n_name)) AS escaped, CASE WHEN n_name = 'FRANCE' THEN 0 WHEN n_name < 'FRANCE' THEN -1 ELSE 1 END AS ordered FROM nation")
def scalar_texts(spark, sf_dir):
    n = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.md5_upper(n).alias("digest"), scalars.hex_escape(n).alias("escaped"), scalars.compare(n, F.lit("FRANCE")).alias("ordered"))


_UNITS = ["pt", "in", "cm", "bp", "sp"]


@register("scalar_parses", """WITH p AS (SELECT p_partkey, p_size, CAST(p_size AS BIGINT) * 1000 + p_partkey % 1000 AS num, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END AS sign, p_partkey % 5 AS u FROM part)
SELECT p_partkey, cast(sign * ((((num * 131072 + 1000) // 2000) * CASE u WHEN 1 THEN 7227 WHEN 2 THEN 7227 WHEN 3 THEN 7227 ELSE 1 END) // CASE u WHEN 1 THEN 100 WHEN 2 THEN 254 WHEN 3 THEN 7200 WHEN 4 THEN 65536 ELSE 1 END) AS BIGINT) AS scaled, true AS reads_back, p_partkey AS number, cast((2 * (p_partkey + 3) * p_size + 7) // 14 AS BIGINT) AS value, printf('#%02x%02x%02x', cast(floor(p_size / 50.0 * 255 + 0.5) AS INTEGER), 255, 0) AS colour, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE -9 END AS low, CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 0 END AS high FROM p""")
def scalar_parses(spark, sf_dir):
    """Lengths, numbers, expressions and colours written as text and read again."""
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    size = F.concat(F.when(F.col("p_partkey") % 3 == 0, "- ").otherwise(""), F.col("p_size"), F.lit("."), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), unit)
    scaled = parsing.parse_dimension(size)
    draw = intervals.uniform(F.when(F.col("p_partkey") % 2 == 0, 10).otherwise(-10))
    colour = parsing.rgb_hex(parsing.driver_rgb(F.concat(F.lit("rgb "), (F.col("p_size") / 50).cast("string"), F.lit(" 1 0"))))
    value = parsing.evaluate(F.concat(F.lit("("), "p_partkey", F.lit("+3)*"), "p_size", F.lit("/7")))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).withColumn("scaled", scaled)
    return rows.select("p_partkey", "scaled", (parsing.parse_dimension(parsing.render_dimension(F.col("scaled"))) == F.col("scaled")).alias("reads_back"), parsing.parse_integer(F.concat(F.lit('"'), F.hex("p_partkey"))).alias("number"), value.alias("value"), colour.alias("colour"), draw["lo"].cast("int").alias("low"), draw["hi"].cast("int").alias("high"))


@register("graph_json", "SELECT '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS line FROM nation UNION ALL SELECT '{\"src\":' || n_nationkey || ',\"dst\":' || n_regionkey || ',\"kind\":1}' FROM nation")
def graph_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return graph.json_lines(n.select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name")), n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.lit(1).alias("kind")))


# --- texts


@register("user_pattern", r"SELECT doc_id, len(regexp_extract_all(text, '[a-z]+[.][0-9]+@[a-z0-9.]+')) AS hits FROM documents WHERE regexp_matches(text, '[a-z]+[.][0-9]+@[a-z0-9.]+')")
def user_pattern(spark, sf_dir):
    p = r"[a-z]+[.][0-9]+@[a-z0-9.]+"
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(p)).select("doc_id", F.regexp_count("text", F.lit(p)).cast("long").alias("hits"))


@register("sentence_capital", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[a-z]{2}[.!?] +[a-z]{2}')")
def sentence_capital(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("[a-z]{2}[.!?] +[a-z]{2}")).select("doc_id")


@register("junk_runs", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[#$%&*]{3}')")
def junk_runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("[#$%&*]{3}")).select("doc_id")


@register("doubled_words", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS s FROM documents), p AS (SELECT doc_id, len([i FOR i IN range(1, len(s)) IF s[i] = s[i + 1] AND s[i] <> '']) AS repeats FROM w) SELECT doc_id, repeats FROM p WHERE repeats > 0")
def doubled_words(spark, sf_dir):
    s = F.split("text", " ")
    twice = F.size(F.filter(F.arrays_zip(F.slice(s, F.lit(1), F.size(s) - 1).alias("a"), F.slice(s, F.lit(2), F.size(s)).alias("b")), lambda x: (x["a"] == x["b"]) & (x["a"] != "")))
    return table(spark, sf_dir, "documents").select("doc_id", twice.cast("long").alias("repeats")).filter("repeats > 0")


@register("repeated_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) > 20 GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") > 20)
    return rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@register("unbalanced_tags", "SELECT page_id, len(regexp_extract_all(html, '<p>')) AS opened, len(regexp_extract_all(html, '</p>')) AS closed FROM pages WHERE len(regexp_extract_all(html, '<p>')) <> len(regexp_extract_all(html, '</p>'))")
def unbalanced_tags(spark, sf_dir):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("<p>").alias("opened"), n("</p>").alias("closed")).filter("opened <> closed")


@register("token_kinds", r"SELECT doc_id, len(regexp_extract_all(text, '\\[A-Za-z]+|[\p{L}]+|[0-9]+(?:\.[0-9]+)?|[^\s\p{L}0-9]')) AS tokens FROM documents WHERE len(regexp_extract_all(text, '\\[A-Za-z]+|[\p{L}]+|[0-9]+(?:\.[0-9]+)?|[^\s\p{L}0-9]')) > 0")
def token_kinds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(clones.TOKEN)).cast("long").alias("tokens")).filter("tokens > 0")


@register("clone_windows", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS s FROM documents), p AS (SELECT doc_id, unnest(list_distinct([array_to_string(s[i:i+7], ' ') FOR i IN range(1, len(s) - 6)])) AS k FROM w WHERE len(s) >= 8) SELECT count(*) AS windows, cast(sum(n) AS BIGINT) AS places FROM (SELECT k, count(*) AS n FROM p GROUP BY k HAVING count(*) > 1)")
def clone_windows(spark, sf_dir):
    words = F.transform(F.split("text", " "), lambda w: F.xxhash64(w))
    return clones.recurring(table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", words.alias("h")), 8)


@register("clone_runs")
def clone_runs(spark, sf_dir):
    return clones.clones(table(spark, sf_dir, "documents"))


@register("produces_substring", "SELECT 'document' AS kind, cast(doc_id AS VARCHAR) AS id FROM documents WHERE contains(text, 'idiot') UNION ALL SELECT 'page', cast(page_id AS VARCHAR) FROM pages WHERE contains(html, 'idiot') UNION ALL SELECT 'benchmark', cast(item_id AS VARCHAR) FROM benchmark WHERE contains(text, 'idiot') UNION ALL SELECT 'turn', cast(conv_id AS VARCHAR) FROM conversations WHERE contains(text, 'idiot')")
def produces_substring(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return search.literal("idiot", document=(t("documents"), "doc_id", "text"), page=(t("pages"), "page_id", "html"), benchmark=(t("benchmark"), "item_id", "text"), turn=(t("conversations"), "conv_id", "text")).select("kind", "id")


@register("fuzzy_prefix", "SELECT p_partkey, CASE WHEN lower(p_name) = 'red' THEN 'exact' WHEN starts_with(lower(p_name), 'red') THEN 'prefix' ELSE 'part' END AS tier FROM part WHERE contains(lower(p_name), 'red')")
def fuzzy_prefix(spark, sf_dir):
    return search.fuzzy(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "red", "p_name").select("p_partkey", "tier")


@register("similar_names", "SELECT a.n AS name, b.n AS known, levenshtein(a.n, b.n) AS distance FROM (SELECT DISTINCT n_name n FROM nation) a JOIN (SELECT DISTINCT n_name n FROM nation) b ON substr(a.n, 1, 1) = substr(b.n, 1, 1) AND abs(length(a.n) - length(b.n)) <= 2 WHERE levenshtein(a.n, b.n) BETWEEN 1 AND 2")
def similar_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return search.similar_names(n, n, "n_name").withColumn("distance", F.col("distance").cast("long"))


@register("rewrite_fix_point", "SELECT doc_id, md5(regexp_replace(text, '!!+', '!', 'g')) AS digest FROM documents")
def rewrite_fix_point(spark, sf_dir):
    rows = rewrite.fix_point(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite.replacements("!!", "!"))
    return rows.select("doc_id", F.md5("text").alias("digest"))


@register("line_diff", """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE contains(text, 'idiot')), l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM d),
c AS (SELECT *, contains(line, 'idiot') AS ch, i - row_number() OVER (PARTITION BY doc_id, contains(line, 'idiot') ORDER BY i) AS g FROM l), b AS (SELECT *, CASE WHEN ch THEN min(i) OVER (PARTITION BY doc_id, ch, g) ELSE i END AS p FROM c),
o AS (SELECT doc_id, p, 0 AS z, i, CASE WHEN ch THEN '-' ELSE ' ' END AS sign, line FROM b UNION ALL SELECT doc_id, p, 1, i, '+', replace(line, 'idiot', 'person') FROM b WHERE ch)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, z, i) - 1 AS no, sign, line FROM o""")
def line_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rewrite.diff(d, d.withColumn("text", F.regexp_replace("text", "idiot", "person")))


@register("paragraphs", "WITH l AS (SELECT conv_id, turn, trim(text) AS t FROM conversations) SELECT conv_id, count(*) AS lines, cast(sum(length(t)) AS BIGINT) AS chars FROM l WHERE t <> '' GROUP BY conv_id")
def paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.trim("text").alias("t")).filter("t <> ''")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("t")).cast("long").alias("chars"))


@register("incremental_counts", "SELECT doc_id, len(string_split(text, ' ')) AS words FROM documents")
def incremental_counts(spark, sf_dir):
    """A run over half the documents, then one over all: only what is new is worked on again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    work = lambda rows: rows.select("doc_id", F.size(F.split("text", " ")).cast("long").alias("words"))
    _, state = incremental(d.filter(F.pmod("doc_id", F.lit(2)) == 0).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 6 == 0, " old").otherwise(""))), work, None)
    return incremental(d, work, state)[0]


# --- sinks


@register("json_records", "SELECT '{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}' AS value FROM region")
def json_records(spark, sf_dir):
    return sinks.json_lines(table(spark, sf_dir, "region"))


@register("csv_records", "SELECT 'n_nationkey,n_name,n_regionkey' AS value UNION ALL SELECT n_nationkey || ',' || n_name || ',' || n_regionkey FROM nation")
def csv_records(spark, sf_dir):
    return sinks.csv_lines(table(spark, sf_dir, "nation"))


def _findings(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    from siftwork.rules import lint
    from siftwork.sources.facts import Facts, lines

    return lint(Facts(spark, lines=lines(table(spark, sf_dir, "documents"))), only)


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS t, cast(generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) AS INTEGER) AS line FROM documents) "


@register("lint_text", _LINES + " UNION ALL ".join(map(fact_queries.line_rule, ("S061", "S003", "S035"))))
def lint_text(spark, sf_dir):
    """Every match, by column, with exceptions judged where it stands."""
    return _findings(spark, sf_dir, "S061", "S003", "S035").select("number", "doc_id", "line", "col")


@register("lint_statistics")
def lint_statistics(spark, sf_dir):
    """All rules that read lines alone, counted."""
    from siftwork.rules import RULES

    text = [r.number for r in RULES.values() if r.reads == ("lines",)]
    return sinks.statistics(_findings(spark, sf_dir, *text))


_FOUND = _LINES + "SELECT '::warning file=document,line=' || line || ',col=' || col || ',title=' || title || '::' || replace(message, '%', '%25') AS value FROM (SELECT line, col, 'sentence-capital' AS title, 'a sentence starts small: ' || found AS message FROM ({}) UNION ALL SELECT line, col, 'et-al', found || ' is not right' FROM ({}) WHERE found <> 'et al.')"


@register("annotations", _FOUND.format(fact_queries.line_rule("S061", "found"), fact_queries.line_rule("S054", "found")))
def annotations(spark, sf_dir):
    return sinks.github(_findings(spark, sf_dir, "et-al", "sentence-capital"))


QUERIES.update(fact_queries.QUERIES)
ORACLE_SQL.update(fact_queries.ORACLE_SQL)
