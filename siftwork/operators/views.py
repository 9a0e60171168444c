"""Named record views over fact tables: what a user asks for by name, with one filter.

Each view is a function of Facts that returns a DataFrame; `query` runs one by
name, filters it and orders it by place.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.functions.filters import apply_filter, check_pattern
from siftwork.operators import graph, ordered
from siftwork.operators.search import literal
from siftwork.plans.shared import materialize
from siftwork.sources.facts import Facts

#: What a key of an occurrence is for, by kind.
ROLES = {"label": "defines", "ref": "uses", "eqref": "uses", "cref": "uses", "cite": "uses", "bibitem": "defines", "environment": "defines", "environment-begin": "uses", "environment-end": "ends", "glossary-entry": "defines", "gls": "uses", "graphic": "reads", "layer": "defines", "layer-use": "uses", "shell": "runs", "item": "lists", "metadata": "sets", "catcode": "sets"}
CALL, CONTROL, LOAD, WRITE = 1, 2, 4, 8
PLACE = ("file", "line", "col")

VIEWS: dict[str, Callable[..., DataFrame]] = {}


def view(name: str):
    def keep(f):
        VIEWS[name] = f
        return f

    return keep


@view("definitions")
def definitions(facts: Facts) -> DataFrame:
    return facts["defs"].withColumn("origin", F.coalesce("origin", F.lit("document"))).withColumn("arity", F.coalesce("arity", F.lit(0)))


@view("expansions")
def expansions(facts: Facts) -> DataFrame:
    return facts["expansions"].withColumn("count", F.coalesce("count", F.lit(1)))


@view("dependencies")
def dependencies(facts: Facts) -> DataFrame:
    about = facts["packages"].select("name", F.col("file").alias("identified"))
    return facts["loads"].join(about, "name", "left").withColumn("resolved", F.coalesce(F.col("status") == "read", F.lit(False)))


@view("occurrences")
def occurrences(facts: Facts) -> DataFrame:
    role = F.create_map(*[F.lit(x) for k, v in ROLES.items() for x in (k, v)])
    return facts["occurrences"].withColumn("role", F.coalesce("role", F.element_at(role, F.col("kind"))))


@view("recursion")
def recursion(facts: Facts) -> DataFrame:
    """(doc_id, name, kind, cycle, place): defined names on a cycle of calls, each with the names of its cycle."""
    key = lambda c: F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.col(c))
    found = graph.cycles(facts["calls"].select(key("name").alias("src"), key("callee").alias("dst")))
    bare = F.regexp_extract("node", "\u0001(.*)$", 1)
    names = found.groupBy("component").agg(F.array_sort(F.collect_list(bare)).alias("cycle"))
    last = ordered.last_wins(facts["defs"].select("doc_id", "name", "node", *PLACE), ["doc_id", "name"], ["node"])
    return last.select("doc_id", "name", *PLACE, key("name").alias("node")).join(found, "node").join(names, "component").select("doc_id", "name", "kind", "cycle", *PLACE)


@view("calls")
def calls(facts: Facts) -> DataFrame:
    return facts["calls"].distinct()


@view("dependency-graph")
def dependency_graph(facts: Facts) -> DataFrame:
    out = facts["edges"].groupBy("doc_id", F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("dst", "kind"))).alias("edges"))
    return facts["vertices"].join(out, ["doc_id", "node"], "left")


@view("trace")
def trace(facts: Facts) -> DataFrame:
    """Expansions in order with what they mean and the definition they use."""
    named = facts["defs"].select("doc_id", F.col("node").alias("definition"), F.col("body"))
    return facts["expansions"].join(named, ["doc_id", "definition"], "left")


@view("trace-compact")
def trace_compact(facts: Facts, most: int = 8) -> DataFrame:
    """What each top-level call used, the most used first, `most` lines a call."""
    inner = facts["expansions"].groupBy("doc_id", "within", "name").agg(F.sum(F.coalesce("count", F.lit(1))).alias("count"))
    w = W.partitionBy("doc_id", "within").orderBy(F.desc("count"), "name")
    return inner.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


@view("files")
def files(facts: Facts) -> DataFrame:
    """Files that were read, ones that were asked for in vain, and found ones that nothing read."""
    read = facts["loads"].filter("status = 'read'").select("doc_id", F.coalesce("path", "name").alias("path")).distinct()
    absent = facts["loads"].filter("status = 'absent'").select("doc_id", F.col("name").alias("path")).distinct()
    unread = facts["found_files"].join(read, ["doc_id", "path"], "left_anti").distinct()
    return read.withColumn("state", F.lit("read")).unionByName(absent.withColumn("state", F.lit("absent"))).unionByName(unread.withColumn("state", F.lit("found")))


@view("side-effects")
def side_effects(facts: Facts, bit: int = WRITE) -> DataFrame:
    first = facts["edges"].filter(F.col("kind").bitwiseAND(F.lit(bit)) != 0).groupBy("doc_id", F.col("src").alias("node")).agg(F.min("dst").alias("target"))
    name = facts["vertices"].select("doc_id", F.col("node").alias("target"), F.col("name").alias("target_name"))
    return facts["vertices"].join(first, ["doc_id", "node"]).join(name, ["doc_id", "target"])


@view("catcodes")
def catcodes(facts: Facts) -> DataFrame:
    """Settings that are not what they were at the start."""
    s = facts["settings"]
    now = s.filter("NOT key LIKE 'initial-%'").groupBy("doc_id", "key").agg(F.max_by("value", "node").alias("now"))
    was = s.filter("key LIKE 'initial-%'").select("doc_id", F.expr("substr(key, 9)").alias("key"), F.col("value").alias("was"))
    return now.join(was, ["doc_id", "key"], "full").filter(~F.col("now").eqNullSafe(F.col("was")))


@view("distribution")
def distribution(facts: Facts) -> DataFrame:
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    kind = F.regexp_extract("path", r"\.(\w+)$", 1)
    return facts["found_files"].groupBy("doc_id", folder.alias("folder"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@view("tagging")
def tagging(facts: Facts) -> DataFrame:
    return facts["settings"].filter("key LIKE 'tagging%'").select("doc_id", "key", "value")


@view("plugins")
def plugins(facts: Facts) -> DataFrame:
    from siftwork.rules import RULES

    return facts.spark.createDataFrame([(r.number, r.name, r.category, r.severity, list(r.reads)) for r in RULES.values()], "number string, name string, category string, severity string, reads array<string>")


@view("project")
def project(facts: Facts, most: int = 8) -> DataFrame:
    """Settings by key, with the first few values and how many more."""
    rows = facts["settings"].groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("value")).alias("v"))
    more = F.size("v") - most
    return rows.select("doc_id", "key", F.when(more > 0, F.concat(F.slice("v", 1, most), F.array(F.concat(F.lit("+"), more.cast("string"))))).otherwise(F.col("v")).alias("values"))


@view("diagnostics")
def diagnostics(facts: Facts) -> DataFrame:
    return facts["diagnostics"].withColumn("count", F.coalesce("count", F.lit(1)))


@view("gaps")
def gaps(facts: Facts, severity: str = "approximation") -> DataFrame:
    """Approximations by code: how often, and where first."""
    rows = diagnostics(facts).filter(F.col("severity") == severity)
    return rows.groupBy("code").agg(F.sum("count").alias("count"), F.min_by(F.struct("message", *PLACE), F.struct("doc_id", "line", "col")).alias("first")).select("code", "count", "first.*")


@view("typeset")
def typeset(facts: Facts) -> DataFrame:
    """(doc_id, file, paragraph, first_line, text): lines between blank ones as one paragraph each."""
    rows = facts["lines"].withColumn("blank", F.trim("text") == "")
    w = W.partitionBy("doc_id", "file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("paragraph", F.sum(F.col("blank").cast("int")).over(w)).filter("NOT blank")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.trim(x["text"])), " ")
    return rows.groupBy("doc_id", "file", "paragraph").agg(F.min("line").alias("first_line"), text.alias("text"))


@view("produces")
def produces(facts: Facts, text: str = "") -> DataFrame:
    """Where a literal text comes from: definitions, uses, keys, messages, colours and lines."""
    return literal(text, definition=(facts["defs"], "name", "body"), expansion=(facts["expansions"], "node", "name"), occurrence=(facts["occurrences"], "key", "detail"), diagnostic=(facts["diagnostics"], "code", "message"), color=(facts["colors"], "name", "value"), line=(facts["lines"], "line", "text"))


@view("options")
def options(facts: Facts, name: str = "", depth: int = 6) -> DataFrame:
    """Keys that a name's callees set, up to some calls away."""
    start = facts["calls"].filter(F.col("name") == name).select(F.col("name").alias("node")).limit(1)
    ways = facts["calls"].select(F.col("name").alias("src"), F.col("callee").alias("dst"))
    near = graph.reach(ways, start, max_depth=depth)
    return facts["settings"].filter("key LIKE 'option:%'").select(F.col("value").alias("node"), F.expr("substr(key, 8)").alias("option")).join(near, "node")


@view("pgfkeys")
def pgfkeys(facts: Facts, prefix: str = "") -> DataFrame:
    return facts["settings"].filter(F.col("key").startswith("/" + prefix.strip("/"))).select("doc_id", "key", "value").distinct()


@view("exports")
def exports(facts: Facts) -> DataFrame:
    """Name to the file that provides it; of several the most loaded one, then by name."""
    loads = facts["loads"].groupBy(F.col("name").alias("package")).agg(F.count(F.lit(1)).alias("loads"))
    rows = facts["defs"].filter("package IS NOT NULL").select("name", "package").distinct().join(loads, "package", "left").withColumn("loads", F.coalesce("loads", F.lit(0)))
    return rows.groupBy("name").agg(F.min_by("package", F.struct(-F.col("loads"), "package")).alias("package"))


@view("previews")
def previews(facts: Facts) -> DataFrame:
    """Colours as a small drawing each."""
    return facts["colors"].select("doc_id", "name", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="16" height="16"><rect width="16" height="16" fill="#'), F.regexp_replace("value", "[^0-9A-Fa-f]", ""), F.lit('"/></svg>')).alias("svg"))


@view("type-plugins")
def type_plugins(facts: Facts) -> DataFrame:
    kinds = ["color", "dimension", "glue", "integer", "key", "label", "citation", "file", "graphic", "environment", "command", "counter", "language", "font", "unit", "date", "url", "text", "math", "table", "list", "option", "package", "class"]
    return facts.spark.createDataFrame([(k,) for k in kinds], "type string")


def explain(facts: Facts, name: str, before: int | None = None) -> DataFrame:
    """The latest definition of a name in each document, before a boundary if one is given."""
    rows = facts["defs"].filter(F.col("name") == name)
    rows = rows if before is None else rows.filter(F.col("node") < before)
    return ordered.last_wins(rows, ["doc_id", "name"], ["node"])


def scope(facts: Facts, before: int, internal: str = "[@:_]") -> DataFrame:
    """Names that can be used at a place: their last definitions before it, without internal ones."""
    check_pattern(internal)
    rows = facts["defs"].filter(F.col("node") < before).filter(~F.col("name").rlike(internal))
    return ordered.last_wins(rows, ["doc_id", "name"], ["node"])


def controls(facts: Facts) -> DataFrame:
    """(doc_id, switch, governed): how many rows each switch decides about."""
    rows = facts["edges"].filter(F.col("kind").bitwiseAND(F.lit(CONTROL)) != 0)
    name = facts["vertices"].select("doc_id", F.col("node").alias("src"), F.col("name").alias("switch"))
    return rows.join(name, ["doc_id", "src"]).groupBy("doc_id", "switch").agg(F.count_distinct("dst").alias("governed"))


#: Names that a row of offered options shows.
OFFERED = 8


@view("switches")
def switches(facts: Facts) -> DataFrame:
    """(doc_id, tag, name, by, value, governs): conditionals a document declares, the options it passes, and what packages offer.

    A switch is true or false if its body is, else undecided; governs counts the rows it decides about.
    """
    d = facts["defs"]
    declared = F.col("by").rlike("^(new|provide)") & (F.col("name").startswith("if") | F.contains("by", F.lit("if")))
    truth = F.when(F.col("body").rlike(r"^\\?iftrue$"), "true").when(F.col("body").rlike(r"^\\?iffalse$"), "false")
    first = d.filter(F.coalesce(declared, F.lit(False)) | truth.isNotNull()).groupBy("doc_id", "name").agg(F.min_by("by", "node").alias("by"), F.min_by("body", "node").alias("body"))
    counts = controls(facts).withColumnRenamed("switch", "name")
    own = first.join(counts, ["doc_id", "name"], "left").select("doc_id", F.lit("switch").alias("tag"), "name", "by", F.coalesce(truth, F.lit("undecided")).alias("value"), F.coalesce("governed", F.lit(0)).cast("long").alias("governs"))
    passed = facts["loads"].filter(F.size("options") > 0).select("doc_id", F.lit("option").alias("tag"), "name", F.col("kind").alias("by"), F.array_join("options", ", ").alias("value"), F.lit(None).cast("long").alias("governs"))
    return own.unionByName(passed).unionByName(offered_options(facts))


@view("offered-options")
def offered_options(facts: Facts) -> DataFrame:
    """Rows like those of `switches`: what each package accepts, the first OFFERED names in order and how many more."""
    d = facts["defs"].filter("tag = 'option' AND subject RLIKE '^[A-Za-z0-9]'").groupBy("doc_id", F.coalesce("package", "file").alias("name"), "subject").agg(F.min("node").alias("node"))
    lists = d.groupBy("doc_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "subject"))), lambda x: x["subject"]).alias("all"))
    more = F.size("all") - OFFERED
    shown = F.concat(F.array_join(F.slice("all", 1, OFFERED), ", "), F.when(more > 0, F.concat(F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(""))
    return lists.select("doc_id", F.lit("offered").alias("tag"), "name", F.lit("package").alias("by"), shown.alias("value"), F.size("all").cast("long").alias("governs"))


@view("option-values")
def option_values(facts: Facts, package: str = "", key: str = "") -> DataFrame:
    """(doc_id, value): values that the definitions of a package, and of what it loads, give to a key."""
    check_pattern(re.escape(key))
    stem = lambda c: F.regexp_replace(c, r"\.(sty|cls)$", "")
    loads = facts["loads"].filter("by IS NOT NULL").select("doc_id", stem(F.col("by")).alias("by"), stem(F.col("name")).alias("name"))
    node = lambda c: F.struct("doc_id", F.col(c).alias("name"))
    edges = loads.select(node("by").alias("src"), node("name").alias("dst"), F.lit(1).alias("kind"))
    start = facts["defs"].select("doc_id").distinct().withColumn("name", F.lit(package)).select(node("name").alias("node"))
    found = graph.reach(edges, start).select("node.doc_id", F.col("node.name").alias("package"))
    rows = facts["defs"].filter("body IS NOT NULL").withColumn("package", stem(F.col("package"))).join(found.distinct(), ["doc_id", "package"], "left_semi")
    value = rf"(?:^|[,{{\s]){re.escape(key)}\s*=\s*([A-Za-z0-9][\w.:-]*)"
    return rows.select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(value), F.lit(1))).alias("value")).distinct()


def summary(facts: Facts) -> DataFrame:
    """(doc_id, file, tag, names): distinct names a file defines by tag, in the order seen."""
    return ordered.first_seen_list(facts["defs"], ["doc_id", "file", "tag"], "name", ["node"])


def providers(facts: Facts, names: DataFrame) -> DataFrame:
    return names.select("name").distinct().join(exports(facts), "name")


def at_place(facts: Facts, file: str, line: int, col: int | None = None) -> DataFrame:
    """Definitions and occurrences at a place."""
    here = (F.col("file") == file) & (F.col("line") == line)
    here = here if col is None else here & (F.col("col") <= col)
    return facts["defs"].filter(here).select("doc_id", "node", "name", *PLACE).unionByName(facts["occurrences"].filter(here).select("doc_id", "node", F.col("key").alias("name"), *PLACE), allowMissingColumns=True)


def slice_where(facts: Facts, filter: str, mask: int | None = None, forward: bool = False, limit: int | None = None) -> DataFrame:
    """(doc_id, node, depth): what the rows that pass a filter depend on, or what depends on them."""
    rows = facts["occurrences"].select("doc_id", "node", "kind", "key", "file", "line").unionByName(facts["defs"].select("doc_id", "node", F.lit("definition").alias("kind"), F.col("name").alias("key"), "file", "line"))
    key = lambda c: F.struct("doc_id", F.col(c).alias("node"))
    start = apply_filter(rows, filter).select(key("node").alias("node")).distinct()
    edges = facts["edges"] if limit is None else facts["edges"].filter((F.col("src") <= limit) & (F.col("dst") <= limit))
    found = graph.reach(edges.select(key("src").alias("src"), key("dst").alias("dst"), "kind"), start, mask, forward)
    return found.select("node.doc_id", "node.node", "depth")


def sliced_text(facts: Facts, nodes: DataFrame) -> DataFrame:
    """The lines that a slice's nodes stand on, with the lines that open and close environments around them."""
    place = facts["vertices"].join(nodes.select("doc_id", "node").distinct(), ["doc_id", "node"], "left_semi").select("doc_id", "file", "line").filter("line IS NOT NULL")
    marks = facts["occurrences"].filter("kind IN ('environment-begin', 'environment-end')").withColumn("step", F.when(F.col("kind") == "environment-begin", 1).otherwise(-1))
    pairs = materialize(ordered.pairs(marks.select("doc_id", "file", "node", "line", "step"), ["doc_id", "file"], ["node"], F.col("step"), "line").filter("open IS NOT NULL AND close IS NOT NULL"), "pairs")
    around = ordered.containing(place.distinct(), pairs, ["doc_id", "file"], "line", "open", "close")
    wanted = place.unionByName(around.select("doc_id", "file", F.col("span_lo").alias("line"))).unionByName(around.select("doc_id", "file", F.col("span_hi").alias("line"))).distinct()
    return facts["lines"].join(wanted, ["doc_id", "file", "line"], "left_semi")


def query(facts: Facts, name: str, filter: str | None = None, **arguments) -> DataFrame:
    """A view by name, filtered, in the order of places where it has them."""
    if name not in VIEWS:
        raise KeyError(f"no view {name}; there are {', '.join(sorted(VIEWS))}")
    rows = apply_filter(VIEWS[name](facts, **arguments), filter)
    order = [c for c in ("doc_id", *PLACE) if c in rows.columns]
    return rows.orderBy(*order) if order else rows


def batch(facts: Facts, requests: list[dict]) -> list[dict]:
    """Many requests {query, filter, ...} over one set of facts; a bad one gives its error and the rest still run."""
    out = []
    for r in requests:
        try:
            out.append({"query": r.get("query"), "rows": query(facts, r["query"], r.get("filter"), **r.get("arguments", {}))})
        except Exception as e:  # each request answers for itself
            out.append({"query": r.get("query"), "error": str(e)})
    return out
