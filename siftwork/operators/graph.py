"""Directed graphs as edge tables (src, dst, kind): slices, closures, cycles and trees.

Loops run on the driver, a round a join; what has been reached is written to
the shared folder after each round, so plans stay short and survive a lost
executor.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.plans.shared import dealt, materialize, release


def merge_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges as one, their kinds or-ed."""
    return edges.groupBy("src", "dst").agg(F.bit_or("kind").alias("kind"))


def calls(edges: DataFrame) -> DataFrame:
    """Distinct ends."""
    return edges.select("src", "dst").distinct()


def reach(edges: DataFrame, start: DataFrame, mask: int | None = None, forward: bool = False, limit: int | None = None, max_depth: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(node, depth): nodes reached from `start` (node) over edges of a kind in `mask`, and how many steps it takes.

    Backward, the default, follows edges from src to what it depends on, dst;
    forward follows them the other way. `limit` keeps nodes up to a number.
    Start nodes have depth 0, with or without edges.
    """
    a, b = ("dst", "src") if forward else ("src", "dst")
    steps = edges if mask is None else edges.filter(F.col("kind").bitwiseAND(F.lit(mask)) != 0)
    steps = steps.select(F.col(a).alias("node"), F.col(b).alias("__to")).distinct()
    if limit is not None:
        steps = steps.filter(F.col("__to") <= limit)
    steps = materialize(steps, "steps")
    edge = materialize(start.select("node").filter("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "edge")
    levels, depth = [edge], 0
    while depth < (max_rounds if max_depth is None else max_depth):
        depth += 1
        ahead = steps.join(edge.select("node"), "node").select(F.col("__to").alias("node")).distinct()
        edge = materialize(ahead.join(_union(levels).select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "edge")
        if edge.isEmpty():
            break
        levels = _appended(levels, edge)
    release(steps)
    return _union(levels)


#: Written levels that a loop keeps apart before it writes them as one.
LEVELS = 16


def _union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _appended(levels: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """The written levels with one more; a level is written anew once in LEVELS rounds, not each time."""
    levels = [*levels, new]
    if len(levels) < LEVELS:
        return levels
    whole = materialize(_union(levels), "seen")
    for x in levels[:-1]:  # the last one is still walked on from
        release(x)
    return [whole]


#: Edges up to which strong components are found by one task, and nodes that a block of a component has.
TOGETHER, MEMBERS = 1 << 22, 1024


def closure(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(src, dst): every pair with a path of one step or more.

    All nodes on a cycle reach the same nodes, so paths are followed between
    components alone; their pairs of members, most of the result, are made
    where they leave and never shuffled, compared or written in between.
    """
    steps = materialize(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "steps")
    part = materialize(strong(steps), "component")
    a, b = part.withColumnsRenamed({"node": "src", "component": "a"}), part.withColumnsRenamed({"node": "dst", "component": "b"})
    between = steps.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).filter("src <> dst")
    pairs = _walked(between, max_rounds).unionByName(part.select(F.col("component").alias("src"), F.col("component").alias("dst")).distinct())
    return _members(pairs, part)


def _walked(edges: DataFrame, max_rounds: int) -> DataFrame:
    """The closure of a graph without cycles. Each round walks on by one edge from the pairs that the last one found."""
    steps = materialize(edges.distinct(), "steps")
    new, levels = steps, [steps]
    for _ in range(max_rounds):
        ahead = new.alias("p").join(steps.alias("e"), F.col("p.dst") == F.col("e.src")).select(F.col("p.src"), F.col("e.dst")).distinct()
        new = materialize(ahead.join(_union(levels), ["src", "dst"], "left_anti"), "closure")
        if new.isEmpty():
            return _union(levels)
        # the steps stay: every round reads them
        levels = [steps, *_appended(levels[1:], new)]
    raise RuntimeError(f"no closure in {max_rounds} rounds")


def _members(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """(src, dst): pairs of components as pairs of their members; what is in no component stands for itself."""
    sizes = part.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("n"))
    block = F.pmod(F.xxhash64("node"), F.col("n").cast("long")).cast("int").alias("block")
    blocks = materialize(part.join(sizes, "component").select("component", "node", block).groupBy("component", "block").agg(F.collect_list("node").alias("nodes")), "blocks")
    for side in ("src", "dst"):
        # numbers first, so that no task of a large component's join holds its arrays
        n = sizes.select(F.col("component").alias(side), F.col("n").alias(f"{side}_n"))
        pairs = pairs.join(n, side, "left").withColumn(f"{side}_block", F.explode(F.sequence(F.lit(0), F.coalesce(f"{side}_n", F.lit(1)) - 1))).drop(f"{side}_n")
    pairs = materialize(pairs, "pairs")
    for side in ("src", "dst"):
        nodes = blocks.select(F.col("component").alias(side), F.col("block").alias(f"{side}_block"), F.col("nodes").alias(f"{side}_nodes"))
        pairs = pairs.join(nodes, [side, f"{side}_block"], "left").withColumn(f"{side}_nodes", F.coalesce(f"{side}_nodes", F.array(side)))
    pairs = materialize(pairs.select("src_nodes", "dst_nodes"), "pairs")
    return dealt(pairs, "src_nodes", "dst_nodes").select(F.explode("src_nodes").alias("src"), "dst_nodes").select("src", F.explode("dst_nodes").alias("dst"))


def strong(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on a cycle, self loops too, and the least node of their component. Up to TOGETHER edges one task finds them, more are coloured in rounds (`cycles`)."""
    if edges.limit(TOGETHER + 1).count() > TOGETHER:
        return cycles(edges).select("node", "component")
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        found = pa.Table.from_batches(batches)
        ends = pa.chunked_array([*found.column(0).chunks, *found.column(1).chunks]).combine_chunks()
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        at = pc.index_in(ends, names).to_numpy()
        node, component = _tarjan(at[: found.num_rows], at[found.num_rows :], len(names))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(node)), names.take(pa.array(component))], names=["node", "component"])

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _tarjan(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between numbers below n: the nodes on a cycle, and the least node of each one's component."""
    order = np.argsort(src, kind="stable")
    begin = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    to = dst[order].tolist()
    low, seen, stack, at = [0] * n, 1, [], begin[:-1]
    component = np.full(n, -1, np.int64)
    done = n + 1
    for root in range(n):
        if low[root]:
            continue
        path, number = [root], {}
        low[root] = number[root] = seen
        seen += 1
        stack.append(root)
        while path:
            v = path[-1]
            if at[v] < begin[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not low[w]:
                    low[w] = number[w] = seen
                    seen += 1
                    stack.append(w)
                    path.append(w)
                elif low[w] < low[v]:
                    low[v] = low[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == number[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(stack.pop())
                    low[members[-1]] = done
                component[members] = min(members)
    sizes = np.bincount(component, minlength=n)
    loops = np.zeros(n, bool)
    loops[src[src == dst]] = True
    node = np.flatnonzero((sizes[component] > 1) | loops)
    return node, component[node]


def cycles(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component, kind): nodes on a cycle. kind is direct for a self loop alone, mutual in a component of several.

    Colours spread forward until they settle: a node's colour is the largest
    node that reaches it. Nodes of one colour that the colour's own node can be
    reached from form its component; they are taken out and the rest goes on.
    Nodes without a way in or out are trimmed first, round by round.
    """
    edges = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    loops = edges.filter("src = dst").select(F.col("src").alias("node"))
    rest = materialize(edges.filter("src <> dst"), "edges")
    found: list[DataFrame] = []
    for _ in range(max_rounds):
        while True:  # trim
            n = rest.count()
            ins, outs = rest.select(F.col("dst").alias("src")).distinct(), rest.select(F.col("src").alias("dst")).distinct()
            less = materialize(rest.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "edges")
            m = less.count()
            release(rest)
            rest = less
            if m == n:
                break
        if not n:
            break
        colour = materialize(rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")), "colour")
        while True:
            ahead = rest.join(colour, rest.src == colour.node).select(F.col("dst").alias("node"), "colour")
            new = materialize(colour.unionByName(ahead).groupBy("node").agg(F.max("colour").alias("colour")), "colour")
            changed = not new.join(colour, ["node", "colour"], "left_anti").isEmpty()
            release(colour)
            colour = new
            if not changed:
                break
        # backward from each root within its own colour
        inside = rest.join(colour.withColumnsRenamed({"node": "src", "colour": "c"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "d"}), "dst").filter("c = d").select("src", "dst")
        inside = materialize(inside, "inside")
        part = reach(inside.withColumn("kind", F.lit(1)), colour.filter("node = colour").select("node"), forward=True).select("node")
        part = materialize(part.join(colour, "node").select("node", F.col("colour").alias("component")), "component")
        found.append(part)
        less = materialize(rest.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")
        for done in (rest, colour, inside):
            release(done)
        rest = less
    spark = edges.sparkSession
    every = found[0] if found else spark.createDataFrame([], f"node {edges.schema['src'].dataType.simpleString()}, component {edges.schema['src'].dataType.simpleString()}")
    for p in found[1:]:
        every = every.unionByName(p)
    sizes = every.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1")
    mutual = every.join(sizes, "component").select("node", F.col("least").alias("component"), F.lit("mutual").alias("kind"))
    direct = loops.join(mutual.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"), F.lit("direct").alias("kind"))
    return mutual.unionByName(direct)


def adjacency(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices with the array of their out-edges, in order; an empty array without any."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("dst", "kind"))).alias("edges"))
    return vertices.join(out, "node", "left").withColumn("edges", F.coalesce("edges", F.array().cast(out.schema["edges"].dataType)))


def first_edge(vertices: DataFrame, edges: DataFrame, bit: int, position: str) -> DataFrame:
    """(node, target, target_name): a vertex's first edge of a kind, with what it leads to."""
    first = edges.filter(F.col("kind").bitwiseAND(F.lit(bit)) != 0).groupBy(F.col("src").alias("node")).agg(F.min_by("dst", position).alias("target"))
    return first.join(vertices.select(F.col("node").alias("target"), F.col("name").alias("target_name")), "target").select("node", "target", "target_name")


def load_tree(loads: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, parent, depth): each file under its first reader, from the roots (node) down.

    loads has (src, dst, at): who reads what, in order. A file that is read
    again later stays where it was first.
    """
    owner = materialize(loads.filter("src <> dst").groupBy("dst").agg(F.min_by("src", F.struct("at", "src")).alias("parent")), "owner")
    tree = materialize(roots.select("node").distinct().withColumn("parent", F.lit(None).cast(loads.schema["src"].dataType)).withColumn("depth", F.lit(0)), "tree")
    edge = tree
    for depth in range(1, max_depth):
        ahead = owner.join(edge.select(F.col("node").alias("parent")), "parent").select(F.col("dst").alias("node"), "parent").withColumn("depth", F.lit(depth))
        edge = materialize(ahead.join(tree.select("node"), "node", "left_anti").select("node", "parent", "depth"), "edge")
        if edge.isEmpty():
            break
        tree = materialize(tree.unionByName(edge), "tree")
    return tree


def dot(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a graph in DOT; backslashes and quotes in names are escaped."""
    safe = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r'([\\"])', r"\\$1")
    nodes = vertices.select(F.format_string('  n%s [label="%s"];', F.col("node").cast("string"), safe(F.col("name"))).alias("line"))
    lines = edges.select(F.format_string("  n%s -> n%s;", F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))
    spark = vertices.sparkSession
    return spark.createDataFrame([("digraph {",)], "line string").unionByName(nodes).unionByName(lines).unionByName(spark.createDataFrame([("}",)], "line string"))


def json_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a graph as JSON, one object a vertex and one an edge, told apart by `id` and `src`."""
    have = [c for c in ("tag", "name", "file", "line", "col", "within") if c in vertices.columns]
    nodes = vertices.select(F.to_json(F.struct(F.col("node").alias("id"), *have), {"ignoreNullFields": "false"}).alias("line"))
    return nodes.unionByName(edges.select(F.to_json(F.struct("src", "dst", "kind")).alias("line")))
