"""Connected components of an undirected graph, by alternating star contractions.

Each round replaces every node's links by links to the smallest neighbour it
knows, first for larger neighbours, then for smaller ones; the edge list ends
as one star per component, rooted in its smallest node. Minima are partial
aggregates and are written before they are joined back, so both sides of each
join are plain shuffles that adaptive execution can split when a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.plans.shared import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): every node of `edges` with the smallest node it reaches.

    Null ends and self loops are ignored (a node with only a self loop has no row);
    an empty edge list gives no rows. Raises RuntimeError beyond `max_rounds`.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(max_rounds if before[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # (u, v) with v > u is an edge stored as (v, u): join on its smaller end
        large = now.withColumnsRenamed({"u": "w", "v": "u"}).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        rest = large.join(least2, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = rest.unionByName(least2.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        state = _state(after)
        for x in (now, least, large, least2):
            release(x)
        now = after
        if state == before:
            break
        before = state
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
