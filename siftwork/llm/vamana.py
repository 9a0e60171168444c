"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

The distinct vectors are dealt into shards of bounded size. In each shard a
graph is built in batches: greedy beam searches from the entry points propose
neighbours for a point, pruning with a relaxed distance keeps diverse edges,
and reverse edges are pruned likewise. One added coordinate makes all vectors
equally long, so that the nearest by distance is the largest inner product;
queries have a zero there. Half of a point's edges are chosen as seen from the
point itself, which keeps the graph connected, half as seen from the query that
it would be; where all vectors are equally long these are the same. Queries
travel in blocks to every shard; the shards' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, FloatType

from siftwork.plans.shared import materialize

SHARD, QUERY_BLOCK = 8192, 2048
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX, BATCH, EXPAND, ENTRIES = 32, 64, 128, 1.2, 256, 4, 32


def beam_search(points: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products) of the `beam` best found for each query, best first; id -1 where there are fewer."""
    q, n = len(queries), len(points)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the place of absent neighbours
    ids = np.full((q, beam), n)
    best = np.full((q, beam), -np.inf, np.float32)
    e = min(len(entries), beam)
    ids[:, :e] = entries[:e]
    best[:, :e] = queries @ points[entries[:e]].T
    seen[:, entries[:e]] = True
    done = ids == n
    rows = np.arange(q)[:, None]
    while True:
        left = np.where(done, -np.inf, best)
        pick = np.argpartition(-left, min(expand, beam - 1), axis=1)[:, :expand] if beam > expand else np.argsort(-left, axis=1)
        live = ~np.take_along_axis(done, pick, 1)
        if not live.any():
            break
        np.put_along_axis(done, pick, True, 1)
        near = np.where(live[:, :, None], graph[np.where(live, ids[rows, pick], 0)], n).reshape(q, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[rows, near]] = n
        seen[rows, near] = True
        fresh = near < n
        width = int(fresh.sum(axis=1).max(initial=0))
        if not width:
            continue
        near = np.sort(near, axis=1)[:, :width]
        value = np.einsum("qd,qkd->qk", queries, points[np.minimum(near, n - 1)])
        value[near == n] = -np.inf
        all_ids, all_best, all_done = np.concatenate([ids, near], 1), np.concatenate([best, value], 1), np.concatenate([done, near == n], 1)
        top = np.argpartition(-all_best, beam - 1, axis=1)[:, :beam]
        ids, best, done = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_best, top, 1), np.take_along_axis(all_done, top, 1)
    order = np.argsort(-best, axis=1, kind="stable")
    ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
    return np.where(ids == n, -1, ids), best


def robust_prune(points: np.ndarray, of: np.ndarray, seen: np.ndarray, found: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """Out-neighbours of the points `of`, placed at `seen`, from candidates (rows, -1 for none): near first, each kept one removing those nearer to it."""
    n = len(points)
    found = np.where((found < 0) | (found == of[:, None]), n, found)
    found = np.sort(found, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = n
    other = points[np.minimum(found, n - 1)]
    length = float((points[0] * points[0]).sum())
    dist = np.maximum(length + (seen * seen).sum(axis=1)[:, None] - 2 * np.einsum("qd,qkd->qk", seen, other), 0.0)
    among = np.maximum(2 * length - 2 * np.matmul(other, other.transpose(0, 2, 1)), 0.0)
    alive = found < n
    out = np.full((len(of), degree), n)
    rows = np.arange(len(of))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = np.argmin(np.where(alive, dist, np.inf), axis=1)
        out[some, k] = found[rows, pick][some]
        alive[rows, pick] = False
        alive &= ~((relax * relax) * among[rows, pick] <= dist)
    return out


def build(vectors: np.ndarray, longest: float, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) of a shard: out-neighbours by row, the row count standing for none."""
    n = len(vectors)
    extra = np.sqrt(np.maximum(longest * longest - (vectors.astype(np.float64) ** 2).sum(axis=1), 0.0))
    points = np.concatenate([vectors, extra[:, None].astype(np.float32)], 1)
    asked = np.concatenate([vectors, np.zeros((n, 1), np.float32)], 1)
    level = bool(extra.max(initial=0.0) <= 0.05 * longest)
    rng = np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), n)
    # the longest vectors are near to every query
    entries = np.unique(np.r_[int(np.argmax(points @ points.mean(axis=0))), rng.integers(0, n, min(n, 7)), np.argsort(extra, kind="stable")[: 0 if level else ENTRIES]])

    def choose(of: np.ndarray, found: np.ndarray, alpha: float) -> np.ndarray:
        if level:
            return robust_prune(points, of, points[of], found, alpha, degree)
        asking = robust_prune(points, of, asked[of], found, alpha, degree // 2)
        rows = np.arange(len(of))[:, None]
        taken = np.zeros((len(of), n + 1), bool)
        taken[rows, asking] = True
        own = robust_prune(points, of, points[of], np.where(taken[rows, found], -1, found), alpha, degree - degree // 2)
        return np.concatenate([own, asking], 1)

    for alpha in (1.0, relax):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            of = order[lo : lo + BATCH]
            found = [beam_search(points, graph, entries, x[of], min(beam, max(n, 2)))[0] for x in ((points,) if level else (points, asked))]
            graph[of] = choose(of, np.concatenate([*found, np.where(graph[of] == n, -1, graph[of])], 1), alpha)
            back, ahead = graph[of].reshape(-1), np.repeat(of, degree)
            back, ahead = back[back < n], ahead[back < n]
            by = np.argsort(back, kind="stable")
            back, ahead = back[by], ahead[by]
            first = np.flatnonzero(np.r_[True, back[1:] != back[:-1]]) if len(back) else np.empty(0, np.int64)
            rank = np.arange(len(back)) - np.repeat(first, np.diff(np.r_[first, len(back)]))
            for part in range(0, int(rank.max(initial=-1)) + 1, degree):
                now = (rank >= part) & (rank < part + degree)
                target = np.unique(back[now])
                new = np.full((len(target), degree), -1)
                new[np.searchsorted(target, back[now]), rank[now] - part] = ahead[now]
                graph[target] = choose(target, np.concatenate([np.where(graph[target] == n, -1, graph[target]), new], 1), alpha)
    return graph.astype(np.int32), entries.astype(np.int32)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): ids with finite, non-zero vectors of the commonest dimension; other dimensions have no product with them.

    Floats stay floats, any other numbers become doubles.
    """
    kind = "array<float>" if vectors.schema[vec_col].dataType == ArrayType(FloatType(), vectors.schema[vec_col].dataType.containsNull) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))).filter(F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (size["d"] if size else -1))


def _first_ids(rows: DataFrame, k: int) -> DataFrame:
    """The k smallest ids of each class, in steps of fewer and fewer salts so that a large class meets nowhere at once."""
    for salts in (16, 4, 1):
        w = W.partitionBy("a", "b", "salt").orderBy("vec_id")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("a", "b", "vec_id")
    return rows


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row of the condition `queries` on vec_id.

    score is the inner product in double precision; ties go to the smaller id,
    and the query itself is left out. Null, zero and non-finite vectors and ids,
    and vectors of another than the commonest dimension, take no part; equal
    vectors share one node of the graph and all count;
    with k others or fewer all are returned by an exact scan of the shard.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col).select("vec_id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")).dropDuplicates(["vec_id", "a", "b"])
    rows = materialize(rows, "vectors")
    nodes = materialize(rows.groupBy("a", "b").agg(F.min("vec_id").alias("node"), F.first("v").alias("v")), "nodes")
    total = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("m")).first()
    if not total["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, longest = -(-total["n"] // shard), float(np.sqrt(total["m"]))
    real = np.dtype(np.float32 if isinstance(rows.schema["v"].dataType.elementType, FloatType) else np.float64)

    def blob(table: pa.Table) -> pa.Table:
        v = np.array(table.column("v").to_pylist(), real)
        return pa.table({"part": table.column("part").slice(0, 1).cast(pa.int32()), "ids": pa.array([table.column("node").to_numpy().astype(np.int64).tobytes()], pa.binary()), "v": pa.array([v.tobytes()], pa.binary()), "graph": pa.nulls(1, pa.binary()), "entries": pa.nulls(1, pa.binary())})

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        graph, entries = build(np.array(table.column("v").to_pylist(), np.float32), longest)
        return blob(table).drop_columns(["graph", "entries"]).append_column("graph", pa.array([graph.tobytes()], pa.binary())).append_column("entries", pa.array([entries.tobytes()], pa.binary()))

    schema = "part int, ids binary, v binary, graph binary, entries binary"
    dealt = nodes.select("node", "v", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(shards)).cast("int").alias("part"))
    # by range, so that each shard has a task of its own
    built = materialize(dealt.repartitionByRange(shards, "part").groupBy("part").applyInArrow(index, schema), "graphs")
    asking = rows.filter(queries).select("a", "b", F.col("vec_id").alias("query_id"))
    asked = nodes.join(asking.select("a", "b").distinct(), ["a", "b"], "left_semi").select("node", "v")
    asked = materialize(asked, "asked")
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    packs = asked.select("node", "v", F.pmod(F.xxhash64("node", F.lit(4)), F.lit(parts)).cast("int").alias("part")).groupBy("part").applyInArrow(blob, schema)
    packs = packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(batches):
        """A shard's graph comes first, then the blocks of queries, one after the other."""
        ids = v = near = graph = entries = None
        for b in batches:
            for own, vectors, links, start in zip(*(b.column(c).to_pylist() for c in ("ids", "v", "graph", "entries"))):
                own = np.frombuffer(own, np.int64)
                vectors = np.frombuffer(vectors, real).reshape(len(own), -1)
                if links is not None:
                    ids, v, near = own, vectors, vectors.astype(np.float32)
                    graph, entries = np.frombuffer(links, np.int32).reshape(len(ids), -1).astype(np.int64), np.frombuffer(start, np.int32)
                    continue
                for lo in range(0, len(own), BATCH):
                    part = vectors[lo : lo + BATCH]
                    if len(ids) <= 4 * k:
                        found = np.tile(np.arange(len(ids)), (len(part), 1))
                    else:
                        found, _ = beam_search(near, graph, entries, part.astype(np.float32), min(beam, len(ids)))
                    score = np.einsum("qd,qkd->qk", part.astype(np.float64), v[np.maximum(found, 0)].astype(np.float64))
                    score[found < 0] = -np.inf
                    node = ids[np.maximum(found, 0)]
                    top = np.lexsort((node, -score), axis=1)[:, : k + 1]
                    score, node = np.take_along_axis(score, top, 1), np.take_along_axis(node, top, 1)
                    ok = score > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[lo : lo + BATCH], ok.sum(axis=1))), pa.array(node[ok]), pa.array(score[ok])], names=["q", "node", "score"])

    streams = built.unionByName(packs).repartitionByRange(shards, "part").sortWithinPartitions("part", F.col("graph").isNull())
    found = streams.mapInArrow(search, "q long, node long, score double")
    w = W.partitionBy("q").orderBy(F.desc("score"), "node")
    found = materialize(found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("q", "node", "score"), "found")
    members = _first_ids(rows.select("a", "b", "vec_id"), k + 1).groupBy("a", "b").agg(F.collect_list("vec_id").alias("ids"))
    members = materialize(members.join(nodes.select("a", "b", "node"), ["a", "b"]).select("node", "ids"), "members")
    every = found.join(members, "node").select("q", "score", F.explode("ids").alias("vec_id"))
    lists = every.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("best"))
    lists = lists.join(nodes.select("a", "b", "node"), F.col("q") == F.col("node")).select("a", "b", "best")
    lists = materialize(lists, "lists")
    out = asking.join(lists, ["a", "b"]).select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op5_neighbours(vectors: DataFrame) -> DataFrame:
    """The contract's digest: the 20 nearest of every row whose id is divisible by 20."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
