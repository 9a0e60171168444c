"""Near-duplicates by the texts themselves: Jaccard similarity of the sets of word shingles.

Wide SimHash fingerprints of the sets of shingles are linked by deletion
variants and population counts (`simhash.wide_links`); what links reach are
coarse groups. Within a group the shingle sets themselves are compared, and only
links whose similarity is enough count; they leave a task as a spanning forest.
A group beyond BLOCK texts is dealt out by pairs of blocks, so every pair in it
still meets.

At a similarity of 0.8 or more at most 2 of 10,000 pairs are passed over, under 1
where the sets are large, and fewer above. Sets of four and five shingles differ
in more bits than that allows, so a set of five is also indexed with each
shingle left out, which finds them all. Shingles are compared by 64-bit hashes.
Equal texts (in words, A-Z lower-cased) are one text from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.base import lower_words_of, texts
from siftwork.llm.simhash import wide_fingerprint, wide_links
from siftwork.operators.components import connected_components
from siftwork.plans.shared import materialize

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BLOCK = 128


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles in order; one of all words if they are fewer; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n))


def marks(hashes: np.ndarray) -> bytes:
    """The wide fingerprint of a set, and those of a set of five less one each; nothing for an empty set."""
    if not len(hashes):
        return b""
    less = [np.delete(hashes, i) for i in range(5)] if len(hashes) == 5 else []
    return b"".join(map(wide_fingerprint, [hashes, *less]))


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(rep, fps) of every distinct text: its smallest id and its fingerprints. Rows with a null id have none."""

    def run(batches):
        for b in batches:
            words = [lower_words_of(t) for t in b.column(1).to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary())
            fps = pa.array([marks(shingles(w, shingle)) for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), same, fps], names=["doc_id", "same", "fps"])

    found = texts(docs.filter("doc_id IS NOT NULL")).mapInArrow(run, "doc_id long, same binary, fps binary")
    found = materialize(found, "sketches")
    return materialize(found.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("fps").alias("fps")).select("rep", "fps"), "distinct")


def candidates(reps: DataFrame) -> DataFrame:
    """(node, component): groups of texts that links of fingerprints lead to."""
    return materialize(connected_components(wide_links(reps), "a", "b"), "groups")


def forest(reps: list[int], sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among these texts."""
    left, right = [], []
    sizes = np.array([len(s) for s in sets])
    rest = np.arange(len(sets))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            own = sets[at]
            # sets of very unequal sizes cannot be similar
            fit = rest[np.minimum(sizes[rest], len(own)) / np.maximum(sizes[rest], len(own)) >= similarity]
            if not len(fit):
                continue
            all_of = np.concatenate([sets[i] for i in fit])
            hit = own[np.minimum(np.searchsorted(own, all_of), len(own) - 1)] == all_of
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[fit]) - sizes[fit])
            found = fit[both / (sizes[fit] + len(own) - both) >= similarity]
            left += [reps[at]] * len(found)
            right += [reps[i] for i in found]
            queue.extend(found)
            rest = rest[~np.isin(rest, found)]
    return left, right


def links(docs: DataFrame, groups: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links within the groups, as many as a spanning forest of each group or pair of blocks needs."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = materialize(groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).filter("blocks > 1"), "large")
    members = groups.join(F.broadcast(large) if large.count() < 100_000 else large, "component", "left")
    members = members.select("node", "component", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    rows = texts(docs.filter("doc_id IS NOT NULL")).join(materialize(members, "members"), F.col("doc_id") == F.col("node"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(pair.alias("key"), F.col("doc_id").alias("rep"), "text").repartition(n, "key").sortWithinPartitions("key")

    def run(batches):
        def done():
            a, b = forest(reps, sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        last, reps, sets = None, [], []
        for batch in batches:
            for key, rep, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and reps:
                    yield done()
                    reps, sets = [], []
                found = shingles(lower_words_of(text), shingle)
                if len(found):
                    reps.append(rep)
                    sets.append(found)
                last = key
        if reps:
            yield done()

    return materialize(rows.mapInArrow(run, "a long, b long"), "links")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of `docs` that stand for their class: the one with the smallest id that links reach, with all its columns.

    Texts without words are one class. Rows with a null id are kept. Of rows that
    repeat id and text one stays; an id stands or falls with all its texts.
    """
    reps = sketches(docs, shingle)
    comps = connected_components(links(docs, candidates(reps), shingle, similarity, block), "a", "b")
    more = comps.filter("node <> component").select(F.col("node").alias("rep"))
    found = materialize(reps.select("rep").distinct().join(more, "rep", "left_anti"), "kept").withColumnRenamed("rep", "__kept_id")
    rows = docs.filter("doc_id IS NOT NULL").join(found, F.col("doc_id") == F.col("__kept_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.filter("doc_id IS NULL"))
