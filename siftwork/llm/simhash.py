"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints within
`max_bits` of each other have a segment that differs in at most one bit. Every
segment is indexed once for each of its bits with that bit left out; equal
variants bring candidates together, and a population count verifies them.

Only distinct fingerprints are indexed, so exact copies cost nothing. Within a
bucket the verified links are reduced to a spanning forest before they leave
the task: the classes stay the same and rows stay linear in the bucket. A
bucket beyond BLOCK fingerprints is not compared in one task but spread over
pairs of blocks.

Texts that share most but not all of their shingles differ in more bits than one
fingerprint of 64 can tell from chance. For them the fingerprint is wide: WORDS
words of 64 bits from the set of shingles, in segments of 16 bits that are
indexed in the same way. Two texts with a segment that differs in at most one
bit have one of its bytes equal, so that a row for each byte meets in one task,
and the variants of the byte beside it are made there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.base import lower_words_of, texts
from siftwork.operators.components import connected_components
from siftwork.plans.shared import materialize

SHINGLE, SEED, MAX_BITS = 4, 42, 4
BLOCK = 16384
#: Of wide fingerprints: their words, the words counted beside a segment's own, and the bits that may differ in all of these and in the first.
WORDS, COUNTED, WIDE_BITS, FIRST_BITS = 8, 3, 53, 24
WIDE_BLOCK, CHUNK, LARGE = 65536, 32768, 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 for a text without words."""
    words = lower_words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 32768):
        part = h[i : i + 32768].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row: the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: one more than pairs of differing bits, so one has at most one of them."""
    m = max_bits // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, rep): each distinct fingerprint under each of its 64 one-wildcard segments."""
    keys = []
    for s, (first, width) in enumerate(segments(max_bits)):
        part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            # the segment and the bit left out stand above the remaining bits
            keys.append(F.lit((s * 64 + bit) << 48).bitwiseOR(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))) if width <= 48 else F.xxhash64(F.lit(s * 64 + bit), part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")


def _forest(fp: np.ndarray, rep: np.ndarray, max_bits: int) -> tuple[list, list]:
    """A spanning forest of the links within one bucket, as (reps, reps)."""
    left, right = [], []
    rest = np.arange(len(fp))
    while len(rest) > 1:
        at, rest, queue = rest[0], rest[1:], []
        queue.append(at)
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count((fp[rest] ^ fp[at]).view(np.uint64)) <= max_bits
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), rep[at]))
                right.append(rep[found])
                queue.extend(found)
                rest = rest[~near]
    return left, right


def _links(batches, max_bits: int, block: int | None):
    """Of rows sorted by (key): links found in each key's bucket; buckets beyond `block` come back whole."""
    names = ["a", "b", "key", "fp"]

    def pack(a, b, key=None, fp=None):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if key is None else pa.array(key, pa.int64()), none if fp is None else pa.array(fp, pa.int64())], names=names)

    def done(key, fp, rep):
        """Whole buckets only."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        group = np.repeat(np.arange(len(starts)), sizes)
        small = sizes[group] <= 8
        left, right = [], []
        for lag in range(1, 8):
            i = np.flatnonzero(small[:-lag] & (group[lag:] == group[:-lag])) if len(key) > lag else []
            if len(i):
                i = i[np.bitwise_count((fp[i] ^ fp[i + lag]).view(np.uint64)) <= max_bits]
                left.append(rep[i])
                right.append(rep[i + lag])
        for g in np.flatnonzero(sizes > 8):
            at = slice(starts[g], starts[g] + sizes[g])
            a, b = _forest(fp[at], rep[at], max_bits)
            left += a
            right += b
        if left and sum(map(len, left)):
            yield pack(np.concatenate(left), np.concatenate(right))

    kept: list[np.ndarray] = [np.empty(0, np.int64)] * 3
    over = None  # the key of a bucket that is passed on
    for b in batches:
        if not b.num_rows:
            continue
        key, fp, rep = (np.concatenate([k, b.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept))
        if over is not None:
            n = np.searchsorted(key, over, side="right")
            if n:
                yield pack(rep[:n], None, key[:n], fp[:n])
            key, fp, rep = key[n:], fp[n:], rep[n:]
            if not len(key):
                kept = [key, fp, rep]
                continue
            over = None
        cut = int(np.searchsorted(key, key[-1], side="left"))  # the last bucket may go on
        if cut:
            yield from done(key[:cut], fp[:cut], rep[:cut])
        kept = [key[cut:], fp[cut:], rep[cut:]]
        if block and len(kept[0]) > block:
            over = kept[0][0]
            yield pack(kept[2], None, kept[0], kept[1])
            kept = [x[:0] for x in kept]
    if len(kept[0]):
        yield from done(*kept)


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between representatives, as many as a spanning forest of each bucket needs."""
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "a long, b long, key long, fp long"
    dealt = variants(fps, max_bits).repartition(n, "key").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(lambda it: _links(it, max_bits, block), schema), "links")
    edges = found.filter("b IS NOT NULL").select("a", "b")
    hot = found.filter("b IS NULL")
    sizes = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    if not sizes.isEmpty():
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
        rows = hot.join(F.broadcast(sizes) if sizes.count() < 100_000 else sizes, "key").withColumn("own", own)
        rows = rows.select(F.col("fp"), F.col("a").alias("rep"), "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select(pair.alias("key"), "fp", "rep").repartition(n, "key").sortWithinPartitions("key")
        more = materialize(rows.mapInArrow(lambda it: _links(it, max_bits, None), schema), "links")
        edges = edges.unionByName(more.select("a", "b"))
    return edges


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """WORDS words of 64 bits of a set of 64-bit hashes: a bit is 1 if set in over half of them, mixed anew for each word; zero for an empty set."""
    ones = np.zeros(64 * WORDS, np.int64)
    word = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), 255):
        z = hashes[i : i + 255, None] + word
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        bits = np.unpackbits(z.astype("<u8").view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def _places(column: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, fingerprints as rows of bytes) of a column of one or more wide fingerprints each."""
    found = column.to_pylist()
    rep = np.repeat(ids.to_numpy(zero_copy_only=False), [len(x) // (8 * WORDS) for x in found])
    return rep, np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8 * WORDS)


def _count_places(batches):
    """(place, n): how many fingerprints hold each byte at each place."""
    counts = np.zeros(8 * WORDS * 256, np.int64)
    for b in batches:
        _, fp = _places(b.column(1), b.column(0))
        counts += np.bincount((np.arange(8 * WORDS) * 256 + fp).ravel(), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["place", "n"])


def _deal(batches, blocks: dict[int, int]):
    """A row for each byte of a fingerprint: (key, rep, words to count). A place of several blocks goes to all its pairs of blocks."""
    names = ["key", "rep", *(f"w{j}" for j in range(COUNTED))]
    of = np.ones(8 * WORDS * 256, np.int64)
    of[list(blocks)] = list(blocks.values())
    at = np.arange(8 * WORDS)
    for b in batches:
        reps, fps = _places(b.column(1), b.column(0))
        for i in range(0, len(reps), 512):
            fp = fps[i : i + 512]
            rep = np.repeat(reps[i : i + 512], len(at))
            place = (at * 256 + fp).ravel()
            beside = fp[:, at ^ 1].astype(np.int64).ravel()
            words = fp.view("<i8")
            words = [words[:, (at // 8 + 1 + j) % WORDS].ravel() for j in range(COUNTED)]
            n = of[place]
            if (n > 1).any():
                row = np.repeat(np.arange(len(n)), n)
                other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                rep, place, beside, words, n = rep[row], place[row], beside[row], [w[row] for w in words], n[row]
                own = ((rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
                place = place + len(of) * (np.minimum(own, other) * n + np.maximum(own, other))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (place << 8 | beside, rep, *words)], names=names)


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Labels of linked nodes become the smallest of theirs."""
    while len(x):
        a, b = label[x], label[y]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]


def _wide_buckets(key: np.ndarray, rep: np.ndarray, words: np.ndarray, max_bits: int):
    """(a, b): links within whole buckets of rows sorted by key, a star for each class."""
    reps, node = np.unique(rep, return_inverse=True)
    label = np.arange(len(reps))
    bit = np.arange(8)
    group = ((key >> 8)[:, None] << 11 | bit << 8 | (key & 255)[:, None] & ~(1 << bit)).ravel()
    order = np.argsort(group, kind="stable")
    group, row = group[order], order // 8
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)])
    size = np.repeat(sizes, sizes)
    if sizes.max() > LARGE:
        for rest in np.split(row[size > LARGE], np.cumsum(sizes[sizes > LARGE])[:-1]):
            while len(rest) > 1:
                queue, rest = [rest[0]], rest[1:]
                while queue and len(rest):
                    at = queue.pop()
                    near = np.bitwise_count((words[rest] ^ words[at]).view(np.uint64)).sum(axis=1) <= max_bits
                    if near.any():
                        found, rest = rest[near], rest[~near]
                        _unite(label, np.full(len(found), node[at]), node[found])
                        queue.extend(found)
        keep = size <= LARGE
        group, row, size = group[keep], row[keep], size[keep]
    lag = 1
    while len(group) > lag:
        if lag & (lag - 1) == 0:  # now and then, groups that are through or are one class go
            of = label[node[row]]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            mixed = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
            keep = np.repeat(mixed, np.diff(np.r_[starts, len(group)])) & (size > lag)
            group, row, size = group[keep], row[keep], size[keep]
            first = words[row, 0]
        i = np.flatnonzero((np.bitwise_count((first[lag:] ^ first[:-lag]).view(np.uint64)) <= FIRST_BITS) & (group[lag:] == group[:-lag]))
        x, y = row[i], row[i + lag]
        apart = label[node[x]] != label[node[y]]
        x, y = x[apart], y[apart]
        near = np.bitwise_count((words[x] ^ words[y]).view(np.uint64)).sum(axis=1) <= max_bits
        _unite(label, node[x[near]], node[y[near]])
        lag += 1
    linked = np.flatnonzero(label != np.arange(len(label)))
    return reps[label[linked]], reps[linked]


def _wide_links(batches, max_bits: int):
    """Of rows sorted by key: the links of each bucket, some buckets at a time."""

    def done(rows):
        a, b = _wide_buckets(rows[0], rows[1], np.ascontiguousarray(np.stack(rows[2:], axis=1)), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    kept, n, enough = [], 0, CHUNK
    for b in batches:
        kept.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        if n < enough:
            continue
        rows = [np.concatenate(c) for c in zip(*kept)]
        cut = int(np.searchsorted(rows[0], rows[0][-1] >> 8 << 8))  # the last bucket may go on
        if cut:
            yield done([c[:cut] for c in rows])
        kept, n = [[c[cut:] for c in rows]], n - cut
        enough = max(CHUNK, 2 * n)
    if n:
        yield done([np.concatenate(c) for c in zip(*kept)])


def wide_links(marks: DataFrame, max_bits: int = WIDE_BITS, block: int = WIDE_BLOCK) -> DataFrame:
    """(a, b): links between the ids of `marks` (rep long, fps binary: one or more wide fingerprints), as stars of each task's classes.

    Two ids are linked if fingerprints of theirs have a segment of 16 bits that
    differs in at most one, and at most `max_bits` differ in the COUNTED words
    that follow the segment's own.
    """
    spark = marks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = marks.select("rep", "fps")
    # at most 256 bytes at each place: a bounded histogram
    counts = marks.mapInArrow(_count_places, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).filter(F.col("n") > block).collect()
    blocks = {r["place"]: -(-r["n"] // block) for r in counts}
    schema = "key long, rep long, " + ", ".join(f"w{j} long" for j in range(COUNTED))
    dealt = marks.mapInArrow(lambda it: _deal(it, blocks), schema).repartition(n, F.shiftright("key", 8)).sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(lambda it: _wide_links(it, max_bits), "a long, b long"), "links")


def classes(docs: DataFrame, max_bits: int = MAX_BITS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable by links.

    Null and empty texts have fingerprint 0 and are linked like any other; a row
    with a null id has a null component and links nothing; repeated rows each
    have a row; an empty table gives none.
    """
    marks = materialize(fingerprints(docs, text_col, id_col), "fingerprints")
    reps = materialize(marks.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    comps = connected_components(links(reps, max_bits), "a", "b")
    of = reps.join(comps, reps.rep == comps.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    of = materialize(of, "classes")
    known = marks.filter("doc_id IS NOT NULL").join(of, "fp").select("doc_id", "fp", "component_id")
    return known.unionByName(marks.filter("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of `docs` that stand for their class: one document each, with all its columns.

    Rows with a null id are kept. Of rows that repeat id and
    text one stays; an id stands or falls with all its texts.
    """
    found = classes(docs, max_bits).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept_id")).distinct()
    rows = docs.filter("doc_id IS NOT NULL").join(found, F.col("doc_id") == F.col("__kept_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.filter("doc_id IS NULL"))


def op2_simhash(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, fingerprint as 16 hex digits, component_id."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
