import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwork.llm import simhash as S


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) > len(shingles))


def slow_classes(fps, bits=4):
    """{id: smallest id reachable} by all pairs."""
    ids = sorted(fps)
    least = {i: i for i in ids}
    todo = True
    near = {i: [j for j in ids if (fps[i] ^ fps[j]).bit_count() <= bits] for i in ids}
    while todo:
        todo = False
        for i in ids:
            m = min(least[j] for j in near[i])
            if m < least[i]:
                least[i], todo = m, True
    return least


def test_against_brute_force(docs, plain):
    rows = {r["doc_id"]: r for r in S.op2_simhash(docs).collect()}
    fps = {k: slow_fingerprint(v) for k, v in plain.items()}
    assert {k: r["fingerprint"] for k, r in rows.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: r["component_id"] for k, r in rows.items()} == slow_classes(fps)


@pytest.mark.parametrize("block", [16384, 4])
def test_dense_groups_and_blocks(spark, block):
    """A ball of near fingerprints and chains, with buckets that go over the block size."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**63))
    fps = {0: centre, 1: centre ^ 0b1111, 2: centre ^ 0b11111111, 900: centre ^ (1 << 63)}
    for i in range(3, 150):
        f = centre
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            f ^= 1 << int(b)
        fps[i] = f
    for i in range(200, 260):
        fps[i] = int(rng.integers(0, 2**63))
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in fps.items()]
    df = spark.createDataFrame(signed, "rep long, fp long").groupBy("fp").agg(F.min("rep").alias("rep"))
    from siftwork.operators.components import connected_components

    comp = {r["node"]: r["component"] for r in connected_components(S.links(df, block=block), "a", "b").collect()}
    rep = {r["fp"]: r["rep"] for r in df.collect()}
    got = {i: comp.get(rep[f], rep[f]) for i, f in signed}
    assert got == slow_classes(fps)


def test_segments_leave_one_with_at_most_one_bit():
    for k in range(1, 8):
        assert len(S.segments(k)) * 2 > k and sum(w for _, w in S.segments(k)) == 64


def test_odd_rows(odd, none):
    rows = S.op2_simhash(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[5]["component_id"] == 4 and all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert S.op2_simhash(none).count() == 0


def test_keep_one(odd, none):
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    assert [i for n, i in ids if not n] == [1, 4, 6, 7, 8, 9] and sum(n for n, _ in ids) == 2
    assert S.keep_one(none).count() == 0


def pairs_of(rng, common, left, right, n):
    """Pairs of sets of random shingle hashes."""
    for _ in range(n):
        h = rng.integers(0, 2**64, common + left + right, np.uint64)
        yield np.unique(h[: common + left]), np.unique(np.r_[h[:common], h[common + left :]])


def near(a, b):
    """Brute force for two wide fingerprints: a segment of 16 bits with one differing bit or none, and the words after its own."""
    x = np.bitwise_count(np.frombuffer(a, "<u8") ^ np.frombuffer(b, "<u8"))
    y = np.bitwise_count(np.frombuffer(a, "<u2") ^ np.frombuffer(b, "<u2"))
    ok = [sum(x[(k + 1 + j) % S.WORDS] for j in range(S.COUNTED)) <= S.WIDE_BITS and x[(k + 1) % S.WORDS] <= S.FIRST_BITS for k in range(S.WORDS)]
    return any(y[s] <= 1 and ok[s // 4] for s in range(len(y)))


def wide_sets(rng):
    """Pairs at a similarity near 0.77, and a group in which some are."""
    sets = [s for pair in pairs_of(rng, 40, 6, 6, 40) for s in pair]
    base = rng.integers(0, 2**64, 60, np.uint64)
    return sets + [np.unique(np.r_[base[rng.choice(60, 57, replace=False)], rng.integers(0, 2**64, 2, np.uint64)]) for _ in range(60)]


def slow_wide(fps):
    """The smallest number that links of wide fingerprints reach, by all pairs."""
    least = list(range(len(fps)))
    links = [(j, i) for i in least for j in range(i) if near(fps[j], fps[i])]
    while True:
        was = list(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if was == least:
            return least


@pytest.mark.parametrize("block", [S.WIDE_BLOCK, 4])
def test_wide_links_by_all_pairs(spark, block):
    from siftwork.operators.components import connected_components

    fps = [S.wide_fingerprint(s) for s in wide_sets(np.random.default_rng(5))]
    df = spark.createDataFrame(list(enumerate(fps)), "rep long, fps binary")
    found = {r["node"]: r["component"] for r in connected_components(S.wide_links(df, block=block), "a", "b").collect()}
    want = slow_wide(fps)
    assert [found.get(i, i) for i in range(len(fps))] == want and 40 < len(set(want)) < 90


@pytest.mark.parametrize("large, chunk", [(2, 32768), (2048, 16)])
def test_wide_buckets_of_many_rows(monkeypatch, large, chunk):
    monkeypatch.setattr(S, "LARGE", large)
    monkeypatch.setattr(S, "CHUNK", chunk)
    fps = [S.wide_fingerprint(s) for s in wide_sets(np.random.default_rng(5))]
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(fps)), pa.int64()), pa.array(fps, pa.binary())], names=["rep", "fps"])
    rows = pa.Table.from_batches(S._deal([docs], {})).sort_by("key").to_batches(max_chunksize=7)
    links = [x for b in S._wide_links(rows, S.WIDE_BITS) for x in zip(*(c.to_pylist() for c in b.columns))]
    least = list(range(len(fps)))
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert least == slow_wide(fps)


@pytest.mark.parametrize("common, left, right", [(12, 1, 2), (12, 0, 3), (20, 2, 3), (80, 10, 10), (400, 0, 100), (400, 50, 50)])
def test_wide_fingerprints_at_the_least_similarity(common, left, right):
    """At most 2 of 10,000 pairs are expected to be passed over at a similarity of 0.8; 1,000 pairs, and 4 is far off that."""
    rng = np.random.default_rng(6)
    assert sum(not near(S.wide_fingerprint(a), S.wide_fingerprint(b)) for a, b in pairs_of(rng, common, left, right, 1000)) < 4


def test_wide_fingerprint_by_plain_counts():
    h = np.random.default_rng(7).integers(0, 2**64, 600, np.uint64)
    mixed = []
    for k in range(S.WORDS):
        word = 0
        counts = [0] * 64
        for x in map(int, h):
            z = (x + k * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            z ^= z >> 31
            for b in range(64):
                counts[b] += z >> b & 1
        for b in range(64):
            word |= (2 * counts[b] > len(h)) << b
        mixed.append(word)
    assert np.frombuffer(S.wide_fingerprint(h), "<u8").tolist() == mixed and S.wide_fingerprint(h[:0]) == bytes(8 * S.WORDS)
