"""Substring dedup by words and by bytes against brute force."""

import hashlib
import random

import numpy as np
import pytest

from siftwork.llm import phrases, suffixes
from siftwork.llm.recurring import blocks, least, runs


def slow_phrases(rows, window=13):
    owner = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            owner.setdefault(b" ".join(w[k : k + window]), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and owner[b" ".join(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def covered(data, window):
    """By text, which bytes a repeated string of so many bytes covers."""
    count = {}
    for i, d in data:
        if i is not None:
            for k in range(len(d) - window + 1):
                h = hash(d[k : k + window])
                count[h] = count.get(h, 0) + 1
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        if i is not None:
            for k in range(len(d) - window + 1):
                if count[hash(d[k : k + window])] > 1:
                    gone[k : k + window] = True
        out.append(gone)
    return out


def slow_bytes(rows, window=400, short=240):
    data = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, d), gone, again in zip(data, covered(data, window), covered(data, short)):
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest(), int(again.sum())))
    return sorted(out, key=str)


def got(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


PHRASES = ("doc_id", "n_words", "n_removed", "kept_sha256")
BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_recurring")


def made(seed, n=60):
    """Texts with shared passages, edits, repeats of their own, copies and periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(10, 200))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 60))))
            if rng.random() < 0.3:
                parts.append((word() + " ") * rng.randrange(1, 300))
        text = rng.choice([" ", "\n", "  "]).join(parts)
        if rows and rng.random() < 0.2:
            text = rows[-1][1]
        if rng.random() < 0.2 and len(text) > 20:
            k = rng.randrange(len(text))
            text = text[:k] + "X" + text[k:]
        rows.append((i, text))
    rng.shuffle(rows)
    return rows


def test_phrases_of_the_table(docs, plain):
    assert got(phrases.op9_phrases(docs), PHRASES) == slow_phrases(plain.items())


def test_bytes_of_the_table(docs, plain):
    assert got(suffixes.op3_suffixes(docs), BYTES) == slow_bytes(plain.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_made_texts(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(phrases.dedup(df), PHRASES) == slow_phrases(rows)
    assert got(suffixes.dedup(df), BYTES) == slow_bytes(rows)


def test_across_buckets(spark, monkeypatch):
    """Every boundary cuts classes of equal windows: what a bucket can't see decides most of the result."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab\0") for _ in range(6))
    passage = " ".join(word() for _ in range(80))
    rows = []
    for i in range(150):
        a, z = sorted((rng.randrange(len(passage)), rng.randrange(len(passage))))
        near = " ".join(rng.choice(("aaaaaa", "bbbbbb")) for _ in range(rng.randrange(60)))
        rows.append((i, near + passage[: z if i % 3 else None] + near[::-1] if i % 2 else passage[a:] + near))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert got(suffixes.dedup(df), BYTES) == slow_bytes(rows)
        assert got(suffixes.dedup(df, 64, 64), BYTES) == slow_bytes(rows, 64, 64)
        monkeypatch.setattr(suffixes, "_messages", lambda *a: iter(()))
        assert got(suffixes.dedup(df), BYTES) != slow_bytes(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_other_windows(spark):
    rows = made(3, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixes.dedup(df, window=64, short=50), BYTES) == slow_bytes(rows, 64, 50)
    assert got(phrases.dedup(df, window=6), PHRASES) == slow_phrases(rows, 6)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(phrases.op9_phrases(odd), PHRASES) == slow_phrases(rows)
    assert got(suffixes.op3_suffixes(odd), BYTES) == slow_bytes(rows)
    assert phrases.op9_phrases(none).count() == 0 and suffixes.op3_suffixes(none).count() == 0


def test_long_shared_text(spark):
    """Two texts that share a megabyte, one more with a part of it, and words of a megabyte each."""
    rng = random.Random(11)
    shared = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150_000))
    huge = " ".join([c * 1_000_000 for c in "abc"] + ["x"] * 20)
    rows = [(5, "one " + shared + " two"), (2, "three " + shared + " four"), (9, "five " + shared[300_000:500_000]), (10, huge), (12, "and " + huge)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(phrases.dedup(df), PHRASES) == slow_phrases(rows)
    assert [r["n_removed"] for r in suffixes.dedup(df.filter("doc_id < 10")).orderBy("doc_id").collect()][:2] == [len(shared) + 3] * 2  # 'e ' before, ' ' behind


def test_phrases_come_from_the_automaton(spark, monkeypatch):
    rows = made(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(phrases, "SAMPLED", 1)
    assert got(phrases.dedup(df), PHRASES) == slow_phrases(rows)
    monkeypatch.setattr(phrases, "locate", lambda p, t, d: (np.empty(0, np.int64),) * 3)
    assert got(phrases.dedup(df), PHRASES) != slow_phrases(rows)


def test_very_long_text(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200_000))
    part = long[1_100_000:1_101_000]
    df = spark.createDataFrame([(1, long), (2, "zz " + part + " zz")], "doc_id long, text string")
    by = {r["doc_id"]: r for r in suffixes.op3_suffixes(df).collect()}
    assert by[1]["n_removed"] == 1000 and by[2]["n_removed"] == 1000 and by[1]["n_spans"] == 1
    words = len(part.split()) - 2
    by = {r["doc_id"]: r for r in phrases.op9_phrases(df).collect()}
    assert by[1]["n_removed"] == 0 and words <= by[2]["n_removed"] <= words + 2


def test_pieces():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 300)
    for w in (1, 2, 3, 7, 64, 300):
        assert least(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]
    a, f, c = runs(np.array([5, 5, 5, 9, 9]), np.array([0, 1, 3, 4, 5]))
    assert (a.tolist(), f.tolist(), c.tolist()) == ([5, 5, 9], [0, 3, 4], [2, 1, 2])
    text = bytes(range(256)) * 3
    parts = [p for g in blocks([text, b"ab"], 9, 100) for p in g]
    starts = {at + i for k, at, p in parts if k == 0 for i in range(len(p) - 9)}
    assert starts == set(range(len(text) - 9)) and all(text[at : at + len(p)] == p for k, at, p in parts if k == 0)
    rng = random.Random(4)
    data = bytes(rng.choice(b"ab") for _ in range(300))
    starts = np.array([rng.randrange(290) for _ in range(60)])
    stops = np.array([rng.randrange(s, 301) for s in starts])
    order = suffixes.multikey_order(np.frombuffer(data, np.uint8), starts, stops)
    found = [data[starts[i] : stops[i]].ljust(400, b"\0") for i in order]
    assert found == sorted(found) and sorted(order) == list(range(60))
