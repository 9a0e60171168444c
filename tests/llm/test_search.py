"""Decontamination, licenses and neighbours against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import decontaminate as D
from siftwork.llm import licenses as L
from siftwork.llm import vamana as V


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def best(item, text):
    """Least word edits to any part of a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_align():
    rng = random.Random(0)
    for _ in range(40):
        item, text = ([rng.randrange(4) for _ in range(n)] for n in (5, 12))
        d, a, b = D.align(np.array(item), np.array(text))
        assert d == best(item, text) == distance(item, text[a:b])


def test_planted_passages(spark, docs, plain):
    """Edited copies of the items are found, by recall; nothing else is."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rng = random.Random(2)
    junk = [w for t in plain.values() for w in t.split()]
    rows, want = [], set()
    for k in range(200):
        i, t = items[k % len(items)]
        ws = t.encode().lower().split()
        for _ in range(rng.randrange(0, D.allowed(len(ws)) + 1)):
            at, how = rng.randrange(len(ws)), rng.randrange(3)
            if how == 0:
                ws[at] = b"zzz%d" % k
            elif how == 1:
                ws.insert(at, rng.choice(junk).encode())
            elif len(ws) > 1:
                del ws[at]
        rows.append((k, " ".join([*rng.sample(junk, 30), *[w.decode() for w in ws], *rng.sample(junk, 30)])))
        want.add((k, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = D.matches(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(got & want) / len(want) > 0.97 and got <= want
    text = {i: t.encode().lower().split() for i, t in rows}
    item = {i: t.encode().lower().split() for i, t in items}
    for r in found:
        part = text[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]
        assert distance(item[r["item_id"]], part) == r["distance"] <= D.allowed(len(item[r["item_id"]])) and r["similarity"] >= 0.8


def test_table_against_brute_force(spark, docs, plain):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in D.op6_decontamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    index = D.Index(items)
    want = set()
    for k, t in plain.items():
        line = index.symbols(t)
        for own in index.by_length.values():
            for i, w in own:
                n = D.allowed(len(w))
                # a match holds all but n of the item's words somewhere
                if np.isin(w, line).sum() >= len(w) - n and D.align(w, line)[0] <= n:
                    want.add((k, i))
    assert got == want


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "short one"), (2, None), (3, ""), (None, "aaa"), (5, "word and more of the same kind word and more"), (5, "short one"), (7, "zzz")], "item_id long, text string")
    rows = D.matches(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(4, 1), (5, 1), (None, 1), (4, 5), (5, 5), (None, 5), (7, 5)}
    assert sum(r["doc_id"] == 4 and r["item_id"] == 1 for r in rows) == 2
    assert D.matches(none, bench).count() == 0 and D.matches(odd, bench.limit(0)).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in D.matches(odd, bench, block_bytes=1).collect()} == {(r["doc_id"], r["item_id"]) for r in rows}
    kept = D.keep_clean(odd, bench)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "6", "8", "9", "None"]


def license_rows(texts):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for i, t in texts:
        ws = word.findall((t or "").translate(lower))
        at = [(k, label) for phrase, label in L.BASE for p in [phrase.split()] for k in range(len(ws) - len(p) + 1) if ws[k : k + len(p)] == p]
        yield i, len(ws), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_long_item_and_many_items():
    """An item of 20,000 different words, and ten thousand items: edited copies are found, nothing else is, in little memory."""
    rng = random.Random(3)
    long = [f"w{i}" for i in range(20_000)]
    rng.shuffle(long)
    index = D.Index([(1, " ".join(long))], walks=1, tables=4).prepare()
    assert index.spread.nbytes + index.turn.nbytes < 1 << 20
    near = [w if rng.random() > 0.02 else "x" for w in long]
    found = list(index.search([index.symbols("a b " + " ".join(near) + " c"), index.symbols("a b c")]))
    assert [(f[0], f[1], f[2], f[3]) for f in found] == [(0, 1, 2, 20_000)] and found[0][4] == sum(a != b for a, b in zip(near, long))
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(20, 60)))) for i in range(10_000)]
    index = D.Index(items).prepare()
    docs, want = [], set()
    for d in range(60):
        i, t = items[rng.randrange(len(items))]
        ws = t.split()
        for _ in range(D.allowed(len(ws)) // 2):
            ws[rng.randrange(len(ws))] = "x"
        docs.append(" ".join([*rng.choices(words, k=30), *ws, *rng.choices(words, k=30)]))
        want.add((d, i))
    got = {(f[0], f[1]) for f in index.search([index.symbols(t) for t in docs])}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_licenses(spark, docs, plain, odd, none):
    pick = lambda df: sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in L.op10_licenses(df).collect()), key=str)
    assert pick(docs) == sorted(license_rows(plain.items()), key=str)
    some = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert pick(odd) == sorted(license_rows(some), key=str) and L.op10_licenses(none).count() == 0
    made = [(1, "Under the MIT License. under the mit license! UNDER-THE-MIT-LICENSE cc by nc"), (2, "under the mit-x license cc by  nc"), (3, "apache license version 2" * 3), (4, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided the following conditions are met"), (5, "cc by nc cc by nc cc by")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert pick(df) == sorted(license_rows(made), key=str)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in L.op10_licenses(df).collect()}
    assert labels[4][0] == "bsd" and 0.6 <= labels[4][1] <= 1 and labels[2][0] == "cc-by-nc" and labels[1][0] == "cc-by-nc,mit"


def slow_labels(text):
    """Labels by looking at every diagonal of every notice."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    out = set()
    for phrase, label in L.BASE:
        p = phrase.split()
        out |= {label} if any(ws[i : i + len(p)] == p for i in range(len(ws))) else set()
    for notice, label in L.NOTICES:
        t = notice.split()
        where = {}
        for p in range(len(ws) - 2):
            for a in range(len(t) - 2):
                if ws[p : p + 3] == t[a : a + 3]:
                    where.setdefault(p - a, set()).add(a)
        shares = {d: len(set().union(*(where.get(d + e, set()) for e in range(-4, 5)))) / (len(t) - 2) for d in where}
        for d, share in shares.items():
            if share < 0.6 or max((shares[e], len(where[e]), -e) for e in shares if abs(e - d) <= 4 and shares[e] >= 0.6) != (share, len(where[d]), -d):
                continue
            places = sorted({d + e + a + j for e in range(-4, 5) for a in where.get(d + e, ()) for j in range(3)})
            row = [0] * (len(t) + 1)
            for p in places:
                new = row[:]
                for j, x in enumerate(t, 1):
                    new[j] = max(new[j - 1], row[j], row[j - 1] + 1 if x == ws[p] else 0)
                row = new
            out |= {label} if row[-1] / len(t) >= 0.6 else set()
    return ",".join(sorted(out))


def test_labels_against_every_diagonal(spark, docs, plain):
    mozilla = next(t for t, label in L.NOTICES if label == "mpl-2")
    rng = random.Random(8)
    rows = [(0, mozilla + " license v 2 0" * 4), (1, "license v 2 0 " * 9), (2, " ".join(reversed(mozilla.split())))]
    for k in range(3, 80):
        ws = " ".join(rng.choice(L.NOTICES)[0] for _ in range(rng.randrange(1, 4))).split()
        for _ in range(rng.randrange(len(ws) // 2)):
            i = rng.randrange(len(ws))
            how = rng.randrange(4)
            if how == 0:
                ws[i] = "zz"
            elif how == 1:
                ws.insert(i, rng.choice(ws))
            elif how == 2 and len(ws) > 4:
                del ws[i]
            else:
                ws[i : i + 6] = ws[i : i + 6][::-1]
        rows.append((k, " ".join(ws)))
    rows += [(1000 + i, t) for i, t in plain.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in L.op10_licenses(df).collect()}
    assert got == {i: slow_labels(t) for i, t in rows}
    assert got[0] == "mpl-2" and got[1] == got[2] == ""


def slow_neighbours(rows, k=20):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], np.float32).astype(np.float64)
    out = {}
    for i in (i for i in ids if i % 20 == 0):
        s = x @ x[ids.index(i)]
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
        out[i] = [(v, -d) for d, v in order]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}, out


@pytest.mark.parametrize("shard", [8192, 100])
def test_recall(spark, shard):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    got, ranks = answers(V.nearest(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), F.col("vec_id") % 20 == 0, shard=shard))
    want = slow_neighbours(rows)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.95
    for q, found in got.items():
        assert [r for r, *_ in sorted(ranks[q])] == list(range(1, 21))
        x = np.array(rows[q], np.float64)
        assert np.allclose([s for _, s in found], [x @ np.array(rows[v], np.float64) for v, _ in found], rtol=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_unequal_lengths_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = {i: (rng.normal(size=8) * (1 + 5 * (i % 7 == 0))).astype(np.float32).tolist() for i in range(400)}
    for i in range(100, 200):
        rows[i] = rows[100]
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    got, _ = answers(V.op5_neighbours(df))
    want = slow_neighbours(rows)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.95
    assert [v for v, _ in got[100]][:3] == [v for v, _ in want[100]][:3]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (None, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, []), (5, [1.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, node int, score double")
    got, _ = answers(V.op5_neighbours(df))
    assert got == {0: [(2, 1.0), (3, 1.0), (20, 0.0)], 20: [(2, 1.0), (3, 1.0), (0, 0.0)]}
    assert V.op5_neighbours(df.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["narrow", "normal"])
def test_recall_of_a_full_shard_of_unequal_lengths(how):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((V.SHARD, 64)).astype(np.float32)
    if how == "narrow":
        v *= rng.uniform(0.8, 1.2, (len(v), 1)).astype(np.float32) / np.linalg.norm(v, axis=1)[:, None]
    graph, entries = V.build(v, float(np.linalg.norm(v, axis=1).max()))
    q = v[::64]
    found, _ = V.beam_search(v, graph, entries, q, V.SEARCH_BEAM)
    want = np.argsort(-(q @ v.T), axis=1)[:, :21]
    assert np.mean([len(set(a[:21]) & set(b)) / 21 for a, b in zip(found.tolist(), want.tolist())]) >= 0.95


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.normal(size=6).tolist() for i in range(60)}
    got, _ = answers(V.op5_neighbours(spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows.items()], "vec_id long, embedding array<double>, a int, b int, v int")))
    for q in (0, 20, 40):
        x = {i: float(np.dot(rows[i], rows[q])) for i in rows if i != q}
        assert np.allclose([s for _, s in got[q]], sorted(x.values(), reverse=True)[:20], rtol=1e-14)


def test_prune_keeps_diverse_edges():
    points = np.array([[0, 0, 1], [1, 0, 0.9], [1.1, 0, 0.8], [-1, 0, 0.9]], np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    out = V.robust_prune(points, np.array([0]), points[:1], np.array([[1, 2, 3, 2, -1]]), 1.2, 4)[0].tolist()
    assert out[:2] == [1, 3] or out[:2] == [3, 1]
    assert 2 not in out
