"""Near-duplicates against brute-force Jaccard of 5-word shingles."""

from itertools import combinations

import pytest

from siftwork.llm import similar


def slow_kept(texts, least=0.8):
    """Ids that are the smallest of their class, by all pairs."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i for i in texts if top(i) == i}


def kept(df, **more):
    return {r["doc_id"] for r in similar.keep_one(df, **more).collect()}


def test_against_brute_force(docs, plain):
    want = slow_kept(plain)
    assert kept(docs) == want and len(want) < len(plain)


@pytest.mark.parametrize("block", [128, 3])
def test_threshold_chains_and_blocks(spark, block):
    w = [f"w{i}" for i in range(104)]

    def text(*changed):
        return " ".join("x" + x if i in changed else x for i, x in enumerate(w))

    # 100 shingles; a changed word inside replaces five, a first one replaces one
    texts = {10: text(), 11: text(50), 12: text(50, 60), 13: text(50, 60, 70), 14: text(20, 40, 60, 80, 90), 15: text().upper()}
    texts |= {20: "a b c d e", 21: "a b c", 22: "A B C", 30: "", 31: " \n"}
    # 8 of 10 shingles are shared, and 7 of 10
    texts |= {40: "q r s t u v w x y z 1 2 3", 41: "q r s t u v w x y z 1 2", 42: "other r s t u v w x y z 1 2"}
    texts |= {100 + i: text(*range(i % 7)) for i in range(20)}
    want = slow_kept(texts)
    assert {10, 14, 20, 21, 30, 40} <= want and not {11, 12, 13, 15, 22, 31, 41} & want
    assert kept(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=block) == want


def test_odd_rows(odd, none):
    rows = similar.keep_one(odd)
    ids = [r["doc_id"] for r in rows.collect()]
    assert rows.columns == odd.columns and sorted(i for i in ids if i is not None) == [1, 4, 6, 7, 8, 9] and ids.count(None) == 2
    assert similar.keep_one(none).count() == 0


def test_stage(spark, small, docs, plain):
    """The stage of the pipeline takes this definition, not op2's digest."""
    import corpus_pipeline

    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()} == slow_kept(plain)


def test_stage_takes_its_links_from_simhash(spark, small, docs, plain, monkeypatch):
    """No other path brings candidates: without the links of fingerprints every distinct text stays."""
    import corpus_pipeline

    monkeypatch.setattr(similar, "wide_links", lambda marks, **_: spark.createDataFrame([], "a long, b long"))
    stay = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()}
    first = {}
    for i in sorted(plain):
        first.setdefault(tuple(plain[i].encode().lower().split()), i)
    assert stay == set(first.values()) and stay > slow_kept(plain)


def test_four_of_five_shingles(spark):
    """Texts of eight and nine words: the least similarity with the fewest shingles."""
    rows = [(2 * i + k, " ".join(f"w{i}x{j}" for j in range(9 - k))) for i in range(300) for k in (0, 1)]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == {2 * i for i in range(300)}
