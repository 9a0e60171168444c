"""The pipeline's decisions against plain versions of them."""

import re

import pytest

import corpus_pipeline as C
from siftwork.llm import decontaminate, langid
from siftwork.plans.shared import materialize
from tests.llm.test_packing import check
from tests.llm.test_similar import slow_kept


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, f in C.STAGES:
        out.append(materialize(f(spark, out[-1], small), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark, small, stages):
    t = [texts(d) for d in stages[:-1]]
    assert all(d.columns == stages[0].columns for d in stages[:-1]) and 4 <= len(C.STAGES) <= 5
    classify = langid.classifier(langid.train(stages[0]))
    assert t[1] == {i: x for i, x in t[0].items() if not classify(x)[2]} and len(t[1]) > 0.97 * len(t[0])
    # five words and a similarity of 0.8 or more, by all pairs
    stay = slow_kept(t[1])
    assert t[2] == {i: x for i, x in t[1].items() if i in stay} and len(t[2]) < len(t[1])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    own = [w for ws in index.by_length.values() for _, w in ws]
    dirty = {i for i, x in t[2].items() for line in [index.symbols(x)] for w in own if decontaminate.align(w, line)[0] <= decontaminate.allowed(len(w))}
    assert t[3] == {i: x for i, x in t[2].items() if i not in dirty}
    assert t[4] == {i: re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", x) for i, x in t[3].items()}
    assert {r["doc_id"]: r["n_chars"] for r in stages[4].collect()} == {i: len(x) for i, x in t[4].items()}
    assert check(stages[5].collect(), t[4]) > 0.97


def test_run(spark, small, stages):
    key = lambda r: (r["doc_id"], r["start"])
    pick = lambda d: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in d.collect())
    got = C.run(spark, small)
    assert sum(r[2] for r in pick(got)) == sum(r[2] for r in pick(stages[-1])) and len({key(r) for r in got.collect()}) == got.count()


def test_odd_rows(spark, small, odd, none):
    for first in (odd, none):
        docs = first
        for name, f in C.STAGES:
            docs = materialize(f(spark, docs, small), name)
        assert docs.count() >= 0
