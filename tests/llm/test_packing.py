import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftwork.llm import packing as P


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(pieces, texts, window=2048):
    """Every token in one piece, right sums, gapless sequences."""
    want = ids_of(texts.values())
    by = dict(zip(texts, want))
    seen = {k: 0 for k in texts}
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = by[p["doc_id"]]
        assert p["start"] == seen[p["doc_id"]] and p["length"] > 0 and p["doc_tokens"] == len(ids)
        seen[p["doc_id"]] += p["length"]
        part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert all(seen[k] == len(by[k]) for k in texts)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(map(len, want)) / (len(sequences) * window)


def test_ids_of_odd_texts():
    """The fast encoder's ids are the tokenizer's, also for controls, long runs, scripts and the larger table."""
    texts = ["", "\x00\x01\x7f\x80", " " * 3000 + "x", "a" * 5000, "\r\n\t\x0b\x0c \u00a0\u2003", "'s 'T don't I'LL", "12345678901234567890", "漢字かな交じり文", "🙂🙂👨‍👩‍👧", "\ufffd\ufeff", "e\u0301 \u0645\u0631\u062d\u0628\u0627", "<|endoftext|>", "\u2028\u2029!!??..--"]
    encode = P.encoder(P.tokenizer_path())
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    for text, want in zip(texts + rows, ids_of(texts + rows)):
        assert [*encode(text)] == want[:-1], text[:40]


def test_round_trip(docs, plain):
    assert check(P.op1_packing(docs).collect(), plain) > 0.99


@pytest.mark.parametrize("window", [16, 64])
def test_small_windows(docs, plain, window):
    some = {k: v for k, v in plain.items() if k < 40}
    assert check(P.pack(docs.filter("doc_id < 40"), window)[0].collect(), some, window) > 0.99


def test_odd_rows(odd, none):
    rows = P.op1_packing(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    check(rows, texts)
    assert {r["doc_id"] for r in rows if r["doc_tokens"] == 1} == {1, 2}
    assert sum(r["length"] for r in P.op1_packing(odd).collect()) == sum(map(len, ids_of([r["text"] for r in odd.collect()])))
    assert P.op1_packing(none).count() == 0


def test_same_ids_as_the_other_library():
    encode = P.encoder(P.tokenizer_path())
    texts = ["", "<|endoftext|> x", "a\r\n\tb  c", "é漢🙂\u0000", "don't  I'll 12345", "=" * 3000, "퟿ ñ" * 50]
    assert [encode(t) + [1] for t in texts] == ids_of(texts)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 2048, 20_000), minlength=2048)
    patterns, rest = P.plan(counts)
    used = rest.copy()
    for own, r in patterns:
        assert 2048 - P.SLACK <= sum(n * m for n, m in own) <= 2048
        for n, m in own:
            used[n] += m * r
    assert (used[1:] == counts[1:]).all() and rest.sum() < 2000
    x = P.non_negative(np.array([[5, 3, 0], [4, 4, 0]]), np.array([0, 0, 0, 10.0, 6, 10]))
    assert np.allclose(x, [10, 3], atol=0.05)


def test_unpack():
    assert P.unpack(np.array([1, 65535], "<u2").tobytes()).tolist() == [1, 65535]
    assert P.unpack(b"\x00" + np.array([1, 70000], "<u4").tobytes()).tolist() == [1, 70000]
