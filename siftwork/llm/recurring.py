"""Which stretches of a corpus may occur twice: anchors that content chooses, and where they recur.

Comparing every window of every text would move the corpus several times over.
Instead every window names an anchor, the least hash among the grams at its
start; equal windows name equal anchors, so only windows whose anchor recurs
can be equal to another. Anchors are a small share of all places. They travel
in packed blocks, each key once for each batch of documents, so neither copies
nor hot passages pile up; an anchor that a batch holds twice is known to recur
without asking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.base import texts
from siftwork.plans.shared import materialize

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Most bytes of text that are hashed at once; a place within them takes PLACE_BITS bits.
BLOCK, PLACE_BITS = 1 << 18, 21


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Rolling:
    """Prefix sums of a polynomial over bytes, and the hash of any stretch from them."""

    def __init__(self, size: int):
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, INVERSE)])

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        with np.errstate(over="ignore"):
            terms = data.astype(np.uint64)
            terms += np.uint64(1)
            terms *= self.up[: len(data)]
            np.cumsum(terms, out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[stop] - sums[start]) * self.down[start]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(anchor: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows in order and their anchors: (anchor, first window, windows) of each run of equal anchors."""
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
    return anchor[cut], window[cut], np.diff(np.r_[cut, len(anchor)])


def blocks(items: list[bytes], overlap: int, size: int = BLOCK) -> Iterator[list[tuple[int, int, bytes]]]:
    """(item, its offset, bytes) in groups of at most `size` bytes; a longer item comes in pieces that overlap."""
    now, have = [], 0
    for k, data in enumerate(items):
        step = size - overlap
        for at in range(0, max(1, len(data) - overlap), step) if len(data) > size else (0,):
            part = data[at : at + size] if len(data) > size else data
            if have + len(part) + 1 > size and now:
                yield now
                now, have = [], 0
            now.append((k, at, part))
            have += len(part) + 1
    if now:
        yield now


def digest(text_col: str = "text"):
    """A 64-bit hash that tells texts of one id apart."""
    return F.xxhash64(text_col)


MESSAGE = "bucket int, kind int, key binary, who binary, doc binary, first binary, count binary"
PACKED = "part int, doc binary, first binary, count binary"
HIT = "doc_id long, x long, first binary, count binary"


def hits(docs: DataFrame, anchors, places_count: bool) -> DataFrame:
    """HIT rows: the runs of windows of each distinct text whose anchor recurs.

    docs has (doc_id, x, text) without nulls. `anchors(list of bytes)` gives
    arrays (item, key, first window, windows). An anchor recurs if two different
    texts hold it, or, with `places_count`, also two places of one text. Of
    equal texts in a batch only the smallest id is looked at: the others are
    copies of it. A text has one row at most.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n

    def emit(batches):
        for b in batches:
            ids, xs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, xs))
            only = np.sort(order[np.r_[True, xs[order][1:] != xs[order][:-1]]]) if len(ids) else order
            data = [t.encode("utf-8", "surrogatepass") for t in b.column(2).take(pa.array(only)).to_pylist()]
            item, key, first, count = anchors(data)
            item = only[item]
            who = xs[item].astype(np.uint64)
            if places_count:
                who = mix(who ^ mix(first.astype(np.uint64) + np.uint64(7)))
            order = np.lexsort((who, key))
            item, key, first, count, who = item[order], key[order], first[order], count[order], who[order]
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            group = np.cumsum(new) - 1
            start = np.flatnonzero(new)
            stop = np.r_[start[1:], len(key)] - 1
            twice = who[start] != who[stop] if len(key) else np.empty(0, bool)
            here = twice[group] if len(key) else twice
            rows = []
            for i, a, z in _by_item(item[here]):
                at = np.flatnonzero(here)[a]
                rows.append((int((ids[i] ^ xs[i]) % buckets), 2, b"", b"", np.array([ids[i], xs[i]], np.int64).tobytes(), first[at].astype(np.int32).tobytes(), count[at].astype(np.int32).tobytes()))
            # kind 1: one word to the others that the key recurs; kind 0: a key to be looked up
            for kind, at in ((1, start[twice]), (0, np.flatnonzero(~here))):
                bucket = (key[at] % np.uint64(buckets)).astype(np.int64)
                at = at[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket)
                for lo, hi in spans(bucket):
                    k = at[lo:hi]
                    doc = np.stack([ids[item[k]], xs[item[k]]]).astype(np.int64)
                    rows.append((int(bucket[lo]), kind, key[k].tobytes(), who[k].tobytes() if places_count else b"", doc.tobytes() if kind == 0 or not places_count else b"", first[k].astype(np.int32).tobytes() if kind == 0 else b"", count[k].astype(np.int32).tobytes() if kind == 0 else b""))
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            for lo in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[lo : lo + 512]], t) for c, t in enumerate(kinds)], names=[c.split()[0] for c in MESSAGE.split(", ")])

    def resolve(batches):
        """What recurs among the keys of a partition, packed by groups of documents."""
        key, who, told, doc, first, count = [], [], [], [], [], []
        local: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            for _, kind, k, w, d, f, c in zip(*(b.column(i).to_pylist() for i in range(7))):
                if kind == 2:
                    f = np.frombuffer(f, np.int32)
                    local.append((np.repeat(np.frombuffer(d, np.int64)[:, None], len(f), 1), f, np.frombuffer(c, np.int32)))
                    continue
                k = np.frombuffer(k, np.uint64)
                key.append(k)
                told.append(np.full(len(k), kind == 1))
                pair = np.frombuffer(d, np.int64).reshape(2, -1) if d else np.zeros((2, len(k)), np.int64)
                doc.append(pair)
                who.append(np.frombuffer(w, np.uint64) if w else pair[1].astype(np.uint64))
                first.append(np.frombuffer(f, np.int32) if f else np.zeros(len(k), np.int32))
                count.append(np.frombuffer(c, np.int32) if c else np.zeros(len(k), np.int32))
        if key:
            k, w, t = np.concatenate(key), np.concatenate(who), np.concatenate(told)
            del key, who, told
            order = np.lexsort((w, k))
            k, w, t = k[order], w[order], t[order]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            stop = np.r_[start[1:], len(k)] - 1
            again = (w[start] != w[stop]) | np.logical_or.reduceat(t, start)
            pick = order[np.repeat(again, stop - start + 1) & ~t]
            del k, w, t, order
            local.append((np.concatenate(doc, axis=1)[:, pick], np.concatenate(first)[pick], np.concatenate(count)[pick]))
        yield from packed(local, buckets)

    found = docs.select("doc_id", "x", "text").mapInArrow(emit, MESSAGE).repartition(n, "bucket").mapInArrow(resolve, PACKED)
    return found.repartition(n, "part").mapInArrow(gather, HIT)


def gather(batches):
    """HIT rows, one a document, of what `packed` has made."""
    local = [(np.frombuffer(d, np.int64).reshape(2, -1), np.frombuffer(f, np.int32), np.frombuffer(c, np.int32)) for b in batches for d, f, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
    if not local:
        return
    d, f, c = np.concatenate([x[0] for x in local], axis=1), np.concatenate([x[1] for x in local]), np.concatenate([x[2] for x in local])
    order = np.lexsort((f, d[1], d[0]))
    d, f, c = d[:, order], f[order], c[order]
    cut = np.flatnonzero(np.r_[True, (d[:, 1:] != d[:, :-1]).any(axis=0)])
    each = list(zip(cut.tolist(), np.r_[cut[1:], d.shape[1]].tolist()))
    for lo in range(0, len(each), 4096):
        part = each[lo : lo + 4096]
        at = [a for a, _ in part]
        yield pa.RecordBatch.from_arrays([pa.array(d[0, at]), pa.array(d[1, at]), pa.array([f[a:z].tobytes() for a, z in part], pa.binary()), pa.array([c[a:z].tobytes() for a, z in part], pa.binary())], names=["doc_id", "x", "first", "count"])


def packed(local: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc, first, count): runs of windows by group of documents."""
    if not local:
        return
    d, f, c = np.concatenate([x[0] for x in local], axis=1), np.concatenate([x[1] for x in local]), np.concatenate([x[2] for x in local])
    part = (mix((d[0] ^ d[1]).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, d, f, c = part[order], d[:, order], f[order], c[order]
    for a, z in spans(part):
        yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([d[:, a:z].tobytes()], pa.binary()), pa.array([f[a:z].tobytes()], pa.binary()), pa.array([c[a:z].tobytes()], pa.binary())], names=["part", "doc", "first", "count"])


def spans(values: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return list(zip(cut.tolist(), np.r_[cut[1:], len(values)].astype(int).tolist()))


def _by_item(items: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    order = np.argsort(items, kind="stable")
    for a, z in spans(items[order]):
        yield int(items[order[a]]), order[a:z], z


def squeeze(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(text.encode("utf-8", "surrogatepass"))


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def with_hits(docs: DataFrame, anchors, places_count: bool) -> DataFrame:
    """(doc_id, x, first_id, copies, runs, sizes, z): every row of docs (doc_id, text) with what it takes part in.

    z is the text as zstandard; first_id the smallest id with the same text and
    copies the number of rows with it; runs and sizes the first windows and
    lengths of its runs, blocks of 32-bit numbers, null where nothing recurs.
    Null ids must be left out before. The texts move once.
    """
    rows = texts(docs).withColumn("x", digest())
    marks = rows.select("doc_id", "x", F.unhex(F.md5("text")).alias("d"))
    # written, so that adaptive execution can split the join where one text has very many copies
    same = materialize(marks.groupBy("d").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "same")
    info = marks.distinct().join(same, "d").select("doc_id", "x", "first_id", "copies")
    found = hits(rows, anchors, places_count).withColumnsRenamed({"first": "runs", "count": "sizes"})
    info = info.join(found, ["doc_id", "x"], "left")

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([squeeze(t) for t in b.column(2).to_pylist()], pa.binary())], names=["doc_id", "x", "z"])

    z = rows.select("doc_id", "x", "text").mapInArrow(pack, "doc_id long, x long, z binary")
    return z.join(info, ["doc_id", "x"])
