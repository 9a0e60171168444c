r"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Words are symbols. For every item length there is a window of that many words
at every word of a document. A CGK walk reads a window from left to right and
repeats each symbol a random number of times, the same for all windows; two
windows within a small edit distance then agree in most places of their
embeddings, so samples of a few places serve as hash keys. Several walks with
several samples each reach the target recall, and an exact alignment verifies
what they propose.

A window that shares fewer neighbouring word pairs with the items of its
length than the distance allows cannot match; such windows are passed over
before embedding, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.base import lower_words_of, small_batches, texts

SIMILARITY = 0.8
WALKS, TABLES, PLACES = 5, 12, 3
#: Most bytes of item texts that one pass over the documents carries to the executors; more items take more passes.
BLOCK_BYTES = 8 << 20
SEED = 20_240_101
#: Most cells of embedded windows that are held at once.
KEY_CELLS = 1 << 23


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Word edits that an item of n words may have."""
    return int((1.0 - similarity) * n + 1e-9)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, stop) of the part of `text` nearest to `item` by word edits; of equal ones the first to end, then the shortest."""

    def last_row(x: np.ndarray, y: np.ndarray, free: bool) -> np.ndarray:
        idx = np.arange(len(y) + 1)
        row = np.zeros(len(y) + 1, np.int64) if free else idx.copy()
        for i, w in enumerate(x, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[:-1] + (y != w), row[1:] + 1)
            row = np.minimum.accumulate(new - idx) + idx
        return row

    row = last_row(item, text, True)
    stop = int(np.argmin(row))
    back = last_row(item[::-1], text[:stop][::-1], False)
    return int(row[stop]), stop - int(np.argmin(back)), stop


class Index:
    """The LSH index of a block of items; small enough to travel with a task."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, walks: int = WALKS, tables: int = TABLES, places: int = PLACES):
        split = [(i, w) for i, t in items if (w := lower_words_of(t))]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
        self.similarity, self.walks, self.tables, self.places = similarity, walks, tables, places
        self.by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, ws in split:
            self.by_length.setdefault(len(ws), []).append((i, np.array([self.vocabulary[w] for w in ws], np.int32)))
        self.longest = max(self.by_length, default=0)

    def prepare(self) -> Index:
        """Walks, samples and item keys, made anew on each worker from the seed."""
        rng = np.random.default_rng(SEED)
        # the bit of a symbol at a step of a walk is the top bit of a product: nothing is stored by step and symbol
        self.spread = rng.integers(1, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64) | np.uint64(1)
        self.turn = rng.integers(1, 1 << 63, (self.walks, 3 * self.longest), dtype=np.uint64) | np.uint64(1)
        self.mix = rng.integers(1, 1 << 62, self.places, dtype=np.int64) | 1
        self.samples, self.keys, self.owners = {}, {}, {}
        lengths = sorted(self.by_length)
        coded = [np.unique(np.concatenate([self._coded(w[:-1], w[1:]) for _, w in self.by_length[n]])) for n in lengths]
        # which lengths each known pair of neighbours is in: self.at[p] to self.at[p + 1] in self.of
        pair, of = (np.concatenate([np.empty(0, np.int64), *x]) for x in (coded, [np.full(len(c), k) for k, c in enumerate(coded)]))
        order = np.argsort(pair, kind="stable")
        self.pairs, many = np.unique(pair, return_counts=True)
        # numbers of 16 bits sort in linear time
        self.at, self.of, self.lengths = np.r_[0, np.cumsum(many)], of[order].astype(np.uint16 if len(lengths) < 1 << 16 else np.int64), lengths
        for n in lengths:
            self.samples[n] = [[np.sort(rng.choice(3 * n, self.places, replace=False)) for _ in range(self.tables)] for _ in range(self.walks)]
            own = np.stack([w for _, w in self.by_length[n]])
            step = max(1, KEY_CELLS // (3 * n))
            keys = np.concatenate([self.embed(part.reshape(-1), np.arange(len(part)) * n, np.full(len(part), n)) for part in (own[lo : lo + step] for lo in range(0, len(own), step))], axis=1)
            order = np.argsort(keys, axis=None, kind="stable")
            self.keys[n], self.owners[n] = keys.reshape(-1)[order], order % len(own)
        return self

    def _coded(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * (len(self.vocabulary) + 1) + b

    def _pairs(self, line: np.ndarray) -> dict[int, np.ndarray]:
        """By item length, where neighbouring words are neighbours in some item of that length."""
        at = np.flatnonzero((line[:-1] > 0) & (line[1:] > 0))
        if not len(at) or not len(self.pairs):
            return {}
        code = self._coded(line[at], line[at + 1])
        pair = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        known = self.pairs[pair] == code
        at, pair = at[known], pair[known]
        many = self.at[pair + 1] - self.at[pair]
        n = self.of[np.repeat(self.at[pair] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())] if len(pair) else pair
        at = np.repeat(at, many)
        order = np.argsort(n, kind="stable")
        n, at = n[order], at[order]
        cut = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else n
        return dict(zip([self.lengths[k] for k in n[cut].tolist()], np.split(at, cut[1:])))

    def _starts(self, line: np.ndarray, p: np.ndarray, n: int, k: int) -> np.ndarray:
        """Starts of windows that hold enough neighbouring pairs (their places are p): an edit breaks or moves out at most two of n - 1."""
        need = n - 1 - 2 * k
        if need <= 0:
            own = np.unique(np.concatenate([w for _, w in self.by_length[n]]))
            return np.flatnonzero(np.isin(line[: len(line) - n + 1], own))
        if len(p) < need:
            return p[:0]
        first, last = p[: len(p) - need + 1], p[need - 1 :]
        fits = last - first <= n - 2
        hi = first[fits]
        # both ends only grow, so each range goes on where the last one stopped
        lo = np.maximum(last[fits] - (n - 2), np.r_[0, hi[:-1] + 1]) if len(hi) else hi
        size = np.maximum(hi - lo + 1, 0)
        every = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return every[every + n <= len(line)]

    def embed(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The keys (walks * tables, windows) of the windows of so many symbols at `starts`."""
        out = np.zeros((self.walks * self.tables, len(starts)), np.int64)
        of = [(n, np.flatnonzero(lengths == n)) for n in np.unique(lengths).tolist()]
        top = int(lengths.max(initial=0))
        with np.errstate(over="ignore"):
            for r in range(self.walks):
                at = starts.astype(np.int64)
                ends = at + lengths
                y = np.zeros((3 * top, len(starts)), np.int32)
                for j in range(3 * top):
                    y[j] = now = np.where(at < ends, symbols[np.minimum(at, len(symbols) - 1)], 0)
                    at += ((self.spread[now] * self.turn[r, j]) >> np.uint64(63)).astype(np.int64)
                for n, cols in of:
                    own = y[: 3 * n, cols].astype(np.int64)
                    for t, s in enumerate(self.samples[n][r]):
                        out[r * self.tables + t, cols] = ((own[s] + 1 + t) * self.mix[:, None]).sum(axis=0) * np.int64(2 * (r * self.tables + t) + 1)
        return out

    def _proposed(self, n: int, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, starts) that share a key; keys are (walks * tables, windows)."""
        key = keys.reshape(-1)
        lo, hi = np.searchsorted(self.keys[n], key, "left"), np.searchsorted(self.keys[n], key, "right")
        hit = np.flatnonzero(hi > lo)
        many = (hi - lo)[hit]
        item = self.owners[n][np.repeat(lo[hit] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())] if len(hit) else hit
        both = np.unique(np.stack([item, np.repeat(starts[hit % len(starts)], many) if len(hit) else hit]), axis=1)
        return both[0], both[1]

    def symbols(self, text: str | None) -> np.ndarray:
        words = lower_words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))

    def search(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(document, item id, first word, words, distance, item words) of every place in `docs` that matches an item."""
        if not self.by_length or not docs:
            return
        # a window that reaches over the gap has too many words outside its document
        gap = np.zeros(allowed(self.longest, self.similarity) + 1, np.int32)
        parts = [x for d in docs for x in (d, gap)]
        line = np.concatenate(parts)
        base = np.cumsum([0] + [len(d) + len(gap) for d in docs])[:-1]
        ends = base + np.array([len(d) for d in docs])
        where = self._pairs(line)
        every = {n: self._starts(line, where.get(n, line[:0].astype(np.int64)), n, allowed(n, self.similarity)) for n in sorted(self.by_length)}
        starts, lengths = np.concatenate(list(every.values())), np.repeat(list(every), [len(x) for x in every.values()])
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        lo = 0
        while lo < len(starts):
            hi = lo + 16384
            while hi > lo + 64 and (hi - lo) * 3 * lengths[min(hi, len(lengths)) - 1] > KEY_CELLS:
                hi = lo + (hi - lo) // 2
            part, size = starts[lo:hi], lengths[lo:hi]
            lo = hi
            keys = self.embed(line, part, size)
            for n in np.unique(size).tolist():
                of = np.flatnonzero(size == n)
                item, start = self._proposed(n, keys[:, of], part[of])
                cut = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else item
                for i, s in zip(item[cut].tolist(), np.split(start, cut[1:])):
                    found.setdefault((n, i), []).append(s)
        for (n, i), hits in sorted(found.items()):
            k, (item_id, own) = allowed(n, self.similarity), self.by_length[n][i]
            s = np.concatenate(hits)
            step = max(1, KEY_CELLS // n)
            enough = [np.isin(line[x[:, None] + np.arange(n)], own).sum(axis=1) >= n - k for x in (s[lo : lo + step] for lo in range(0, len(s), step))]
            s = s[np.concatenate(enough)]  # else too few of the item's words
            if not len(s):
                continue
            d = np.searchsorted(base, s, side="right") - 1
            cuts = np.flatnonzero((np.diff(s) > n) | (np.diff(d) > 0)) + 1
            for places, doc in zip(np.split(s, cuts), d[np.r_[0, cuts].astype(int)]):
                # a run of near starts may hold several copies: look behind each until none is left
                left, right = max(int(base[doc]), int(places[0]) - k), min(int(ends[doc]), int(places[-1]) + n + k)
                for a, b in self._places(own, line, left, right, n, k):
                    yield int(doc), item_id, a - int(base[doc]), b - a, int(self._distance), n

    def _places(self, own: np.ndarray, line: np.ndarray, left: int, right: int, n: int, k: int) -> Iterator[tuple[int, int]]:
        while right - left >= n - k and right > left:
            stop = min(right, left + 3 * (n + k))
            dist, a, b = align(own, line[left:stop])
            if dist <= k and b > a:
                self._distance = dist
                yield left + a, left + b
                left += b
            elif stop == right:
                return
            else:
                left = stop - (n + k)


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; null ids or texts are left out."""
    now: list[tuple[int, str]] = []
    size = 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        now.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= block_bytes:
            yield now
            now, size = [], 0
    if now:
        yield now


MATCH = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per place of a document that is within the allowed word edits of an item.

    similarity = 1 - distance / item words, at least `similarity`. Null and
    empty texts and items without words match nothing; repeated rows are each
    reported; equal items each match. No shuffle: the items travel in blocks.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    out = []
    for block in blocks(items, block_bytes):
        index = Index(block, similarity)

        def run(batches, index=index):
            index.prepare()
            for b in batches:
                ids = b.column(0).to_pylist()
                found = list(index.search([index.symbols(t) for t in b.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[f[0]] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3)), pa.array([f[4] for f in found], pa.int32()), pa.array([1.0 - f[4] / f[5] for f in found], pa.float64())],
                    names=["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"],
                )

        out.append(rows.mapInArrow(run, MATCH))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], MATCH)


def keep_clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that hold no match, with all their columns. Row by row: no join, no shuffle."""
    small_batches(docs.sparkSession)
    for block in blocks(items, block_bytes):
        index = Index(block, similarity)

        def run(batches, index=index):
            index.prepare()
            for b in batches:
                bad = {f[0] for f in index.search([index.symbols(t) for t in b.column("text").to_pylist()])}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return matches(docs, items)
