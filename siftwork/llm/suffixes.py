"""Suffix-array dedup of long repeated byte strings.

Suffixes are the windows that may recur: those whose anchor does (see
`recurring`). They travel in segments, the windows of one anchor with the bytes
they need. Sampled splitters range-partition the segments by all bytes from the
anchor on, then by those before it, so that splitters cut even a passage that is
everywhere. A bucket sorts its segments both ways by multikey quicksort, eight
bytes at a time and only as deep as neighbours stay equal; windows that lie
equally far from their anchors are equal if both orders put them in one class.
A window equal to one of another bucket shares as many bytes with the splitter
between them. Such windows alone, one of each class, are compared across the
boundaries, by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.base import texts
from siftwork.llm.recurring import Rolling, blocks, least, mix, runs, spans, unsqueeze, with_hits
from siftwork.plans.shared import materialize

#: Bytes of a string that is removed, of a shorter one that is only counted, and of a gram.
WINDOW, SHORT, GRAM = 400, 240, 16
#: Segments sampled for each bucket.
SAMPLE = 16
LOW, SPREAD = np.uint64((1 << 21) - 1), np.uint64(0xD6E8FEB86659FD93)


def area_of(window: int) -> int:
    """Bytes at a window's start among whose grams its anchor is; what is left from the last of them on is the anchor's key."""
    return window * 2 // 3


def ranks(data: np.ndarray, rolling: Rolling, gram: int = GRAM) -> np.ndarray:
    """A pseudo-random rank of the gram at every byte; the low bits are the byte's place, so the first of equal grams ranks least."""
    sums = rolling.sums(data)
    n = len(data) - gram + 1
    with np.errstate(over="ignore"):
        out = (sums[gram:] - sums[:n]) * rolling.down[:n]
        out *= SPREAD
    out &= ~LOW
    out |= np.arange(n, dtype=np.uint64)
    return out


def byte_anchors(window: int, area: int, gram: int = GRAM):
    """A function: list of texts in bytes -> arrays (item, key, first window, windows).

    A window's anchor is the least gram of its first `area` bytes, the key a hash of the bytes from there that every such window holds.
    """
    keyed = window - area + gram

    def find(data: list[bytes]):
        rolling, out = None, []
        for group in blocks(data, window - 1):
            if max(len(p) for _, _, p in group) < window:
                continue
            joined = np.frombuffer(b" ".join(p for _, _, p in group), np.uint8)
            if rolling is None or len(rolling.up) <= len(joined):
                rolling = Rolling(max(len(joined), 1 << 18) + 1)
            best = least(ranks(joined, rolling, gram), area - gram + 1)
            sizes = np.array([len(p) for _, _, p in group])
            offset = np.r_[0, np.cumsum(sizes + 1)[:-1]]
            many = np.maximum(sizes - window + 1, 0)
            part = np.repeat(np.arange(len(group)), many)
            windows = np.arange(many.sum()) + np.repeat(offset - np.r_[0, np.cumsum(many)[:-1]], many)
            anchor, first, count = runs((best[windows] & LOW).astype(np.int64), windows)
            of = part[np.searchsorted(windows, first)]
            item, base = np.array([k for k, _, _ in group])[of], np.array([at for _, at, _ in group])[of]
            out.append((item, mix(rolling.of(rolling.sums(joined), anchor, anchor + keyed)), base + first - offset[of], count))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    return find


def anchors_of(data: bytes, starts: np.ndarray, rolling: Rolling, window: int, area: int, gram: int = GRAM) -> np.ndarray:
    """The anchors of the windows at `starts`, in order, of one text."""
    size = len(rolling.up) - 1
    out = np.empty(len(starts), np.int64)
    for lo in range(0, max(1, len(data) - window + 1), size - window + 1):
        a, z = np.searchsorted(starts, [lo, lo + size - window + 1])
        if a < z:
            best = least(ranks(np.frombuffer(data[lo : lo + size], np.uint8), rolling, gram), area - gram + 1)
            out[a:z] = lo + (best[starts[a:z] - lo] & LOW).astype(np.int64)
    return out


def multikey_order(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The order of the suffixes data[start:stop], by a multikey quicksort on keys of eight bytes; equal ones in any order.

    Each round looks at the next key of those suffixes alone that are equal so far; one that ends comes before what goes on.
    """
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    at = np.arange(len(starts))
    for depth in range(0, int((stops - starts).max(initial=0)), 8):
        if len(at) < 2:
            break
        sub = order[at]
        place, left = starts[sub] + depth, np.clip(stops[sub] - starts[sub] - depth, 0, 8)
        key = words[np.minimum(place, len(data))].astype(np.uint64)
        short = left < 8
        key[short] = np.where(left[short] > 0, key[short] & (~np.uint64(0) << (np.uint64(8) * (8 - left[short]).astype(np.uint64) % np.uint64(64))), 0)
        by = np.lexsort((left, key, group[at]) if short.any() else (key, group[at]))
        order[at] = sub[by]
        key, left, g = key[by], left[by], group[at]
        new = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1]) | (left[1:] != left[:-1])]
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, len(at)])
        group[at] = np.repeat(at[first], sizes)
        at = at[np.repeat((sizes > 1) & (left[first] == 8), sizes)]
    return order


def shared_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes are equal from places a and b on, at most `most`."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = np.zeros(len(a), np.int64)
    on = np.flatnonzero(most > 0)
    while len(on):
        x = words[np.minimum(a[on] + out[on], len(data))] ^ words[np.minimum(b[on] + out[on], len(data))]
        # whole bytes below the lowest bit that differs
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
        out[on] += same
        on = on[(same == 8) & (out[on] < most[on])]
    return np.minimum(out, most)


class Bucket:
    """Segments sorted from their anchors on and, backwards, before them."""

    def __init__(self, segments: list[bytes], anchors: np.ndarray, counts: np.ndarray):
        sizes = np.array([len(s) for s in segments], np.int64)
        base = np.r_[0, np.cumsum(sizes)]
        data = np.frombuffer(b"".join(segments), np.uint8)
        self.data, self.base, self.anchors, self.counts, self.right = data, base, anchors, counts, sizes - anchors
        start = base[:-1] + anchors
        self.order, self.same = self._sorted(data, start, base[1:])
        turned = len(data) - start
        self.order_left, self.same_left = self._sorted(np.ascontiguousarray(data[::-1]), turned, turned + anchors)

    @staticmethod
    def _sorted(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and how much each one shares with the next."""
        order = multikey_order(data, start, stop)
        size = (stop - start)[order]
        return order, shared_bytes(data, start[order][:-1], start[order][1:], np.minimum(size[:-1], size[1:]))

    def shared_with(self, cut: bytes) -> np.ndarray:
        """How many bytes from the anchor on each segment shares with a splitter."""
        both = np.r_[self.data, np.frombuffer(cut, np.uint8)]
        return shared_bytes(both, self.base[:-1] + self.anchors, np.full(len(self.anchors), len(self.data)), np.minimum(self.right, len(cut)))

    def nearest(self) -> np.ndarray:
        """How many bytes from the anchor on each segment shares with its nearest neighbour."""
        out = np.empty(len(self.anchors), np.int64)
        out[self.order] = np.maximum(np.r_[0, self.same], np.r_[self.same, 0])
        return out

    def classes(self, window: int, ahead: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segments, classes): who has a window `ahead` bytes before the anchor, and the class of equal ones that it is in."""
        of = some[(self.anchors[some] >= ahead) & (self.anchors[some] - ahead < self.counts[some]) & (self.right[some] >= window - ahead)]
        n = len(self.anchors)
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[self.order] = np.cumsum(np.r_[0, self.same < window - ahead])
        left[self.order_left] = np.cumsum(np.r_[0, self.same_left < ahead])
        return of, right[of] * n + left[of]

    def text(self, segment: int, ahead: int, window: int) -> bytes:
        at = self.base[segment] + self.anchors[segment] - ahead
        return self.data[at : at + window].tobytes()


def repeats(bucket: Bucket, window: int, reach: int, beyond: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, bool]]]:
    """(yes, open): yes[segment, d] says that the window d bytes before the anchor has an equal one in the bucket.

    open lists (segment, d, alone) for one window of each class that shares all
    its bytes from the anchor on with a splitter (`beyond` says how many a
    segment does): these may have equals in other buckets.
    """
    yes = np.zeros((len(bucket.anchors), reach + 1), bool)
    open_: list[tuple[int, int, bool]] = []
    some = np.flatnonzero(np.maximum(bucket.nearest(), beyond) >= window - reach)
    for d in range(reach + 1 if len(some) else 0):
        of, kind = bucket.classes(window, d, some)
        if not len(of):
            continue
        by = np.argsort(kind, kind="stable")
        k = kind[by]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[first, len(k)])
        yes[of[by[np.repeat(size > 1, size)]], d] = True
        lead = of[by[first]]
        at = np.flatnonzero(beyond[lead] >= window - d)
        open_ += zip(lead[at].tolist(), [d] * len(at), (size[at] == 1).tolist())
    return yes, open_


def covers(yes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, stop) of runs of repeated windows, counted from the anchor."""
    reach = yes.shape[1] - 1
    step = np.diff(np.pad(yes[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    of, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    return of, start - reach, stop - 1 - reach + window


#: A segment, or, without bytes, runs of bytes that repeat: start and stop by run.
SEGMENT = "doc_id long, x long, first int, count int, seg binary, anchor int, silent boolean, long boolean, covers binary"
#: kind 0: bytes of a text that repeat; 1: hashes of windows and their places, to be compared across buckets; 2: hashes without a place.
FOUND = "kind int, bucket int, doc_id long, x long, start long, stop long, long boolean, keys binary, places binary"
COVER = "doc_id long, x long, start long, stop long, long boolean"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_recurring long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _rows(out: list[tuple], types: list, names: list[str], step: int = 4096) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(out), step):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out[lo : lo + step]], t) for k, t in enumerate(types)], names=names)


_I, _B = pa.int64(), pa.binary()
SEGMENT_TYPES = [_I, _I, pa.int32(), pa.int32(), _B, pa.int32(), pa.bool_(), pa.bool_(), _B]
FOUND_TYPES = [pa.int32(), pa.int32(), _I, _I, _I, _I, pa.bool_(), _B, _B]
RESULT_TYPES = [_I, _I, _I, _I, pa.string(), _I]


def touching(runs_: np.ndarray) -> np.ndarray:
    """Runs (start, stop) in order, those that touch made one."""
    runs_ = runs_[np.argsort(runs_[:, 0], kind="stable")]
    far = np.maximum.accumulate(runs_[:, 1])
    new = np.flatnonzero(np.r_[True, runs_[1:, 0] > far[:-1]])
    return np.stack([runs_[new, 0], far[np.r_[new[1:], len(runs_)] - 1]], axis=1)


def _unpack_covers(batches):
    for b in batches:
        each = [np.frombuffer(c, np.int64).reshape(-1, 2) for c in b.column(3).to_pylist()]
        of = np.repeat(np.arange(len(each)), [len(e) for e in each])
        pair = np.concatenate(each) if each else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), pa.array(pair[:, 0]), pa.array(pair[:, 1]), b.column(2).take(pa.array(of))], names=_names(COVER))


def splitters(segs: DataFrame, parts: int) -> list[tuple[bytes, bytes]]:
    """At most parts - 1 segments, as bytes from the anchor on and bytes before it backwards, that cut the table evenly; from some SAMPLE * parts rows."""
    total = segs.count()
    if not total:
        return []
    share = max(1, total // (SAMPLE * parts))
    chosen = segs.filter(F.pmod(F.xxhash64("doc_id", "x", "first"), F.lit(share)) == 0).select("seg", "anchor").collect()
    sample = sorted(_sides(r["seg"], r["anchor"]) for r in chosen)
    return sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if len(sample) > 1 else []


def _sides(seg: bytes, anchor: int) -> tuple[bytes, bytes]:
    return bytes(seg[anchor:]), bytes(seg[:anchor][::-1])


def dedup(docs: DataFrame, window: int = WINDOW, short: int = SHORT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """RESULT: every row without the bytes that a repeated string of `window` bytes covers.

    Strings are judged on the whole input: all places of a repeated string go,
    overlaps and places within one text included. n_recurring counts the bytes
    that a repeated string of `short` bytes covers (a passage of some forty
    words); those are only counted. Null texts are empty; a repeated row counts
    as a second place; a row with a null id is left whole and is no source.
    """
    if not 3 * GRAM <= short <= window:
        raise ValueError(f"short must be from {3 * GRAM} to window")
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    area = area_of(short)
    reach = area - GRAM
    seen = with_hits(rows.filter("doc_id IS NOT NULL"), byte_anchors(short, area), True)
    state_schema = "doc_id long, x long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_recurring long, z binary, runs binary, sizes binary, silent boolean"

    def first_look(batches):
        for b in batches:
            out = []
            for doc_id, x, z, first_id, copies, found, sizes in zip(*(c.to_pylist() for c in b.columns)):
                data = unsqueeze(z)
                n = len(data)
                if copies > 1 or not found or n < short:
                    again, gone = copies > 1 and n >= short, copies > 1 and n >= window
                    source = again and found and first_id == doc_id
                    kept = hashlib.sha256(b"" if gone else data).hexdigest()
                    out.append((doc_id, x, n, n if gone else 0, int(gone), kept, n if again else 0, z if source else None, found if source else None, sizes if source else None, True))
                else:
                    out.append((doc_id, x, n, 0, 0, None, 0, z, found, sizes, False))
            yield from _rows(out, [_I, _I, _I, _I, _I, pa.string(), _I, _B, _B, _B, pa.bool_()], _names(state_schema), max(1, len(out)))

    state = materialize(seen.select("doc_id", "x", "z", "first_id", "copies", "runs", "sizes").mapInArrow(first_look, state_schema), "looked")

    def segments(batches):
        """Distinct segments of a batch, and the places of those that it holds twice."""
        rolling = Rolling(1 << 18)
        for b in batches:
            places: dict[tuple, list[tuple]] = {}
            for doc_id, x, z, found, sizes, silent in zip(*(c.to_pylist() for c in b.columns)):
                data = unsqueeze(z)
                first, count = np.frombuffer(found, np.int32), np.frombuffer(sizes, np.int32)
                anchor = anchors_of(data, first.astype(np.int64), rolling, short, area) - first
                for f, c, at in zip(first.tolist(), count.tolist(), anchor.tolist()):
                    places.setdefault((data[f : f + c - 1 + window], c, at), []).append((doc_id, x, f, silent))
            out, sure = [], {}
            for (seg, c, at), own in places.items():
                doc_id, x, f, silent = own[0]
                out.append((doc_id, x, f, c, seg, at, silent or len(own) > 1, None, None))
                for d, y, g, quiet in own if len(own) > 1 else ():
                    if not quiet:
                        sure.setdefault((d, y, False), []).append((g, g + c - 1 + short))
                        if len(seg) >= window:
                            sure.setdefault((d, y, True), []).append((g, g + min(c - 1 + window, len(seg))))
            out += [(d, y, None, None, None, None, None, long, touching(np.array(runs_, np.int64)).tobytes()) for (d, y, long), runs_ in sure.items()]
            yield from _rows(out, SEGMENT_TYPES, _names(SEGMENT))

    # a row that repeats is a silent source; two of them say no more than one
    open_ = state.filter("z IS NOT NULL").select("doc_id", "x", "z", "runs", "sizes", "silent")
    every = materialize(open_.mapInArrow(segments, SEGMENT), "segments")
    segs = every.filter("seg IS NOT NULL").select("doc_id", "x", "first", "count", "seg", "anchor", "silent")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(segs, n)

    def deal(batches):
        for b in batches:
            at = [bisect_right(cuts, _sides(s, a)) for s, a in zip(b.column("seg").to_pylist(), b.column("anchor").to_pylist())]
            yield b.append_column("bucket", pa.array(at, pa.int32()))

    def compare(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("bucket")
        number = t.column("bucket").to_numpy()
        for lo, hi in spans(number):
            yield from one(t.slice(lo, hi - lo), int(number[lo]))

    def one(t: pa.Table, number: int):
        segs = t.column("seg").to_pylist()
        anchors, counts, first = (t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "count", "first"))
        ids, xs = t.column("doc_id").to_numpy(), t.column("x").to_numpy()
        loud = ~t.column("silent").to_numpy(zero_copy_only=False).astype(bool)
        bucket = Bucket(segs, anchors, counts)
        beyond = np.zeros(len(segs), np.int64)
        for cut in cuts[max(number - 1, 0) : number + 1]:
            beyond = np.maximum(beyond, bucket.shared_with(cut[0]))
        for size in (short, window) if short < window else (window,):
            long = size == window
            yes, open_ = repeats(bucket, size, reach, beyond)
            of, start, stop = covers(yes & loud[:, None], size)
            place = first[of] + anchors[of]
            for lo in range(0, len(of), 8192):
                o, p = of[lo : lo + 8192], place[lo : lo + 8192]
                k = len(o)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.nulls(k, pa.int32()), pa.array(ids[o]), pa.array(xs[o]), pa.array(p + start[lo : lo + 8192]), pa.array(p + stop[lo : lo + 8192]), pa.array(np.full(k, long)), pa.nulls(k, _B), pa.nulls(k, _B)], names=_names(FOUND))
            yield from _messages(bucket, open_, size, long, loud, np.stack([ids, xs, first + anchors]), 4 * n)

    dealt = segs.mapInArrow(deal, "doc_id long, x long, first int, count int, seg binary, anchor int, silent boolean, bucket int").repartitionByRange(n, "bucket")
    found = materialize(dealt.mapInArrow(compare, FOUND), "found")

    def resolve(batches):
        """Windows that another bucket has too."""
        key, place, big = [], [], []
        for b in batches:
            for long, k, p in zip(*(b.column(c).to_pylist() for c in ("long", "keys", "places"))):
                k = np.frombuffer(k, np.uint64).reshape(-1, 2)
                key.append(k)
                place.append(np.frombuffer(p, np.int64).reshape(3, -1) if p else np.full((3, len(k)), -1))
                big.append(np.full(len(k), long))
        if not key:
            return
        key, place, big = np.concatenate(key), np.concatenate(place, axis=1), np.concatenate(big)
        by = np.lexsort((key[:, 1], key[:, 0]))
        key = key[by]
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        size = np.diff(np.r_[cut, len(key)])
        at = by[np.repeat(size > 1, size)]
        at = at[place[2, at] >= 0]
        # neighbouring windows of a text make one row
        at = at[np.lexsort((place[2, at], place[1, at], place[0, at], big[at]))]
        p, g = place[:, at], big[at]
        new = np.flatnonzero(np.r_[True, (p[:2, 1:] != p[:2, :-1]).any(axis=0) | (g[1:] != g[:-1]) | (p[2, 1:] > p[2, :-1] + 1)][: len(at)])
        last = np.r_[new[1:], len(at)][: len(new)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(p[0, new]), pa.array(p[1, new]), pa.array(p[2, new]), pa.array(p[2, last] + np.where(g[last], window, short)), pa.array(g[new])], names=_names(COVER))

    sure = every.filter("seg IS NULL").select("doc_id", "x", "long", "covers").mapInArrow(_unpack_covers, COVER)
    across = found.filter("kind > 0").select("bucket", "long", "keys", "places").repartition(n, "bucket").mapInArrow(resolve, COVER)
    cover = found.filter("kind = 0").select("doc_id", "x", "start", "stop", "long").unionByName(sure).unionByName(across)
    merged = cover.groupBy("doc_id", "x").agg(F.collect_list(F.struct("start", "stop", "long")).alias("covers"))
    todo = state.filter("kept_sha256 IS NULL").select("doc_id", "x", "z").join(merged, ["doc_id", "x"], "left")

    def finish(batches):
        for b in batches:
            out = []
            for doc_id, _, z, found in zip(*(c.to_pylist() for c in b.columns)):
                data = np.frombuffer(unsqueeze(z), np.uint8)
                edge = np.zeros((2, len(data) + 1), np.int32)
                for c in found or []:
                    edge[int(c["long"]), c["start"]] += 1
                    edge[int(c["long"]), c["stop"]] -= 1
                gone, again = np.cumsum(edge[1, :-1]) > 0, np.cumsum(edge[:, :-1].sum(axis=0)) > 0
                gaps = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
                out.append((doc_id, len(data), int(gone.sum()), gaps, hashlib.sha256(data[~gone].tobytes()).hexdigest(), int(again.sum())))
            yield from _rows(out, RESULT_TYPES, _names(RESULT), max(1, len(out)))

    def whole(batches):
        for b in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            yield from _rows([(None, len(x), 0, 0, hashlib.sha256(x).hexdigest(), 0) for x in data], RESULT_TYPES, _names(RESULT), max(1, len(data)))

    done = state.filter("kept_sha256 IS NOT NULL").select(*_names(RESULT))
    return done.unionByName(todo.mapInArrow(finish, RESULT)).unionByName(rows.filter("doc_id IS NULL").mapInArrow(whole, RESULT))


def _messages(bucket: Bucket, open_: list[tuple[int, int, bool]], window: int, long: bool, loud: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """FOUND rows of the windows that may have equals beyond the bucket, packed by a part of their hash."""
    for lo in range(0, len(open_), 1 << 17):
        part = open_[lo : lo + (1 << 17)]
        key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(bucket.text(i, d, window)) for i, d, _ in part), np.uint64).reshape(-1, 2)
        of, ahead = np.array([i for i, _, _ in part]), np.array([d for _, d, _ in part])
        asks = np.array([alone for _, _, alone in part]) & loud[of]
        to = (key[:, 0] % np.uint64(buckets)).astype(np.int64) * 2 + ~asks
        by = np.argsort(to, kind="stable")
        where = place[:, of] - np.stack([0 * ahead, 0 * ahead, ahead])
        out = []
        for a, z in spans(to[by]):
            at = by[a:z]
            quiet = int(to[at[0]]) & 1
            out.append((1 + quiet, int(to[at[0]]) >> 1, None, None, None, None, long, key[at].tobytes(), b"" if quiet else np.ascontiguousarray(where[:, at], np.int64).tobytes()))
        yield from _rows(out, FOUND_TYPES, _names(FOUND), 512)


def op3_suffixes(docs: DataFrame) -> DataFrame:
    """The contract's digest; n_recurring counts repeats of 240 bytes."""
    return dedup(docs)
