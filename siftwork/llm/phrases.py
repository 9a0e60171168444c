"""Substring dedup by repeated-phrase automata.

Runs of windows whose anchor recurs (see `recurring`) go with their words to the
shard of that anchor, where all equal windows meet. A shard confirms which
windows recur in two documents, joins neighbours that always stand together to
phrases, compiles the phrases into an Aho-Corasick automaton and streams the
words of all its documents through it. Only the occurrences that the automaton
finds say who owns a phrase, the smallest id among them, and where it goes.
Windows of an anchor that is very common are dealt out one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.base import texts
from siftwork.llm.recurring import HIT, PACKED, Rolling, gather, least, mix, packed, runs, spans, unsqueeze, with_hits
from siftwork.plans.shared import materialize

WINDOW, GRAM = 13, 5
#: Most words that a shard compiles and streams at once, but for a single anchor with more.
SHARD_WORDS = 1 << 20
#: An anchor with over one in 4 n of all segments, for n partitions, is dealt out by windows; so many segments are counted at most, nearly.
SAMPLED = 1 << 18
#: Single windows that a task holds before it sends them.
SPLIT = 1 << 16
DIGIT = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SPACE = _SPACE.tolist()


def word_anchors(window: int = WINDOW, gram: int = GRAM):
    """A function: list of texts in bytes -> arrays (item, key, first window, windows)."""

    def find(data: list[bytes]):
        space, rolling = np.array(SPACE), None
        out = []
        for group in _word_blocks(data, window):
            joined = np.frombuffer(b" ".join(part for _, _, part in group), np.uint8)
            if rolling is None or len(rolling.up) <= len(joined):
                rolling = Rolling(max(len(joined), 1 << 18) + 1)
            inside = ~space[joined]
            step = np.diff(np.r_[0, inside.view(np.int8), 0])
            start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            if len(start) < window:
                continue
            hashed = mix(rolling.of(rolling.sums(joined), start, stop))
            offset = np.cumsum([0] + [len(part) + 1 for _, _, part in group])[:-1]
            part = np.searchsorted(offset, start, side="right") - 1
            first_word = np.searchsorted(part, np.arange(len(group)))
            n = len(start) - gram + 1
            key = np.zeros(n, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(gram):
                    key = key * np.uint64(0x100000001B3) + hashed[j : j + n]
            key = mix(key)
            # the place stands in the low bits: the least value is the first of the least grams
            ranked = (key & ~np.uint64((1 << 21) - 1)) | np.arange(n, dtype=np.uint64)
            at = (least(ranked, window - gram + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
            windows = np.flatnonzero(part[: len(part) - window + 1] == part[window - 1 :])
            if not len(windows):
                continue
            anchor, first, count = runs(at[windows], windows)
            of = part[first]
            item = np.array([k for k, _, _ in group])[of]
            base = np.array([words for _, words, _ in group])[of]
            out.append((item, key[anchor], base + first - first_word[of], count))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    return find


def _word_blocks(data: list[bytes], window: int, size: int = 1 << 18):
    """Like recurring.blocks, but a long text is cut between words and its pieces share window - 1 words; offsets count words."""
    now, have = [], 0
    for k, text in enumerate(data):
        if len(text) <= size:
            parts = [(k, 0, text)]
        else:
            words = text.split()
            parts, at = [], 0
            while at == 0 or at + window - 1 < len(words):
                end, length = at, 0
                while end < len(words) and (length < size // 2 or end - at < 2 * window):
                    length += len(words[end]) + 1
                    end += 1
                parts.append((k, at, b" ".join(words[at:end])))
                if end == len(words):
                    break
                at = end - window + 1
        for p in parts:
            if now and have + len(p[2]) + 1 > size:
                yield now
                now, have = [], 0
            now.append(p)
            have += len(p[2]) + 1
    if now:
        yield now


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def grouped(line: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The group of equal windows of `line` that each start in `at` is in: the least place of its group."""
    h = np.zeros(len(at), np.uint64)
    spread = mix(line.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        for j in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + spread[at + j]
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    lead = np.repeat(order[first], np.diff(np.r_[first, len(at)]))
    # windows of one hash and other words stay alone
    same = np.ones(len(at), bool)
    for j in range(window):
        same &= line[at[order] + j] == line[at[lead] + j]
    out = np.empty(len(at), np.int64)
    out[order] = np.where(same, lead, order)
    return out


def phrases_of(line: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(place, words) of the phrases of a shard: maximal chains of windows that recur in two documents and always stand together.

    low and high are the smallest and the largest document of each window.
    """
    n = len(at)
    group = grouped(line, at, window)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
    size = np.diff(np.r_[first, n])
    number = np.empty(n, np.int64)
    number[order] = np.repeat(np.arange(len(first)), size)
    recurs = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
    follows = np.r_[np.where(at[1:] == at[:-1] + 1, number[1:], -1), -1][order]
    least_, most = np.minimum.reduceat(follows, first), np.maximum.reduceat(follows, first)
    after = np.where((least_ == most) & (most >= 0), most, -1)
    after = np.where((after >= 0) & (size[np.maximum(after, 0)] == size), after, -1)
    head = recurs.copy()
    head[after[(after >= 0) & recurs]] = False
    place, now = at[order[first]][head], np.flatnonzero(head)
    length = np.full(len(now), window)
    on = np.arange(len(now))
    while len(on := on[after[now[on]] >= 0]):
        now[on] = after[now[on]]
        length[on] += 1
    return list(zip(place.tolist(), length.tolist()))


def locate(phrases: list[str], text: str, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first word, last word) of every occurrence of the phrases in a text, both written in `digits` characters a word."""
    if not phrases:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, p in enumerate(phrases):
        automaton.add_word(p, k)
    automaton.make_automaton()
    found = np.fromiter((x for pair in automaton.iter(text) for x in pair), np.int64).reshape(-1, 2)
    which, last = found[:, 1], found[:, 0] // digits
    sizes = np.array([len(p) // digits for p in phrases])
    return which, last - sizes[which] + 1, last


def written(line: np.ndarray, words: int) -> tuple[str, int]:
    """Word numbers as characters, the same many for each word; a digit's range tells its place, so nothing is found between words."""
    digits = 1
    while DIGIT**digits <= words:
        digits += 1
    if digits > 256 // DIGIT:
        raise ValueError("too many different words in a shard")
    out = np.empty((len(line), digits), np.uint8)
    for j in range(digits):
        out[:, j] = line // DIGIT ** (digits - 1 - j) % DIGIT + DIGIT * j
    return out.tobytes().decode("latin-1"), digits


#: Segments of one bucket: keys of 64 bits, holders by segment, (id, text, first word) by holder, and the words.
#: Without keys: windows that are known to stand in an earlier document, as (ids, texts), first words and counts.
SEGMENTS = "bucket int, keys binary, holders binary, docs binary, firsts binary, words binary"
STATE = "doc_id long, x long, n_words long, n_removed long, kept_sha256 string, z binary, runs binary, sizes binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def dedup(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """RESULT: every row with the words that stay once each repeated window is removed from all but its owner.

    A word goes if a window of `window` words over it also starts in a document
    with a smaller id. Null and empty texts have no words; rows that repeat an
    id are sources and targets alike; a row with a null id loses nothing and is
    no source.
    """
    rows = texts(docs, id_col, text_col)
    seen = with_hits(rows.filter("doc_id IS NOT NULL"), word_anchors(window), False)

    def first_look(batches):
        for b in batches:
            out = []
            for doc_id, x, z, first_id, found, sizes in zip(*(c.to_pylist() for c in b.columns)):
                words = unsqueeze(z).split()
                n = len(words)
                if first_id < doc_id and n >= window:
                    out.append((doc_id, x, n, n, sha([]), None, None, None))
                elif first_id < doc_id or not found or n < window:
                    out.append((doc_id, x, n, 0, sha(words), None, None, None))
                else:
                    out.append((doc_id, x, n, 0, None, z, found, sizes))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    names = ["doc_id", "x", "n_words", "n_removed", "kept_sha256", "z", "runs", "sizes"]
    state = materialize(seen.select("doc_id", "x", "z", "first_id", "runs", "sizes").mapInArrow(first_look, STATE), "looked")
    open_ = state.filter("z IS NOT NULL").select("doc_id", "x", "z", "runs", "sizes")

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segs = materialize(open_.mapInArrow(lambda batches: _segments(batches, window, 4 * n), SEGMENTS), "segments")
    common = _common(segs, n)

    def route(batches):
        places: dict[tuple[int, bytes], list] = {}
        for b in batches:
            keys = b.column("keys").to_pylist()
            split = np.array([bool(k and len(common)) and bool(np.isin(np.frombuffer(k, np.uint64), common).any()) for k in keys], bool)
            yield b.filter(pa.array(~split))
            for row in b.filter(pa.array(split)).to_pylist():
                yield from _packs(_by_window(row, common, window, places), window, 4 * n)
                if len(places) >= SPLIT:
                    yield from _packs(places, window, n, 4)
                    places = {}
        yield from _packs(places, window, n, 4)

    found = segs.mapInArrow(route, SEGMENTS).repartition(n, "bucket").mapInArrow(lambda batches: _shards(batches, window, 4 * n), PACKED)
    later = materialize(found.repartition(n, "part").mapInArrow(gather, HIT), "later")
    todo = state.filter("z IS NOT NULL").select("doc_id", "x", "z").join(later, ["doc_id", "x"], "left").select("doc_id", "z", "first", "count")

    def finish(batches):
        for b in batches:
            out = []
            for doc_id, z, first, count in zip(*(c.to_pylist() for c in b.columns)):
                words = unsqueeze(z).split()
                if first is None:
                    out.append((doc_id, len(words), 0, sha(words)))
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                first, count = np.frombuffer(first, np.int32), np.frombuffer(count, np.int32)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + count - 1 + window, -1)
                keep = np.cumsum(edge)[:-1] == 0
                out.append((doc_id, len(words), int((~keep).sum()), sha([w for w, k in zip(words, keep.tolist()) if k])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    done = state.filter("z IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256")
    none = rows.filter("doc_id IS NULL").mapInArrow(lambda it: (_plain(b) for b in it), RESULT)
    return done.unionByName(todo.mapInArrow(finish, RESULT)).unionByName(none)


def _pack(bucket: int, segs: list[tuple[int, bytes, list[tuple[int, int, int]]]]) -> tuple:
    holders = np.array([h for _, _, own in segs for h in own], np.int64).reshape(-1, 3)
    return (bucket, np.array([k for k, _, _ in segs], np.uint64).tobytes(), np.array([len(own) for _, _, own in segs], np.int32).tobytes(), holders[:, :2].tobytes(), holders[:, 2].astype(np.int32).tobytes(), b"\n".join(s for _, s, _ in segs))


def _packs(places: dict[tuple[int, bytes], list], window: int, buckets: int, step: int = 1) -> Iterator[pa.RecordBatch]:
    """SEGMENTS rows, one for every `step`-th bucket; places are holders by key and words.

    Of the holders that meet here only the smallest id goes on: the others have
    the words from an earlier document, and a row without keys says so. However
    many hold a passage, a shard hears of one from each task.
    """
    by: dict[int, list] = {}
    told: list[tuple[int, int, int, int]] = []
    for (key, words), own in places.items():
        if len(own) > 1:
            low = min(h[0] for h in own)
            many = words.count(b" ") + 2 - window
            told += [(*h, many) for h in own if h[0] > low]
            own = [h for h in own if h[0] == low]
        by.setdefault(key % buckets * step, []).append((key, words, own))
    rows = [_pack(bucket, segs) for bucket, segs in by.items()]
    if told:
        t = np.array(told, np.int64)
        rows.append((next(iter(by)), None, t[:, 3].astype(np.int32).tobytes(), t[:, :2].T.tobytes(), t[:, 2].astype(np.int32).tobytes(), None))
    kinds = [pa.int32(), *[pa.binary()] * 5]
    for lo in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[lo : lo + 256]], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in SEGMENTS.split(", ")])


def _unpack(row) -> list[tuple[int, bytes, np.ndarray]]:
    """(key, words, holders) of each segment of a SEGMENTS row."""
    many = np.frombuffer(row["holders"], np.int32)
    own = np.concatenate([np.frombuffer(row["docs"], np.int64).reshape(-1, 2), np.frombuffer(row["firsts"], np.int32).astype(np.int64)[:, None]], axis=1)
    return list(zip(np.frombuffer(row["keys"], np.uint64).tolist(), row["words"].split(b"\n"), np.split(own, np.cumsum(many)[:-1])))


def _segments(batches, window: int, buckets: int):
    """The distinct segments of each batch of texts with all who hold them."""
    anchors = word_anchors(window)
    for b in batches:
        ids, xs, z, found, sizes = (c.to_pylist() for c in b.columns)
        data = [unsqueeze(x) for x in z]
        item, key, first, count = anchors(data)
        wanted = [(np.int64(k) << np.int64(32)) | np.frombuffer(f, np.int32).astype(np.int64) for k, f in enumerate(found)]
        pick = np.isin((item << np.int64(32)) | first, np.concatenate(wanted)) if wanted else np.empty(0, bool)
        places: dict[tuple[int, bytes], list] = {}
        last, words = -1, []
        for i, k, f, c in zip(item[pick].tolist(), key[pick].tolist(), first[pick].tolist(), count[pick].tolist()):
            if i != last:
                last, words = i, data[i].split()
            places.setdefault((k, b" ".join(words[f : f + c + window - 1])), []).append((ids[i], xs[i], f))
        yield from _packs(places, window, buckets)


def _common(segs: DataFrame, n: int) -> np.ndarray:
    """The keys with over one in 4 n of the segments; there are less than 4 n of them."""
    total = segs.agg(F.sum(F.length("keys") / 8)).first()[0] or 0
    share = np.uint64(max(1, int(total) // SAMPLED))

    def some(batches):
        for b in batches:
            for keys, holders, docs in zip(*(c.to_pylist() for c in b.columns)):
                key = np.frombuffer(keys, np.uint64)
                lead = np.frombuffer(docs, np.uint64).reshape(-1, 2)[np.r_[0, np.cumsum(np.frombuffer(holders, np.int32))[:-1]]]
                yield pa.RecordBatch.from_arrays([pa.array(key[mix(lead[:, 0] ^ lead[:, 1] ^ mix(key)) % share == 0].view(np.int64))], names=["key"])

    counts = segs.filter("keys IS NOT NULL").select("keys", "holders", "docs").mapInArrow(some, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.filter(F.col("n") > max(1, int(total) // int(share) // (4 * n))).select("key").collect()
    return np.array([r["key"] for r in rows], np.int64).view(np.uint64)


def _by_window(row: dict, common: np.ndarray, window: int, places: dict[tuple[int, bytes], list]) -> dict[tuple[int, bytes], list]:
    """The segments of a SEGMENTS row but for those of common keys, which are added to `places` cut into single windows, each with a key of its own."""
    rest = {}
    for key, words, own in _unpack(row):
        if key not in common:
            rest[key, words] = own.tolist()
            continue
        split = words.split(b" ")
        for i in range(len(split) - window + 1):
            part = b" ".join(split[i : i + window])
            places.setdefault((xxhash.xxh3_64_intdigest(part), part), []).extend((d, x, f + i) for d, x, f in own.tolist())
    return rest


def _shards(batches, window: int, parts: int):
    """PACKED rows: the windows that each document has from an earlier one."""
    held: dict[int, list[dict]] = {}
    for b in batches:
        rows = b.to_pylist()
        for row in rows:
            if row["keys"] is not None:
                held.setdefault(row["bucket"], []).append(row)
        yield from packed([(np.frombuffer(r["docs"], np.int64).reshape(2, -1), np.frombuffer(r["firsts"], np.int32), np.frombuffer(r["holders"], np.int32)) for r in rows if r["keys"] is None], parts)
    for bucket in sorted(held):
        segs = sorted((seg for row in held.pop(bucket) for seg in _unpack(row)), key=lambda seg: seg[0])
        words, start = 0, 0
        for k, (key, text, _) in enumerate(segs):
            if words > SHARD_WORDS and key != segs[k - 1][0]:
                yield from _shard(segs[start:k], window, parts)
                words, start = 0, k
            words += text.count(b" ") + 1
        yield from _shard(segs[start:], window, parts)


def _shard(segs: list[tuple[int, bytes, np.ndarray]], window: int, parts: int):
    """Compiles the phrases of a shard and streams its documents' words through the automaton."""
    split = [text.split(b" ") for _, text, _ in segs]
    size = np.fromiter(map(len, split), np.int64, len(split))
    words = list(chain.from_iterable(split))
    ids = {w: k for k, w in enumerate(dict.fromkeys(words), 1)}
    start = np.r_[0, np.cumsum(size + 1)]
    # a zero between two segments stands for no word
    line = np.zeros(start[-1], np.int64)
    inside = np.ones(start[-1], bool)
    inside[start[1:] - 1] = False
    line[inside] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    many = size - window + 1
    at = np.arange(many.sum()) + np.repeat(start[:-1] - np.r_[0, np.cumsum(many)[:-1]], many)
    holders = np.array([len(own) for _, _, own in segs])
    own = np.concatenate([own for _, _, own in segs])
    begin = np.r_[0, np.cumsum(holders)[:-1]]
    low, high = np.minimum.reduceat(own[:, 0], begin), np.maximum.reduceat(own[:, 0], begin)
    text, digits = written(line, len(ids))
    of = phrases_of(line, at, np.repeat(low, many), np.repeat(high, many), window)
    which, first, last = locate([text[p * digits : (p + k) * digits] for p, k in of], text, digits)
    if not len(which):
        return
    seg = np.searchsorted(start, first, side="right") - 1
    owner = np.full(len(of), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, low[seg])
    each = holders[seg]
    row = np.repeat(begin[seg] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
    of = np.repeat(np.arange(len(seg)), each)
    gone = own[row, 0] > owner[which[of]]
    row, of = row[gone], of[gone]
    where = own[row, 2] + (first - start[seg])[of]
    yield from packed([(np.ascontiguousarray(own[row, :2].T), where.astype(np.int32), (last - first - window + 2)[of].astype(np.int32))], parts)


def _plain(b: pa.RecordBatch) -> pa.RecordBatch:
    words = [t.encode("utf-8", "surrogatepass").split() for t in b.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([sha(w) for w in words], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op9_phrases(docs: DataFrame) -> DataFrame:
    return dedup(docs)
