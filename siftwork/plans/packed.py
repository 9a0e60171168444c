"""Windows of long token lists as packed blocks of hashes: one row a bucket and batch instead of one a window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Buckets that windows are dealt to by the first bits of their hash, and tasks that share them at least.
BITS, TASKS = 10, 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of hashes in order."""
    out = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def windows(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (id, list of hashes): the id, place, first hash and hash of every window of `size`."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offsets, h = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    n = np.maximum(np.diff(offsets) - size + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[row] + place
    return ids[row], place, h[start], joined([h[start + j] for j in range(size)])


def spans(values: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return list(zip(cut.tolist(), np.r_[cut[1:], len(values)].astype(int).tolist()))


def dealt_to(key: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.uint16)


def pack(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, bytes of each column): rows by bucket; whole numbers take as few bytes as they need."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    for a, z in spans(bucket):
        yield int(bucket[a]), [_bytes(c[a:z]) for c in columns]


def _bytes(x: np.ndarray) -> bytes:
    if x.dtype != np.int64 or x.min() < 0:
        return x.tobytes()
    return x.astype(next((t for t in (np.uint8, np.uint16, np.uint32) if x.max() <= np.iinfo(t).max), np.int64)).tobytes()


_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def read(parts: list[bytes], sizes: list[int], kind=np.int64) -> np.ndarray:
    """A column of packed rows; sizes are the numbers of items."""
    return np.concatenate([np.frombuffer(p, _WIDTHS.get(len(p) // n, kind)).astype(kind) for p, n in zip(parts, sizes)])


def batches_of(rows: Iterator[tuple[int, list[bytes]]], names: list[str], most: int = 256) -> Iterator[pa.RecordBatch]:
    """Packed rows as Arrow batches."""
    held: list[tuple[int, list[bytes]]] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int32()), *[pa.array([c[i] for _, c in held], pa.binary()) for i in range(len(names) - 1)]], names=names)

    for r in rows:
        held.append(r)
        if len(held) == most:
            yield out()
            held = []
    if held:
        yield out()


def by_bucket(batches, read_bucket: Callable[[list[list[bytes]]], None]) -> Iterator:
    """What a function makes of the packed columns of each bucket of a partition."""
    found: dict[int, list[list[bytes]]] = {}
    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(1, b.num_columns)]
        for k, bucket in enumerate(b.column(0).to_pylist()):
            found.setdefault(bucket, [[] for _ in columns])
            for held, c in zip(found[bucket], columns):
                held.append(c[k])
    while found:
        yield from read_bucket(found.popitem()[1])


def tasks(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS)
