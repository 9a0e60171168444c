"""Sequence packing by non-negative least squares over the length histogram.

Texts become token ids; full windows are cut off, and what remains of each
document is one piece of a known length. Shallow combinations of lengths that
fill a window exactly are enumerated, non-negative least squares finds how
often to repeat each against the histogram of the whole table, the repeats are
rounded down, and what is left is packed greedily, largest first. Pieces that
still fit nowhere are laid end to end and cut at window borders.

Only the histogram (at most `window` numbers) reaches the driver. Which place a
document gets follows from its rank among the pieces of its length, which is
the rank in its task plus what earlier tasks hold.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.llm.base import texts
from siftwork.plans.shared import materialize

WINDOW, END = 2048, 1
#: Padding that a greedily filled window may keep before its pieces are laid end to end instead.
SLACK = 8
#: Most cut pieces (about 100 bytes each) that are sent to all executors.
CUT_ROWS = 50_000


def tokenizer_path() -> str:
    """The vocabulary of the public byte-level BPE, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """A function text -> ids of the byte-level BPE in `path`; special strings are ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


TOKENS = "task int, row long, doc_id long, n long, size int, rank long, full long, full_rank long, crcs array<long>, ids binary"


def tokenise(docs: DataFrame, window: int = WINDOW, end: int = END, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """TOKENS: every document's ids (16 or 32 bits, little-endian) with the end id, and its ranks within its task.

    size is what remains after `full` windows, rank its number among equal sizes
    of the task; crcs are the CRC-32 of each full window and of the remainder.
    """
    where = path or tokenizer_path()

    def run(batches):
        encode = encoder(where)
        task = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        row = 0
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text), end], np.uint32)
                full, size = divmod(len(ids), window)
                cuts = [ids[i : i + window] for i in range(0, len(ids), window)]
                out.append((task, row, doc_id, len(ids), size, int(seen[size]), full, int(seen[window]), [crc(c) for c in cuts], ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\x00" + ids.astype("<u4").tobytes()))
                seen[size] += 1
                seen[window] += full
                row += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in TOKENS.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(run, TOKENS)


def unpack(ids: bytes) -> np.ndarray:
    """Ids as `tokenise` stores them: an odd length marks 32-bit ids behind one byte."""
    return np.frombuffer(ids[1:], "<u4") if len(ids) % 2 else np.frombuffer(ids, "<u2")


def combinations(window: int = WINDOW) -> np.ndarray:
    """Shallow combinations (a, b, c) of lengths, c possibly 0, that fill the window exactly: all pairs and an even choice of triples."""
    found = {(a, window - a, 0) for a in range((window + 1) // 2, window)}
    for a in range(1, window - 1):
        rest = window - a
        for eighth in range(1, 5):
            b = rest * eighth // 8
            if b:
                found.add((*sorted((a, b, rest - b), reverse=True),))
    return np.array(sorted(found), np.int64)


def non_negative(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: repeats whose lengths add up to `counts`."""
    k = len(counts)

    def made(x):
        out = np.zeros(k)
        for c in combos.T:
            out += np.bincount(c, x, k)
        out[0] = 0.0
        return out

    def back(r):
        r = r.copy()
        r[0] = 0.0
        return r[combos].sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(made(v))
        top = float(np.linalg.norm(v))
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(made(y) - counts) / (1.05 * top), 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(counts: np.ndarray, window: int = WINDOW, slack: int = SLACK) -> tuple[list[tuple[list[tuple[int, int]], int]], np.ndarray]:
    """Patterns ([(length, how many)], repeats), and the counts of lengths that are laid end to end.

    counts[n] is the number of pieces of n tokens, for n below `window`.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    patterns: list[tuple[list[tuple[int, int]], int]] = []
    if left.sum() == 0:
        return patterns, left
    combos = combinations(window)
    combos = combos[(left[combos[:, 0]] > 0) & (left[combos[:, 1]] > 0) & ((combos[:, 2] == 0) | (left[combos[:, 2]] > 0))]
    if len(combos):
        repeats = np.floor(non_negative(combos, left.astype(float)) + 1e-6).astype(np.int64)
        for c, r in sorted(zip(combos.tolist(), repeats.tolist()), key=lambda z: (-z[1], z[0])):
            if r <= 0:
                break
            own = [(n, c.count(n)) for n in sorted({*c} - {0}, reverse=True)]
            r = min(r, *(int(left[n]) // m for n, m in own))
            if r > 0:
                patterns.append((own, r))
                for n, m in own:
                    left[n] -= m * r
    rest = np.zeros_like(left)
    while (have := np.flatnonzero(left)).size:
        own, room = {}, window
        spare = left.copy()
        while room and (fits := have[(have <= room) & (spare[have] > 0)]).size:
            n = int(fits[-1])
            m = int(min(spare[n], room // n))
            own[n] = own.get(n, 0) + m
            spare[n] -= m
            room -= n * m
        n = int(have[-1])
        if room > slack:  # the largest piece can't be matched now, and lengths only get fewer
            rest[n] += left[n]
            left[n] = 0
            continue
        r = min(int(left[n]) // m for n, m in own.items())
        patterns.append((sorted(own.items(), reverse=True), r))
        for n, m in own.items():
            left[n] -= m * r
    return patterns, rest


PLACES = "size int, first long, last long, kind int, base long, many long, at long"


def places(patterns: list, rest: np.ndarray, window: int = WINDOW) -> tuple[list[tuple], int]:
    """Rows of PLACES: where pieces ranked first..last of a size go; and the number of sequences.

    kind 0: sequence base + (rank - first) / many, offset at + size * ((rank - first) mod many);
    kind 1: token at + (rank - first) * size of the stretch that starts with sequence base.
    """
    rows, next_rank, sequence = [], {}, 0
    for own, r in patterns:
        at = 0
        for n, m in own:
            first = next_rank.get(n, 0)
            rows.append((n, first, first + m * r, 0, sequence, m, at))
            next_rank[n] = first + m * r
            at += n * m
        sequence += r
    at = 0
    for n in np.flatnonzero(rest)[::-1].tolist():
        first = next_rank.get(n, 0)
        rows.append((n, first, first + int(rest[n]), 1, sequence, 1, at))
        at += n * int(rest[n])
    return rows, sequence + -(-at // window)


def pack(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces, tokens). Each token of each document is in exactly one piece.

    pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, task, row;
    the last two find the document in `tokens`, which holds the ids. A null or
    empty text is one end id; repeated rows and null ids are packed like others;
    an empty table gives no pieces.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenise(docs, window, path=path, text_col=text_col, id_col=id_col), "tokens")
    of = tokens.groupBy("task", "size").agg(F.count(F.lit(1)).alias("c")).filter("size > 0")
    full = tokens.groupBy("task").agg(F.sum("full").alias("c")).select("task", F.lit(window).alias("size"), "c")
    per_task = materialize(of.unionByName(full).filter("c > 0"), "counts")
    counts = np.zeros(window + 1, np.int64)
    for r in per_task.groupBy("size").agg(F.sum("c").alias("c")).collect():
        counts[r["size"]] = r["c"]
    patterns, rest = plan(counts[:window], window)
    rows, sequences = places(patterns, rest, window)
    # one row a length and pattern: bounded by the window, whatever the table's size
    where = F.broadcast(spark.createDataFrame(rows, PLACES))
    before = W.partitionBy("size").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_task.select("task", "size", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("earlier"))
    narrow = tokens.select("task", "row", "doc_id", "n", "size", "rank", "full", "full_rank", "crcs")
    keep = [F.col("doc_id"), F.col("n").alias("doc_tokens"), F.col("task"), F.col("row")]

    whole = narrow.filter("full > 0").withColumn("want", F.lit(window)).join(offsets.withColumnsRenamed({"task": "t", "size": "s"}), (F.col("task") == F.col("t")) & (F.col("want") == F.col("s")))
    whole = whole.select("*", F.posexplode(F.slice("crcs", F.lit(1), F.col("full").cast("int"))).alias("k", "crc"))
    whole = whole.select(*keep, (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), (F.lit(sequences) + F.col("earlier") + F.col("full_rank") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    small = narrow.filter("size > 0").join(offsets.withColumnsRenamed({"task": "t", "size": "s"}), (F.col("task") == F.col("t")) & (F.col("size") == F.col("s"))).withColumn("g", F.col("earlier") + F.col("rank"))
    at = where.select(F.col("size").alias("z"), "first", "last", "kind", "base", "many", "at")
    small = small.join(at, (F.col("size") == F.col("z")) & (F.col("g") >= F.col("first")) & (F.col("g") < F.col("last")))
    k = F.col("g") - F.col("first")
    start = (F.col("full") * window).cast("long")
    token = F.col("at") + k * F.col("size")
    over = F.greatest(token % window + F.col("size") - window, F.lit(0))
    head = F.col("size") - over
    last = F.element_at("crcs", -1)
    one = F.struct(start.alias("start"), F.col("size").cast("long").alias("length"), last.alias("ids_crc32"), (F.col("base") + F.floor(k / F.col("many"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(k, F.col("many")) * F.col("size")).cast("long").alias("offset"))
    laid = F.struct(start.alias("start"), head.cast("long").alias("length"), F.when(over == 0, last).alias("ids_crc32"), (F.col("base") + F.floor(token / window)).cast("long").alias("sequence_id"), (token % window).cast("long").alias("offset"))
    tail = F.struct((start + head).cast("long").alias("start"), over.cast("long").alias("length"), F.lit(None).cast("long").alias("ids_crc32"), (F.col("base") + F.floor(token / window) + 1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = F.when(F.col("kind") == 0, F.array(one)).when(over == 0, F.array(laid)).otherwise(F.array(laid, tail))
    small = materialize(small.select(*keep, F.explode(parts).alias("p")).select("doc_id", "doc_tokens", "task", "row", "p.*"), "pieces")

    # pieces that a window border cuts need the ids once more
    cut = small.filter("ids_crc32 IS NULL")

    def sums(batches):
        for b in batches:
            found = [crc(unpack(x)[s : s + n]) for x, s, n in zip(b.column("ids").to_pylist(), b.column("start").to_pylist(), b.column("length").to_pylist())]
            yield b.drop_columns(["ids"]).set_column(b.schema.names.index("ids_crc32"), "ids_crc32", pa.array(found, pa.int64()))

    # at most one piece in `window` tokens of the stretch is cut, in two: few enough to send, or a plain join
    few = 2 * int((rest * np.arange(window)).sum() // window + 1) <= CUT_ROWS
    known = tokens.select("task", "row", "ids").join(F.broadcast(cut) if few else cut, ["task", "row"]).select(*small.columns, "ids").mapInArrow(sums, small.schema)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "row"]
    pieces = whole.select(columns).unionByName(small.filter("ids_crc32 IS NOT NULL").select(columns)).unionByName(known.select(columns))
    return pieces, tokens


def op1_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)[0].drop("task", "row")
