"""Edits, their conflicts, rewriting to a fix-point, and line diffs.

An edit is (doc_id, start, stop, replacement, rank): characters from 0, rank the
gravity and order of its finding, least first.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.plans.shared import materialize

EDITS = "doc_id long, start long, stop long, replacement string, rank long"


def resolve(edits: list[tuple[int, int, str, int]]) -> tuple[list, list]:
    """(kept, dropped): by place, then rank; an edit that overlaps one kept before is dropped. Insertions at one place are both kept."""
    kept, dropped, end = [], [], -1
    for e in sorted(edits, key=lambda e: (e[0], e[1], e[3])):
        (dropped if e[0] < end else kept).append(e)
        if e[0] >= end:
            end = e[1]
    return kept, dropped


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, applied, dropped): each text with its edits, from the end backwards; texts without edits as they are."""
    own = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "replacement", "rank")).alias("edits"))
    rows = docs.select("doc_id", "text").join(own, "doc_id", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, text, edits in pdf[["doc_id", "text", "edits"]].itertuples(index=False):
                kept, dropped = resolve([(e["start"], e["stop"], e["replacement"], e["rank"]) for e in (edits if edits is not None else [])])
                new = text
                for start, stop, replacement, _ in reversed(kept):
                    new = new[:start] + replacement + new[stop:]
                out.append((doc_id, new, len(kept), len(dropped)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "applied", "dropped"])

    return rows.mapInPandas(run, "doc_id long, text string, applied long, dropped long")


def fix_point(docs: DataFrame, plan: Callable[[DataFrame], DataFrame], errors: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 8) -> DataFrame:
    """(doc_id, text): texts rewritten until no edit is planned, at most `rounds` times.

    `plan` gives EDITS of texts, `errors` counts (doc_id, n). A document with
    more errors after a round than before takes back that round and applies the
    gravest edit alone; if that does no good either it is left.
    """
    now = materialize(docs.select("doc_id", "text"), "texts")
    stuck = None
    for _ in range(rounds):
        edits = plan(now)
        if stuck is not None:
            edits = edits.join(stuck, "doc_id", "left_anti")
        edits = materialize(edits, "edits")
        if edits.isEmpty():
            break
        new = materialize(apply_edits(now, edits).select("doc_id", "text"), "texts")
        if errors is not None:
            was, has = errors(now).withColumnRenamed("n", "was"), errors(new)
            worse = materialize(has.join(was, "doc_id", "left").filter(F.col("n") > F.coalesce("was", F.lit(0))).select("doc_id"), "worse")
            if not worse.isEmpty():
                best = edits.join(worse, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("start", "stop", "replacement", "rank"), F.struct("rank", "start")).alias("e")).select("doc_id", "e.*")
                back = now.join(worse, "doc_id", "left_semi")
                one = materialize(apply_edits(back, best).select("doc_id", "text"), "texts")
                still = errors(one).join(was, "doc_id", "left").filter(F.col("n") > F.coalesce("was", F.lit(0))).select("doc_id")
                still = materialize(still, "worse")
                fixed = one.join(still, "doc_id", "left_anti").unionByName(now.join(still, "doc_id", "left_semi"))
                new = materialize(new.join(worse, "doc_id", "left_anti").unionByName(fixed), "texts")
                stuck = still if stuck is None else materialize(stuck.unionByName(still).distinct(), "stuck")
        now = new
    return now


def replacements(pattern: str, replacement: str, rank: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A plan: every match of a pattern is replaced (Java's $1 for groups)."""

    def plan(docs: DataFrame) -> DataFrame:
        rows = docs.filter(F.col("text").rlike(pattern))
        cut = rows.select("doc_id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("p"))
        each = cut.select("doc_id", "m", "p", F.posexplode("m").alias("i", "found"))
        gaps = F.aggregate(F.slice("p", F.lit(1), F.col("i") + 1), F.lit(0), lambda a, x: a + F.length(x))
        hits = F.aggregate(F.slice("m", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
        start = (gaps + hits).cast("long")
        return each.select("doc_id", start.alias("start"), (start + F.length("found")).alias("stop"), F.regexp_replace("found", pattern, replacement).alias("replacement"), F.lit(rank).cast("long").alias("rank"))

    return plan


def line_diff(a: list[str], b: list[str], cells: int = 1 << 24) -> list[tuple[str, str]]:
    """(' ', line), ('-', line) and ('+', line): common ends are set apart, the middle by a longest common subsequence, or replaced whole beyond `cells`."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    out = [(" ", s) for s in a[:lo]]
    if len(x) * len(y) > cells:
        out += [("-", s) for s in x] + [("+", s) for s in y]
    else:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i] == y[j]:
                out.append((" ", x[i]))
                i, j = i + 1, j + 1
            elif i < len(x) and (j == len(y) or best[i + 1][j] >= best[i][j + 1]):
                out.append(("-", x[i]))
                i += 1
            else:
                out.append(("+", y[j]))
                j += 1
    return out + [(" ", s) for s in a[len(a) - hi :]] if hi else out


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, no, sign, line): the changed and kept lines of texts that differ."""
    rows = before.select("doc_id", F.col("text").alias("a")).join(after.select("doc_id", F.col("text").alias("b")), "doc_id").filter(~F.col("a").eqNullSafe(F.col("b")))

    def run(batches):
        for pdf in batches:
            out = [(i, n, s, t) for i, a, b in pdf[["doc_id", "a", "b"]].itertuples(index=False) for n, (s, t) in enumerate(line_diff((a or "").split("\n"), (b or "").split("\n")))]
            yield pd.DataFrame(out, columns=["doc_id", "no", "sign", "line"])

    return rows.mapInPandas(run, "doc_id long, no long, sign string, line string")
