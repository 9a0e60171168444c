"""Operators on ordered rows: first and rest, adjacency, balance, pairing, as-of picks and running text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def rest_of_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str], site: str) -> DataFrame:
    """Every row but the first of its key, with the first one's `site` as first_site. Null keys are keys too."""
    w = W.partitionBy(*keys).orderBy(*_cols(order))
    out = df.withColumn("__n", F.row_number().over(w)).withColumn("first_site", F.first(site).over(w))
    return out.filter(F.col("__n") > 1).drop("__n")


def earlier_equal(df: DataFrame, value: Sequence[str], order: Sequence[str], site: str) -> DataFrame:
    """Rows whose value an earlier row has, with that row's site; `rest_of_duplicates` by value."""
    return rest_of_duplicates(df, value, order, site)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: partial aggregation, no sort of whole groups."""
    other = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*other), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def dead_stores(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_write: Column) -> DataFrame:
    """Writes that the next event of their key, another write, replaces before any read."""
    w = W.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("__w", is_write).withColumn("__next", F.lead("__w").over(w)).filter(F.col("__w") & F.col("__next")).drop("__w", "__next")


def balance(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column) -> DataFrame:
    """Adds depth and surplus to rows of opens (+1), closes (-1) and others (0).

    A close without an open doesn't go below zero: depth is the running sum less
    its running minimum, and a close that makes a new minimum is surplus.
    """
    w = W.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("__step", F.coalesce(step, F.lit(0))).withColumn("__sum", F.sum("__step").over(w))
    out = out.withColumn("__low", F.least(F.lit(0), F.min("__sum").over(w))).withColumn("__was", F.least(F.lit(0), F.coalesce(F.min("__sum").over(before), F.lit(0))))
    return out.withColumn("depth", F.col("__sum") - F.col("__low")).withColumn("surplus", F.col("__low") < F.col("__was")).drop("__step", "__sum", "__low", "__was")


def pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column, site: str) -> DataFrame:
    """(keys, open, close, depth): each open with the close that ends it; unmatched opens have a null close, surplus closes a null open."""
    rows = balance(df.withColumn("__s", step), keys, order, F.col("__s")).filter(F.col("__s") != 0)
    level = F.when(F.col("__s") > 0, F.col("depth")).otherwise(F.col("depth") + 1)
    rows = rows.withColumn("__level", F.when(F.col("surplus"), F.lit(0)).otherwise(level))
    w = W.partitionBy(*keys, "__level").orderBy(*_cols(order))
    rows = rows.withColumn("__next", F.lead(site).over(w)).withColumn("__next_step", F.lead("__s").over(w))
    opens = rows.filter(F.col("__s") > 0).select(*keys, F.col(site).alias("open"), F.when(F.col("__next_step") < 0, F.col("__next")).alias("close"), F.col("__level").alias("depth"))
    extra = rows.filter(F.col("surplus")).select(*keys, F.lit(None).cast(df.schema[site].dataType).alias("open"), F.col(site).alias("close"), F.lit(0).cast(opens.schema["depth"].dataType).alias("depth"))
    return opens.unionByName(extra)


def match_kinds(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, step: str, site: str) -> DataFrame:
    """Pairs of mixed kinds: a close ends the last open of its own kind and drops what opened since.

    (keys, kind, open, close): dropped or left opens have a null close, closes
    without an open of their kind a null open. A stack machine by group.
    """
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"kind {df.schema[kind].dataType.simpleString()}", f"open {df.schema[site].dataType.simpleString()}", f"close {df.schema[site].dataType.simpleString()}"])

    def run(group, pdf):
        stack, out = [], []
        for k, s, at in pdf.sort_values(list(order))[[kind, step, site]].itertuples(index=False):
            if s > 0:
                stack.append((k, at))
            elif s < 0:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == k), None)
                if i is None:
                    out.append((*group, k, None, at))
                else:
                    out += [(*group, kk, o, None) for kk, o in stack[i + 1 :]]
                    out.append((*group, k, stack[i][1], at))
                    del stack[i:]
        out += [(*group, kk, o, None) for kk, o in stack]
        import pandas as pd

        return pd.DataFrame(out, columns=[*keys, "kind", "open", "close"]).astype({"open": "Int64", "close": "Int64"})

    needed = list(dict.fromkeys([*keys, *order, kind, step, site]))
    return df.select(*needed).groupBy(*keys).applyInPandas(run, schema)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, take: Sequence[str]) -> DataFrame:
    """`left` with the `take` columns of the last row of `right` at or before it, by key: one sort of both, no range join."""
    a = left.withColumn("__side", F.lit(1)).withColumn("__take", F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType))
    b = right.select(*keys, at, F.lit(0).alias("__side"), F.struct(*take).alias("__take"))
    w = W.partitionBy(*keys).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__take", ignorenulls=True).over(w))
    return both.filter("__side = 1").select(*[F.col(c) for c in left.columns], *[F.col(f"__last.{c}").alias(c if c not in left.columns else f"{c}_as_of") for c in take])


def containing(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str) -> DataFrame:
    """Points with every span of their key that holds them."""
    s = spans.select(*keys, F.col(lo).alias("span_lo"), F.col(hi).alias("span_hi"))
    return points.join(s, list(keys)).filter((F.col(at) >= F.col("span_lo")) & (F.col(at) <= F.col("span_hi")))


def running_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, size: int = 200) -> DataFrame:
    """Adds the last `size` characters of all text so far, by offsets into one joined text a group."""
    w = W.partitionBy(*keys).orderBy(*_cols(order))
    parts = F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(w.rowsBetween(-size, 0))
    # no more than the last `size` rows can show, each of one character at least; empty ones are looked through
    filled = df.filter(F.length(F.coalesce(F.col(text), F.lit(""))) > 0).withColumn("running", F.substring(F.array_join(parts, ""), -size, size))
    return filled


def adjacent_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows equal to the row before them."""
    w = W.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("__before", F.lag(value).over(w)).filter(F.col("__before") == F.col(value)).drop("__before")


def rollup(df: DataFrame, key: str, amount: str, order: Sequence[str], site: str) -> DataFrame:
    """(key, total, first_site): sums by key with the first row's site, most first, then by key."""
    return df.groupBy(key).agg(F.sum(amount).alias("total"), F.min_by(site, F.struct(*order)).alias("first_site")).orderBy(F.desc("total"), F.asc(key))


def shares(df: DataFrame, key: str, amount: str, at_least: float) -> DataFrame:
    """Keys that make up at least a share of the total; the total is one number, joined to the sums."""
    sums = df.groupBy(key).agg(F.sum(amount).alias("amount"))
    whole = sums.agg(F.sum("amount").alias("__all"))
    return sums.crossJoin(F.broadcast(whole)).withColumn("share", F.col("amount") / F.col("__all")).filter(F.col("share") >= at_least).drop("__all")


def first_seen_list(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(keys, values): distinct values in the order of their first row."""
    first = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("__at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda x: x[value]).alias("values"))
