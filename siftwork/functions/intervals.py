"""Intervals of integers with a mark for 'zero excluded', and their lattice.

A value is struct<lo: long, hi: long, nz: boolean>. Undecided tests are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

INT_MIN, INT_MAX = -(2**31), 2**31 - 1
KIND = "struct<lo:bigint,hi:bigint,nz:boolean>"


def interval(lo: Column, hi: Column, nz: Column | None = None) -> Column:
    """The ordered interval of two ends."""
    return F.struct(F.least(lo, hi).cast("long").alias("lo"), F.greatest(lo, hi).cast("long").alias("hi"), (F.lit(False) if nz is None else F.coalesce(nz, F.lit(False))).alias("nz"))


def exact(x: Column) -> Column:
    return F.struct(x.cast("long").alias("lo"), x.cast("long").alias("hi"), F.lit(False).alias("nz"))


def excludes_zero(v: Column) -> Column:
    return v["nz"] | (v["lo"] > 0) | (v["hi"] < 0)


def without_zero(v: Column) -> Column:
    """Zero taken out: an end at zero moves inwards, the mark stays only with zero strictly inside; null if nothing is left."""
    lo = F.when(v["lo"] == 0, F.lit(1)).otherwise(v["lo"]).cast("long")
    hi = F.when(v["hi"] == 0, F.lit(-1)).otherwise(v["hi"]).cast("long")
    return F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi"), ((lo < 0) & (hi > 0)).alias("nz")))


def _marked(lo: Column, hi: Column, nz: Column) -> Column:
    whole = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(False).alias("nz"))
    return F.when(lo > hi, F.lit(None)).when(nz, without_zero(whole)).otherwise(whole)


def meet(a: Column, b: Column) -> Column:
    """The intersection; null if empty."""
    return _marked(F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"]), a["nz"] | b["nz"])


def join(a: Column, b: Column) -> Column:
    """The hull; zero stays out only if both exclude it."""
    return _marked(F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"]), excludes_zero(a) & excludes_zero(b))


def join_all(v: Column) -> Column:
    """Aggregate: the hull of a group."""
    return _marked(F.min(v["lo"]), F.max(v["hi"]), F.bool_and(excludes_zero(v)))


def widen(before: Column, after: Column) -> Column:
    """An end that moved goes to the end of the 32-bit range."""
    lo = F.when(after["lo"] < before["lo"], F.lit(INT_MIN)).otherwise(before["lo"])
    hi = F.when(after["hi"] > before["hi"], F.lit(INT_MAX)).otherwise(before["hi"])
    return _marked(lo, hi, excludes_zero(before) & excludes_zero(after))


def neg(v: Column) -> Column:
    return F.struct((-v["hi"]).alias("lo"), (-v["lo"]).alias("hi"), v["nz"].alias("nz"))


def absolute(v: Column) -> Column:
    low = F.when(v["lo"] > 0, v["lo"]).when(v["hi"] < 0, -v["hi"]).when(v["nz"], F.lit(1)).otherwise(F.lit(0))
    return F.struct(low.cast("long").alias("lo"), F.greatest(F.abs(v["lo"]), F.abs(v["hi"])).cast("long").alias("hi"), F.lit(False).alias("nz"))


def add(a: Column, b: Column) -> Column:
    return _marked(a["lo"] + b["lo"], a["hi"] + b["hi"], F.lit(False))


def multiply(a: Column, b: Column) -> Column:
    """Of the four corners; zero is excluded if both factors exclude it."""
    corners = [a[i] * b[j] for i in ("lo", "hi") for j in ("lo", "hi")]
    return _marked(F.least(*corners), F.greatest(*corners), excludes_zero(a) & excludes_zero(b))


def divide(a: Column, b: Column) -> Column:
    """Truncating division by an interval without zero; null where zero may divide."""
    ends = [F.when(b["lo"] > 0, b["lo"]).when(b["hi"] < 0, b["hi"]), F.when(b["lo"] > 0, b["hi"]).when(b["hi"] < 0, b["lo"])]
    corners = [truncated(a[i], e) for i in ("lo", "hi") for e in ends]
    return F.when((b["lo"] > 0) | (b["hi"] < 0), _marked(F.least(*corners), F.greatest(*corners), F.lit(False)))


def truncated(a: Column, b: Column) -> Column:
    """Integer division towards zero; null by zero. In integers throughout."""
    q = F.floor(F.try_divide(F.abs(a).cast("decimal(38,0)"), F.abs(b).cast("decimal(38,0)"))).cast("long")
    return F.when(b != 0, F.when((a < 0) != (b < 0), -q).otherwise(q))


def less(a: Column, b: Column) -> Column:
    return F.when(a["hi"] < b["lo"], F.lit(True)).when(a["lo"] >= b["hi"], F.lit(False))


def equal(a: Column, b: Column) -> Column:
    zero_apart = ((a["lo"] == 0) & (a["hi"] == 0) & excludes_zero(b)) | ((b["lo"] == 0) & (b["hi"] == 0) & excludes_zero(a))
    points = (a["lo"] == a["hi"]) & (b["lo"] == b["hi"]) & (a["lo"] == b["lo"])
    return F.when(points, F.lit(True)).when((a["hi"] < b["lo"]) | (b["hi"] < a["lo"]) | zero_apart, F.lit(False))


def odd(v: Column) -> Column:
    return F.when(v["lo"] == v["hi"], F.pmod(v["lo"], F.lit(2)) == 1)


def narrow_less(v: Column, bound: Column, holds: bool) -> Column:
    """The part of an interval for which `v < bound` holds, or does not."""
    return _marked(v["lo"], F.least(v["hi"], bound - 1), v["nz"]) if holds else _marked(F.greatest(v["lo"], bound), v["hi"], v["nz"])


def set_lift(df: DataFrame, keys: list[str], value: str, most: int = 8) -> DataFrame:
    """(keys, members): the sorted distinct values of a group while they are few, else their hull as one interval.

    At most `most` + 1 values of a group ever meet; the hull is a plain minimum and maximum.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(value))
    few = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("__r", rank).filter(F.col("__r") <= most + 1)
    few = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("long"))).alias("__few"))
    hull = df.groupBy(*keys).agg(F.min(value).cast("long").alias("__lo"), F.max(value).cast("long").alias("__hi"))
    points = F.transform("__few", lambda x: F.struct(x.alias("lo"), x.alias("hi")))
    whole = F.array(F.struct(F.col("__lo").alias("lo"), F.col("__hi").alias("hi")))
    return hull.join(few, keys).select(*keys, F.when(F.size("__few") <= most, points).otherwise(whole).alias("members"))


def wrap32(x: Column) -> Column:
    """A sum as 32 bits keep it."""
    return F.pmod(x.cast("long") + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)


def muldiv(x: Column, n: Column, d: Column) -> Column:
    """x * n / d with a wide product, rounded half away from zero; null by zero."""
    product = x.cast("decimal(19,0)") * n.cast("decimal(19,0)")
    size = F.floor((F.abs(product) * 2 + F.abs(d)) / (F.abs(d) * 2)).cast("long")
    return F.when(d != 0, F.when((product < 0) != (d < 0), -size).otherwise(size))


def uniform(n: Column) -> Column:
    """The interval that a uniform draw below n can fall into: an interval, not a sample; the whole range for an unknown n."""
    top = INT_MAX - 1
    return F.when(n > 0, interval(F.lit(0), n - 1)).when(n < 0, interval(n + 1, F.lit(0))).when(n == 0, exact(F.lit(0))).otherwise(interval(F.lit(-top), F.lit(top)))
