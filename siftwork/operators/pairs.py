"""Pairs of rows of one group whose values lie near each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.plans.shared import dealt, materialize

#: Bands that `high` spans, and rows that a block of a band has, about.
BANDS, ROWS = 4, 256


def near(df: DataFrame, key: str, groups: list[str], value: str, low: float, high: float) -> DataFrame:
    """(key, other): keys in order of rows with equal groups whose values differ by `low` to `high`, as many as there are.

    Rows lie in blocks of bands of values. Only blocks of a group whose bands are
    near enough meet, and their pairs are dealt out by how many pairs of rows
    they make, so neither a large group nor a small file makes a long task.
    """
    width = high / BANDS
    # beyond the bounds all share a band: more to compare, nothing is lost
    band = F.floor(F.greatest(F.least(F.col(value) / width, F.lit(1e18)), F.lit(-1e18))).alias("band")
    rows = df.select(*groups, band, F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("x")).dropna(subset=groups).filter("x.k IS NOT NULL AND x.v IS NOT NULL")
    sizes = rows.groupBy(*groups, "band").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("n"))
    block = F.pmod(F.xxhash64("x"), F.col("n")).alias("block")
    blocks = materialize(rows.join(sizes, [*groups, "band"]).select(*groups, "band", block, "x").groupBy(*groups, "band", "block").agg(F.collect_list("x").alias("xs")), "blocks")
    # differing by more than BANDS + 1 bands is differing by more than `high`, also after rounding
    ahead = blocks.withColumnsRenamed({"block": "a_block", "xs": "a"}).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(BANDS + 1)))).withColumn("band", F.col("band") + F.col("step"))
    met = ahead.join(blocks.withColumnsRenamed({"xs": "b"}), [*groups, "band"]).filter("step > 0 OR a_block <= block")
    met = materialize(met.select("a", "b", (F.expr("step = 0 AND a_block = block")).alias("same")), "met")
    pairs = dealt(met, "a", "b").select(F.explode("a").alias("a"), "b", "same").select("a", F.explode("b").alias("b"), "same")
    apart = F.abs(F.col("a.v") - F.col("b.v")).between(low, high)
    order = F.when(F.col("same"), F.col("a.k") < F.col("b.k")).otherwise(F.col("a.k") != F.col("b.k"))
    return pairs.filter(apart & order).select(F.least("a.k", "b.k").alias(key), F.greatest("a.k", "b.k").alias("other"))
