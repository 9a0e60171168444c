"""Finding by name: tiers of matches from exact to misspelled, and literal search over several tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("exact", "prefix", "part", "name_fuzzy", "word", "word_fuzzy")


def budget(query: str) -> int:
    """Typing errors that a query of this length may have."""
    return 0 if len(query) < 4 else 1 if len(query) < 7 else 2


def prefix_distance(query: str, word: str) -> int:
    """Edits (neighbour swaps count one) that turn `query` into some prefix of `word`."""
    rows = [list(range(len(word) + 1))]
    for i, a in enumerate(query, 1):
        row = [i]
        for j, b in enumerate(word, 1):
            best = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (a != b))
            if i > 1 and j > 1 and a == word[j - 2] and query[i - 2] == b:
                best = min(best, rows[i - 2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return min(rows[-1])


def fuzzy(df: DataFrame, query: str, name: str, about: str | None = None) -> DataFrame:
    """Rows that match `query` with their tier and cost, best first.

    Tiers: the name itself, a prefix, a part, a name within the typing budget, a
    word of the description, a word within the budget. Misspellings are looked
    for only among rows that no cheaper tier finds.
    """
    q, typos = query.lower(), budget(query)
    n = F.lower(F.coalesce(F.col(name), F.lit("")))
    a = F.lower(F.coalesce(F.col(about), F.lit(""))) if about else F.lit("")
    words = F.split(a, r"[^\p{L}\p{N}]+")

    @F.pandas_udf("int")
    def near(col: pd.Series) -> pd.Series:
        return col.map(lambda x: min((prefix_distance(q, w) for w in x.split("\u0001") if w), default=99))

    plain = F.when(n == q, 0).when(n.startswith(q), 1).when(F.contains(n, F.lit(q)), 2).when(F.exists(words, lambda w: w.startswith(q)), 4)
    rows = df.withColumn("__t", plain)
    cost = F.when(F.col("__t").isin(1, 2), F.length(n) - len(q)).otherwise(0)
    sure = rows.filter("__t IS NOT NULL").withColumn("cost", cost.cast("int"))
    if not typos:
        found = sure
    else:
        rest = rows.filter("__t IS NULL").withColumn("__n", near(n)).withColumn("__w", near(F.array_join(words, "\u0001")))
        rest = rest.withColumn("__t", F.when(F.col("__n") <= typos, 3).when(F.col("__w") <= typos, 5)).withColumn("cost", F.least("__n", "__w").cast("int"))
        found = sure.unionByName(rest.filter("__t IS NOT NULL").drop("__n", "__w"))
    return found.withColumn("tier", F.element_at(F.array(*map(F.lit, TIERS)), (F.col("__t") + 1).cast("int"))).orderBy("__t", "cost", name).drop("__t")


def literal(text: str, **sources: tuple[DataFrame, str, str]) -> DataFrame:
    """(kind, id, text): rows of named (table, id, text column) that hold a text as it is; an empty text finds nothing."""
    out = None
    for kind, (df, key, col) in sources.items():
        hit = F.contains(F.col(col), F.lit(text)) if text else F.lit(False)
        rows = df.filter(hit).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(col).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def similar_names(names: DataFrame, known: DataFrame, name: str, within: int = 2) -> DataFrame:
    """(name, known, distance): names at a small edit distance from known ones with the same first letter, by an equi-join on letter and length."""
    a = names.select(F.col(name).alias("name")).distinct().withColumn("l", F.substring("name", 1, 1)).withColumn("n", F.explode(F.sequence(F.length("name") - within, F.length("name") + within)))
    b = known.select(F.col(name).alias("known")).distinct().withColumn("l", F.substring("known", 1, 1)).withColumn("n", F.length("known"))
    return a.join(b, ["l", "n"]).withColumn("distance", F.levenshtein("name", "known", within)).filter(f"distance BETWEEN 1 AND {within}").select("name", "known", "distance")


def verdict(a: Column, b: Column) -> Column:
    """equal, covers or differs: whether a pattern of choices like a|b covers a text."""
    return F.when(a == b, "equal").when(F.array_contains(F.split(a, r"\|"), b), "covers").otherwise("differs")
