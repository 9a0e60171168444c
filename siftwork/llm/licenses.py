r"""License scans by diagonal voting.

The rolling word k-grams of all documents are joined with the positions of the
same k-grams in license templates. A match votes for its diagonal, the document
position less the template position; a template that stands in a text gathers
its votes on one diagonal, or on neighbouring ones where words were put in or
left out. Votes are gathered by diagonal, each with the template positions that
it has. A diagonal is merged with its neighbours, so that a template position
counts once; the strongest of a neighbourhood stays and its words are verified:
those in their order must make up the same share of the template.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.llm.base import texts
from siftwork.plans.shared import materialize

K = 3
#: Share of a template's k-grams, and of its words in order, that a text must hold, and how far from the strongest diagonal merged ones may lie.
COVER, DRIFT = 0.6, 4
#: Phrases that are labels by themselves wherever all their words stand in a row (given by the contract).
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Notices that the voting looks for. Any list of (text, label) may be given instead.
NOTICES = [
    ("released under the terms of the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", "gpl-3"),
    ("this program is free software licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license version 2 1 or later", "lgpl-2.1"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"


def _words(data: bytes, table: bytes) -> list[bytes]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; the table lower-cases A-Z and blanks what separates words."""
    return [w for w in data.translate(table).split(b" ") if w]


def in_order(template: list[int], at: dict[int, int]) -> int:
    """The most words of a template that a text has in their order; `at` gives the known words of the text by place."""
    row = np.zeros(len(template) + 1, np.int64)
    words = np.array(template)
    for place in sorted(at):
        row[1:] = np.maximum(row[1:], np.where(words == at[place], row[:-1] + 1, 0))
        row = np.maximum.accumulate(row)
    return int(row[-1])


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): one row (row, doc_id, n_words) per document, and the verified spans.

    spans: row, template, label, base, first_word, last_word, cover. Null and
    empty texts have no words; repeated rows and ids each have their own row.
    The templates must be few enough to travel with each task (they are checked
    to stay under 4 MB).
    """
    spark = docs.sparkSession
    table = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32 for c in range(256))
    split = [(t, label, i < len(base), _words(t.encode(), table)) for i, (t, label) in enumerate([*base, *notices])]
    if sum(len(t) for t, *_ in split) > 4 << 20:
        raise ValueError("templates exceed 4 MB; scan them in several calls")
    if any(len(ws) < K for *_, ws in split):
        raise ValueError(f"a template needs at least {K} words")
    ids = {w: i for i, w in enumerate(sorted({w for *_, ws in split for w in ws}), 1)}
    size = len(ids) + 1
    code = lambda ws: [(ids[a] * size + ids[b]) * size + ids[c] for a, b, c in zip(ws, ws[1:], ws[2:])]
    positions = [(h, t, p) for t, (*_, ws) in enumerate(split) for p, h in enumerate(code(ws))]
    grams = spark.createDataFrame(positions, "code long, template int, at int")
    about = spark.createDataFrame([(t, label, own, len(ws) - K + 1) for t, (_, label, own, ws) in enumerate(split)], "template int, label string, base boolean, grams int")

    def run(batches):
        get = ids.get
        for b in batches:
            counts, at, codes = [], [], []
            for text in b.column(2).to_pylist():
                ws = _words(text.encode("utf-8", "surrogatepass"), table)
                x = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
                # a k-gram with a word of no template can't be equal to any of theirs
                p = np.flatnonzero((x[:-2] > 0) & (x[1:-1] > 0) & (x[2:] > 0)) if len(x) >= K else x[:0]
                counts.append(len(ws))
                at.append(p)
                codes.append((x[p] * size + x[p + 1]) * size + x[p + 2] if len(p) else p)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(codes, pa.list_(pa.int64()))], names=["row", "doc_id", "n_words", "pos", "code"])

    numbered = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = materialize(numbered.mapInArrow(run, "row long, doc_id long, n_words long, pos array<long>, code array<long>"), "grams")
    each = rows.filter(F.size("pos") > 0).select("row", F.explode(F.arrays_zip("pos", "code")).alias("g")).select("row", F.col("g.pos").alias("pos"), F.col("g.code").alias("code"))
    votes = each.join(F.broadcast(grams), "code").groupBy("row", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    votes = votes.join(F.broadcast(about), "template")
    exact = votes.filter(F.col("base") & (F.size("ats") == F.col("grams"))).select("row", "template", "label", "base", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("grams") + K - 2).alias("last_word"), F.lit(1.0).alias("cover"))
    w = W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    near = votes.filter(~F.col("base")).withColumn("near", F.collect_list(F.struct("diagonal", "ats")).over(w))
    share = F.size(F.array_distinct(F.flatten(F.transform("near", lambda n: n["ats"])))) / F.col("grams")
    strong = near.withColumn("share", share).filter(F.col("share") >= COVER)
    strong = strong.withColumn("most", F.max(F.struct("share", F.size("ats"), -F.col("diagonal"))).over(w)).filter(F.col("most") == F.struct("share", F.size("ats"), -F.col("diagonal")))
    numbers = [[ids[x] for x in ws] for *_, ws in split]

    def verify(batches):
        for b in batches:
            out = []
            for row, template, label, near in zip(*(b.column(c).to_pylist() for c in ("row", "template", "label", "near"))):
                own = numbers[template]
                at = {n["diagonal"] + a + j: own[a + j] for n in near for a in n["ats"] for j in range(K)}
                cover = in_order(own, at) / len(own)
                if cover >= COVER:
                    out.append((row, template, label, False, min(at), max(at), cover))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()))], names=["row", "template", "label", "base", "first_word", "last_word", "cover"])

    kept = strong.select("row", "template", "label", "near").mapInArrow(verify, "row long, template int, label string, base boolean, first_word long, last_word long, cover double")
    spans = exact.unionByName(kept)
    return rows.select("row", "doc_id", "n_words"), spans


def op10_licenses(docs: DataFrame) -> DataFrame:
    """The contract's digest of one row per document."""
    rows, spans = scan(docs)
    own = F.col("base")
    found = spans.groupBy("row").agg(
        F.count(F.when(own, 1)).alias("n_base"),
        F.min(F.when(own, F.col("first_word"))).alias("first_word"),
        F.max(F.when(own, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(own, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.join(found, "row", "left").na.fill(none).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
