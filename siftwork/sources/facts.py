"""Fact tables: what an analysis observed, one table a fact, and what plain tables give of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "file STRING, line INT, col INT"
SCHEMAS: dict[str, str] = {
    "defs": f"doc_id LONG, node INT, name STRING, by STRING, tag STRING, subject STRING, mode STRING, package STRING, origin STRING, depth INT, global BOOLEAN, certain BOOLEAN, redefines BOOLEAN, arity INT, parameters STRING, body STRING, {PLACE}",
    "expansions": f"doc_id LONG, node INT, name STRING, meaning STRING, definition INT, package STRING, within STRING, count INT, mode STRING, conditional BOOLEAN, origin STRING, {PLACE}",
    "loads": f"doc_id LONG, node INT, name STRING, kind STRING, options ARRAY<STRING>, by STRING, status STRING, depth INT, certain BOOLEAN, path STRING, provided STRING, required STRING, cost LONG, in_body BOOLEAN, {PLACE}",
    "occurrences": f"doc_id LONG, node INT, kind STRING, key STRING, detail STRING, role STRING, target STRING, section STRING, package STRING, certain BOOLEAN, {PLACE}",
    "diagnostics": f"doc_id LONG, severity STRING, code STRING, message STRING, count INT, origin STRING, {PLACE}",
    "vertices": f"doc_id LONG, node INT, tag STRING, name STRING, within INT, {PLACE}",
    "edges": "doc_id LONG, src INT, dst INT, kind INT",
    "calls": "doc_id LONG, name STRING, callee STRING",
    "colors": f"doc_id LONG, node INT, name STRING, value STRING, {PLACE}",
    "color_uses": f"doc_id LONG, node INT, name STRING, on_value STRING, {PLACE}",
    "stack_ops": f"doc_id LONG, seq INT, stack INT, op STRING, {PLACE}",
    "quantities": f"doc_id LONG, node INT, number STRING, unit STRING, {PLACE}",
    "vars": f"doc_id LONG, node INT, name STRING, action STRING, scope STRING, type STRING, {PLACE}",
    "fonts": f"doc_id LONG, node INT, family STRING, encoding STRING, shape STRING, {PLACE}",
    "overfull": f"doc_id LONG, node INT, what STRING, excess DOUBLE, {PLACE}",
    "settings": f"doc_id LONG, node INT, key STRING, value STRING, {PLACE}",
    "written_files": "doc_id LONG, path STRING",
    "found_files": "doc_id LONG, path STRING",
    "packages": "name STRING, file STRING, installed BOOLEAN, successor STRING, tagged BOOLEAN, before STRING",
    "bib_entries": f"doc_id LONG, node INT, key STRING, kind STRING, title STRING, year STRING, doi STRING, author STRING, fields ARRAY<STRING>, {PLACE}",
    "cells": f"doc_id LONG, table_id INT, row INT, column INT, text STRING, align STRING, {PLACE}",
    "lines": "doc_id LONG, file STRING, line INT, text STRING",
    "assertions": f"doc_id LONG, node INT, text STRING, holds BOOLEAN, assumed BOOLEAN, {PLACE}",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


class Facts(Mapping):
    """Fact tables by name; a table that isn't given is empty. Given tables may lack columns, which are null then."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        if unknown := set(tables) - set(SCHEMAS):
            raise KeyError(f"no such fact tables: {sorted(unknown)}")
        self.spark, self.tables = spark, tables

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        whole = empty(self.spark, name)
        given = self.tables.get(name)
        if given is None:
            return whole
        kinds = {f.name: f.dataType for f in whole.schema}
        return given.select(*[(F.col(c) if c in given.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def __iter__(self):
        return iter(SCHEMAS)

    def __len__(self):
        return len(SCHEMAS)


def lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, file, line, text): the lines of every document, from 1; a null text has none."""
    parts = F.posexplode(F.split(F.col(text_col), "\r\n|\n|\r", -1)).alias("__i", "text")
    return docs.select(F.col(id_col).alias("doc_id"), parts).select("doc_id", F.lit("document").alias("file"), (F.col("__i") + 1).alias("line"), "text")


def documents(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(path, text, replaced): whole files under a path, decoded; what can't be decoded becomes U+FFFD and is counted."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            text = [bytes(c).decode(encoding, "replace") for c in pdf["content"]]
            yield pdf[["path"]].assign(text=text, replaced=[t.count("\ufffd") for t in text])

    return rows.mapInPandas(run, "path string, text string, replaced long")
