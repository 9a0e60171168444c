"""Sinks: records and findings as JSON, CSV, Markdown, text, SARIF, annotations, logs and diagnostics.

Those of findings are distributed: one line of output a row, or one document in
an aggregate of bounded reports. Those for reading (Markdown, aligned text) show
the rows that a driver can hold and say so by their `most` parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("json", "csv", "markdown", "text", "sarif", "github", "log", "lsp", "dot")
#: Columns that come first where a record has them.
ORDER = ["doc_id", "number", "code", "category", "severity", "kind", "name", "key", "message", "file", "path", "line", "col"]


def columns(df: DataFrame) -> list[str]:
    first = [c for c in ORDER if c in df.columns]
    return first + [c for c in df.columns if c not in first]


def json_lines(df: DataFrame) -> DataFrame:
    """(value): a JSON object a record, its keys in order of name."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("value"))


def cell(col: Column, kind: T.DataType) -> Column:
    """A value as CSV text: arrays joined by commas, an array of two bounds as a range, null as nothing."""
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(col, lambda x: x.cast("string")), ", ")
    elif isinstance(kind, T.StructType) and {"min", "max"} == set(kind.names):
        text = F.when(col["max"].isNull(), F.concat(col["min"].cast("string"), F.lit("+"))).when(col["min"] == col["max"], col["min"].cast("string")).otherwise(F.concat_ws("-", col["min"].cast("string"), col["max"].cast("string")))
    elif isinstance(kind, (T.StructType, T.MapType)):
        text = F.to_json(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """(value): comma-separated lines with a head; columns without any value are left out, quotes stand only where needed."""
    some = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    keep = [c for c in columns(df) if some[c]]
    quoted = []
    for c in keep:
        text = cell(F.col(f"`{c}`"), df.schema[c].dataType)
        quoted.append(F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    head = df.sparkSession.createDataFrame([(",".join(keep),)], "value string")
    return head.unionByName(df.select(F.concat_ws(",", *quoted).alias("value"))) if keep else head


def _shown(df: DataFrame, most: int) -> tuple[list[str], list[list[str]]]:
    names = columns(df)
    rows = df.select(*[cell(F.col(f"`{c}`"), df.schema[c].dataType).alias(str(i)) for i, c in enumerate(names)]).limit(most).collect()
    return names, [list(r) for r in rows]


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A pipe table of the first `most` rows."""
    names, rows = _shown(df, most)
    safe = lambda x: x.replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(map(safe, r)) + " |" for r in rows)])


def aligned(df: DataFrame, most: int = 1000, width: int = 40) -> str:
    """Columns side by side, each as wide as its longest value up to `width`."""
    names, rows = _shown(df, most)
    cut = lambda x: x if len(x) <= width else x[: width - 1] + "…"
    table = [[cut(x.replace("\n", " ")) for x in r] for r in [names, *rows]]
    sizes = [max(len(r[i]) for r in table) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(s) for x, s in zip(r, sizes)).rstrip() for r in table)


def github(findings: DataFrame) -> DataFrame:
    """(value): an annotation command a finding."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    safe = F.replace(F.replace(F.replace("message", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return findings.select(F.format_string("::%s file=%s,line=%d,col=%d,title=%s::%s", level, F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(1)), F.coalesce("col", F.lit(1)), F.col("code"), safe).alias("value"))


def log(findings: DataFrame) -> DataFrame:
    """(value): file:line: message, as compilers log it."""
    return findings.select(F.format_string("%s:%d: %s %s: %s", F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(1)), F.initcap("severity"), F.col("code"), F.col("message")).alias("value"))


def lsp(findings: DataFrame) -> DataFrame:
    """(doc_id, file, value): editor diagnostics, places from 0."""
    level = F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).when(F.col("severity") == "info", 3).otherwise(4)
    at = lambda d: F.struct((F.coalesce("line", F.lit(1)) - 1).alias("line"), (F.coalesce("col", F.lit(1)) - 1 + d).alias("character"))
    return findings.select("doc_id", "file", F.to_json(F.struct(F.struct(at(0).alias("start"), at(1).alias("end")).alias("range"), level.alias("severity"), F.col("code"), F.col("message"))).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(value): one SARIF 2.1.0 result a finding."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    region = F.struct(F.coalesce("line", F.lit(1)).alias("startLine"), F.coalesce("col", F.lit(1)).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.coalesce("file", F.lit("")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def sarif(findings: DataFrame, tool: str = "siftwork", most: int = 25_000) -> str:
    """One SARIF file of all findings in order, in runs of `most`, the format's usual bound on a run.

    The file is one text, so the driver holds it; `sarif_results` stays distributed.
    """
    from siftwork.rules.registry import ordered

    results = [r["value"] for r in sarif_results(ordered(findings)).collect()]
    runs = [results[i : i + most] for i in range(0, len(results), most)] or [[]]
    head = '{"tool":{"driver":{"name":"' + tool + '"}},"results":['
    return '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[' + ",".join(head + ",".join(r) + "]}" for r in runs) + "]}"


def statistics(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category", "severity", "code").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("documents"))


def render(df: DataFrame, form: str) -> DataFrame | str:
    """A sink by name; an unknown one is an error that names those there are."""
    sinks = {"json": json_lines, "csv": csv_lines, "markdown": markdown, "text": aligned, "sarif": sarif, "github": github, "log": log, "lsp": lsp}
    if form not in sinks:
        raise ValueError(f"no format {form}; there are {', '.join(sinks)}")
    return sinks[form](df)
