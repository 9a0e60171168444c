"""Project files: resolving names to paths, settings of build files, literate sources, and category-code tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Extensions tried by kind of file, in order.
EXTENSIONS = {"package": [".sty"], "class": [".cls"], "include": [".tex"], "bibliography": [".bib"], "graphic": [".pdf", ".png", ".jpg", ".eps"]}


def discover(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, size, modified): the files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def roots(lines: DataFrame) -> DataFrame:
    """Documents that can be built by themselves: they name a class outside comments."""
    return lines.filter(F.col("text").rlike(r"^[^%]*\\documentclass")).select("doc_id", "file").distinct()


def resolve(loads: DataFrame, files: DataFrame) -> DataFrame:
    """loads (doc_id, name, kind) with the path found and whether only its case differs; null where nothing fits.

    A name as it is goes before its kind's extensions, an exact case before another.
    """
    ways = F.create_map(*[F.lit(x) if i % 2 == 0 else F.array(*map(F.lit, x)) for k, v in EXTENSIONS.items() for i, x in enumerate((k, ["", *v]))])
    tried = loads.select("doc_id", "name", "kind", F.posexplode(F.coalesce(F.element_at(ways, F.col("kind")), F.array(F.lit("")))).alias("rank", "ext")).withColumn("want", F.concat("name", "ext"))
    have = files.select("path", F.substring_index("path", "/", -1).alias("file"))
    hit = tried.join(have, F.lower(F.substring_index("want", "/", -1)) == F.lower("file")).withColumn("other_case", F.substring_index("want", "/", -1) != F.col("file"))
    best = hit.groupBy("doc_id", "name", "kind").agg(F.min_by(F.struct("path", "other_case"), F.struct("other_case", "rank", "path")).alias("f"))
    return loads.join(best, ["doc_id", "name", "kind"], "left").select(*loads.columns, "f.path", F.col("f.other_case").alias("other_case"))


def settings(lines: DataFrame) -> DataFrame:
    """(doc_id, node, key, value, file, line): assignments of build files: `$name = value;`, `name = value`, `key: value`."""
    p = r"^\s*(?:\$|local\s+|set\s+)?([A-Za-z_][\w.-]*)\s*(?:=|:)\s*(.+?)\s*;?\s*$"
    rows = lines.filter(~F.col("text").rlike(r"^\s*(?:#|--|%|//)")).withColumn("key", F.regexp_extract("text", p, 1)).filter("key <> ''")
    value = F.regexp_replace(F.regexp_extract("text", p, 2), r"^[\"']|[\"']$", "")
    return rows.select("doc_id", F.col("line").alias("node"), "key", value.alias("value"), "file", "line")


def unpack(text: str, options: set[str]) -> str:
    """A literate source without its comments: `%<a|b&!c>line` and `%<*a>` ... `%</a>` keep what the options ask for."""

    def holds(guard: str) -> bool:
        return any(all((t[1:] not in options) if t.startswith("!") else t in options for t in re.split("[&,]", alt)) for alt in guard.split("|"))

    out, open_ = [], []
    for line in text.split("\n"):
        if m := re.match(r"%<([*/]?)([^>]*)>(.*)", line):
            if m[1] == "*":
                open_.append(holds(m[2]))
            elif m[1] == "/":
                if open_:
                    open_.pop()
            elif all(open_) and holds(m[2].lstrip("+-")) != m[2].startswith("-"):
                out.append(m[3])
        elif all(open_) and (not line.startswith("%") or line.startswith("%%")):
            out.append(line)
    return "\n".join(out)


def literate(docs: DataFrame, options: list[str]) -> DataFrame:
    """(doc_id, text): literate sources unpacked for some options."""
    chosen = set(options)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[unpack(t or "", chosen) for t in pdf["text"]])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string")


#: Category codes of characters that are neither letters (11) nor others (12): fixed values.
CATCODES = {"\\": 0, "{": 1, "}": 2, "$": 3, "&": 4, "\n": 5, "#": 6, "^": 7, "_": 8, "\0": 9, " ": 10, "\t": 10, "~": 13, "%": 14, "\x7f": 15}


def scan(text: str, catcodes: dict[str, int] | None = None) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, category, line, col) of a text's tokens: control sequences, characters, paragraph ends.

    Blanks after a control word and at the start of a line are passed over, runs
    of blanks are one, an empty line is a paragraph end, a comment takes the rest
    of its line.
    """
    codes = CATCODES | (catcodes or {})
    cat = lambda c: codes.get(c, 11 if c.isalpha() else 12)
    out = []
    for no, line in enumerate(text.split("\n"), 1):
        state, i = "new", 0
        line += "\n"
        while i < len(line):
            c, k, col = line[i], cat(line[i]), i + 1
            i += 1
            if k == 0:
                end = i
                while end < len(line) and cat(line[end]) == 11:
                    end += 1
                end = max(end, min(i + 1, len(line)))
                name = line[i:end]
                i = end
                out.append(("command", name, 0, no, col))
                state = "skip" if name[:1] and cat(name[0]) in (10, 11) else "mid"
            elif k == 5:
                out += [("command", "par", 0, no, col)] if state == "new" else [("character", " ", 10, no, col)] if state == "mid" else []
                break
            elif k == 14:
                break
            elif k == 10:
                if state == "mid":
                    out.append(("character", " ", 10, no, col))
                    state = "skip"
            elif k not in (9, 15):
                out.append(("character", c, k, no, col))
                state = "mid"
    return out


def tokens(docs: DataFrame, catcodes: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, idx, kind, text, cat, line, col): the tokens of documents, by category codes."""

    def run(batches):
        for pdf in batches:
            rows = [(i, n, *t) for i, text in pdf[["doc_id", "text"]].itertuples(index=False) for n, t in enumerate(scan(text or "", catcodes))]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "kind", "text", "cat", "line", "col"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, idx long, kind string, text string, cat int, line int, col int")


def rename(tokens_: DataFrame, old: str, new: str) -> DataFrame:
    """(doc_id, line, col, replacement): the places of a command's name, to be given another."""
    return tokens_.filter((F.col("kind") == "command") & (F.col("text") == old)).select("doc_id", "line", "col", F.lit("\\" + new).alias("replacement"))


def nesting(tokens_: DataFrame) -> DataFrame:
    """Tokens with the depth of groups that they stand in; a surplus close does not go below zero."""
    from siftwork.operators.ordered import balance

    step = F.when(F.col("cat") == 1, 1).when(F.col("cat") == 2, -1).otherwise(0)
    return balance(tokens_, ["doc_id"], ["idx"], step)


def order_of_files(files: DataFrame, main: str) -> DataFrame:
    """Rows with (file, line, col) in the order of a document: its main file first."""
    return files.withColumn("position", F.row_number().over(W.partitionBy("doc_id").orderBy(F.when(F.col("file") == main, 0).otherwise(1), "file", "line", "col")))
