"""What a rule is, how rules run together, and what is left out of their findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.sources.facts import Facts

#: Categories by the letter of a rule's number, and severities, gravest first.
CATEGORIES = {"C": "correctness", "X": "security", "S": "style", "P": "performance", "A": "precision"}
SEVERITIES = ("error", "warning", "info", "hint")
FINDING = ("doc_id", "file", "line", "col", "message")


@dataclass(frozen=True)
class Rule:
    number: str
    name: str
    severity: str
    run: Callable[[Facts, dict], DataFrame]
    #: Fact tables that it reads; rules on lines alone need no analysis.
    reads: tuple[str, ...] = ()

    @property
    def category(self) -> str:
        return CATEGORIES[self.number[0]]

    def findings(self, facts: Facts, config: dict | None = None) -> DataFrame:
        """doc_id, file, line, col, message and the rule's own columns; one row a place."""
        rows = self.run(facts, config or {}).select(*FINDING)
        rows = rows.groupBy("doc_id", "file", "line", "col").agg(F.min("message").alias("message"))
        return rows.select("doc_id", F.lit(self.number).alias("number"), F.lit(self.name).alias("code"), F.lit(self.category).alias("category"), F.lit(self.severity).alias("severity"), "message", "file", "line", "col")


RULES: dict[str, Rule] = {}


def register(number: str, name: str, severity: str, run: Callable[[Facts, dict], DataFrame], *reads: str) -> None:
    if number in RULES or severity not in SEVERITIES:
        raise ValueError(f"bad or repeated rule {number}")
    RULES[number] = Rule(number, name, severity, run, reads)


def at(df: DataFrame, message: str | Column) -> DataFrame:
    """Rows as findings: a message with $column parts filled in, at the row's own place."""
    if isinstance(message, str):
        parts, rest = [], message
        while "$" in rest:
            head, _, tail = rest.partition("$")
            n = next((i for i, c in enumerate(tail) if not (c.isalnum() or c == "_")), len(tail))
            parts += [F.lit(head), F.coalesce(F.col(tail[:n]).cast("string"), F.lit(""))]
            rest = tail[n:]
        message = F.concat(*parts, F.lit(rest))
    have = set(df.columns)
    place = [F.col(c) if c in have else F.lit(None).cast("string" if c == "file" else "int").alias(c) for c in ("file", "line", "col")]
    return df.select("doc_id", *place, message.alias("message"))


#: Characters before a match that an exception may look at.
CONTEXT = 16


def matches(rows: DataFrame, regex: str, text_col: str = "text") -> DataFrame:
    """Every match of a pattern in `text_col`: rows with `found`, `col` (from 1) and `before`, the CONTEXT characters ahead of it."""
    hit = rows.filter(F.col(text_col).rlike(regex)).withColumn("__row", F.monotonically_increasing_id())
    found = F.regexp_extract_all(text_col, F.lit(regex), F.lit(0))
    each = F.arrays_zip(found.alias("found"), F.slice(F.split(text_col, regex, -1), F.lit(1), F.size(found)).alias("ahead"))
    hit = hit.select(*hit.columns, F.posexplode(each).alias("__i", "__x"))
    # where a match starts is a running sum over its own line
    w = W.partitionBy("__row").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum(F.length("__x.ahead") + F.length("__x.found")).over(w) - F.length("__x.found")
    hit = hit.withColumn("found", F.col("__x.found")).withColumn("col", (start + 1).cast("int"))
    lo = F.greatest(F.col("col") - CONTEXT, F.lit(1))
    return hit.withColumn("before", F.substring(text_col, lo, F.col("col") - lo)).drop("__row", "__i", "__x")


def pattern(regex: str, message: str, unless: str | None = None):
    """A rule on lines: every match of the pattern, at its place; `unless` is an exception that ends where the match does."""

    def run(facts: Facts, config: dict) -> DataFrame:
        rows = matches(facts["lines"], regex)
        if unless:
            rows = rows.filter(~F.concat("before", "found").rlike(f"(?:{unless})$"))
        return at(rows, message)

    return run


def occurrences(facts: Facts, *kinds: str) -> DataFrame:
    rows = facts["occurrences"]
    return rows.filter(F.col("kind").isin(*kinds)) if kinds else rows


def undefined(use: tuple[str, ...], define: tuple[str, ...], message: str):
    """A rule: uses whose key no definition of the document has."""

    def run(facts: Facts, config: dict) -> DataFrame:
        known = occurrences(facts, *define).select("doc_id", "key").distinct()
        return at(occurrences(facts, *use).filter(F.col("key").isNotNull()).join(known, ["doc_id", "key"], "left_anti"), message)

    return run


def repeated(table: str, keys: list[str], message: str, where: str | None = None):
    """A rule: rows of a table after the first of their keys."""

    def run(facts: Facts, config: dict) -> DataFrame:
        rows = facts[table].filter(where) if where else facts[table]
        w = W.partitionBy("doc_id", *keys).orderBy("node")
        first = F.first(F.concat_ws(":", "file", "line")).over(w)
        return at(rows.withColumn("n", F.row_number().over(w)).withColumn("first", first).filter("n > 1"), message)

    return run


def where(table: str, condition: str, message: str):
    """A rule: rows of a table for which a condition holds."""
    return lambda facts, config: at(facts[table].filter(condition), message)


def diagnosed(regex: str, message: str = "$message"):
    """A rule: recorded diagnostics whose code or message fits."""
    return lambda facts, config: at(facts["diagnostics"].filter(F.coalesce(F.col("code").rlike(regex) | F.col("message").rlike(regex), F.lit(False))), message)


def setting(facts: Facts, key: str) -> DataFrame:
    """(doc_id, value): the last setting of a key in each document."""
    return facts["settings"].filter(F.col("key") == key).groupBy("doc_id").agg(F.max_by("value", "node").alias("value"), F.max_by("file", "node").alias("file"), F.max_by("line", "node").alias("line"), F.max_by("col", "node").alias("col"))


def suppressed(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings that no comment takes back.

    `% lint-ignore CODES` acts on its line, or on the next one if nothing else
    stands on it; `% lint-ignore-file CODES` on the whole file; a region runs from
    `% lint-off CODES` to the next `% lint-on`. No codes mean all of them.
    """
    marks = lines.withColumn("mark", F.regexp_extract("text", r"%\s*lint-(ignore-file|ignore|off|on)\b", 1)).filter("mark <> ''")
    codes = F.split(F.trim(F.regexp_extract("text", r"%\s*lint-(?:ignore-file|ignore|off|on)\b[ :]*([\w, -]*)", 1)), r"[,\s]+")
    marks = marks.withColumn("codes", F.filter(codes, lambda c: c != ""))
    alone = F.col("text").rlike(r"^\s*%")
    end = F.min(F.when(F.col("mark") == "on", F.col("line"))).over(W.partitionBy("doc_id", "file").orderBy("line").rowsBetween(1, W.unboundedFollowing))
    marks = marks.withColumn("end", end).filter("mark <> 'on'")
    lo = F.when(F.col("mark") == "ignore-file", F.lit(0)).when((F.col("mark") == "ignore") & alone, F.col("line") + 1).otherwise(F.col("line"))
    hi = F.when(F.col("mark") == "ignore-file", F.lit(2**31 - 1)).when(F.col("mark") == "off", F.coalesce("end", F.lit(2**31 - 1))).otherwise(lo)
    spans = marks.select("doc_id", "file", lo.alias("lo"), hi.alias("hi"), F.explode_outer("codes").alias("only"))
    f, s = findings.alias("f"), spans.alias("s")
    hit = (F.col("f.doc_id") == F.col("s.doc_id")) & F.col("f.file").eqNullSafe(F.col("s.file")) & (F.col("f.line") >= F.col("s.lo")) & (F.col("f.line") <= F.col("s.hi")) & (F.col("s.only").isNull() | (F.col("s.only") == F.col("f.number")) | (F.col("s.only") == F.col("f.code")))
    return f.join(s, hit, "left_anti")


def lint(facts: Facts, only: Iterable[str] | None = None, off: Iterable[str] = (), config: dict | None = None) -> DataFrame:
    """The findings of the chosen rules (by number or name), without suppressed ones, non-errors in files that the run writes, and raised errors that another finding explains."""
    off = set(off)
    chosen = [r for r in RULES.values() if (only is None or {r.number, r.name} & set(only)) and not {r.number, r.name} & off]
    rows = reduce(DataFrame.unionByName, [r.findings(facts, config) for r in chosen])
    if "lines" in facts.tables:
        rows = suppressed(rows, facts["lines"])
    if "written_files" in facts.tables:
        written = facts["written_files"].select("doc_id", F.col("path").alias("file")).distinct()
        rows = rows.filter("severity = 'error'").unionByName(rows.filter("severity <> 'error'").join(written, ["doc_id", "file"], "left_anti"))
    raised, other = rows.filter("code = 'raised-error'"), rows.filter("code <> 'raised-error'")
    explained = other.filter("severity = 'error'").select("doc_id", "file", "line").distinct()
    return other.unionByName(raised.join(explained, ["doc_id", "file", "line"], "left_anti"))


def reconcile(early: DataFrame, late: DataFrame) -> DataFrame:
    """Findings of a sketch and of the run that followed: state is confirmed, retracted or new."""
    key = ["doc_id", "code", "file", "line", "col"]
    a = early.select(*key).distinct().withColumn("__e", F.lit(True))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    found = late.alias("a").join(a.alias("b"), same, "left").select("a.*", F.when(F.col("b.__e"), "confirmed").otherwise("new").alias("state"))
    gone = early.alias("a").join(late.select(*key).distinct().alias("b"), same, "left_anti").withColumn("state", F.lit("retracted"))
    return found.unionByName(gone)


def ordered(findings: DataFrame) -> DataFrame:
    """Findings by document and place, gravest first at one place."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return findings.orderBy("doc_id", "file", "line", "col", rank, "number")


def shown_per_rule(findings: DataFrame, most: int = 3) -> DataFrame:
    """The first `most` of each rule with how many there are: a report, not the findings."""
    w = W.partitionBy("number").orderBy("doc_id", "file", "line", "col")
    total = findings.groupBy("number").agg(F.count(F.lit(1)).alias("total"))
    return findings.withColumn("shown", F.row_number().over(w)).filter(F.col("shown") <= most).join(F.broadcast(total), "number")
