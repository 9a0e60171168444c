"""Rules on cost, and on how exact the analysis was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators.graph import cycles
from siftwork.rules.registry import at, diagnosed, occurrences, register, where
from siftwork.sources.facts import Facts


def _recursive(facts: Facts, config: dict) -> DataFrame:
    """Defined names that call themselves, at once or through others."""
    name = lambda c: F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.col(c))
    found = cycles(facts["calls"].select(name("name").alias("src"), name("callee").alias("dst")))
    last = facts["defs"].groupBy("doc_id", "name").agg(F.max_by(F.struct("file", "line", "col"), "node").alias("p")).select("doc_id", "name", "p.*")
    rows = last.withColumn("node", name("name")).join(found.select("node", "kind"), "node")
    return at(rows, "$name is recursive ($kind)")


def _preamble(facts: Facts, config: dict) -> DataFrame:
    loads = facts["loads"].filter("cost IS NOT NULL")
    total = loads.groupBy("doc_id").agg(F.sum("cost").alias("all"))
    rows = loads.join(total, "doc_id").filter(F.col("cost") >= config.get("preamble-share", 0.3) * F.col("all"))
    return at(rows.withColumn("share", F.round(100 * F.col("cost") / F.col("all")).cast("int")), "$name takes $share % of the loading")


def _include(facts: Facts, config: dict) -> DataFrame:
    parts = facts["loads"].filter("kind = 'include'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("file", "line", "col"), "node").alias("p"))
    only = facts["settings"].filter("key = 'includeonly'").select("doc_id").distinct()
    return at(parts.filter(F.col("n") >= config.get("include-parts", 3)).join(only, "doc_id", "left_anti").select("doc_id", "n", "p.*"), "$n parts could be built one at a time")


def _unused_package(facts: Facts, config: dict) -> DataFrame:
    used = facts["expansions"].filter("package IS NOT NULL").select("doc_id", F.col("package").alias("name"))
    used = used.unionByName(facts["occurrences"].filter("package IS NOT NULL").select("doc_id", F.col("package").alias("name"))).distinct()
    return at(facts["loads"].filter("kind = 'package' AND by IS NULL").join(used, ["doc_id", "name"], "left_anti"), "nothing of $name is used")


def _unused_dependency(facts: Facts, config: dict) -> DataFrame:
    used = facts["expansions"].filter("package IS NOT NULL").select("doc_id", F.col("package").alias("name"), F.col("within").alias("by")).distinct()
    return at(facts["loads"].filter("kind = 'package' AND by IS NOT NULL").join(used, ["doc_id", "name", "by"], "left_anti"), "$by loads $name and uses nothing of it")


def _imprecision(facts: Facts, config: dict) -> DataFrame:
    rows = facts["diagnostics"].filter("severity = 'approximation'")
    some = rows.groupBy("doc_id", "code").agg(F.sum(F.coalesce("count", F.lit(1))).alias("n"), F.min_by(F.struct("file", "line", "col"), F.struct("line", "col")).alias("p"))
    return at(some.select("doc_id", "code", "n", "p.*"), "$code, $n times")


def _duplicate_package(facts: Facts, config: dict) -> DataFrame:
    first = facts["loads"].filter("kind = 'package'").groupBy("doc_id", "name").agg(F.min("node").alias("first"))
    return at(facts["loads"].filter("kind = 'package' AND by IS NULL").join(first, ["doc_id", "name"]).filter("node > first"), "$name is loaded again")


register("A001", "analysis-imprecision", "info", _imprecision, "diagnostics")
register("A002", "assertion-unknown", "info", where("assertions", "holds IS NULL AND NOT coalesce(assumed, false)", "can't be told: $text"), "assertions")
register("A003", "unread-document", "error", diagnosed("unread"), "diagnostics")
register("P001", "package-after-preamble", "error", where("loads", "kind = 'package' AND in_body", "$name is loaded in the body"), "loads")
register("P002", "includeonly-available", "info", _include, "loads", "settings")
register("P003", "preamble-cost", "info", _preamble, "loads")
register("P004", "recursive-macro", "info", _recursive, "calls", "defs")
register("P005", "unused-dependency", "info", _unused_dependency, "loads", "expansions")
register("P006", "unused-package", "info", _unused_package, "loads", "expansions", "occurrences")
register("S031", "duplicate-package", "info", _duplicate_package, "loads")
