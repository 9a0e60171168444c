"""Rules on style: spacing, punctuation, marks, unused and repeated definitions, tables and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.functions.scalars import colour_distance, contrast
from siftwork.operators.ordered import dead_stores
from siftwork.rules.registry import RULES, at, matches, occurrences, pattern, register, setting, undefined, where
from siftwork.sources.facts import Facts


def unused(define: str, use: tuple[str, ...], message: str):
    """A rule: definitions whose key no use of the document names."""

    def run(facts: Facts, config: dict) -> DataFrame:
        used = occurrences(facts, *use).select("doc_id", "key").distinct()
        return at(occurrences(facts, define).filter(F.col("key").isNotNull()).join(used, ["doc_id", "key"], "left_anti"), message)

    return run


def _unused_definition(facts: Facts, config: dict) -> DataFrame:
    used = facts["expansions"].select("doc_id", "name").unionByName(facts["calls"].select("doc_id", F.col("callee").alias("name"))).distinct()
    return at(facts["defs"].filter("origin = 'document' OR origin IS NULL").join(used, ["doc_id", "name"], "left_anti"), "$name is never used")


def _dead_definition(facts: Facts, config: dict) -> DataFrame:
    writes = facts["defs"].select("doc_id", "name", "node", "file", "line", "col", F.lit(True).alias("write"))
    reads = facts["expansions"].select("doc_id", "name", "node", "file", "line", "col", F.lit(False).alias("write"))
    return at(dead_stores(writes.unionByName(reads), ["doc_id", "name"], ["node"], F.col("write")), "$name is defined anew before it is used")


def _group_local(facts: Facts, config: dict) -> DataFrame:
    inside = facts["vertices"].filter("within IS NOT NULL").select("doc_id", "node")
    return at(facts["defs"].filter("depth > 0 AND NOT coalesce(global, false) AND (origin = 'document' OR origin IS NULL)").join(inside, ["doc_id", "node"], "left_anti"), "$name is lost at the end of the group")


def _duplicate_color(facts: Facts, config: dict) -> DataFrame:
    w = W.partitionBy("doc_id", "value").orderBy("node")
    return at(facts["colors"].withColumn("first", F.first("name").over(w)).withColumn("n", F.row_number().over(w)).filter("n > 1 AND first <> name"), "$name has the value of $first")


def _contrast(facts: Facts, config: dict) -> DataFrame:
    rows = facts["color_uses"].join(facts["colors"].select("doc_id", "name", F.col("value").alias("fore")), ["doc_id", "name"])
    rows = rows.withColumn("ratio", F.round(contrast(F.col("fore"), F.coalesce("on_value", F.lit("FFFFFF"))), 2))
    return at(rows.filter(F.col("ratio") < config.get("contrast", 4.5)), "$name has a contrast of $ratio")


def _indistinct(facts: Facts, config: dict) -> DataFrame:
    """Colours of one document that are near each other but not equal; a palette is small, and pairs stay within it."""
    low, high = config.get("colour-distance", (0.5, 8.0))
    a = facts["colors"]
    b = a.select("doc_id", F.col("name").alias("other"), F.col("value").alias("v2"), F.col("node").alias("n2"))
    rows = a.join(b, "doc_id").filter("n2 < node").withColumn("d", colour_distance(F.col("value"), F.col("v2")))
    return at(rows.filter(F.col("d").between(low, high)), "$name can hardly be told from $other")


def _precision(facts: Facts, config: dict) -> DataFrame:
    n = F.length(F.regexp_extract("text", r"^\s*-?\d+\.(\d+)\s*$", 1))
    rows = facts["cells"].filter(F.col("text").rlike(r"^\s*-?\d+(\.\d+)?\s*$")).withColumn("n", n)
    some = rows.groupBy("doc_id", "table_id", "column").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min_by(F.struct("file", "line", "col"), "row").alias("p")).filter("lo <> hi")
    return at(some.select("doc_id", "column", "lo", "hi", "p.*"), "column $column has $lo to $hi decimals")


def _not_aligned(facts: Facts, config: dict) -> DataFrame:
    number = F.col("text").rlike(r"^\s*-?\d+(\.\d+)?\s*$").cast("int")
    some = facts["cells"].groupBy("doc_id", "table_id", "column", "align").agg(F.avg(number).alias("share"), F.min_by(F.struct("file", "line", "col"), "row").alias("p"))
    return at(some.filter("share >= 0.8 AND align IN ('l', 'c')").select("doc_id", "column", "p.*"), "the numbers of column $column do not line up")


def _unit_in_cells(facts: Facts, config: dict) -> DataFrame:
    unit = F.regexp_extract("text", r"^\s*-?[\d.]+\s*([A-Za-z%°]+)\s*$", 1)
    some = facts["cells"].withColumn("unit", unit).groupBy("doc_id", "table_id", "column").agg(F.count_distinct(F.nullif("unit", F.lit(""))).alias("kinds"), F.count(F.nullif("unit", F.lit(""))).alias("n"), F.max("unit").alias("unit"), F.min_by(F.struct("file", "line", "col"), "row").alias("p"))
    return at(some.filter("kinds = 1 AND n >= 3").select("doc_id", "column", "unit", "p.*"), "the unit $unit belongs in the head of column $column")


def _csquotes(facts: Facts, config: dict) -> DataFrame:
    rows = facts["lines"].filter(F.col("text").rlike("``|''|[“”„«»]"))
    some = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("file", "line"), "line").alias("p")).filter(F.col("n") >= config.get("csquotes-lines", 3))
    has = facts["loads"].filter("name = 'csquotes'").select("doc_id").distinct()
    return at(some.join(has, "doc_id", "left_anti").select("doc_id", "n", "p.*"), "$n lines with quotes set by hand")


def _microtype(facts: Facts, config: dict) -> DataFrame:
    has = facts["loads"].filter("name = 'microtype'").select("doc_id").distinct()
    root = facts["loads"].filter("kind = 'class'")
    return at(root.join(has, "doc_id", "left_anti"), "microtype would help the line breaks")


def _fonts(condition: str, message: str):
    return lambda facts, config: at(facts["fonts"].filter(condition).groupBy("doc_id").agg(F.min_by(F.struct("file", "line", "col", "family", "encoding"), "node").alias("p")).select("doc_id", "p.*"), message)


def _hand_written(kind: str, regex: str, message: str):
    """Text that says what a reference could: its number equals that of a known target."""

    def run(facts: Facts, config: dict) -> DataFrame:
        rows = facts["lines"].withColumn("said", F.regexp_extract("text", regex, 1)).withColumn("detail", F.lower(F.regexp_extract("text", regex, 2))).filter("detail <> ''")
        known = occurrences(facts, kind).select("doc_id", F.lower("detail").alias("detail")).distinct()
        return at(rows.join(known, ["doc_id", "detail"], "left_semi"), message)

    return run


def _lists(regex: str, message: str):
    """Items of one list that all start alike."""

    def run(facts: Facts, config: dict) -> DataFrame:
        rows = occurrences(facts, "item").withColumn("hit", F.col("detail").rlike(regex).cast("int"))
        some = rows.groupBy("doc_id", "section").agg(F.avg("hit").alias("share"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("file", "line", "col"), "node").alias("p"))
        return at(some.filter("n >= 2 AND share = 1").select("doc_id", "p.*"), message)

    return run


def _clones(facts: Facts, config: dict) -> DataFrame:
    from siftwork.operators.clones import clone_groups

    rows = clone_groups(facts["lines"])
    return at(rows, "repeated $tokens tokens in $places places")


def _successor(facts: Facts, config: dict) -> DataFrame:
    new = facts["packages"].filter("successor IS NOT NULL").select("name", "successor")
    has = facts["loads"].select("doc_id", F.col("name").alias("successor")).distinct()
    return at(facts["loads"].join(new, "name").join(has, ["doc_id", "successor"], "left_anti"), "$successor has taken the place of $name")


def _redundant_load(facts: Facts, config: dict) -> DataFrame:
    w = W.partitionBy("doc_id", "name").orderBy("node")
    none = F.array().cast("array<string>")
    rows = facts["loads"].withColumn("n", F.row_number().over(w)).withColumn("had", F.first("options").over(w)).filter("n > 1")
    return at(rows.filter(F.size(F.array_except(F.coalesce("options", none), F.coalesce("had", none))) == 0), "$name is loaded already, with these options")


def _suppress_codes(facts: Facts, config: dict) -> DataFrame:
    known = [x for r in RULES.values() for x in (r.number, r.name)]
    codes = F.explode(F.filter(F.split(F.trim(F.regexp_extract("text", r"%\s*lint-(?:ignore-file|ignore|off)\b[ :]*([\w, -]*)", 1)), r"[,\s]+"), lambda c: c != "")).alias("code")
    rows = facts["lines"].filter(F.col("text").rlike(r"%\s*lint-(ignore|off)")).select("doc_id", "file", "line", codes)
    return at(rows.filter(~F.col("code").isin(known)), "no rule $code")


def _user_pattern(facts: Facts, config: dict) -> DataFrame:
    """Texts and patterns from the configuration, outside comments."""
    wanted = config.get("user-patterns", [])
    plain = facts["lines"].withColumn("text", F.regexp_extract("text", r"^((?:[^%\\]|\\.)*+\\?)", 1))
    none = at(plain.limit(0), "")
    for p in wanted:
        regex = p["pattern"] if "pattern" in p else r"\Q" + p["text"].replace(r"\E", r"\E\\E\Q") + r"\E"
        none = none.unionByName(at(matches(plain, regex), F.lit(p.get("message", "found"))))
    return none


def _long_lines(facts: Facts, config: dict) -> DataFrame:
    given = at(facts["overfull"].filter("what = 'line'"), "the line is $excess too wide")
    most = config.get("line-length")
    return given.unionByName(at(facts["lines"].filter(F.length("text") > most), "a line of over " + str(most) + " characters")) if most else given


def _primitive(facts: Facts, config: dict) -> DataFrame:
    old = config.get("primitive-commands", {"over": "frac", "centerline": "centering", "bf": "bfseries", "it": "itshape", "eqno": "tag", "def": "newcommand"})
    names = facts.spark.createDataFrame(list(old.items()), "name string, better string")
    return at(facts["expansions"].filter("origin = 'document' OR origin IS NULL").join(F.broadcast(names), "name"), "$better is the better $name")


def _mathml(facts: Facts, config: dict) -> DataFrame:
    on = setting(facts, "tagging").filter("value = 'on'").select("doc_id")
    has = facts["settings"].filter("key = 'mathml'").select("doc_id").distinct()
    math = occurrences(facts, "math").groupBy("doc_id").agg(F.min_by(F.struct("file", "line", "col"), "node").alias("p")).select("doc_id", "p.*")
    return at(math.join(on, "doc_id", "left_semi").join(has, "doc_id", "left_anti"), "formulas without MathML")


def _displays(facts: Facts, config: dict) -> DataFrame:
    used = occurrences(facts, "ref", "eqref", "cref").select("doc_id", "key").distinct()
    return at(occurrences(facts, "numbered-display").join(used, ["doc_id", "key"], "left_anti"), "the number of $key is never used")


def _uncited(facts: Facts, config: dict) -> DataFrame:
    cites = occurrences(facts, "cite")
    every = cites.filter("key = '*'").select("doc_id").distinct()
    return at(facts["bib_entries"].join(cites.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti").join(every, "doc_id", "left_anti"), "$key is not cited")


_ITALIC = lambda kind, message: where("occurrences", f"kind = 'italic-correction' AND detail = '{kind}'", message)

register("S001", "accent-on-dotted-letter", "warning", pattern(r"\\['`^\"~=.]\s*\{?[ij]\b", "$found needs a dotless letter"), "lines")
register("S002", "command-terminated-space", "warning", pattern(r"\\(LaTeX|TeX|dots|ldots|today|BibTeX) +[A-Za-z]", "the blank after $found is lost"), "lines")
register("S003", "dimension-times", "warning", pattern(r"\b\d+\s?[x*]\s?\d+\b", "$found wants a times sign"), "lines")
register("S004", "double-space", "warning", pattern(r"\S {2,}\S", "several blanks in a row"), "lines")
register("S005", "ellipsis-dots", "warning", pattern(r"(?:^|[^.])\.\.\.(?:[^.]|$)", "three full stops for an ellipsis"), "lines")
register("S006", "expl3-scope", "warning", where("vars", "(name RLIKE '^g_' AND scope = 'local') OR (name RLIKE '^l_' AND scope = 'global')", "$name is set $scope"), "vars")
register("S007", "expl3-type", "warning", where("vars", "type IS NOT NULL AND NOT endswith(name, concat('_', type))", "$name is used as $type"), "vars")
register("S008", "group-local-definition", "warning", _group_local, "defs", "vertices")
register("S009", "math-operator-name", "warning", pattern(r"\$[^$]*(?<![\\A-Za-z])(sin|cos|tan|log|ln|exp|max|min|lim|det)\b[^$]*\$", "an operator name needs a backslash"), "lines")
register("S010", "missing-italic-correction", "warning", _ITALIC("missing", "the slanted text leans on what follows"), "occurrences")
register("S011", "missing-nonbreaking-space", "warning", pattern(r"\w +\\(ref|cite|eqref|autoref|cref)\b", "a tie belongs before $found"), "lines")
register("S012", "parenthesis-spacing", "warning", pattern(r"\(\s+\S|\S\s+\)|[A-Za-z0-9]\([A-Za-z]{2,}\s", "blanks are not right at a parenthesis"), "lines")
register("S013", "quote-direction", "warning", pattern(r"(?:^|\s)''\w|\w``(?:\s|$)|(?:^|\s)”\w|\w“(?:\s|$)", "$found points the wrong way"), "lines")
register("S014", "sentence-spacing", "warning", pattern(r"\b[A-Z]{2,}\.\s+[A-Z]|\b(?:e\.g|i\.e|etc|cf)\. [a-z]", "the space after $found is not what it should be"), "lines")
register("S015", "space-before-command", "warning", pattern(r"\w +\\(footnote|index|label)\b", "a blank before $found"), "lines")
register("S016", "space-before-punctuation", "warning", pattern(r"\w +[,;:.!?](?:\s|$)", "a blank before a mark"), "lines")
register("S017", "stray-italic-correction", "warning", _ITALIC("stray", "an italic correction in upright text"), "occurrences")
register("S018", "unknown-suppress-code", "warning", _suppress_codes, "lines")
register("S019", "user-pattern", "warning", _user_pattern, "lines")
register("S020", "wrong-dash", "warning", pattern(r"\d-\d+\b(?!-)|\w - \w|\d---\d", "$found wants another dash"), "lines")
register("S021", "wrong-quote-character", "warning", pattern("(?:^|\\s)\"\\w|\\w\"(?:\\s|$|[.,;])|´", "straight or foreign quote"), "lines")
register("S022", "zero-italic-correction", "warning", _ITALIC("zero", "an italic correction of nothing"), "occurrences")
register("S026", "comment-marker", "info", pattern(r"(?:%|<!--).*\b(TODO|FIXME|XXX|HACK)\b", "a note to come back to"), "lines")
register("S027", "computer-modern-in-t1", "info", _fonts("encoding = 'T1' AND family RLIKE '^cm'", "bitmap-like $family in T1"), "fonts")
register("S028", "csquotes-available", "info", _csquotes, "lines", "loads")
register("S029", "dead-definition", "info", _dead_definition, "defs", "expansions")
register("S030", "duplicate-color-value", "info", _duplicate_color, "colors")
register("S032", "hand-set-quantity", "info", lambda f, c: at(f["quantities"], "$number $unit is set by hand").unionByName(pattern(r"\b\d+(?:\.\d+)?(?:~|\\,| )(?:mm|cm|km|kg|mg|ms|Hz|kHz|GHz|MB|GB)\b", "$found is set by hand")(f, c)), "quantities", "lines")
register("S033", "inconsistent-precision", "info", _precision, "cells")
register("S034", "math-punctuation", "info", pattern(r"[.,;]\s*\$\$?\s*$|\$\$\s*[.,;]", "a mark on the wrong side of a formula"), "lines")
register("S035", "math-shift-dollars", "info", pattern(r"\$\$", "double dollars for a display"), "lines")
register("S036", "microtype-available", "info", _microtype, "loads")
register("S037", "numbers-not-aligned", "info", _not_aligned, "cells")
register("S038", "ot1-font-encoding", "info", _fonts("encoding = 'OT1'", "OT1 can't hyphenate accented words"), "fonts")
register("S039", "prefer-cleveref", "info", pattern(r"\b(?:Figure|Table|Section|Equation|Fig\.|Sec\.|Eq\.)[~ ]\\ref\b", "$found could name its target itself"), "lines")
register("S040", "primitive-tex-command", "info", _primitive, "expansions")
register("S041", "quote-ligature", "info", pattern(r"``|''|,,", "quotes made of other marks"), "lines")
register("S042", "quote-punctuation", "info", pattern("(?:''|”|\")[.,]|[.,](?:''|”|\")", "a mark at a quote: $found"), "lines")
register("S043", "stray-space", "info", pattern(r"[{(\[]\s+\w|\s+$", "a blank that shows"), "lines")
register("S044", "table-rules", "info", lambda f, c: at(occurrences(f, "table-rule").filter("detail IN ('vline', 'hline')").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("file", "line", "col"), "node").alias("p")).select("doc_id", "n", "p.*"), "$n plain rules in a table"), "occurrences")
register("S045", "unit-in-cells", "info", _unit_in_cells, "cells")
register("S046", "unreferenced-numbered-display", "info", _displays, "occurrences")
register("S047", "unused-bibitem", "info", unused("bibitem", ("cite",), "$key is not cited"), "occurrences")
register("S048", "unused-color", "info", lambda f, c: at(f["colors"].join(f["color_uses"].select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti"), "$name is not used"), "colors", "color_uses")
register("S049", "unused-definition", "info", _unused_definition, "defs", "expansions", "calls")
register("S050", "unused-label", "info", unused("label", ("ref", "eqref", "cref"), "$key is not referred to"), "occurrences")
register("S051", "hand-written-reference", "info", _hand_written("label", r"\b(Figure|Table|Section|Equation)[~ ](\d+(?:\.\d+)*)\b", "$said $detail is written by hand"), "lines", "occurrences")
register("S052", "hand-written-author", "info", _hand_written("bibitem", r"\b(([A-Z]\w+)) (?:et al\.|and [A-Z]\w+) *\\cite", "$said is written by hand"), "lines", "occurrences")
register("S053", "clones", "info", _clones, "lines")
register("S054", "et-al", "warning", pattern(r"\bet\.? al\b(?!\.)|\bet\. al\.", "$found is not right"), "lines")
register("S055", "uncited-bibliography-entry", "info", _uncited, "bib_entries", "occurrences")
register("S056", "itemize-numbered", "info", _lists(r"^\s*\(?\d+[.):]", "items numbered by hand"), "occurrences")
register("S057", "itemize-described", "info", _lists(r"^\s*(\\textbf\{[^}]*\}|[A-Z]\w*):", "items that describe a term each"), "occurrences")
register("S058", "package-successor", "info", _successor, "loads", "packages")
register("S059", "bare-reference", "info", pattern(r"(?:^|[.(]\s*)\\ref\b", "a number without its kind"), "lines")
register("S060", "doubled-punctuation", "warning", pattern(r"(?:,,|;;|::|,\.|\.,|(?<!\.)\.\.(?!\.))(?=\s|$)", "$found"), "lines")
register("S061", "sentence-capital", "warning", pattern(r"[a-z]{2}[.!?] +[a-z]{2}", "a sentence starts small: $found", unless=r"\b(e\.g|i\.e|cf|etc|vs|al)\. +[a-z]{2}"), "lines")
register("S062", "overfull-line", "warning", _long_lines, "overfull", "lines")
register("S063", "overfull-box", "warning", where("overfull", "what = 'box'", "the box is $excess too full"), "overfull")
register("S064", "wider-than-line", "warning", where("overfull", "what = 'object'", "$excess wider than the line"), "overfull")
register("S065", "tagged-math-without-mathml", "info", _mathml, "settings", "occurrences")
register("S066", "redundant-package-load", "info", _redundant_load, "loads")
register("S067", "low-contrast-color", "warning", _contrast, "colors", "color_uses")
register("S068", "indistinct-colors", "info", _indistinct, "colors")
