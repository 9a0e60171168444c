"""Rules on correctness: undefined and repeated names, nesting, modes, metadata, bibliographies, assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.functions.scalars import title_key
from siftwork.operators.ordered import balance, match_kinds
from siftwork.rules.registry import at, diagnosed, occurrences, pattern, register, repeated, setting, undefined, where
from siftwork.sources.facts import Facts


def _near(names: DataFrame, known: DataFrame, within: int = 2) -> DataFrame:
    """names (doc_id, name, place) with the known name at a small edit distance.

    Candidates share a first letter and differ in length by `within` at most: an
    equi-join on letter and length, so no all-pairs comparison.
    """
    a = names.withColumn("__l", F.substring("name", 1, 1)).withColumn("__n", F.explode(F.sequence(F.length("name") - within, F.length("name") + within)))
    b = known.select(F.col("name").alias("known")).distinct().withColumn("__l", F.substring("known", 1, 1)).withColumn("__n", F.length("known"))
    hit = a.join(b, ["__l", "__n"]).withColumn("distance", F.levenshtein("name", "known", within)).filter("distance BETWEEN 1 AND " + str(within))
    w = W.partitionBy("doc_id", "node").orderBy("distance", "known")
    return hit.withColumn("__r", F.row_number().over(w)).filter("__r = 1")


def _undefined_commands(facts: Facts, config: dict) -> DataFrame:
    uses = facts["expansions"].filter("meaning = 'undefined'")
    known = facts["defs"].select("name")
    near = _near(uses.select("doc_id", "node", "name"), known).select("doc_id", "node", "known")
    rows = uses.join(near, ["doc_id", "node"], "left")
    return at(rows, F.concat(F.lit("undefined "), "name", F.when(F.col("known").isNotNull(), F.concat(F.lit("; did you mean "), "known", F.lit("?"))).otherwise("")))


def _recursion(facts: Facts, config: dict) -> DataFrame:
    """Names that call themselves or one another without a conditional in between, and that the run had to cut short."""
    return at(facts["diagnostics"].filter("code = 'recursion'"), "$message")


def _new_redefines(facts: Facts, config: dict) -> DataFrame:
    d = facts["defs"]
    first = d.groupBy("doc_id", "name").agg(F.min("node").alias("first"))
    return at(d.filter("by = 'new' AND origin = 'document'").join(first, ["doc_id", "name"]).filter("node > first"), "$name is declared new but was defined before")


def _already(facts: Facts, config: dict) -> DataFrame:
    w = W.partitionBy("doc_id", "name").orderBy("node")
    rows = facts["defs"].filter("by IN ('new', 'provide-strict')").withColumn("n", F.row_number().over(w)).filter("n > 1")
    return at(rows, "$name is already defined").unionByName(diagnosed("already.?defined")(facts, config))


def _option_clash(facts: Facts, config: dict) -> DataFrame:
    w = W.partitionBy("doc_id", "name").orderBy("node").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = facts["loads"].withColumn("had", F.first("options").over(w)).withColumn("new", F.array_except(F.coalesce("options", F.array().cast("array<string>")), F.coalesce("had", F.array().cast("array<string>"))))
    return at(rows.filter(F.size("new") > 0).withColumn("extra", F.array_join("new", ",")), "$name is loaded again with new options $extra")


def _nesting(*kinds: str, message: str):
    """Openings and closings of these kinds that do not pair, in the order of the run."""

    def run(facts: Facts, config: dict) -> DataFrame:
        rows = occurrences(facts, *[f"{k}-{e}" for k in kinds for e in ("begin", "end")])
        rows = rows.withColumn("step", F.when(F.col("kind").endswith("-begin"), 1).otherwise(-1)).withColumn("what", F.coalesce("key", F.lit("")))
        pairs = match_kinds(rows.select("doc_id", "node", "what", "step"), ["doc_id"], ["node"], "what", "step", "node").filter("open IS NULL OR close IS NULL")
        bad = pairs.select("doc_id", F.coalesce("open", "close").alias("node"), F.when(F.col("open").isNull(), "has no opening").otherwise("is never closed").alias("why"))
        return at(rows.join(bad, ["doc_id", "node"]), F.concat(F.lit(message + " "), "what", F.lit(" "), "why"))

    return run


def _brackets(facts: Facts, config: dict) -> DataFrame:
    """Round and square brackets that do not pair within a document; a surplus close does not borrow from a later open."""
    found = []
    for opening, closing in (("(", ")"), ("[", "]")):
        rows = facts["lines"].filter(F.col("text").contains(opening) | F.col("text").contains(closing))
        marks = rows.select("doc_id", "file", "line", F.posexplode(F.split("text", "")).alias("i", "c")).filter(F.col("c").isin(opening, closing))
        marks = balance(marks, ["doc_id", "file"], ["line", "i"], F.when(F.col("c") == opening, 1).otherwise(-1)).withColumn("col", F.col("i") + 1)
        found.append(at(marks.filter("surplus"), f"{closing} without {opening}"))
        w = W.partitionBy("doc_id", "file").orderBy(F.desc("line"), F.desc("i"))
        last = marks.withColumn("r", F.row_number().over(w)).filter("r = 1 AND depth > 0")
        found.append(at(last, F.concat("depth", F.lit(f" {opening} still open"))))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _color_stack(facts: Facts, config: dict) -> DataFrame:
    rows = balance(facts["stack_ops"].filter("stack IS NOT NULL"), ["doc_id", "stack"], ["seq"], F.when(F.col("op") == "push", 1).when(F.col("op") == "pop", -1).otherwise(0))
    last = rows.groupBy("doc_id", "stack").agg(F.max_by(F.struct("depth", "file", "line", "col"), "seq").alias("e")).select("doc_id", "stack", "e.*").filter("depth > 0")
    return at(rows.filter("surplus"), "pop from the empty stack $stack").unionByName(at(last, "$depth colours still on stack $stack"))


def _mode(facts: Facts, config: dict) -> DataFrame:
    """A use that asks for one mode while the innermost open one is the other."""
    rows = facts["expansions"].filter("mode IS NOT NULL AND meaning IN ('needs-math', 'needs-text')")
    return at(rows.filter("(meaning = 'needs-math' AND mode <> 'math') OR (meaning = 'needs-text' AND mode = 'math')"), "$name is not for $mode mode")


def _catcodes(facts: Facts, config: dict) -> DataFrame:
    s = facts["settings"]
    now = s.filter("key LIKE 'catcode:%'").groupBy("doc_id", "key").agg(F.max_by("value", "node").alias("now"))
    first = s.filter("key LIKE 'initial-catcode:%'").select("doc_id", F.expr("substr(key, 9)").alias("key"), F.col("value").alias("was"))
    change = occurrences(facts, "catcode").groupBy("doc_id", F.concat(F.lit("catcode:"), F.col("key")).alias("key")).agg(F.min_by(F.struct("file", "line", "col"), "node").alias("p"))
    rows = now.join(first, ["doc_id", "key"], "full").filter(~F.col("now").eqNullSafe(F.col("was"))).join(change, ["doc_id", "key"]).select("doc_id", "key", "p.*")
    return at(rows, "$key is not what it was")


def _missing_field(facts: Facts, config: dict) -> DataFrame:
    must = config.get("required-fields", {"article": ["author", "title", "year"], "book": ["title", "year"], "inproceedings": ["author", "title", "booktitle"]})
    want = F.create_map(*[F.lit(x) if i % 2 == 0 else F.array(*map(F.lit, x)) for k, v in must.items() for i, x in enumerate((k, v))])
    rows = facts["bib_entries"].withColumn("lacks", F.array_except(F.element_at(want, F.lower("kind")), F.coalesce("fields", F.array().cast("array<string>"))))
    return at(rows.filter(F.size("lacks") > 0).withColumn("what", F.array_join("lacks", ", ")), "$key lacks $what")


def duplicate_works(entries: DataFrame) -> DataFrame:
    """(doc_id, node, other): entries that are the same work: equal DOIs where both have one, else equal title keys of over 8 bytes and years that agree or are absent. The entry with more fields is `other`."""
    e = entries.select("doc_id", "node", F.nullif(F.lower("doi"), F.lit("")).alias("doi"), title_key(F.col("title")).alias("t"), F.coalesce("year", F.lit("")).alias("year"), F.coalesce(F.size("fields"), F.lit(0)).alias("n"))
    side = lambda p: e.select("doc_id", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "doi", "t", "year", "n")])
    a, b = side("a"), side("b")
    both = "a_doi IS NOT NULL AND b_doi IS NOT NULL"
    by_doi = a.join(b, (a.doc_id == b.doc_id) & (F.col("a_doi") == F.col("b_doi")) & (F.col("a_node") < F.col("b_node"))).drop(b.doc_id)
    by_title = a.filter(F.octet_length("a_t") > 8).join(b, (a.doc_id == b.doc_id) & (F.col("a_t") == F.col("b_t")) & (F.col("a_node") < F.col("b_node"))).drop(b.doc_id)
    by_title = by_title.filter(f"NOT ({both}) AND (a_year = b_year OR a_year = '' OR b_year = '')")
    pairs = by_doi.unionByName(by_title).dropDuplicates(["doc_id", "a_node", "b_node"])
    less = F.col("b_n") <= F.col("a_n")
    return pairs.select("doc_id", F.when(less, F.col("b_node")).otherwise(F.col("a_node")).alias("node"), F.when(less, F.col("a_node")).otherwise(F.col("b_node")).alias("other"))


def _duplicate_work(facts: Facts, config: dict) -> DataFrame:
    return at(facts["bib_entries"].join(duplicate_works(facts["bib_entries"]).select("doc_id", "node").distinct(), ["doc_id", "node"]), "$key is a work listed twice")


def _reference_name(facts: Facts, config: dict) -> DataFrame:
    """A word before a reference that names another kind of target than the label is: 'Table' before a figure's."""
    kinds = config.get("reference-words", {"figure": "figure", "table": "table", "section": "section", "equation": "equation", "chapter": "section", "theorem": "theorem"})
    of = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v)])
    labels = occurrences(facts, "label").select("doc_id", "key", F.col("target").alias("is")).distinct()
    rows = occurrences(facts, "ref").withColumn("said", F.element_at(of, F.lower("detail"))).join(labels, ["doc_id", "key"])
    return at(rows.filter("said <> is"), "$detail before a reference to a $is")


def _boundary(kinds: tuple[str, ...], message: str):
    """Occurrences after the row that closes the part they belong to."""

    def run(facts: Facts, config: dict) -> DataFrame:
        edge = facts["loads"].filter("kind = 'class'").groupBy("doc_id").agg(F.min("node").alias("edge"))
        return at(occurrences(facts, *kinds).join(edge, "doc_id").filter("node > edge"), message)

    return run


def _load_order(facts: Facts, config: dict) -> DataFrame:
    first = facts["loads"].groupBy("doc_id", "name").agg(F.min_by(F.struct("node", "file", "line", "col"), "node").alias("p"))
    must = facts["packages"].filter("before IS NOT NULL").select("name", "before")
    later = first.select("doc_id", F.col("name").alias("before"), F.col("p.node").alias("edge"))
    rows = first.join(must, "name").join(later, ["doc_id", "before"]).filter("p.node > edge").select("doc_id", "name", "before", "p.*")
    return at(rows, "$name must be loaded before $before")


def _misspelled_packages(facts: Facts, config: dict) -> DataFrame:
    rows = facts["loads"].filter("status = 'absent'")
    near = _near(rows.select("doc_id", "node", "name"), facts["packages"].select("name")).select("doc_id", "node", "known")
    return at(rows.join(near, ["doc_id", "node"]), "unknown $name; did you mean $known?")


def _magic(facts: Facts, config: dict) -> DataFrame:
    known = config.get("magic-keys", ["program", "root", "encoding", "spellcheck", "options", "ts-program"])
    rows = facts["lines"].withColumn("name", F.lower(F.regexp_extract("text", r"^\s*%\s*![Tt][Ee][Xx]\s+([\w-]+)\s*=", 1))).filter("name <> ''").withColumn("node", F.col("line"))
    spark = facts.spark
    near = _near(rows.select("doc_id", "node", "name"), spark.createDataFrame([(k,) for k in known], "name string")).select("doc_id", "node", "known")
    return at(rows.filter(~F.col("name").isin(known)).join(near, ["doc_id", "node"]), "unknown key $name; did you mean $known?")


def _tagging(condition: str, message: str):
    """Of documents with tagging on: what their last settings lack."""

    def run(facts: Facts, config: dict) -> DataFrame:
        last = facts["settings"].groupBy("doc_id", "key").agg(F.max_by("value", "node").alias("value"))
        has = last.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("has"))
        return at(setting(facts, "tagging").filter("value = 'on'").join(has, "doc_id").filter(condition), message)

    return run


def _tagging_packages(facts: Facts, config: dict) -> DataFrame:
    on = setting(facts, "tagging").filter("value = 'on'").select("doc_id")
    bad = facts["packages"].filter("NOT tagged").select("name")
    return at(facts["loads"].join(bad, "name", "left_semi").join(on, "doc_id", "left_semi"), "$name does not work with tagging")


def _missing_end(facts: Facts, config: dict) -> DataFrame:
    rows = diagnosed("missing.?end")(facts, config)
    has = facts["lines"].groupBy("doc_id").agg(F.max(F.col("text").contains("\\begin{document}")).alias("b"), F.max(F.col("text").contains("\\end{document}")).alias("e"), F.max("line").alias("line"))
    return rows.unionByName(at(has.filter("b AND NOT e").withColumn("file", F.lit("document")), "the document does not end"))


def _library_errors(facts: Facts, config: dict) -> DataFrame:
    rows = facts["diagnostics"].filter("severity = 'error' AND origin = 'library'")
    first = rows.groupBy("doc_id", "code").agg(F.sum(F.coalesce("count", F.lit(1))).alias("n"), F.min_by(F.struct("message", "file", "line", "col"), F.struct("line", "col")).alias("p"))
    return at(first.select("doc_id", "n", "p.*"), "$message ($n times)")


def _raised(facts: Facts, config: dict) -> DataFrame:
    return at(facts["diagnostics"].filter("code = 'raised'"), "$message")


def _languages(facts: Facts, config: dict) -> DataFrame:
    known = config.get("code-languages", ["python", "c", "java", "r", "bash", "tex", "html", "sql", "rust", "haskell"])
    return at(occurrences(facts, "code-language").filter(~F.lower("key").isin(known)), "unknown language $key")


def _duplicate_loads(facts: Facts, config: dict) -> DataFrame:
    return repeated("occurrences", ["key"], "$key is loaded again, first at $first", "kind = 'bib-file'")(facts, config)


def _delimiters(facts: Facts, config: dict) -> DataFrame:
    return pattern(r"\\(left|right|[bB]ig+[lrm]?)\s*[A-Za-z0-9]", "$found is followed by no delimiter")(facts, config)


register("C001", "already-defined", "error", _already, "defs", "diagnostics")
register("C002", "bibtex-command-under-biblatex", "error", lambda f, c: at(f["expansions"].filter("name IN ('bibliography', 'bibliographystyle', 'nocitebibtex')").join(f["loads"].filter("name = 'biblatex'").select("doc_id").distinct(), "doc_id", "left_semi"), "$name belongs to another bibliography system"), "expansions", "loads")
register("C007", "caused-library-error", "error", _library_errors, "diagnostics")
register("C008", "math-still-open", "error", diagnosed("math.?(still.?)?open", "math is still open"), "diagnostics")
register("C009", "missing-graphic", "error", lambda f, c: at(occurrences(f, "graphic").join(f["found_files"].select("doc_id", F.col("path").alias("key")), ["doc_id", "key"], "left_anti"), "no file $key"), "occurrences", "found_files")
register("C010", "new-redefines", "error", _new_redefines, "defs")
register("C011", "not-defined", "error", undefined(("renew",), ("definition",), "$key is renewed but not defined"), "occurrences")
register("C012", "option-clash", "error", _option_clash, "loads")
register("C013", "raised-error", "error", _raised, "diagnostics")
register("C014", "undefined-color", "error", lambda f, c: at(f["color_uses"].join(f["colors"].select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti"), "no colour $name"), "color_uses", "colors")
register("C015", "undefined-control-sequence", "error", _undefined_commands, "expansions", "defs")
register("C016", "undefined-environment", "error", undefined(("environment-begin",), ("environment",), "no environment $key"), "occurrences")
register("C017", "undefined-glossary-entry", "error", undefined(("gls",), ("glossary-entry",), "no entry $key"), "occurrences")
register("C018", "unguarded-recursion", "error", _recursion, "diagnostics")
register("C020", "catcode-escapes-group", "warning", _catcodes, "settings", "occurrences")
register("C021", "conflicting-color-definition", "warning", lambda f, c: at(f["colors"].join(f["colors"].groupBy("doc_id", "name").agg(F.count_distinct("value").alias("n"), F.min("node").alias("first")), ["doc_id", "name"]).filter("n > 1 AND node > first"), "$name has several values"), "colors")
register("C022", "delimiter-not-followed", "warning", _delimiters, "lines")
register("C023", "duplicate-bibliography-entry", "warning", repeated("occurrences", ["key"], "$key is listed again, first at $first", "kind = 'bibitem'"), "occurrences")
register("C024", "duplicate-label", "warning", repeated("occurrences", ["key"], "$key is a label again, first at $first", "kind = 'label'"), "occurrences")
register("C025", "environment-mismatch", "error", _nesting("environment", message="environment"), "occurrences")
register("C026", "expl-syntax-left-on", "warning", lambda f, c: at(setting(f, "expl-syntax").filter("value = 'on'"), "expl syntax is still on at the end"), "settings")
register("C027", "expl3-constant-set", "warning", where("vars", "name RLIKE '^c_' AND action = 'set'", "constant $name is set"), "vars")
register("C028", "expl3-signature-mismatch", "warning", where("defs", "name RLIKE ':' AND arity IS NOT NULL AND length(regexp_extract(name, ':([A-Za-z]*)$', 1)) <> arity", "$name takes $arity arguments"), "defs")
register("C029", "ignored-verbatim-tail", "warning", pattern(r"\\end\{(verbatim|lstlisting|comment)\}\s*[^\s%].*$", "what follows on the line is ignored"), "lines")
register("C030", "math-script-braces", "warning", pattern(r"\$[^$]*[_^][A-Za-z0-9]{2,}[^$]*\$", "only the first character is raised or lowered"), "lines")
register("C031", "missing-dependency", "warning", lambda f, c: at(f["loads"].filter("required IS NOT NULL").join(f["loads"].select("doc_id", F.col("name").alias("required")).distinct(), ["doc_id", "required"], "left_anti"), "$name needs $required"), "loads")
register("C032", "unbalanced-brackets", "warning", _brackets, "lines")
register("C033", "unbalanced-color-stack", "warning", _color_stack, "stack_ops")
register("C034", "unbalanced-pdf-content", "warning", _nesting("pdf", message="PDF operator"), "occurrences")
register("C035", "undefined-citation", "warning", lambda f, c: at(occurrences(f, "cite").join(occurrences(f, "bibitem").select("doc_id", "key").unionByName(f["bib_entries"].select("doc_id", "key")).distinct(), ["doc_id", "key"], "left_anti"), "no entry $key"), "occurrences", "bib_entries")
register("C036", "undefined-optional-content", "warning", undefined(("layer-use",), ("layer",), "no layer $key"), "occurrences")
register("C037", "undefined-reference", "warning", undefined(("ref",), ("label",), "no label $key"), "occurrences")
register("C038", "uninstalled-package", "warning", lambda f, c: at(f["loads"].join(f["packages"].filter("NOT installed").select("name"), "name", "left_semi"), "$name is not installed"), "loads", "packages")
register("C039", "unresolved-file", "warning", where("loads", "status = 'absent' AND kind <> 'package'", "no file $name"), "loads")
register("C040", "expected-load", "info", diagnosed("expected.?load"), "diagnostics")
register("C041", "math-mode-mismatch", "info", _mode, "expansions")
register("C042", "unintended-escape", "info", pattern(r"[A-Za-z]\\(?:[ntr]\b|textbackslash [ntr]\b)", "$found may be meant as a line break or tab"), "lines")
register("C043", "assertion-refuted", "error", where("assertions", "NOT holds AND NOT coalesce(assumed, false)", "does not hold: $text"), "assertions")
register("C044", "assertion-proved", "hint", where("assertions", "holds AND NOT coalesce(assumed, false)", "holds: $text"), "assertions")
register("C045", "assumption-made", "info", where("assertions", "assumed", "assumed: $text"), "assertions")
register("C046", "invalid-directive", "error", pattern(r"%\s*lint-(?!(?:ignore-file|ignore|off|on|assert|assume)\b)\w*", "unknown directive $found"), "lines")
register("C047", "missing-end", "error", _missing_end, "diagnostics", "lines")
register("C048", "undefined-cref-format", "warning", lambda f, c: at(occurrences(f, "cref").join(occurrences(f, "label").select("doc_id", "key", F.col("target").alias("is")), ["doc_id", "key"]).join(occurrences(f, "cref-format").select("doc_id", F.col("key").alias("is")).distinct(), ["doc_id", "is"], "left_anti"), "no format for $is"), "occurrences")
register("C049", "unknown-code-language", "warning", _languages, "occurrences")
register("C050", "duplicate-bibliography-load", "warning", _duplicate_loads, "occurrences")
register("C051", "duplicate-bibliography-work", "warning", _duplicate_work, "bib_entries")
register("C052", "bibliography-entry-missing-field", "warning", _missing_field, "bib_entries")
register("C053", "undefined-bibliography-string", "warning", undefined(("bib-string-use",), ("bib-string",), "no string $key"), "occurrences")
register("C054", "reference-name-mismatch", "warning", _reference_name, "occurrences")
register("C055", "metadata-after-class", "error", _boundary(("metadata",), "metadata come after the class"), "occurrences", "loads")
register("C056", "tagging-incompatible-package", "warning", _tagging_packages, "loads", "packages", "settings")
register("C057", "graphic-without-alt", "warning", lambda f, c: at(occurrences(f, "graphic").filter("detail IS NULL OR NOT detail RLIKE '(^|,)\\\\s*(alt|artifact|actualtext)\\\\b'"), "$key has no alternative text"), "occurrences")
register("C058", "pdfua-without-title", "warning", _tagging("element_at(has, 'standard') LIKE '%ua%' AND element_at(has, 'title') IS NULL", "no title"), "settings")
register("C059", "tagging-without-language", "warning", _tagging("element_at(has, 'language') IS NULL", "no language"), "settings")
register("C060", "tagging-unsupported-engine", "warning", _tagging("element_at(has, 'engine') NOT IN ('lualatex', 'pdflatex')", "the engine can't tag"), "settings")
register("C061", "package-load-order", "warning", _load_order, "loads", "packages")
register("C062", "unknown-package-name", "warning", _misspelled_packages, "loads", "packages")
register("C063", "misspelled-magic-comment", "warning", _magic, "lines")
register("C064", "package-call-error", "warning", diagnosed("package.?call"), "diagnostics")
register("C065", "missing-bibliography", "warning", lambda f, c: at(occurrences(f, "cite").groupBy("doc_id").agg(F.min_by(F.struct("file", "line", "col"), "node").alias("p")).select("doc_id", "p.*").join(occurrences(f, "bibliography", "bibitem").select("doc_id").distinct(), "doc_id", "left_anti"), "citations without a bibliography"), "occurrences")
