import pytest
from pyspark.sql import functions as F

from siftwork import sinks
from siftwork.operators import views
from siftwork.rules import RULES, lint
from siftwork.rules.registry import ordered, shown_per_rule
from siftwork.sources import bibliography, config
from siftwork.sources.facts import SCHEMAS, Facts, lines
from siftwork.streaming import incremental, latest, watch


def facts(spark, **tables):
    out = {}
    for name, (cols, rows) in tables.items():
        kinds = {p.strip().split(" ")[0]: p.strip().split(" ", 1)[1] for p in SCHEMAS[name].split(", ")}
        out[name] = spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in cols.split()))
    return Facts(spark, **out)


def text(spark, *rows):
    return Facts(spark, lines=lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))


def test_there_are_all_rules():
    count = {c: sum(r.number[0] == c for r in RULES.values()) for c in "ACPSX"}
    assert len(RULES) == 144 and count == {"A": 3, "C": 65, "P": 6, "S": 68, "X": 2}


def test_every_rule_runs_on_empty_facts(spark):
    for group in ("A", "X", "P"):
        assert lint(Facts(spark), [n for n in RULES if n[0] == group]).count() == 0


@pytest.mark.parametrize("letter,part", [("C", 0), ("C", 1), ("C", 2), ("S", 0), ("S", 1), ("S", 2)])
def test_plans_of_all_rules(spark, letter, part):
    for n in [n for n in sorted(RULES) if n[0] == letter and n != "S053"][part::3]:
        assert RULES[n].findings(Facts(spark)).columns[:3] == ["doc_id", "number", "code"]


@pytest.mark.parametrize(
    "code,bad,good",
    [
        ("double-space", "a  b", "a b"), ("ellipsis-dots", "wait... no", "wait."), ("et-al", "Doe et al said", "Doe et al. said"), ("wrong-dash", "pages 3-5", "pages 3--5"), ("space-before-punctuation", "so , it", "so, it"), ("doubled-punctuation", "so,, it", "so, it"),
        ("sentence-capital", "the end. then it", "the end. Then it"), ("comment-marker", "% TODO x", "% done"), ("math-shift-dollars", "$$x$$", "$x$"), ("dimension-times", "3x4", "3 by 4"), ("unbalanced-brackets", "(a", "(a)"), ("missing-nonbreaking-space", r"see \ref{a}", r"see~\ref{a}"),
        ("ignored-verbatim-tail", r"\end{verbatim} x", r"\end{verbatim}"), ("math-script-braces", "$x_ab$", "$x_{ab}$"), ("misspelled-magic-comment", "% !TeX rot = a", "% !TeX root = a"), ("quote-direction", "''word", "``word''"), ("unknown-suppress-code", "% lint-ignore nothing-here", "% lint-ignore et-al"),
        ("wrong-quote-character", 'a "word" b', "a ``word'' b"), ("accent-on-dotted-letter", r"\'i", r"\'e"), ("invalid-directive", "% lint-what", "% lint-ignore"), ("math-operator-name", "$sin x$", r"$\sin x$"), ("hand-set-quantity", "5 km", "five km"),
    ],
)
def test_text_rules(spark, code, bad, good):
    got = {r["doc_id"] for r in lint(text(spark, bad, good, None, ""), [code]).collect()}
    assert got == {0}


def test_brackets_clamp(spark):
    rows = lint(text(spark, "a) (b) c)\n(d"), ["C032"]).collect()
    assert {(r["line"], r["col"]) for r in rows} == {(1, 2), (1, 9), (2, 1)}


def test_suppressions(spark):
    t = "a  b % lint-ignore double-space\na  b\n% lint-ignore S004\na  b\n% lint-off\na  b\n% lint-on\na  b"
    assert [r["line"] for r in ordered(lint(text(spark, t), ["S004"])).collect()] == [2, 8]
    assert lint(text(spark, "% lint-ignore-file\na  b"), ["S004"]).count() == 0
    assert lint(text(spark, "a  b"), off=["S004"], only=["S004", "S005"]).count() == 0


OCC = "doc_id node kind key file line col"


def test_keys(spark):
    f = facts(spark, occurrences=(OCC, [(1, 1, "label", "a", "f", 1, 1), (1, 2, "label", "a", "f", 2, 1), (1, 3, "ref", "b", "f", 3, 1), (1, 4, "ref", "a", "f", 4, 1), (1, 5, "label", "c", "f", 5, 1), (2, 1, "ref", "a", "g", 1, 1)]))
    got = {(r["code"], r["doc_id"], r["line"]) for r in lint(f, ["duplicate-label", "undefined-reference", "unused-label"]).collect()}
    assert got == {("duplicate-label", 1, 2), ("undefined-reference", 1, 3), ("undefined-reference", 2, 1), ("unused-label", 1, 5)}


def test_environments(spark):
    f = facts(spark, occurrences=(OCC, [(1, i, f"environment-{e}", k, "f", i, 1) for i, (e, k) in enumerate([("begin", "a"), ("begin", "b"), ("end", "a"), ("end", "c")])]))
    assert {r["line"] for r in lint(f, ["C025"]).collect()} == {1, 3}


def test_definitions(spark):
    d = "doc_id node name by depth origin file line col"
    f = facts(spark, defs=(d, [(1, 1, "a", "def", 0, "document", "f", 1, 1), (1, 3, "a", "def", 0, "document", "f", 2, 1), (1, 5, "b", "def", 2, "document", "f", 3, 1)]), expansions=("doc_id node name meaning file line col", [(1, 4, "a", "macro", "f", 5, 1), (1, 6, "aa", "undefined", "f", 6, 1)]), calls=("doc_id name callee", [(1, "a", "b"), (1, "b", "a"), (1, "c", "c")]))
    got = {(r["code"], r["line"]) for r in lint(f, ["dead-definition", "group-local-definition", "undefined-control-sequence", "recursive-macro"]).collect()}
    assert got == {("dead-definition", 1), ("group-local-definition", 3), ("undefined-control-sequence", 6), ("recursive-macro", 2), ("recursive-macro", 3)}
    assert {(r["name"], r["kind"], tuple(r["cycle"])) for r in views.query(f, "recursion").collect()} == {("a", "mutual", ("a", "b")), ("b", "mutual", ("a", "b"))}
    assert views.explain(f, "a").first()["node"] == 3 and views.explain(f, "a", 3).first()["node"] == 1


def test_colours_and_stacks(spark):
    f = facts(spark, colors=("doc_id node name value file line col", [(1, 1, "a", "FFFF00", "f", 1, 1), (1, 2, "b", "FFFF00", "f", 2, 1), (1, 3, "a", "000000", "f", 3, 1)]), color_uses=("doc_id node name file line col", [(1, 4, "b", "f", 4, 1), (1, 5, "z", "f", 5, 1)]), stack_ops=("doc_id seq stack op file line col", [(1, 1, 0, "pop", "f", 1, 1), (1, 2, 0, "push", "f", 2, 1), (1, 3, None, "push", "f", 3, 1)]))
    got = {(r["code"], r["line"]) for r in lint(f, ["C014", "C021", "C033", "S030", "S048", "S067"]).collect()}
    assert got == {("undefined-color", 5), ("conflicting-color-definition", 3), ("unbalanced-color-stack", 1), ("unbalanced-color-stack", 2), ("duplicate-color-value", 2), ("unused-color", 1), ("unused-color", 3), ("low-contrast-color", 4)}


def test_raised_errors_that_others_explain(spark):
    f = facts(spark, diagnostics=("doc_id severity code message file line col", [(1, "error", "raised", "no", "f", 1, 1), (1, "error", "raised", "no", "f", 2, 1)]), occurrences=(OCC, []), loads=("doc_id node name kind status file line col", [(1, 1, "x", "include", "absent", "f", 1, 1)]))
    assert {(r["code"], r["line"]) for r in lint(f, ["C013", "C039"]).collect()} == {("raised-error", 1), ("raised-error", 2), ("unresolved-file", 1)} - {("raised-error", 1) if RULES["C039"].severity == "error" else None}


def test_views(spark):
    f = facts(spark, diagnostics=("doc_id severity code message count file line col", [(1, "approximation", "x", "first", 2, "f", 1, 1), (2, "approximation", "x", "later", 3, "f", 1, 1), (1, "error", "y", "no", 1, "f", 2, 1)]), loads=("doc_id node name status path file line col", [(1, 1, "a", "read", "a.tex", "f", 1, 1), (1, 2, "b", "absent", None, "f", 2, 1)]), found_files=("doc_id path", [(1, "a.tex"), (1, "c.tex")]), settings=("doc_id node key value", [(1, 1, "initial-catcode:64", "12"), (1, 2, "catcode:64", "11")]))
    assert [tuple(r)[:3] for r in views.query(f, "gaps").collect()] == [("x", 5, "first")]
    assert {(r["path"], r["state"]) for r in views.query(f, "files").collect()} == {("a.tex", "read"), ("b", "absent"), ("c.tex", "found")}
    assert [tuple(r) for r in views.query(f, "catcodes", 'key ~= "64"').collect()] == [(1, "catcode:64", "11", "12")]
    out = views.batch(f, [{"query": "gaps"}, {"query": "nothing"}, {"query": "files", "filter": "zzz = 1"}])
    assert "rows" in out[0] and "error" in out[1] and "error" in out[2]
    assert len(views.VIEWS) >= 24
    for name in views.VIEWS:
        assert views.query(f, name).columns


def test_slices(spark):
    place = "doc_id node tag name file line"
    f = facts(spark, vertices=(place, [(1, i, "t", f"n{i}", "f", i) for i in range(1, 5)]), edges=("doc_id src dst kind", [(1, 3, 2, 1), (1, 2, 1, 2), (2, 3, 4, 1)]), occurrences=(OCC, [(1, 3, "ref", "k", "f", 3, 1)]), lines=("doc_id file line text", [(1, "f", i, f"line {i}") for i in range(1, 5)]))
    nodes = views.slice_where(f, "kind = ref")
    assert {(r["doc_id"], r["node"]) for r in nodes.collect()} == {(1, 1), (1, 2), (1, 3)}
    assert {r["node"] for r in views.slice_where(f, "kind = ref", mask=1).collect()} == {2, 3}
    assert {r["line"] for r in views.sliced_text(f, nodes).collect()} == {1, 2, 3}


def test_sinks(spark):
    df = spark.createDataFrame([(1, 'a,"b', ["x", "y"], None), (2, None, [], None)], "doc_id long, name string, arr array<string>, nothing string")
    assert [r["value"] for r in sinks.csv_lines(df).collect()] == ["doc_id,name,arr", '1,"a,""b","x, y"', "2,,"]
    assert sinks.json_lines(df).first()["value"] == '{"arr":["x","y"],"doc_id":1,"name":"a,\\"b"}'
    assert sinks.markdown(df).splitlines()[1] == "|---|---|---|---|" and sinks.aligned(df).splitlines()[0].startswith("doc_id")
    found = lint(text(spark, "a  b,, c"), ["S004", "S060"])
    assert all(r["value"].startswith("::warning file=document,line=1") for r in sinks.github(found).collect())
    assert '"ruleId":"double-space"' in sinks.sarif(found) and sinks.log(found).count() == 2 and sinks.lsp(found).count() == 2 and sinks.statistics(found).count() == 2
    assert shown_per_rule(found, 1).count() == 2
    with pytest.raises(ValueError, match="there are json"):
        sinks.render(df, "what")


BIB = '@string{j = "Some Journal"}\n@comment{x}\n@article{k1,\n title = {The {Big} Book}, year = 1999, journal = j # { II}, doi="10.1/X", author={Doe, Jane and von Ham, Al}}\n@book{k2, title={The Big Book}, year={1999}}'
RIS = "TY  - JOUR\nTI  - The Big Book\nAU  - Doe, Jane\nAU  - von Ham, Al\nPY  - 1999\nDO  - 10.1/X\nER  - \n"
ENW = "%0 Journal Article\n%T The Big Book\n%A Doe, Jane\n%D 1999\n%R 10.1/X\n"
CSL = '[{"id": "k1", "type": "article-journal", "title": "The Big Book", "DOI": "10.1/X", "issued": {"date-parts": [[1999]]}, "author": [{"family": "Doe", "given": "Jane"}]}]'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/k1</id><title>The Big\n Book</title><published>1999-01-01</published><author><name>Jane Doe</name></author></entry></feed>'


def test_bibliographies(spark):
    docs = spark.createDataFrame(list(enumerate([BIB, RIS, ENW, CSL, ATOM, None, "", "[broken"])), "doc_id long, text string")
    rows = bibliography.entries(docs).collect()
    assert {(r["doc_id"], r["year"]) for r in rows} == {(i, "1999") for i in range(5)} and len(rows) == 6
    by = {r["doc_id"]: r for r in rows if r["node"] == 0}
    assert by[0]["title"] == "The {Big} Book" and all(by[i]["title"] == "The Big Book" for i in range(1, 5)) and {by[i]["kind"] for i in range(4)} == {"article"}
    assert bibliography.names("Doe, Jane and von Ham, Jr, Al and Max von Au")[1:] == [{"first": "Al", "von": "von", "last": "Ham", "jr": "Jr"}, {"first": "Max", "von": "von", "last": "Au", "jr": ""}]
    f = Facts(spark, bib_entries=bibliography.entries(docs))
    assert {(r["doc_id"], r["line"]) for r in lint(f, ["C051"]).collect()} == {(0, 5)}


def test_config():
    assert config.layered({"a": {"b": 1}, "l": [1]}, {"a": {"c": 2}, "l+": [2]}, config.assigned("a.b=3")) == {"a": {"b": 3, "c": 2}, "l": [1, 2]}


def test_incremental_equals_full(spark, tmp_path):
    work = lambda d: d.select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    one = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "x")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b"), (2, "d e"), (4, "")], "doc_id long, text string")
    _, state = incremental(one, work, None)
    rows, _ = incremental(two, work, state)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, work(two).collect()))
    one.write.parquet(str(tmp_path / "in"), mode="append")
    args = (spark, str(tmp_path / "in"), "doc_id long, text string", work, str(tmp_path / "out"), str(tmp_path / "state"))
    watch(*args).awaitTermination()
    two.write.parquet(str(tmp_path / "in"), mode="append")
    watch(*args).awaitTermination()
    assert sorted(map(tuple, latest(spark, str(tmp_path / "out")).select("doc_id", "w").collect())) == sorted([(1, "a"), (1, "b"), (2, "d"), (2, "e"), (3, "x"), (4, "")])


def test_sarif_has_all_findings(spark):
    """More findings than fit a run go on in further runs, in order."""
    import json

    found = lint(text(spark, "\n".join(["a  b"] * 5)), ["S004"])
    runs = json.loads(sinks.sarif(found, most=2))["runs"]
    line = lambda x: x["locations"][0]["physicalLocation"]["region"]["startLine"]
    assert [[line(x) for x in r["results"]] for r in runs] == [[1, 2], [3, 4], [5]]
    assert json.loads(sinks.sarif(found.limit(0)))["runs"][0]["results"] == []
    assert len(json.loads(sinks.sarif(found))["runs"]) == 1


def test_statistics_count_every_rule_on_lines(spark, small):
    """The clone rule reads lines alone too."""
    from siftwork.queries import lint_statistics

    found = {r["code"]: r["findings"] for r in lint_statistics(spark, small).collect()}
    assert found["clones"] > 0
