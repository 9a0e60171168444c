import random

from pyspark.sql import functions as F

from siftwork.operators import layout
from siftwork.rules import lint
from siftwork.rules.registry import reconcile
from siftwork.sources import projects as P
from siftwork.sources.facts import Facts, documents, lines


def test_scan():
    t = P.scan("\\ab c{1}  d % no\n\n  x\\%")
    assert [(k, x) for k, x, *_ in t] == [("command", "ab"), ("character", "c"), ("character", "{"), ("character", "1"), ("character", "}"), ("character", " "), ("character", "d"), ("character", " "), ("command", "par"), ("character", "x"), ("command", "%"), ("character", " ")]
    assert [c for *_, c, _, _ in P.scan("a@b", {"@": 11})][:3] == [11, 11, 11]
    assert P.scan("a\\")[1][0] == "command"


def test_tokens_and_depth(spark):
    df = spark.createDataFrame([(1, "}{a{b}}"), (2, None)], "doc_id long, text string")
    rows = P.nesting(P.tokens(df)).filter("doc_id = 1").orderBy("idx").collect()
    assert [r["depth"] for r in rows][:7] == [0, 1, 1, 2, 2, 1, 0] and rows[0]["surplus"]
    t = P.tokens(spark.createDataFrame([(1, "\\foo \\food \\foo")], "doc_id long, text string"))
    assert [(r["line"], r["col"], r["replacement"]) for r in P.rename(t, "foo", "bar").orderBy("col").collect()] == [(1, 1, "\\bar"), (1, 12, "\\bar")]


def test_resolve(spark):
    loads = spark.createDataFrame([(1, "Geo", "package"), (1, "fig", "graphic"), (1, "none", "include"), (1, "a.tex", "include")], "doc_id long, name string, kind string")
    files = spark.createDataFrame([("/x/geo.sty",), ("/x/fig.png",), ("/x/fig.pdf",), ("/x/a.tex",), ("/x/A.tex",)], "path string")
    got = {r["name"]: (r["path"], r["other_case"]) for r in P.resolve(loads, files).collect()}
    assert got == {"Geo": ("/x/geo.sty", True), "fig": ("/x/fig.pdf", False), "none": (None, None), "a.tex": ("/x/a.tex", False)}


def test_settings_and_literate(spark):
    df = spark.createDataFrame([(1, "# c\n$pdf_mode = 1;\nengine: 'xelatex'\nmodule = \"m\"")], "doc_id long, text string")
    assert [(r["key"], r["value"]) for r in P.settings(lines(df)).orderBy("node").collect()] == [("pdf_mode", "1"), ("engine", "xelatex"), ("module", "m")]
    text = "% doc\n%<*a>\ncode\n%<b>inner\n%<!b>other\n%</a>\n%<*c>\nhidden\n%</c>\n%% kept"
    assert P.unpack(text, {"a"}) == "code\nother\n%% kept" and P.unpack(text, {"a", "b"}) == "code\ninner\n%% kept"
    assert P.literate(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["c"]).first()["text"] == "hidden\n%% kept"


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.tex").write_bytes(b"\\documentclass{x}\nbad \xff")
    (tmp_path / "b.tex").write_text("% \\documentclass{x}")
    docs = documents(spark, str(tmp_path))
    assert docs.count() == 2 and "\ufffd" in docs.filter("path LIKE '%a.tex'").first()["text"] and docs.agg(F.sum("replaced")).first()[0] == 1
    numbered = docs.withColumn("doc_id", F.when(F.col("path").endswith("a.tex"), 1).otherwise(2))
    assert [r["doc_id"] for r in P.roots(lines(numbered)).collect()] == [1]
    assert {r["name"] for r in P.discover(spark, str(tmp_path), "*.tex").collect()} == {"a.tex", "b.tex"}


def test_reconcile(spark):
    one = Facts(spark, lines=lines(spark.createDataFrame([(1, "a  b\nc  d")], "doc_id long, text string")))
    two = Facts(spark, lines=lines(spark.createDataFrame([(1, "a  b\nc d\ne  f")], "doc_id long, text string")))
    got = {(r["line"], r["state"]) for r in reconcile(lint(one, ["S004"]), lint(two, ["S004"])).collect()}
    assert got == {(1, "confirmed"), (2, "retracted"), (3, "new")}


def test_hyphenation():
    known = layout.patterns(["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"])
    assert [w for w in (layout.hyphenate("hyphenation", known),)] == [[2, 6]]


def test_lines():
    rng = random.Random(1)
    words = ["x" * rng.randrange(1, 9) for _ in range(200)]
    starts = layout.break_lines([float(len(w)) for w in words], 1.0, 40.0)
    rows = [words[a:z] for a, z in zip(starts, [*starts[1:], len(words)])]
    assert sum(rows, []) == words and all(sum(map(len, r)) + (len(r) - 1) * 0.67 <= 40 for r in rows)
    assert len(rows) < 40


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, 1, "aa bb cc dd"), (1, 2, None)], "doc_id long, paragraph long, text string")
    assert [r["text"] for r in layout.paragraphs(df, 5).orderBy("line").collect()] == ["aa bb", "cc dd"]
