"""Texts read as numbers, lengths, glue and colours; option views and graphs as JSON."""

import json

import pytest
from pyspark.sql import functions as F

from siftwork.functions import intervals, parsing as P
from siftwork.operators import graph, views
from siftwork.sources.facts import Facts


def each(spark, f, *values):
    """f over one column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_integers(spark):
    assert each(spark, P.parse_integer, "12", " --7x", "-+ 3", '"FF', "-'17", "`A", "99999999999", "x", "", None, "`", '"G', "007") == [12, 7, -3, 255, -15, 65, 2**31 - 1, None, None, None, None, None, 7]


def test_dimensions(spark):
    assert each(spark, P.parse_dimension, "0.1pt", "1in", "-2,5 PT", "1cm", ".5bp", "3sp", "1", "pt", "1.2.3pt", "2em", None, "99999pt") == [6554, 4736286, -163840, 1864679, 32890, 3, None, None, None, None, None, 2**30 - 1]


def test_lengths_read_back(spark):
    rows = spark.range(-70000, 70000, 37).select((F.col("id") * 11).alias("n"))
    assert rows.filter(P.parse_dimension(P.render_dimension(F.col("n"))) != F.col("n")).count() == 0
    assert [r[0] for r in spark.createDataFrame([(65536,), (6554,), (-98304,), (0,)], "n long").select(P.render_dimension(F.col("n"))).collect()] == ["1.0pt", "0.1pt", "-1.5pt", "0.0pt"]


def test_glue(spark):
    got = each(spark, P.parse_glue, "1pt plus 2pt minus .5pt", "3sp plus 1.5fill", "2sp minus fil", "1pt plus x", "abc", "4sp minus 1sp plus 2fi")
    flat = [None if g is None else (g.width, tuple(g.stretch), tuple(g.shrink)) for g in got]
    assert flat == [(65536, (131072, 0), (32768, 0)), (3, (98304, 2), (0, 0)), (2, (0, 0), (65536, 1)), None, None, (4, (131072, 1), (1, 0))]


def test_colours(spark):
    rows = [("rgb", "1, .5,0"), ("gray", "0.25"), ("cmyk", "0,0,0,1"), ("HTML", "FF8000"), ("rgb", "1,2"), ("HTML", "FF80"), ("other", "1"), ("RGB", "a,1,2")]
    df = spark.createDataFrame(rows, "m string, s string")
    assert [r[0] for r in df.select(P.parse_colour(F.col("m"), F.col("s"))).collect()] == [[1.0, 0.5, 0.0], [0.25], [0.0, 0.0, 0.0, 1.0], [255.0, 128.0, 0.0], None, None, None, None]
    assert each(spark, lambda x: P.rgb_hex(P.driver_rgb(x)), "rgb 1 0.5 0", "gray [.5]", "cmyk 0 1 1 0", "push", "0 0") == ["#ff8000", "#808080", "#ff0000", None, None]
    assert each(spark, lambda x: P.rgb_hsb(P.driver_rgb(x)), "1 0 0", "0 0.5 0", "0 0 0") == [[0.0, 1.0, 1.0], [pytest.approx(1 / 3), 1.0, 0.5], [0.0, 0.0, 0.0]]


def test_texts(spark):
    assert each(spark, P.comma_split, "a, b ,,c={x,{y,z}},d", "", "{,}") == [["a", "b", "c={x,{y,z}}", "d"], [], ["{,}"]]
    assert each(spark, lambda x: P.character(x.cast("int")), "65", "233", "128512", "-1", "55296") == ["A", "é", "😀", None, None]
    assert each(spark, lambda x: P.change_case(x, {"a": "A", "ß": "ẞ"}), "aß b") == ["Aẞ b"]
    assert each(spark, P.job_name, "/x/y.z/main.doc.tex", "main", ".rc") == ["main.doc", "main", ".rc"]
    assert each(spark, P.control_sequence, "par") == ["\\par"] and each(spark, lambda x: P.meaning(F.lit("#1"), x), "b#1") == ["macro:#1->b#1"]
    assert each(spark, lambda x: P.creation_date(x.cast("timestamp")), "2024-02-03 04:05:06") == ["D:20240203040506Z"]
    assert each(spark, lambda x: P.elapsed(F.lit("2024-01-01 00:00:00").cast("timestamp"), x.cast("timestamp")), "2024-01-01 00:00:01.5", "2025-01-01 00:00:00") == [98304, 2**31 - 1]


def test_expressions(spark):
    got = each(spark, P.evaluate, "1+2*3", "(7-10)/2", "5/2", "-5/2", "2147483647*3/3", "2147483647*3", "1/0", "2 * (3 + 4", "a", "", None, "-(-4)")
    assert [None if g is None else int(g) for g in got] == [7, -2, 3, -3, 2147483647, None, None, None, None, None, None, 4]


def test_uniform(spark):
    df = spark.createDataFrame([(5,), (-3,), (0,), (None,)], "n long")
    assert [tuple(r[0])[:2] for r in df.select(intervals.uniform(F.col("n"))).collect()] == [(0, 4), (-2, 0), (0, 0), (-2147483646, 2147483646)]


def test_option_views(spark):
    defs = [(1, 1, "ifdraft", "newif", None, None, None, "\\iffalse"), (1, 2, "ifbig", "newif", None, None, None, None), (1, 3, "x", "def", None, None, None, "paper=a4, b"), *[(1, 10 + k, f"o{k}", "DeclareOption", "option", f"opt{k}", "kit.sty", "paper = a5" if k == 0 else None) for k in range(10)], (1, 30, "y", "def", None, None, "base", "{paper=letter}")]
    defs = spark.createDataFrame(defs, "doc_id long, node int, name string, by string, tag string, subject string, package string, body string")
    loads = spark.createDataFrame([(1, 1, "kit", "package", ["draft", "a4"], None), (1, 2, "base.sty", "package", None, "kit.sty")], "doc_id long, node int, name string, kind string, options array<string>, by string")
    vertices = spark.createDataFrame([(1, 1, "switch", "ifdraft")], "doc_id long, node int, tag string, name string")
    edges = spark.createDataFrame([(1, 1, 5, 2), (1, 1, 6, 2)], "doc_id long, src int, dst int, kind int")
    f = Facts(spark, defs=defs, loads=loads, vertices=vertices, edges=edges)
    got = {(r["tag"], r["name"]): (r["value"], r["governs"]) for r in views.query(f, "switches").collect()}
    assert got == {("switch", "ifdraft"): ("false", 2), ("switch", "ifbig"): ("undecided", 0), ("option", "kit"): ("draft, a4", None), ("offered", "kit.sty"): ("opt0, opt1, opt2, opt3, opt4, opt5, opt6, opt7, and 2 more", 10)}
    assert {r["value"] for r in views.query(f, "option-values", package="kit", key="paper").collect()} == {"a5", "letter"}


def test_graph_as_json(spark):
    v = spark.createDataFrame([(1, 't"x', None)], "node int, name string, line int")
    e = spark.createDataFrame([(1, 1, 3)], "src int, dst int, kind int")
    assert [json.loads(r["line"]) for r in graph.json_lines(v, e).collect()] == [{"id": 1, "name": 't"x', "line": None}, {"src": 1, "dst": 1, "kind": 3}]
