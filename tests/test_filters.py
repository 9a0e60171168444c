import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import filters as L


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "x", 1.5, True, ["a", "b"], ["id", "a", "n", "flag", "arr"]), (2, None, None, None, None, ["id", "a", "n"]), (3, "", -2.0, False, [], ["id", "a", "n", "flag", "arr"]), (4, None, 7.0, None, None, ["id", "n"])]
    return spark.createDataFrame(data, "id int, a string, n double, flag boolean, arr array<string>, _present array<string>")


def ids(df, text, **k):
    return sorted(r["id"] for r in L.apply_filter(df, text, **k).collect())


@pytest.mark.parametrize(
    "text,want",
    [
        ("a = x", [1]), ('a = ""', [2, 3]), ("a != x", [2, 3]), ("not a = x", [2, 3, 4]), ("not a != x", [1, 4]), ("n > 1", [1, 4]), ("n > x", []), ("not n > x", [1, 2, 3, 4]),
        ("a > 1", []), ("flag = true", [1]), ("n = 1.5", [1]), ("a ~= ''", [1, 2, 3]), ("a ~ '^x$' or n < 0", [1, 3]), ("a !~ x and n <= -2", [3]), ("", [1, 2, 3, 4]),
        ("id=1 || id=2 && id=3", [1]), ("(id=1 || id=2) && !id=1", [2]), ("A = x", []), ("id >= 3 AND NOT id = 4", [3]), ("flag = ''", []), ('a = "x', [1]), ('arr = \'["a","b"]\'', [1]),
    ],
)
def test_truth_table(rows, text, want):
    assert ids(rows, text, strict=False) == want


@pytest.mark.parametrize("text", ["a =", "= x", "a = x or", "(a = x", "a = x)", "a x", "a ~ '('", "a ~ '(?=x)'", r"a ~ '(x)\1'", "and = x"])
def test_errors(text):
    with pytest.raises(L.FilterError):
        L.parse(text)


def test_unknown_field_names_the_fields(rows):
    with pytest.raises(L.FilterError, match="there are id, a, n"):
        L.apply_filter(rows, "zzz = 1")


def test_quoted_keyword_is_a_keyword():
    with pytest.raises(L.FilterError):
        L.parse('a = "and"')


def test_fields():
    assert L.fields(L.parse("a = 1 and (b = 2 or not a ~ x)")) == ["a", "b"]


def test_pushes_down(spark, small):
    df = L.apply_filter(spark.read.parquet(f"{small}/orders.parquet"), "o_totalprice > 1000")
    assert "PushedFilters: [" in df._jdf.queryExecution().toString() and "o_totalprice" in df._jdf.queryExecution().toString()


def test_random_trees_against_python(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["p", "q", None]), rng.choice([1.0, 2.0, None])) for i in range(30)]
    df = spark.createDataFrame(data, "id int, s string, v double")

    def make(d):
        if d == 0 or rng.random() < 0.3:
            return rng.choice([("s = p", lambda r: (r[1] or "") == "p"), ("s != q", lambda r: (r[1] or "") != "q"), ("v >= 2", lambda r: r[2] is not None and r[2] >= 2), ("v < 2", lambda r: r[2] is not None and r[2] < 2)])
        k = rng.choice(["and", "or", "not"])
        a = make(d - 1)
        if k == "not":
            return f"not ({a[0]})", lambda r, f=a[1]: not f(r)
        b = make(d - 1)
        return f"({a[0]}) {k} ({b[0]})", (lambda r, f=a[1], g=b[1]: f(r) and g(r)) if k == "and" else (lambda r, f=a[1], g=b[1]: f(r) or g(r))

    cases = [make(3) for _ in range(25)]
    got = df.select("id", *[L.to_column(L.parse(t), df.schema).alias(f"c{i}") for i, (t, _) in enumerate(cases)]).collect()
    for r, src in zip(got, data):
        assert [r[f"c{i}"] for i in range(len(cases))] == [bool(f(src)) for _, f in cases]
    assert df.select(F.lit(1)).count() == 30
