"""The filter language: `field op word` tests joined by and, or, not and parentheses, compiled to one Column.

Tests look at the text that a value shows: a string as it is, null as nothing,
anything else as its JSON. A field that a row lacks makes every test false,
`!=` and `!~` included, so `not` of a test on it is true. A present null is not
a missing field: `a = ""` finds it. Ragged rows carry the names they hold in an
array column named PRESENT; without that column every field is present.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRESENT = "_present"
OPERATORS = ("!=", "!~", "~=", "<=", ">=", "=", "~", "<", ">")


class FilterError(ValueError):
    """The text is not a filter, or it names a field that no row has."""


@dataclass(frozen=True)
class Test:
    field: str
    op: str
    word: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Always:
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) with kind word, op, and, or, not, ( or ). A quote may stay open; quoted keywords are still keywords."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
            continue
        if c in "()":
            out.append((c, c))
            i += 1
            continue
        pair = text[i : i + 2]
        if pair in ("&&", "||"):
            out.append(("and" if pair == "&&" else "or", pair))
            i += 2
            continue
        op = next((o for o in OPERATORS if text.startswith(o, i)), None)
        if op:
            out.append(("op", op))
            i += len(op)
            continue
        if c == "!":
            out.append(("not", c))
            i += 1
            continue
        if c in "'\"":
            end = text.find(c, i + 1)
            word, i = (text[i + 1 :], len(text)) if end < 0 else (text[i + 1 : end], end + 1)
        else:
            end = i
            while end < len(text) and not text[end].isspace() and text[end] not in "()=<>!~&|'\"":
                end += 1
            if end == i:
                raise FilterError(f"unexpected {c!r} at {i}")
            word, i = text[i:end], end
        out.append((word.lower(), word) if word.lower() in ("and", "or", "not") else ("word", word))
    return out


class _Parser:
    def __init__(self, text: str):
        self.rest = tokens(text)
        self.at = 0

    def peek(self) -> str | None:
        return self.rest[self.at][0] if self.at < len(self.rest) else None

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            found = repr(self.rest[self.at][1]) if self.at < len(self.rest) else "the end"
            raise FilterError(f"expected {kind}, found {found}")
        self.at += 1
        return self.rest[self.at - 1][1]

    def either(self):
        out = self.both()
        while self.peek() == "or":
            self.at += 1
            out = Or(out, self.both())
        return out

    def both(self):
        out = self.one()
        while self.peek() == "and":
            self.at += 1
            out = And(out, self.one())
        return out

    def one(self):
        if self.peek() == "not":
            self.at += 1
            return Not(self.one())
        if self.peek() == "(":
            self.at += 1
            out = self.either()
            self.take(")")
            return out
        field, op, word = self.take("word"), self.take("op"), self.take("word")
        if op in ("~", "!~"):
            check_pattern(word)
        return Test(field, op, word)


def check_pattern(pattern: str) -> None:
    """Patterns keep to what linear-time engines share: no look-around, no back-references."""
    if re.search(r"\(\?(?:[=!]|<[=!]|>)|(?<!\\)(?:\\\\)*\\[1-9]|[*+?}]\+", pattern):
        raise FilterError(f"look-around, back-references and possessive repeats are not supported: {pattern}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise FilterError(f"bad pattern {pattern!r}: {e}") from e


def parse(text: str | None):
    """The tree of a filter; nothing or blanks pass every row."""
    if text is None or not text.strip():
        return Always()
    p = _Parser(text)
    out = p.either()
    if p.at < len(p.rest):
        raise FilterError(f"unexpected {p.rest[p.at][1]!r}")
    return out


def fields(tree) -> list[str]:
    """The names that a filter tests, in order."""
    if isinstance(tree, Test):
        return [tree.field]
    if isinstance(tree, Not):
        return fields(tree.of)
    if isinstance(tree, (And, Or)):
        return list(dict.fromkeys(fields(tree.left) + fields(tree.right)))
    return []


def shown(col: Column, kind: T.DataType) -> Column:
    """The text of a value that string tests look at."""
    if isinstance(kind, T.StringType):
        text = col
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def _number(word: str) -> float | None:
    try:
        return float(word)
    except ValueError:
        return None


def to_column(tree, schema: T.StructType) -> Column:
    """The Boolean column of a tree: never null."""
    if isinstance(tree, Always):
        return F.lit(True)
    if isinstance(tree, Not):
        return ~to_column(tree.of, schema)
    if isinstance(tree, And):
        return to_column(tree.left, schema) & to_column(tree.right, schema)
    if isinstance(tree, Or):
        return to_column(tree.left, schema) | to_column(tree.right, schema)
    if tree.field not in schema.names:
        return F.lit(False)
    col, kind = F.col(f"`{tree.field}`"), schema[tree.field].dataType
    if tree.op in ("<", "<=", ">", ">="):
        bound = _number(tree.word)
        if bound is None or not isinstance(kind, T.NumericType):
            return F.lit(False)
        value, low = col.cast("double"), F.lit(bound)
        test = {"<": value < low, "<=": value <= low, ">": value > low, ">=": value >= low}[tree.op]
    else:
        text, word = shown(col, kind), F.lit(tree.word)
        test = {"=": lambda: text == word, "!=": lambda: text != word, "~=": lambda: F.contains(text, word), "~": lambda: text.rlike(tree.word), "!~": lambda: ~text.rlike(tree.word)}[tree.op]()
    test = F.coalesce(test, F.lit(False))
    return test & F.array_contains(PRESENT, tree.field) if PRESENT in schema.names else test


def apply_filter(df: DataFrame, text: str | None, strict: bool = True) -> DataFrame:
    """The rows that pass. With `strict` a field that the schema lacks is an error that lists the fields there are."""
    tree = parse(text)
    if strict and (unknown := [f for f in fields(tree) if f not in df.columns]):
        raise FilterError(f"no row has {', '.join(unknown)}; there are {', '.join(c for c in df.columns if c != PRESENT)}")
    return df.filter(to_column(tree, df.schema))
