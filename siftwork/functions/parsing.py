"""Texts read as numbers, lengths, glue and colours, and written back; lengths are in scaled points."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.scalars import UNITS

INT_MAX, DIMEN_MAX, UNIT = 2**31 - 1, 2**30 - 1, 65536
#: Digits of a fraction that count.
DIGITS = 17
#: Numbers that a colour has by model: fixed values.
ARITY = {"gray": 1, "wave": 1, "rgb": 3, "RGB": 3, "cmy": 3, "hsb": 3, "cmyk": 4}


def let(x: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _signed(x: Column) -> tuple[Column, Column]:
    """The product of leading signs, and what follows them."""
    head = F.regexp_extract(x, r"^[\s+\-]*", 0)
    minus = F.length(head) - F.length(F.replace(head, F.lit("-"), F.lit("")))
    return F.when(minus % 2 == 1, F.lit(-1)).otherwise(F.lit(1)), F.trim(F.substring(x, F.length(head) + 1, F.length(x)))


def _whole(a: Column, b: Column) -> Column:
    """a div b of decimals that aren't negative."""
    return ((a - a % b) / b).cast("decimal(38,0)")


def parse_integer(x: Column) -> Column:
    """Signs and a number: decimal, "hexadecimal, 'octal or `character; null if there is none, cut at 2^31 - 1."""
    sign, rest = _signed(F.trim(x))
    return sign * let(rest, _unsigned)


def _unsigned(rest: Column) -> Column:
    tail = F.trim(F.substring(rest, F.lit(2), F.length(rest)))
    radix = lambda digits, base: F.when(tail.rlike(f"^{digits}+$") & (F.length(F.ltrim(tail, F.lit("0"))) <= 15), F.conv(tail, base, 10).cast("decimal(38,0)"))
    plain = F.regexp_extract(rest, "^0*([0-9]*)", 1)
    decimal = F.when(rest.rlike("^[0-9]"), F.when(F.length(plain) > 10, F.lit(INT_MAX)).when(plain == "", F.lit(0)).otherwise(plain.cast("decimal(38,0)")))
    first = F.substring(rest, 1, 1)
    char = F.substring(rest, 2, 1)
    n = F.when(first == '"', radix("[0-9A-Fa-f]", 16)).when(first == "'", radix("[0-7]", 8)).when(first == "`", F.when(char != "", F.ascii(char))).otherwise(decimal)
    return F.when(n.isNotNull(), F.least(n.cast("long"), F.lit(INT_MAX)))


def _decimal(digits: Column) -> tuple[Column, Column]:
    """Numerator and denominator of a decimal fraction with point or comma; null numerator if it is none."""
    s = F.replace(digits, F.lit(","), F.lit("."))
    whole = F.substring_index(s, ".", 1)
    frac = F.when(F.contains(s, F.lit(".")), F.substring(s, F.length(whole) + 2, F.length(s))).otherwise(F.lit(""))
    good = (whole.rlike("^[0-9]{0,15}$")) & frac.rlike("^[0-9]*$") & (F.length(F.concat(whole, frac)) > 0)
    frac = F.substring(frac, 1, DIGITS)
    zero = F.lit("0")
    return F.when(good, F.concat(zero, whole, frac).cast("decimal(38,0)")), F.concat(F.lit("1"), F.repeat(zero, F.length(frac))).cast("decimal(38,0)")


def parse_dimension(x: Column) -> Column:
    """Signs, a decimal and a unit as scaled points: the decimal is rounded to 2^-16, the unit's ratio cut towards zero; null if it can't be read."""
    sign, rest = _signed(F.trim(x))
    return sign * let(rest, lambda r: let(F.regexp_extract(r, "^[0-9.,]*", 0), lambda digits: _scaled(r, digits)))


def _scaled(rest: Column, digits: Column) -> Column:
    unit = F.regexp_extract(F.lower(F.trim(F.substring(rest, F.length(digits) + 1, F.length(rest)))), "^(" + "|".join(UNITS) + ")", 1)
    num, den = _decimal(digits)
    ratio = lambda k: F.element_at(F.create_map(*[F.lit(v) for u, r in UNITS.items() for v in (u, r[k])]), F.nullif(unit, F.lit("")))
    rounded = let(F.struct(num.alias("n"), den.alias("d")), lambda v: _whole(v["n"] * (2 * UNIT) + v["d"], v["d"] * 2))
    sp = let(F.struct((rounded * ratio(0)).cast("decimal(38,0)").alias("n"), ratio(1).cast("decimal(38,0)").alias("d")), lambda v: _whole(v["n"], v["d"]))
    return let(sp, lambda v: F.when(v.isNotNull(), F.least(v, F.lit(DIMEN_MAX).cast("decimal(38,0)"))).cast("long"))


def _stretch(x: Column) -> Column:
    """(amount, order): a length, or a factor of the infinities fil, fill and filll."""
    order = F.length(F.regexp_extract(x, "fi(l*)", 1))
    sign, digits = _signed(F.regexp_extract(x, "^(.*?)fi", 1))
    num, den = _decimal(F.trim(digits))
    infinite = F.coalesce(sign * _whole(num * UNIT, den), F.lit(UNIT)).cast("long")
    finite = parse_dimension(x)
    pair = lambda a, o: F.struct(a.cast("long").alias("amount"), o.cast("int").alias("order"))
    return F.when(F.contains(x, F.lit("fi")), pair(infinite, F.least(F.greatest(order, F.lit(1)), F.lit(3)))).when(finite.isNotNull(), pair(finite, F.lit(0)))


def parse_glue(x: Column) -> Column:
    """struct(width, stretch, shrink) of `length plus length minus length`; null if a part can't be read."""
    s = F.lower(x)
    width = parse_dimension(F.regexp_extract(s, r"^(.*?)(?: plus| minus|$)", 1))
    none = F.struct(F.lit(0).cast("long").alias("amount"), F.lit(0).alias("order"))
    part = lambda key, other: F.when(F.contains(s, F.lit(f" {key}")), _stretch(F.regexp_extract(s, rf" {key}(.*?)(?:{other}|$)", 1))).otherwise(none)
    stretch, shrink = part("plus", "minus"), part("minus", "plus")
    return F.when(width.isNotNull() & stretch.isNotNull() & shrink.isNotNull(), F.struct(width.alias("width"), stretch.alias("stretch"), shrink.alias("shrink")))


def render_dimension(sp: Column) -> Column:
    """A length in points with the fewest digits, one at least, that read back as the same length."""

    def digits(rest: Column) -> Column:
        tries = []
        for k in range(1, 6):
            n = F.floor((rest * 10**k * 2 + UNIT) / (2 * UNIT))
            back = F.floor((n * (2 * UNIT) + 10**k) / (2 * 10**k))
            tries.append(F.when((back == rest) & (n < 10**k), F.lpad(n.cast("string"), k, "0")))
        return F.coalesce(*tries)

    return let(sp, lambda v: F.concat(F.when(v < 0, "-").otherwise(""), F.floor(F.abs(v) / UNIT).cast("string"), F.lit("."), let(F.abs(v) % UNIT, digits), F.lit("pt")))


def parse_colour(model: Column, spec: Column) -> Column:
    """A colour's numbers by model; null if their count or form is wrong. HTML has six hex digits, two a number."""
    parts = F.transform(F.split(spec, ","), lambda p: F.when(F.trim(p).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.trim(p).cast("double")))
    arity = F.element_at(F.create_map(*[F.lit(v) for pair in ARITY.items() for v in pair]), model)
    hexed = F.array(*[F.conv(F.substring(F.trim(spec), 2 * k + 1, 2), 16, 10).cast("double") for k in range(3)])
    return F.when(model == "HTML", F.when(F.trim(spec).rlike("^[0-9A-Fa-f]{6}$"), hexed)).when((F.size(parts) == arity) & ~F.exists(parts, lambda p: p.isNull()), parts)


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def driver_rgb(spec: Column) -> Column:
    """Red, green and blue (0 to 1) of a driver's colour: the first run of one, three or four numbers."""
    number = r"\[?[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\]?"
    run = F.regexp_extract(spec, rf"(?:^|\s)({number}(?:\s+{number})*)(?=\s|$)", 1)
    v = F.transform(F.filter(F.split(F.translate(run, "[]", ""), r"\s+"), lambda p: p != ""), lambda p: p.cast("double"))
    at = lambda k: F.get(v, F.lit(k))
    rgb = F.when(F.size(v) == 1, F.array(at(0), at(0), at(0))).when(F.size(v) == 3, v).when(F.size(v) == 4, F.array(*[(1 - at(k)) * (1 - at(3)) for k in range(3)]))
    return F.transform(rgb, _clamped)


def rgb_hex(rgb: Column) -> Column:
    """#rrggbb of red, green and blue from 0 to 1."""
    byte = lambda k: F.lpad(F.lower(F.hex(F.floor(_clamped(F.get(rgb, F.lit(k))) * 255 + 0.5))), 2, "0")
    return F.when(rgb.isNotNull(), F.concat(F.lit("#"), byte(0), byte(1), byte(2)))


def rgb_hsb(rgb: Column) -> Column:
    """Hue, saturation and brightness of red, green and blue, all 0 to 1."""
    r, g, b = (F.get(rgb, F.lit(k)) for k in range(3))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d = most - least
    sixth = F.when(d == 0, F.lit(0.0)).when(most == r, F.pmod((g - b) / F.nullif(d, F.lit(0.0)), F.lit(6.0))).when(most == g, (b - r) / F.nullif(d, F.lit(0.0)) + 2).otherwise((r - g) / F.nullif(d, F.lit(0.0)) + 4)
    return F.array(sixth / 6, F.when(most == 0, F.lit(0.0)).otherwise(d / F.nullif(most, F.lit(0.0))), most)


def comma_split(x: Column) -> Column:
    """Parts between commas outside braces (three deep), trimmed, without empty ones."""
    inner = r"[^{}]"
    for _ in range(3):
        inner = rf"(?:[^{{}}]|\{{{inner}*\}})"
    braced = inner[len("(?:[^{}]|") : -1]
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(rf"(?:[^,{{}}]|{braced})+"), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")


def character(code: Column) -> Column:
    """The character of a code point; null for what is none."""
    ok = (code >= 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))


def change_case(x: Column, codes: dict[str, str]) -> Column:
    """Characters replaced by a code table; those not in it stay."""
    return F.translate(x, "".join(codes), "".join(codes.values()))


def control_sequence(name: Column, escape: str = "\\") -> Column:
    return F.concat(F.lit(escape), name)


def meaning(parameters: Column, body: Column) -> Column:
    """What a macro means, as text."""
    return F.concat(F.lit("macro:"), F.coalesce(parameters, F.lit("")), F.lit("->"), F.coalesce(body, F.lit("")))


def job_name(path: Column) -> Column:
    """A file's name without folders and its last ending."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def creation_date(at: Column) -> Column:
    """A time (UTC) as documents record it."""
    return F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("Z"))


def elapsed(start: Column, now: Column) -> Column:
    """Time between two times in 65536ths of a second, cut at 2^31 - 1."""
    return F.least(F.floor((F.unix_micros(now) - F.unix_micros(start)) * UNIT / 1_000_000), F.lit(INT_MAX)).cast("long")


def _evaluate(text: str | None) -> int | None:
    """+ - * / and parentheses over integers, left to right; a quotient is rounded, ties away from zero, and a product that it follows is kept whole."""
    tokens = re.findall(r"\d+|[-+*/()]", text or "")
    if "".join(tokens) != re.sub(r"\s+", "", text or "") or not tokens:
        return None
    at = 0

    def atom() -> int:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "(":
            value = total()
            if tokens[at] != ")":
                raise ValueError
            at += 1
            return value
        return -atom() if t == "-" else atom() if t == "+" else int(t)

    def fits(v: int) -> int:
        if abs(v) > INT_MAX:
            raise ValueError
        return v

    def product() -> int:
        nonlocal at
        value = atom()
        while at < len(tokens) and tokens[at] in "*/":
            times = tokens[at] == "*"
            at += 1
            by = atom()
            if times and at < len(tokens) and tokens[at] == "/":
                at += 1
                value, times, by = value * by, False, atom()
            if times:
                value *= by
            else:
                n, d = abs(value), abs(by)
                value = (2 * n + d) // (2 * d) * (1 if (value < 0) == (by < 0) else -1)
            fits(value)
        return value

    def total() -> int:
        nonlocal at
        value = product()
        while at < len(tokens) and tokens[at] in "+-":
            sign = 1 if tokens[at] == "+" else -1
            at += 1
            value = fits(value + sign * product())
        return value

    try:
        value = fits(total())
        return value if at == len(tokens) else None
    except (ValueError, ZeroDivisionError, IndexError, RecursionError):
        return None


def evaluate(x: Column) -> Column:
    """The value of an integer expression; null if it is none, divides by zero or leaves the 32-bit range."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_evaluate).astype("Int64")

    return run(x)
