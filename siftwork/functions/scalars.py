"""Scalar helpers as Columns: text conversions, keys of works, units and colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units as exact fractions of a point: fixed values.
UNITS = {"pt": (1, 1), "in": (7227, 100), "pc": (12, 1), "cm": (7227, 254), "mm": (7227, 2540), "bp": (7227, 7200), "dd": (1238, 1157), "cc": (14856, 1157), "sp": (1, 65536), "nd": (685, 642), "nc": (1370, 107), "px": (7227, 7200)}


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by binary order."""
    return F.when(a == b, 0).when(a < b, -1).when(a > b, 1)


def hex_escape(x: Column) -> Column:
    return F.hex(F.encode(x, "UTF-8"))


def hex_unescape(x: Column) -> Column:
    return F.decode(F.unhex(x), "UTF-8")


def md5_upper(x: Column) -> Column:
    return F.upper(F.md5(x))


def name_escape(x: Column) -> Column:
    """A name with delimiters and blanks as # and two hex digits."""
    marks = {"#": "#23", " ": "#20", "%": "#25", "(": "#28", ")": "#29", "/": "#2F", "<": "#3C", ">": "#3E", "[": "#5B", "]": "#5D", "{": "#7B", "}": "#7D"}
    return reduce(lambda c, m: F.replace(c, F.lit(m), F.lit(marks[m])), marks, x)


def string_escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"([\\()])", r"\\$1"), "[\r\n]", r"\\n")


def roman(n: Column) -> Column:
    """Lower-case roman numerals, digit by digit; nothing for numbers below one."""
    n = F.greatest(n.cast("int"), F.lit(0))
    ones = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
    digit = lambda one, five, ten, value: F.element_at(F.array(*[F.lit(d.translate(str.maketrans("ivx", one + five + ten))) for d in ones]), (F.floor(n / value) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit("c", "d", "m", 100), digit("x", "l", "c", 10), digit("i", "v", "x", 1))


def title_key(x: Column) -> Column:
    """Letters and digits in lower case."""
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def doi(x: Column) -> Column:
    """A DOI without resolver and prefix, in lower case; null if it has blanks or no slash."""
    bare = F.lower(F.regexp_replace(F.trim(x), r"^(?i)(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(F.contains(bare, F.lit("/")) & ~bare.rlike(r"\s"), bare)


def citation_key(author: Column, year: Column, title: Column) -> Column:
    """Family name, year and first long title word."""
    family = F.lower(F.regexp_replace(F.regexp_extract(author, r"^\s*([^,\s]+)", 1), r"[^\p{L}]", ""))
    word = F.lower(F.regexp_extract(title, r"(\p{L}{4,})", 1))
    return F.concat(family, F.coalesce(year, F.lit("")), word)


def excerpt(x: Column, size: int = 60) -> Column:
    """The start of a text on one line, with a mark where it was cut."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…")))


def utf16_length(x: Column) -> Column:
    """Code units of UTF-16, by which editors count columns."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def uncommented(line: Column) -> Column:
    """A line up to its first comment sign that an even number of backslashes precedes."""
    return F.regexp_extract(line, r"^((?:[^%\\]|\\.)*+\\?)", 1)


def to_scaled(amount: Column, unit: Column) -> Column:
    """A length in scaled points, cut towards zero; null for a unit that is not known."""
    numerator = F.create_map(*[F.lit(v) for u, (n, _) in UNITS.items() for v in (u, n)])
    denominator = F.create_map(*[F.lit(v) for u, (_, d) in UNITS.items() for v in (u, d)])
    value = amount.cast("decimal(20,8)") * F.lit(65536) * F.element_at(numerator, unit) / F.element_at(denominator, unit)
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("long")


def hex_channel(colour: Column, k: int) -> Column:
    """One of three channels of RRGGBB as 0 to 1."""
    return F.conv(F.substring(colour, 2 * k + 1, 2), 16, 10).cast("int") / 255.0


def _linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(colour: Column) -> Column:
    """Relative luminance of RRGGBB."""
    r, g, b = (_linear(hex_channel(colour, k)) for k in range(3))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colours, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def lab(colour: Column) -> Column:
    """CIELAB of RRGGBB under D65."""
    r, g, b = (_linear(hex_channel(colour, k)) for k in range(3))
    xyz = [(0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883]
    x, y, z = (F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116) for t in xyz)
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def colour_distance(a: Column, b: Column) -> Column:
    p, q = lab(a), lab(b)
    return F.sqrt(sum((F.pow(p[k] - q[k], F.lit(2.0)) for k in ("l", "a", "b")), F.lit(0.0)))
