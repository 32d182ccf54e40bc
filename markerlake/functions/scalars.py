"""Scalars of the engine's maths, strings and times as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def sgn(v: Column) -> Column:
    """1 from zero on, -1 below."""
    return F.when(v >= 0, 1.0).otherwise(-1.0)


def floor_mod(v: Column, m: float) -> Column:
    return v - m * F.floor(v / m)


def mod2pi_positive(v: Column) -> Column:
    return floor_mod(v, TWO_PI)


def mod2pi(v: Column) -> Column:
    """Into [-pi, pi)."""
    return floor_mod(v + math.pi, TWO_PI) - math.pi


def mod2pi_ref(ref: Column, v: Column) -> Column:
    """v moved by whole turns to within pi of ref."""
    return ref + mod2pi(v - ref)


def mod360_positive(v: Column) -> Column:
    return floor_mod(v, 360.0)


def mod360(v: Column) -> Column:
    return floor_mod(v + 180.0, 360.0) - 180.0


def theta_to_int(theta: Column, bins: int) -> Column:
    """Bin of an angle, the nearest of `bins` around the circle."""
    return F.pmod(F.floor(mod2pi_positive(theta + math.pi / bins) / (TWO_PI / bins)), F.lit(bins)).cast("int")


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(v, F.lit(high)))


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def symmetric_eigenvalues(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Smaller and larger eigenvalue of [[a, b], [b, c]]."""
    root = F.sqrt((a - c) * (a - c) + 4 * b * b)
    return 0.5 * (a + c - root), 0.5 * (a + c + root)


def singular_values(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Larger and smaller singular value of [[a, b], [c, d]]."""
    p, q = F.hypot(a + d, c - b), F.hypot(a - d, b + c)
    return 0.5 * (p + q), 0.5 * F.abs(p - q)


def polyval(coefficients: Column, x: Column) -> Column:
    """Sum of c_i x^i."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * x + c)


def diff_index(a: Column, b: Column) -> Column:
    """First place (from 0) where two strings differ; the shorter length where one starts the other."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, n)


def split_nonempty(s: Column, delimiter: str) -> Column:
    """Parts between a literal delimiter, without empty ones."""
    import re

    return F.filter(F.split(s, re.escape(delimiter)), lambda p: p != "")


def index_of(s: Column, part: str) -> Column:
    return F.instr(s, part) - 1


def last_index_of(s: Column, part: str) -> Column:
    """Place (from 0) of the last occurrence, -1 if none."""
    at = F.instr(F.reverse(s), part[::-1])
    return F.when(at == 0, -1).otherwise(F.length(s) - at - len(part) + 1)


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(" \t\n\x0b\x0c\r"))


def starts_with_any(s: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.startswith(s, p))


def replace_many(s: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def hhmmss_to_utime(v: Column) -> Column:
    """A number hhmmss.ss as microseconds, to a hundredth of a second."""
    hundredths = F.floor(v * 100 + 0.5).cast("long")
    h, m, s = F.floor(hundredths / 1_000_000), F.floor(hundredths / 10_000) % 100, hundredths % 10_000
    return ((h * 3600 + m * 60) * 1_000_000 + s * 10_000).cast("long")


def near(a: Column, b: Column, within: float = 1e-9) -> Column:
    return F.abs(a - b) < within


def ms_to_us(v: Column) -> Column:
    return v.cast("long") * 1000


def is_variable_character(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_]$")


def expand_variables(s: Column, values: dict[str, str]) -> Column:
    """Each $NAME (letters, digits and _) by its value, by nothing where it has none. The values are a parameter, since
    executors have their own environments."""
    names = F.regexp_extract_all(s, F.lit(r"\$([A-Za-z0-9_]*)"), 1)
    known = F.create_map(*(F.lit(x) for pair in {"": "", **values}.items() for x in pair))
    gaps = F.split(s, r"\$[A-Za-z0-9_]*", -1)
    return F.array_join(F.flatten(F.zip_with(gaps, names, lambda g, n: F.array(F.coalesce(g, F.lit("")), F.coalesce(F.try_element_at(known, n), F.lit(""))))), "")


def upper_ascii(s: Column) -> Column:
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lower_ascii(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return lower_ascii(a) == lower_ascii(b)


def matches_any(s: Column, parts: list[str]) -> Column:
    return s.isin(*parts)


# A feeder is a text with a place in it: struct(s, at), at counted from 0.


def feeder(s: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(0).alias("at"))


def _read(f: Column) -> Column:
    return F.substring(f["s"], F.lit(1), f["at"])


def feeder_has_next(f: Column) -> Column:
    return f["at"] < F.length(f["s"])


def feeder_peek(f: Column, n: int = 1) -> Column:
    """The next n characters, or as many as there are."""
    return F.substring(f["s"], f["at"] + 1, F.lit(n))


def feeder_advance(f: Column, n: int = 1) -> Column:
    return F.struct(f["s"].alias("s"), F.least(f["at"] + n, F.length(f["s"])).alias("at"))


def feeder_starts_with(f: Column, part: str) -> Column:
    return feeder_peek(f, len(part)) == part


def feeder_require(f: Column, part: str) -> Column:
    """The feeder after part, null where the text goes on otherwise."""
    return F.when(feeder_starts_with(f, part), feeder_advance(f, len(part)))


def feeder_line(f: Column) -> Column:
    """Line of the place, from 1."""
    return F.length(F.regexp_replace(_read(f), "[^\n]", "")) + 1


def feeder_column(f: Column) -> Column:
    """Characters since the line began."""
    return F.length(F.substring_index(_read(f), "\n", -1))
