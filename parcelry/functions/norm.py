"""Column expressions that make keys, labels and amounts comparable. All run inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key5(c: Column | str) -> Column:
    """A five-character key with leading zeros, from text or from a number that lost them (12.0 -> 00012)."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", "")
    return F.lpad(F.substring(F.nullif(text, F.lit("")), 1, 5), 5, "0")


def opaque_id(c: Column | str) -> Column:
    """A number that is a name: its digits as text; 0 and what isn't a number are NULL."""
    return F.nullif(col(c).try_cast("decimal(38,0)").cast("string"), F.lit("0"))


def label(c: Column | str) -> Column:
    """Trimmed upper case; blank is NULL."""
    return F.nullif(F.upper(F.trim(col(c))), F.lit(""))


def blank_null(c: Column | str, *sentinels: str) -> Column:
    """Trimmed; blank and the sentinels are NULL."""
    text = F.nullif(F.trim(col(c)), F.lit(""))
    return reduce(lambda x, s: F.nullif(x, F.lit(s)), sentinels, text)


def token(c: Column | str) -> Column:
    """A free-text name as a file-safe token."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"[ \-/().]+", "_"), "^_+|_+$", "")


def first_match(cases: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.when(cases[0][0], F.lit(cases[0][1]) if not isinstance(cases[0][1], Column) else cases[0][1])
    for when, value in cases[1:]:
        out = out.when(when, value if isinstance(value, Column) else F.lit(value))
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def joined_key(*columns: Column | str, sep: str = "|") -> Column:
    """A composite key that is NULL if any part is, unlike concat_ws."""
    parts = [x for c in columns for x in (F.lit(sep), col(c).cast("string"))][1:]
    return F.concat(*parts)


def money(c: Column | str) -> Column:
    """An exact amount, cast before it is summed."""
    return col(c).cast("decimal(38,6)")


def cents(c: Column | str) -> Column:
    return col(c).cast("decimal(18,2)")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0).cast("double"))


def percent_of(c: Column | str, *by: str) -> Column:
    """100 c over its sum in the group."""
    total = F.sum(col(c)).over(Window.partitionBy(*by))
    return 100 * ratio(col(c), total)


def significant(c: Column | str, digits: int = 6) -> Column:
    """Rounded to so many significant figures; 0, NULL and what isn't finite stay."""
    x = col(c)
    p = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x))).cast("double"))
    return F.when(x.isNull() | (x == 0) | ~finite(x), x).otherwise(F.rint(x * p) / p)


def finite(c: Column | str) -> Column:
    x = col(c)
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def within(c: Column | str, low: Column | float, high: Column | float, slack: float = 0.0) -> Column:
    return col(c).between(low - slack, high + slack)


def deviation(mass: Column | str, target: Column | str) -> Column:
    """|mass / target - 1|."""
    return F.abs(ratio(mass, target) - 1)


def headroom(mean: Column | str, low: Column | str, high: Column | str) -> Column:
    """1 in the middle of [low, high], 0 at its ends, negative outside."""
    m, a, b = col(mean), col(low), col(high)
    return 2 * F.least(m - a, b - m) / F.nullif(b - a, F.lit(0).cast("double"))


def centimetres(metres: Column | str) -> Column:
    """Whole centimetres, decimal-exact."""
    return F.floor(col(metres).cast("decimal(20,6)") * 100).cast("long")


def has_non_digit(c: Column | str) -> Column:
    return F.length(F.translate(col(c), "0123456789", "")) > 0


def missing(c: Column | str) -> Column:
    """What a profile counts as missing: NULL, blank and '0'."""
    x = F.trim(col(c).cast("string"))
    return x.isNull() | x.isin("", "0")


def in_period(c: Column | str, first: str, last: str) -> Column:
    return F.to_date(col(c)).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def still_open(c: Column | str) -> Column:
    """The open end of a validity."""
    return F.to_date(col(c)) == F.lit("9999-12-31").cast("date")


def fingerprint(*columns: str) -> Column:
    """A row's 64 bits; equal rows agree, so verify rows that agree."""
    return F.xxhash64(*columns)


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt(squared_distance(ax, ay, bx, by))


def squared_distance(ax, ay, bx, by) -> Column:
    return F.pow(col(ax) - col(bx), F.lit(2)) + F.pow(col(ay) - col(by), F.lit(2))


def set_expression(expression: str, sets: dict[str, Column]) -> Column:
    """'a - b + c' over named array columns, from the left."""
    parts = expression.split()
    out = F.array_distinct(sets[parts[0]])
    for op, name in zip(parts[1::2], parts[2::2], strict=True):
        if op not in "+-":
            raise ValueError(f"{op}: only + and - combine sets")
        out = F.array_except(out, sets[name]) if op == "-" else F.array_union(out, sets[name])
    return F.array_sort(out)
