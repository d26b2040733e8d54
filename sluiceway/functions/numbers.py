"""Numbers as text, rounded as the C library prints them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluiceway.functions.arrays import bind

# A fraction below this is zero at up to six digits.
_TINY = "pow(2D, -30)"
# Doubles from here on are whole numbers.
_WHOLE_FROM = "pow(2D, 53)"
# Above what the shortest form of a value that is not coarse can be off, in digits.
_CLOSE = "1e-3D"


def _exact(part: str, digits: int) -> str:
    """SQL of a fraction in [0, 1) times 10**digits, rounded half to even on its exact value.

    A double is a whole number over a power of two; with both in decimal integers
    nothing is lost.
    """
    power = f"54 - cast(floor(log2({part})) AS int)"
    above = f"cast(cast({part} * pow(2D, p) AS bigint) AS decimal(18, 0))"
    below = (
        f"cast(cast(pow(2D, p - 40) AS bigint) AS decimal(15, 0)) * cast({2**40} AS decimal(13, 0))"
    )
    number = f"{above} * cast({10**digits} AS decimal({digits + 1}, 0))"
    twice = "cast(q.above % q.below AS decimal(38, 0)) * 2"
    odd = "(q.above div q.below) % 2 = 1"
    up = f"{twice} > q.below OR ({twice} = q.below AND {odd})"
    return f"""CASE WHEN {part} < {_TINY} THEN 0L ELSE
        transform(array({power}), p ->
          transform(array(struct({number} AS above, {below} AS below)), q ->
            q.above div q.below + if({up}, 1, 0))[0])[0] END"""


def _fixed(v: str, digits: int) -> str:
    """SQL of the text of the double ``v``, a name."""
    # Where the value is clear of a half, and finer than the digits shown, Spark's
    # own way of rounding the shortest decimal form gives the same.
    coarse = "pow(2D, 33)" if digits <= 2 else "pow(2D, 20)"
    scaled = f"abs({v}) * {10**digits}D"
    clear = f"abs({v}) < {coarse} AND abs({scaled} % 1D - 0.5D) > {_CLOSE}"
    minus = f"if({v} < 0 OR cast({v} AS string) = '-0.0', '-', '')"
    fraction = _exact(f"(abs({v}) - floor(abs({v})))", digits)
    carried = f"cast(floor(abs({v})) + if(f >= {10**digits}, 1, 0) AS string)"
    rest = f"lpad(cast(f % {10**digits} AS string), {digits}, '0')"
    return f"""CASE
        WHEN {clear} THEN printf('%.{digits}f', {v})
        WHEN isnan({v}) THEN 'nan'
        WHEN abs({v}) = double('inf') THEN concat({minus}, 'inf')
        WHEN abs({v}) >= {_WHOLE_FROM} THEN printf('%.{digits}f', {v})
        ELSE transform(array({fraction}), f -> concat({minus}, {carried}, '.', {rest}))[0] END"""


def _clear(value: Column, digits: int) -> Column:
    """Whether Spark's own printing is right: almost always. Nothing here leaves generated code."""
    coarse = 2.0**33 if digits <= 2 else 2.0**20
    scaled = F.abs(value) * F.lit(float(10**digits))
    return (F.abs(value) < coarse) & (F.abs(scaled % 1.0 - 0.5) > 1e-3)


def _printed(value: Column, digits: int) -> Column:
    """The text where that is right, else null."""
    return F.when(_clear(value, digits), F.printf(F.lit(f"%.{digits}f"), value))


def fixed(value: Column, digits: int) -> Column:
    """A double with a fixed number of digits (1 to 6), as ``%.<digits>f`` prints it in C.

    Spark's ``printf`` rounds the shortest decimal form instead of the exact
    value: 405.95 gives 406.0 there and 405.9 here. From 2**53 on, where doubles
    are whole, they are printed in the shortest form.
    """
    return F.coalesce(_printed(value, digits), bind(value, f"v -> {_fixed('v', digits)}"))


def number_text(value: Column) -> Column:
    """A double with six digits, its trailing zeros cut but for the first digit."""
    zeros = r"(\.\d+?)0+$"
    usual = F.regexp_replace(_printed(value, 6), zeros, "$1")
    return F.coalesce(usual, bind(value, f"v -> regexp_replace({_fixed('v', 6)}, r'{zeros}', '$1')"))


# Upper bound, what scales the number, suffix, and the digits shown.
# The milli band ends at 0.1, and plain numbers below 10 show two digits.
METRIC_BANDS = (
    ("1e-9D", "* 1e12D", "p", 1),
    ("1e-6D", "* 1e9D", "n", 1),
    ("1e-3D", "* 1e6D", "μ", 1),
    ("0.1D", "* 1e3D", "m", 1),
    ("10D", "", "", 2),
    ("1e3D", "", "", 1),
    ("1e6D", "/ 1e3D", "K", 1),
    ("1e9D", "/ 1e6D", "M", 1),
    ("1e12D", "/ 1e9D", "G", 1),
    ("double('inf')", "/ 1e12D", "T", 1),
)


def metric_text(value: Column) -> Column:
    """A number with a metric suffix, such as ``1.5K``."""
    usual = F.when(value == 0, F.lit("0"))
    for bound, scale, suffix, digits in METRIC_BANDS:
        factor = float(scale.lstrip("*/ ").rstrip("D") or 1)
        scaled = value / factor if scale.startswith("/") else value * factor if scale else value
        limit = float("inf") if "inf" in bound else float(bound.rstrip("D"))
        usual = usual.when(F.abs(value) < limit, F.concat(_printed(scaled, digits), F.lit(suffix)))
    bands = " ".join(
        f"WHEN abs(v) < {bound} THEN struct(v {scale} AS s, '{suffix}' AS suffix, {digits} AS digits)"
        for bound, scale, suffix, digits in METRIC_BANDS
    )
    last = f"struct(v {METRIC_BANDS[-1][1]} AS s, '{METRIC_BANDS[-1][2]}' AS suffix, 1 AS digits)"
    shown = f"CASE WHEN b.digits = 2 THEN {_fixed('b.s', 2)} ELSE {_fixed('b.s', 1)} END"
    text = f"transform(array(CASE {bands} ELSE {last} END), b -> concat({shown}, b.suffix))[0]"
    return F.coalesce(usual, bind(value, f"v -> {text}"))
