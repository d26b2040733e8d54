"""Times as text, and time arithmetic, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths in microseconds and milliseconds. A week in milliseconds
# is seven days here.
MICROS_PER_MILLI = 1_000
MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE
MICROS_PER_DAY = 24 * MICROS_PER_HOUR
MICROS_PER_WEEK = 7 * MICROS_PER_DAY
MILLIS_PER_WEEK = MICROS_PER_WEEK // MICROS_PER_MILLI

DEFAULT_FORMAT = "%Y-%m-%d %H:%M:%S"

# C time directives and Spark's patterns for them.
DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%p": "a",
    "%j": "DDD",
    "%a": "E",
    "%A": "EEEE",
    "%b": "MMM",
    "%B": "MMMM",
    "%F": "yyyy-MM-dd",
    "%T": "HH:mm:ss",
    "%R": "HH:mm",
    "%D": "MM/dd/yy",
}


def java_format(fmt: str) -> str:
    """A C time format as a Spark pattern; text between directives is quoted."""
    out, at, literal = [], 0, ""

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
            literal = ""

    while at < len(fmt):
        directive = fmt[at : at + 2]
        if directive in ("%%", "%n", "%t"):
            literal += {"%%": "%", "%n": "\n", "%t": "\t"}[directive]
            at += 2
        elif fmt[at] == "%":
            if directive not in DIRECTIVES:
                raise ValueError(f"unsupported time directive {directive}")
            flush()
            out.append(DIRECTIVES[directive])
            at += 2
        else:
            literal += fmt[at]
            at += 1
    flush()
    return "".join(out)


def time_text(time_us: Column, fmt: str = DEFAULT_FORMAT) -> Column:
    """Microseconds since the epoch as text; what is below a second is cut."""
    return F.date_format(F.timestamp_micros(time_us), java_format(fmt))


def days_after(time_us: Column, days: Column | float) -> Column:
    """The time some days, also part of a day, later; in microseconds, cut to whole ones."""
    added = (days if isinstance(days, Column) else F.lit(float(days))) * float(MICROS_PER_DAY)
    return (time_us.cast("double") + added).cast("bigint")
