"""Text predicates and rewrites with byte and ASCII meaning."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes a field is checked for. Each holds for the empty text
# too, and the number shape is as loose as it reads: "-" and "." fit.
SHAPES = {
    "hex": "[0-9a-fA-F]*",
    "alphanumeric": "[0-9a-zA-Z]*",
    "shell_safe": "[0-9a-zA-Z_.-]*",
    "digits": "[0-9]*",
    "number": "-?[0-9]*([.,][0-9]*)?",
}


def has_shape(value: Column, shape: str) -> Column:
    """Whether the whole text has one of the ``SHAPES``."""
    return value.rlike(rf"\A(?:{SHAPES[shape]})\z")


def _is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def ascii_lower(value: Column) -> Column:
    """A to Z lowered, all else kept. Spark's ``lower`` is far quicker than ``translate``
    but knows all of Unicode, so it serves pure ASCII only."""
    by_letter = F.translate(value, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(_is_ascii(value), F.lower(value)).otherwise(by_letter)


def ascii_upper(value: Column) -> Column:
    by_letter = F.translate(value, string.ascii_lowercase, string.ascii_uppercase)
    return F.when(_is_ascii(value), F.upper(value)).otherwise(by_letter)


def strip_shell(value: Column) -> Column:
    """Only the characters that are safe in a shell word."""
    kept = string.ascii_letters + string.digits + "_.-"
    dropped = "".join(c for c in map(chr, range(128)) if c not in kept)
    ascii_only = F.translate(value, dropped, "")
    return F.when(_is_ascii(value), ascii_only).otherwise(
        F.regexp_replace(ascii_only, r"[^\x00-\x7f]+", "")
    )


def strip_trailing_slashes(value: Column) -> Column:
    return F.rtrim(value, F.lit("/"))


def replace_all(value: Column, pattern: str, by: str) -> Column:
    """Every occurrence replaced, left to right; what is put in is not searched again."""
    return F.replace(value, F.lit(pattern), F.lit(by))


def includes_ignoring_case(value: Column, part: str) -> Column:
    folded = part.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return F.contains(ascii_lower(value), F.lit(folded))


def find_byte(value: Column, char: str) -> Column:
    """Byte position of the first such character from 0, or -1."""
    before = F.substring_index(value, char, 1)
    return F.when(F.contains(value, F.lit(char)), F.octet_length(before)).otherwise(-1)


def find_last_byte(value: Column, char: str) -> Column:
    """Byte position of the last such character from 0, or -1."""
    behind = F.octet_length(F.substring_index(value, char, -1))
    at = F.octet_length(value) - behind - len(char.encode())
    return F.when(F.contains(value, F.lit(char)), at).otherwise(-1)


def compare_bytes(left: Column, right: Column) -> Column:
    """-1, 0 or 1 by unsigned byte order, where a prefix comes first."""
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def split_on(value: Column, separator: str) -> Column:
    """The parts between literal separators; empty parts stay."""
    return F.split(value, re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", separator), -1)


def join_list(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator)


def join_set(parts: Column, separator: str) -> Column:
    """The distinct parts in byte order, joined."""
    return F.array_join(F.sort_array(F.array_distinct(parts)), separator)


def fill(template: str, values: Sequence[Column]) -> Column:
    """``$0``, ``$1``, ... replaced in turn by the values.

    The order shows: ``$1`` also takes the start of ``$10``, and a ``$k`` inside a
    value is replaced when k comes later.
    """
    text = F.lit(template)
    for number, value in enumerate(values):
        text = F.replace(text, F.lit(f"${number}"), value.cast("string"))
    return text
