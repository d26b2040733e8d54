"""JSON text, written to the byte as log collectors write it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sluiceway.config import ConfigError
from sluiceway.functions.arrays import bind

# Control characters with a short escape. Every other one below
# 0x20 is written as \u00xx with lower-case digits.
SHORT_ESCAPES = {
    "\b": "\\b",
    "\t": "\\t",
    "\n": "\\n",
    "\f": "\\f",
    "\r": "\\r",
}


def _escape(code: int) -> str:
    return SHORT_ESCAPES.get(chr(code), f"\\u{code:04x}")


def json_escape(value: Column) -> Column:
    """The inside of a JSON string: quote, backslash and control characters escaped."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in range(0x20):
        full = F.call_function("replace", full, *_pair(code))
    # Few rows hold a control character; only those go through all replacements.
    return F.when(value.rlike(r"[\x00-\x1f]"), full).otherwise(plain)


@lru_cache(maxsize=None)
def _pair(code: int) -> tuple[Column, Column]:
    """A control character and its escape as literals, built once: they are used a lot."""
    return F.char(F.lit(code)), F.lit(_escape(code))


def json_quote(value: Column) -> Column:
    return F.concat(F.lit('"'), json_escape(value), F.lit('"'))


def json_literal(text: str) -> str:
    """The same quoting for a text known on the driver."""
    table = {"\\": "\\\\", '"': '\\"', **SHORT_ESCAPES}
    body = "".join(table.get(c) or (_escape(ord(c)) if c < " " else c) for c in text)
    return f'"{body}"'


def json_object(
    fields: Sequence[tuple[str, Column]], present: Mapping[str, Column] | None = None
) -> Column:
    """A compact object of string fields in the given order.

    A field named in ``present`` is written only where that column is true. The
    first field may not be one of those.
    """
    present = present or {}
    parts: list[Column] = [F.lit("{")]
    for number, (name, value) in enumerate(fields):
        member = F.concat(F.lit("," * (number > 0) + json_literal(name) + ":"), json_quote(value))
        if name in present:
            member = F.when(present[name], member).otherwise(F.lit(""))
        parts.append(member)
    return F.concat(*parts, F.lit("}"))


def wrap_line(line: Column) -> Column:
    """A raw line as ``{ "data": "..." }``."""
    return F.concat(F.lit('{ "data": "'), json_escape(line), F.lit('" }'))


def overlay(*texts: Column) -> Column:
    """JSON objects as one: shallow, the last one wins per key, value types kept.

    Empty and missing texts do not count, and one that is alone stays as it is. Where one
    is no object, nothing can be laid over it, and the last text wins as a whole. Each
    text is parsed once, however many there are. Needs the LAST_WIN map policy, which
    ``session.prepare`` sets and ``check_last_win`` looks for.
    """
    fields = "map<string,variant>"
    parsed = F.array(*[F.from_json(text, fields) for text in texts])
    given = F.filter(F.array(*texts), lambda text: F.coalesce(text, F.lit("")) != "")
    none = F.from_json(F.lit("{}"), fields)

    def merged(maps: Column) -> Column:
        objects = F.size(F.filter(maps, lambda m: m.isNotNull()))
        laid = F.map_concat(*[F.coalesce(F.get(maps, F.lit(i)), none) for i in range(len(texts))])
        return F.when(objects == F.size(given), F.to_json(laid)).otherwise(F.element_at(given, -1))

    return (
        F.when(F.size(given) == 0, F.lit(""))
        .when(F.size(given) == 1, F.get(given, F.lit(0)))
        .otherwise(bind(parsed, merged))
    )


def check_last_win(spark: SparkSession) -> None:
    """Fail before any data is read where equal keys would be an error."""
    if spark.conf.get("spark.sql.mapKeyDedupPolicy").upper() != "LAST_WIN":
        raise ConfigError("EINVAL", "set spark.sql.mapKeyDedupPolicy to LAST_WIN, as session.prepare does")
