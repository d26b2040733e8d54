"""Log lines to fields and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.json_text import json_object, wrap_line
from sluiceway.functions.patterns import (
    FieldPattern,
    compile_pattern,
    group_list,
    group_texts,
    matches,
    was_set,
)


def drop_blank(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that are not empty. A lone carriage return is not empty."""
    return lines.filter(F.col(line) != "")


def regex_match(lines: DataFrame, pattern: str, line: str = "line") -> DataFrame:
    """Lines in which the pattern is found."""
    ready = compile_pattern(lines.sparkSession, pattern)
    return lines.filter(matches(F.col(line), ready))


def extract_fields(lines: DataFrame, pattern: str, line: str = "line") -> DataFrame:
    """Matching lines with one string column per named group; an unset group is ``''``."""
    ready = compile_pattern(lines.sparkSession, pattern)
    found = lines.filter(matches(F.col(line), ready))
    listed = found.withColumn("_groups", group_list(F.col(line), ready))
    return listed.select(*found.columns, *[text.alias(n) for n, text in _named(ready)])


def _named(pattern: FieldPattern) -> list[tuple[str, Column]]:
    """Name and text of each group, out of the column ``_groups``."""
    return [(name, F.get("_groups", F.lit(i))) for i, (name, _) in enumerate(pattern.fields)]


def _payload(line: Column, pattern: FieldPattern, named: list[tuple[str, Column]] | None = None) -> Column:
    named = named or group_texts(line, pattern)
    if len(pattern.unset) < len(named):
        present = {
            name: was_set(line, pattern, n) for name, n in pattern.fields if n in pattern.unset
        }
        return json_object(named, present)
    # Every field may be missing: choose by the last one that was set.
    text = F.lit("{}")
    for size, (_, number) in enumerate(pattern.fields, start=1):
        text = F.when(was_set(line, pattern, number), json_object(named[:size])).otherwise(text)
    return text


def extract_payload(
    lines: DataFrame, pattern: str, line: str = "line", payload: str = "event_data"
) -> DataFrame:
    """Matching lines with their fields as JSON text in group order.

    An unset group is written as ``""``, but left out where no group behind it is
    set either. Non-blank lines only.
    """
    ready = compile_pattern(lines.sparkSession, pattern)
    found = drop_blank(lines, line).filter(matches(F.col(line), ready))
    listed = found.withColumn("_groups", group_list(F.col(line), ready))
    return listed.withColumn(payload, _payload(F.col(line), ready, _named(ready))).drop("_groups")


def record_of(line: Column, pattern: FieldPattern | None) -> Column:
    """The record a raw line contributes: ``''`` for a blank or unmatched line.

    For use where a line keeps its place whether or not it yields an event, as in
    the round zip.
    """
    if pattern is None:
        return F.when(line == "", F.lit("")).otherwise(wrap_line(line))
    found = (line != "") & matches(line, pattern)
    return F.when(found, _payload(line, pattern)).otherwise(F.lit(""))


def wrap_raw(lines: DataFrame, line: str = "line", payload: str = "event_data") -> DataFrame:
    """Non-blank lines with the line itself as payload ``{ "data": ... }``."""
    return drop_blank(lines, line).withColumn(payload, wrap_line(F.col(line)))


def encode_payload(df: DataFrame, fields: list[str], payload: str = "event_data") -> DataFrame:
    """String columns as one JSON object, escaped to the byte as collectors do."""
    return df.withColumn(payload, json_object([(name, F.col(name)) for name in fields]))
