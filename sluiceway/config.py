"""Configuration as plain Python data, checked on the driver before any job runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sluiceway import schema


class ConfigError(ValueError):
    """A configuration that cannot be run; ``code`` is the short error name."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Property:
    """One key with its values. Keys may repeat, so lists of these keep their order."""

    key: str
    values: tuple[str, ...] = ()


def first_value(properties: Iterable[Property], key: str) -> str | None:
    """The first value under ``key``; entries without values are skipped."""
    return next((p.values[0] for p in properties if p.key == key and p.values), None)


def all_values(properties: Iterable[Property], key: str) -> list[tuple[str, ...]]:
    """The value lists of every entry under ``key``, in order."""
    return [p.values for p in properties if p.key == key]


def value_at(properties: Iterable[Property], key: str, i: int, j: int) -> str | None:
    """Value ``j`` of the ``i``-th entry under ``key``, or None."""
    entries = all_values(properties, key)
    if i >= len(entries) or j >= len(entries[i]):
        return None
    return entries[i][j]


@dataclass(frozen=True)
class Route:
    """Events whose name fits ``event_name_match`` go to ``target``."""

    route_no: int
    event_name_match: str
    target: str


@dataclass(frozen=True)
class Source:
    """A source of an event binding, looked up by plug-in name."""

    plugin: str
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class Binding:
    """An event, how often it is emitted, and the sources it is made from."""

    event_name: str
    interval_micros: int
    sources: tuple[Source, ...]

    def __post_init__(self) -> None:
        if self.interval_micros <= 0:
            raise ConfigError("EINVAL", f"event {self.event_name} needs a positive interval")


@dataclass(frozen=True)
class Output:
    """A place events are sent to."""

    output_no: int
    output_name: str
    plugin: str = "table"
    properties: tuple[Property, ...] = field(default=())


def routes_of(properties: Sequence[Property]) -> list[Route]:
    """Routes written as ``route <event> <target>`` properties.

    Anything but two values is an error, also no value at all: a list that ends
    there in silence would lose the routes behind it.
    """
    routes = []
    for number, values in enumerate(all_values(properties, "route"), start=1):
        if len(values) != 2:
            raise ConfigError(
                "EINVAL", f"route {number} has {len(values)} values, wanted an event and a target"
            )
        routes.append(Route(number, *values))
    return routes


def _local_table(spark: SparkSession, rows: Sequence[tuple], columns: T.StructType) -> DataFrame:
    """A small table that is part of the plan, where a list would be spread over all cores."""
    named = [dict(zip(columns.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, to_arrow_schema(columns)), columns)


def _plain(properties: Iterable[Property]) -> list[dict]:
    return [{"key": p.key, "values": list(p.values)} for p in properties]


def routes_table(
    spark: SparkSession, routes: Sequence[Route], stopped: Sequence[bool] | None = None
) -> DataFrame:
    """Routes as a table, with ``stopped`` beside them if that is known."""
    rows = [(r.route_no, r.event_name_match, r.target) for r in routes]
    if stopped is None:
        return _local_table(spark, rows, schema.ROUTES)
    columns = T.StructType([*schema.ROUTES.fields, T.StructField("stopped", T.BooleanType(), False)])
    return _local_table(spark, [(*row, stop) for row, stop in zip(rows, stopped)], columns)


def bindings_table(spark: SparkSession, bindings: Sequence[Binding]) -> DataFrame:
    rows = [
        (b.event_name, b.interval_micros, number, source.plugin, _plain(source.properties))
        for b in bindings
        for number, source in enumerate(b.sources, start=1)
    ]
    return _local_table(spark, rows, schema.BINDINGS)


def outputs_table(spark: SparkSession, outputs: Sequence[Output]) -> DataFrame:
    rows = [(o.output_no, o.output_name, o.plugin, _plain(o.properties)) for o in outputs]
    return _local_table(spark, rows, schema.OUTPUTS)
