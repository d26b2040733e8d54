"""Sources and outputs under plug-in names."""

from __future__ import annotations

import socket
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.config import ConfigError, Output, Source, first_value, routes_of
from sluiceway.functions.patterns import compile_pattern
from sluiceway.operators.extract import extract_payload, record_of, wrap_raw
from sluiceway.sources.heartbeat import heartbeat_stream, host_record
from sluiceway.sources.sensors import stream_records
from sluiceway.sources.tail import tail_logs
from sluiceway.streaming.writers import Send, delivery_writer, kafka_writer, line_writer, table_writer

# A source takes the session and its configuration and gives its records as a
# table or a stream with ``event_data``; an output gives a foreachBatch function.
SourcePlugin = Callable[[SparkSession, Source], DataFrame]
OutputPlugin = Callable[[Output], Callable[[DataFrame, int], None]]
# For an event of several sources: records that keep their place (``path``,
# ``byte_offset``, ``record``), or a sensor, which has a fresh record in every round.
RecordsPlugin = Callable[[SparkSession, Source], DataFrame]
SensorPlugin = Callable[[Source], Column]


class Registry:
    """Plug-ins by name. Unknown names fail on the driver, before any job."""

    def __init__(self) -> None:
        self._sources: dict[str, SourcePlugin] = {}
        self._records: dict[str, RecordsPlugin] = {}
        self._sensors: dict[str, SensorPlugin] = {}
        self._outputs: dict[str, OutputPlugin] = {}

    def add_source(
        self,
        name: str,
        plugin: SourcePlugin,
        records: RecordsPlugin | None = None,
        sensor: SensorPlugin | None = None,
    ) -> None:
        self._sources[name] = plugin
        if records:
            self._records[name] = records
        if sensor:
            self._sensors[name] = sensor

    def add_output(self, name: str, plugin: OutputPlugin) -> None:
        self._outputs[name] = plugin

    def source(self, spark: SparkSession, config: Source) -> DataFrame:
        return _named(self._sources, config.plugin)(spark, config)

    def sensor(self, config: Source) -> Column | None:
        """The record of a sensor; None for any other source."""
        _named(self._sources, config.plugin)
        plugin = self._sensors.get(config.plugin)
        return plugin(config) if plugin else None

    def records(self, spark: SparkSession, config: Source) -> DataFrame:
        """``path``, ``byte_offset`` and ``record`` of a source that is no sensor."""
        _named(self._sources, config.plugin)
        if config.plugin not in self._records:
            raise ConfigError("EINVAL", f"a {config.plugin} source cannot be lined up with others")
        return self._records[config.plugin](spark, config)

    def output(self, config: Output) -> Callable[[DataFrame, int], None]:
        return _named(self._outputs, config.plugin)(config)


def _named(plugins: Mapping[str, Callable], name: str) -> Callable:
    if name not in plugins:
        raise ConfigError("PLUGIN_NOT_FOUND", f"no plugin called {name}")
    return plugins[name]


def _needed(config: Source | Output, key: str) -> str:
    value = first_value(config.properties, key)
    if not value:
        raise ConfigError("EINVAL", f"a {config.plugin} needs a property {key}")
    return value


# Options of the log source that a configuration may set.
_TAIL_OPTIONS = ("progressPath", "maxBytesPerBatch", "failOnDataLoss", "lossPath", "splitBytes", "forgetMissing")


def _tailed(spark: SparkSession, config: Source) -> DataFrame:
    path = _needed(config, "logfile")
    given = {key: first_value(config.properties, key) for key in _TAIL_OPTIONS}
    return tail_logs(spark, path, **{key: value for key, value in given.items() if value is not None})


def _logfile(spark: SparkSession, config: Source) -> DataFrame:
    lines = _tailed(spark, config)
    pattern = first_value(config.properties, "regex")
    return wrap_raw(lines) if pattern is None else extract_payload(lines, pattern)


def _log_records(spark: SparkSession, config: Source) -> DataFrame:
    lines = _tailed(spark, config)
    pattern = first_value(config.properties, "regex")
    ready = None if pattern is None else compile_pattern(spark, pattern)
    return lines.select("path", "byte_offset", record_of(F.col("line"), ready).alias("record"))


def _host(config: Source) -> tuple[str, str]:
    hostname = first_value(config.properties, "hostname") or socket.gethostname()
    return hostname, first_value(config.properties, "fqdn") or ""


def _hostname(spark: SparkSession, config: Source) -> DataFrame:
    return heartbeat_stream(spark, *_host(config))


def _host_record(config: Source) -> Column:
    return host_record(*map(F.lit, _host(config)))


def _json_files(spark: SparkSession, config: Source) -> DataFrame:
    return stream_records(spark, _needed(config, "path"), "")


def _tables(config: Output) -> Callable[[DataFrame, int], None]:
    unrouted = first_value(config.properties, "unrouted")
    return table_writer(_needed(config, "path"), routes_of(config.properties), unrouted)


def _files(config: Output) -> Callable[[DataFrame, int], None]:
    return line_writer(_needed(config, "path"))


def _kafka(config: Output) -> Callable[[DataFrame, int], None]:
    return kafka_writer(_needed(config, "servers"))


def delivery_output(send: Send, max_attempts: int = 3) -> OutputPlugin:
    """An output that sends request bodies with a function of the user."""

    def plugin(config: Output) -> Callable[[DataFrame, int], None]:
        return delivery_writer(_needed(config, "path"), routes_of(config.properties), send, max_attempts)

    return plugin


def default_registry(send: Send | None = None) -> Registry:
    """The plug-ins of this library; ``delivery`` only with a function that sends."""
    registry = Registry()
    registry.add_source("logfile", _logfile, records=_log_records)
    registry.add_source("hostname", _hostname, sensor=_host_record)
    registry.add_source("json", _json_files)
    registry.add_output("table", _tables)
    registry.add_output("file", _files)
    registry.add_output("kafka", _kafka)
    if send:
        registry.add_output("delivery", delivery_output(send))
    return registry
