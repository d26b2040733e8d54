"""One job per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions import numbers, text, times
from sluiceway.functions.json_text import json_quote
from sluiceway.operators import combine, delivery, envelope, extract, listing, profile, progress
from sluiceway.operators import routing, severity, sinks
from sluiceway.plans import tables as t
from sluiceway.session import fresh_path, prepare
from sluiceway.sources import heartbeat as hb
from sluiceway.sources import lines, sensors, tail
from sluiceway.streaming import run, writers
from sluiceway.streaming import table_sink as committed

Query = Callable[[SparkSession, str], DataFrame]

_registry: dict[str, Query] = {}


def query(job: Query) -> Query:
    """Register a job under its name; session settings are put in place before it."""

    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return job(prepare(spark), folder)

    _registry[job.__name__] = prepared
    return prepared


def all_queries() -> dict[str, Query]:
    return dict(_registry)


# --- lines ---------------------------------------------------------------------


def _document_lines(spark: SparkSession, folder: str) -> DataFrame:
    documents = t.table(spark, folder, "documents")
    return lines.split_lines(documents, keys=["doc_id"])


@query
def scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.scan_lines(t.table(spark, folder, "documents"), keys=["doc_id"])


@query
def resume_scan(spark: SparkSession, folder: str) -> DataFrame:
    files = t.log_files(spark, folder)
    first_line = F.octet_length(F.substring_index("text", "\n", 1)).cast("bigint") + 1
    # German logs were rotated since, French ones truncated, Spanish ones never read.
    saved = (
        files.filter(F.col("lang") != "es")
        .select(
            progress.checkpoint_key(F.col("path")).alias("checkpoint_key"),
            F.when(F.col("lang") == "de", F.col("inode") + 1)
            .otherwise(F.col("inode"))
            .alias("inode"),
            F.when(F.col("lang") == "fr", F.col("size") + 1).otherwise(first_line).alias("offset"),
        )
    )
    resumed = progress.resume_offsets(files, saved)
    return lines.scan_lines(resumed, keys=["path", "inode", "start"], start="start").drop("line_no")


@query
def drop_blank(spark: SparkSession, folder: str) -> DataFrame:
    # A sentence end before a line end becomes a blank line.
    files = t.table(spark, folder, "documents").withColumn(
        "text", F.replace("text", F.lit(".\n"), F.lit("\n\n"))
    )
    return extract.drop_blank(lines.split_lines(files, keys=["doc_id"]))


@query
def wrap_raw(spark: SparkSession, folder: str) -> DataFrame:
    found = _document_lines(spark, folder)
    return extract.wrap_raw(found).drop("line")


@query
def encode_payload(spark: SparkSession, folder: str) -> DataFrame:
    pages = t.table(spark, folder, "pages")
    return extract.encode_payload(pages, ["url", "html"]).select("page_id", "event_data")


@query
def regex_fields(spark: SparkSession, folder: str) -> DataFrame:
    found = _document_lines(spark, folder)
    return extract.extract_fields(found, t.LINE_PATTERN).drop("line")


@query
def regex_url(spark: SparkSession, folder: str) -> DataFrame:
    pages = t.table(spark, folder, "pages").select("page_id", "url")
    payloads = extract.extract_payload(pages, t.URL_PATTERN, line="url")
    return extract.extract_fields(payloads, t.URL_PATTERN, line="url").drop("url")


@query
def regex_match(spark: SparkSession, folder: str) -> DataFrame:
    found = _document_lines(spark, folder)
    return extract.regex_match(found, r"(?<left>\w+) \| (?<right>[a-m]+)[,.]?")


# --- envelope and time ---------------------------------------------------------


@query
def to_event(spark: SparkSession, folder: str) -> DataFrame:
    ticked = envelope.tick_assign(t.envelopes(spark, folder), t.START_US, t.MINUTE_US)
    events = envelope.to_event(
        ticked, F.col("event_name"), "event_data", F.timestamp_micros("tick_us")
    )
    return events.select(F.unix_micros("time").alias("time_us"), "event_name", "event_data")


@query
def tick_assign(spark: SparkSession, folder: str) -> DataFrame:
    events = t.envelopes(spark, folder).select("event_id", "time_us")
    return envelope.tick_assign(events, t.START_US, t.MINUTE_US)


@query
def missed_ticks(spark: SparkSession, folder: str) -> DataFrame:
    events = t.envelopes(spark, folder).select("event_name", "time_us")
    ticked = envelope.tick_assign(events, t.START_US, t.MINUTE_US)
    return envelope.missed_ticks(ticked, t.START_US, t.MINUTE_US)


@query
def heartbeat(spark: SparkSession, folder: str) -> DataFrame:
    return hb.heartbeat(t.hosts(spark, folder), t.START_US, t.SECOND_US, ticks=60)


# --- combination ---------------------------------------------------------------


@query
def union_bindings(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["tick_us", "event_name", "event_data"]
    ticked = envelope.tick_assign(t.envelopes(spark, folder), t.START_US, t.MINUTE_US)
    alive = hb.heartbeat(t.hosts(spark, folder), t.START_US, t.MINUTE_US, ticks=10)
    return combine.union_bindings(ticked.select(columns), alive.select(columns))


SOURCES = ["system", "user", "assistant"]


@query
def round_zip(spark: SparkSession, folder: str) -> DataFrame:
    sensor = F.concat(F.lit('{"conv":'), "conv_id", F.lit("}"))
    return combine.round_zip(
        t.table(spark, folder, "conversations"),
        ["conv_id"],
        SOURCES,
        source="role",
        order="turn",
        record="text",
        sensors={"sensor": sensor},
    )


@query
def merge_last(spark: SparkSession, folder: str) -> DataFrame:
    return combine.last_source(
        t.table(spark, folder, "conversations"),
        ["conv_id"],
        SOURCES[-1],
        source="role",
        order="turn",
        record="text",
    )


@query
def merge_last_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The same rounds through the zip of all sources."""
    zipped = combine.round_zip(
        t.table(spark, folder, "conversations"),
        ["conv_id"],
        SOURCES,
        source="role",
        order="turn",
        record="text",
    )
    return combine.merge_last(zipped, SOURCES)


@query
def merge_broken(spark: SparkSession, folder: str) -> DataFrame:
    """Objects whose keys all survive, beside records that are no objects."""
    top = F.concat(F.lit('{"user":'), "user_id", F.lit("}"))
    records = t.envelopes(spark, folder).select(
        "event_id",
        F.when(F.col("event_name") == "signup", F.lit("{cut")).otherwise(F.col("event_data")).alias("base"),
        F.when(F.col("event_name") == "error", F.lit("oops")).otherwise(top).alias("top"),
        F.concat(F.lit('{"no":'), "event_id", F.lit("}")).alias("last"),
    )
    return combine.merge_overlay(records, ["base", "top", "last"])


@query
def merge_overlay(spark: SparkSession, folder: str) -> DataFrame:
    top = F.concat(
        F.lit('{"user":'), "user_id", F.lit(',"k":{"was":['), "event_id", F.lit(',"'),
        "event_name", F.lit('"]}}'),
    )
    records = t.envelopes(spark, folder).select(
        "event_id",
        F.col("event_data").alias("base"),
        F.when(F.col("event_name") == "view", F.lit("")).otherwise(top).alias("top"),
    )
    return combine.merge_overlay(records, ["base", "top"])


@query
def merge_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Rounds of JSON records laid over each other, the sensor first."""
    turns = t.table(spark, folder, "conversations")
    record = F.concat(
        F.lit('{"'), "role", F.lit('":'), json_quote(F.col("text")), F.lit(',"turn":'), "turn", F.lit("}")
    )
    zipped = combine.round_zip(
        turns.select("conv_id", "role", "turn", record.alias("record")),
        ["conv_id"],
        SOURCES,
        source="role",
        order="turn",
        sensors={"sensor": F.concat(F.lit('{"conv":'), "conv_id", F.lit(',"turn":-1}'))},
    )
    return combine.merge_overlay(zipped, ["sensor", *SOURCES])


# --- routing -------------------------------------------------------------------


@query
def route_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: how many events each table receives, and over what time."""
    return (
        routing.route_exact(t.envelopes(spark, folder), t.ROUTES)
        .groupBy("database", "table")
        .agg(
            F.count("*").alias("n_events"),
            F.min("time_us").alias("first_us"),
            F.max("time_us").alias("last_us"),
            F.sum(F.octet_length("event_data")).alias("n_bytes"),
        )
    )


@query
def route_shared(spark: SparkSession, folder: str) -> DataFrame:
    """Routes numbered by event."""
    return routing.route_exact(t.envelopes(spark, folder), t.SHARED_ROUTES).select(
        "event_id", "route_no", "database", "table"
    )


@query
def route_many(spark: SparkSession, folder: str) -> DataFrame:
    """A long list of patterns."""
    events = t.envelopes(spark, folder).select("event_id", "event_name")
    return routing.route_template(events, t.MANY_ROUTES).select("event_id", "route_no", "database", "table")


@query
def route_errors(spark: SparkSession, folder: str) -> DataFrame:
    return routing.route_errors(t.envelopes(spark, folder), t.ROUTES).select(
        "event_id", "route_no", "target", "error_code", "stopped"
    )


@query
def route_table(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as events by customer, with a table of routes that grows with the customers."""
    name = F.concat(F.lit("customer."), "o_custkey")
    orders = t.table(spark, folder, "orders").select("o_orderkey", name.alias("event_name"))
    match = F.concat(F.lit("customer."), "c_custkey").alias("event_name_match")
    bad = F.col("c_nationkey") < 5
    targets = [
        F.concat_ws("/", F.lit("all"), "c_custkey"),
        F.concat_ws("/", "c_mktsegment", F.when(bad, F.lit("x/y")).otherwise(F.lit("orders"))),
        F.concat_ws("/", F.lit("nation"), "c_nationkey"),
    ]
    numbered = [F.struct(F.lit(n).alias("route_no"), c.alias("target")) for n, c in enumerate(targets)]
    routes = t.table(spark, folder, "customer").select(match, F.inline(F.array(*numbered)))
    return routing.route_exact(orders, routes).drop("target", "event_name")


def _order_patterns(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as events by customer and status, and a table of route patterns that grows with the customers."""
    name = F.concat(F.lit("order."), "o_custkey", F.lit("."), "o_orderstatus")
    orders = t.table(spark, folder, "orders").select("o_orderkey", name.alias("event_name"))
    nation = F.col("c_nationkey")

    def entry(no: int, match: F.Column, target: F.Column):
        return F.struct(
            (F.col("c_custkey") * 3 + no).alias("route_no"), match.alias("event_name_match"), target.alias("target")
        )

    begins = entry(1, F.concat(F.lit("order."), "c_custkey", F.lit(".*")), F.concat(F.lit("nation"), nation, F.lit("/%E")))
    late = F.when(nation == 1, F.lit("x/y/z")).otherwise(F.concat(F.lit("late/"), "c_custkey"))
    ends = entry(2, F.concat(F.lit("*"), "c_custkey", F.lit(".F")), late)
    holds = entry(3, F.concat(F.lit("*."), "c_custkey", F.lit(".*")), F.concat(F.lit("%E/"), "c_custkey"))
    listed = F.array_compact(F.array(begins, F.when(nation < 5, ends), F.when(nation > 20, holds)))
    return orders, t.table(spark, folder, "customer").select(F.inline(listed))


@query
def route_patterns(spark: SparkSession, folder: str) -> DataFrame:
    orders, routes = _order_patterns(spark, folder)
    return routing.route(orders, routes).drop("event_name")


@query
def unrouted_patterns(spark: SparkSession, folder: str) -> DataFrame:
    orders, routes = _order_patterns(spark, folder)
    return routing.unrouted(orders, routes.filter(~F.col("event_name_match").startswith("order.")))


@query
def routed(spark: SparkSession, folder: str) -> DataFrame:
    return routing.routed(t.envelopes(spark, folder), t.ROUTES).select("event_id", "event_name")


@query
def unrouted(spark: SparkSession, folder: str) -> DataFrame:
    return routing.unrouted(t.envelopes(spark, folder), t.ROUTES).select("event_id", "event_name")


@query
def route_template(spark: SparkSession, folder: str) -> DataFrame:
    events = t.envelopes(spark, folder).select("event_id", "event_name")
    return routing.route_template(events, t.WILDCARD_ROUTES).drop("event_name")


@query
def parse_target(spark: SparkSession, folder: str) -> DataFrame:
    nation = F.col("c_nationkey")
    target = (
        F.when(nation < 5, F.col("c_mktsegment"))
        .when(nation > 20, F.concat_ws("/", "c_mktsegment", "c_name", "c_nationkey"))
        .when(nation == 10, F.concat(F.lit("/"), "c_name"))
        .otherwise(F.concat_ws("/", "c_mktsegment", "c_name"))
    )
    customers = t.table(spark, folder, "customer").select("c_custkey", target.alias("target"))
    return routing.parse_target(customers).drop("error_message")


@query
def routes_from_properties(spark: SparkSession, folder: str) -> DataFrame:
    def entry(key: str, *values: F.Column):
        return F.struct(F.lit(key).alias("key"), F.array(*values).alias("values"))

    crm = F.concat(F.lit("crm/"), "c_mktsegment")
    outputs = t.table(spark, folder, "customer").select(
        "c_custkey",
        F.array(
            entry("host", F.col("c_name")),
            entry("route", F.col("c_mktsegment"), crm),
            F.when(F.col("c_acctbal") < 2000, entry("route", F.col("c_name"))).otherwise(
                entry("route", F.lit("signup"), F.concat(F.lit("new/"), "c_name"))
            ),
            entry("queue_maxlen", F.lit("100")),
        ).alias("properties"),
    )
    return routing.routes_from_properties(outputs)


@query
def target_broadcast(spark: SparkSession, folder: str) -> DataFrame:
    failing = {
        1: F.when(F.col("event_name") == "error", F.lit("EINVAL")),
        2: F.when(F.col("value") > 60, F.lit("EIO")),
        3: F.lit(None),
    }
    events = t.envelopes(spark, folder).select("event_id", "event_name", "value")
    offered = routing.offer_to_outputs(events, t.OUTPUTS, lambda o: failing[o.output_no])
    return routing.per_output(offered.drop("event_name", "value")).withColumn(
        "output_no", F.col("output_no").cast("bigint")
    )


@query
def severity_filter(spark: SparkSession, folder: str) -> DataFrame:
    events = t.envelopes(spark, folder).select(
        "event_id", t.level_of(F.col("event_name")).alias("level")
    )
    return severity.severity_filter(events, "INFO")


@query
def unknown_severity(spark: SparkSession, folder: str) -> DataFrame:
    events = t.envelopes(spark, folder).select(
        "event_id", t.level_of(F.col("event_name")).alias("level")
    )
    return severity.unknown_severity(events)


@query
def list_bindings(spark: SparkSession, folder: str) -> DataFrame:
    turns = t.table(spark, folder, "conversations")
    name = F.concat(F.lit("chat."), "conv_id")
    bindings = turns.select(
        name.alias("event_name"),
        F.array_position(F.lit(SOURCES), F.col("role")).alias("source_no"),
        F.col("role").alias("source_name"),
    )
    routes = turns.select(
        name.alias("event_name_match"),
        F.lit(1).alias("route_no"),
        F.concat(F.lit("chat/"), "conv_id").alias("target"),
    )
    return listing.list_bindings(bindings, routes)


@query
def count_bindings(spark: SparkSession, folder: str) -> DataFrame:
    return listing.count_bindings(list_bindings(spark, folder))


# --- delivery ------------------------------------------------------------------


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return routing.route_exact(t.envelopes(spark, folder), t.ROUTES).select(
        "database",
        "table",
        "event_data",
        t.http_status(F.col("event_id")).alias("http_status"),
        t.attempt(F.col("event_id")).alias("attempt"),
    )


@query
def delivery_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.delivery_outcome(_deliveries(spark, folder))


@query
def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.dead_letters(_deliveries(spark, folder))


@query
def redeliver(spark: SparkSession, folder: str) -> DataFrame:
    failed = delivery.dead_letters(_deliveries(spark, folder))
    orders = t.table(spark, folder, "orders").select(
        F.concat(F.lit("order."), "o_orderstatus").alias("event_name"),
        extract.json_object([("key", F.col("o_orderkey").cast("string"))]).alias("event_data"),
    )
    fresh = routing.route_exact(orders, t.ORDER_ROUTES).select("database", "table", "event_data")
    return delivery.redeliver(failed, fresh, max_attempts=3).withColumn(
        "attempt", F.col("attempt").cast("bigint")
    )


@query
def insert_payload(spark: SparkSession, folder: str) -> DataFrame:
    delivered = routing.route_exact(t.envelopes(spark, folder), t.ROUTES)
    return delivery.insert_payload(delivered).select("event_id", "route_no", "body")


@query
def kafka_shape(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.kafka_shape(t.envelopes(spark, folder), key=F.col("user_id"))


@query
def table_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "tables")
    delivered = routing.route_exact(t.envelopes(spark, folder), t.ROUTES)
    sinks.write_tables(delivered.select("database", "table", "event_id", "event_data"), path)
    return sinks.read_tables(spark, path)


@query
def file_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    events = t.envelopes(spark, folder).select("event_id", "event_name", "event_data")
    sinks.write_json(events, path)
    return spark.read.schema("event_id bigint, event_name string, event_data string").json(path)


# --- files and streams ---------------------------------------------------------


@query
def tail_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the documents as log files, read back by the log source."""
    path = fresh_path(spark, "logs")
    _document_lines(spark, folder).select("line").write.text(path)
    return tail.read_logs(spark, f"{path}/part-*").select("line", "byte_length")


@query
def stream_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream of files, routed into tables batch by batch until drained."""
    path, checkpoint = fresh_path(spark, "streamed"), fresh_path(spark, "checkpoint")
    schema = t.table(spark, folder, "events").schema
    # As a glob, since a stream takes a plain path for a folder, and this may be one file.
    arriving = spark.readStream.schema(schema).parquet(f"{folder}/{{events.parquet}}")
    events = arriving.select(
        "event_id", F.col("event_type").alias("event_name"), F.col("props").alias("event_data")
    )
    started = run.start(events, writers.table_writer(path, t.ROUTES), checkpoint, drain=True)
    started.awaitTermination()
    return sinks.read_tables(spark, path).select("database", "table", "event_id", "event_data")


@query
def committed_sink(spark: SparkSession, folder: str) -> DataFrame:
    """The same stream through the sink that commits batch by batch."""
    committed.register(spark)
    path, checkpoint = fresh_path(spark, "committed"), fresh_path(spark, "checkpoint")
    schema = t.table(spark, folder, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{folder}/{{events.parquet}}")
    events = arriving.select(
        "event_id", F.col("event_type").alias("event_name"), F.col("props").alias("event_data")
    )
    routed = routing.route_exact(events, t.ROUTES).select("database", "table", "event_id", "event_data")
    out = routed.writeStream.format("event_tables").option("checkpointLocation", checkpoint).option("path", path)
    out.trigger(availableNow=True).start().awaitTermination()
    return committed.read_committed(spark, path)


# --- progress ------------------------------------------------------------------


@query
def checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    files = t.log_files(spark, folder)
    found = lines.scan_lines(files, keys=["path", "inode"])
    # English logs had been read up to the end of their first line.
    previous = files.filter(F.col("lang") == "en").select(
        progress.checkpoint_key(F.col("path")).alias("checkpoint_key"),
        "inode",
        (F.octet_length(F.substring_index("text", "\n", 1)) + 1).cast("bigint").alias("offset"),
    )
    return progress.checkpoints(found, previous)


@query
def source_lag(spark: SparkSession, folder: str) -> DataFrame:
    """How far each log lies behind its file: English ones stopped after a line, German ones were rotated, French ones cut."""
    files = t.log_files(spark, folder)
    read = progress.checkpoints(lines.scan_lines(files, keys=["path", "inode"]))
    first_line = (F.octet_length(F.substring_index("text", "\n", 1)) + 1).cast("bigint")
    stopped = files.filter("lang = 'en'").select(
        progress.checkpoint_key(F.col("path")).alias("checkpoint_key"), first_line.alias("_stop")
    )
    read = read.join(stopped, "checkpoint_key", "left")
    read = read.withColumn("offset", F.least("offset", F.coalesce("_stop", "offset"))).drop("_stop")
    now = files.select(
        "path",
        F.when(F.col("lang") == "de", F.col("inode") + 1).otherwise(F.col("inode")).alias("inode"),
        F.when(F.col("lang") == "fr", F.lit(1).cast("bigint")).otherwise(F.col("size")).alias("size"),
    )
    return progress.behind(read, now)


# --- columns -------------------------------------------------------------------


@query
def field_profile(spark: SparkSession, folder: str) -> DataFrame:
    events = t.table(spark, folder, "events")
    orders = t.table(spark, folder, "orders")
    return profile.field_profile(events, ["event_type", "user_id", "value", "props"]).unionByName(
        profile.field_profile(orders, ["o_orderstatus", "o_orderkey", "o_orderpriority"])
    )


@query
def text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    body = F.col("text")
    return t.table(spark, folder, "documents").select(
        "doc_id",
        F.md5(text.ascii_lower(body)).alias("lower_md5"),
        F.md5(text.ascii_upper(body)).alias("upper_md5"),
        F.md5(text.strip_shell(body)).alias("shell_md5"),
        F.md5(text.replace_all(body, "th", "thth")).alias("replaced_md5"),
        text.strip_trailing_slashes(F.concat_ws("/", "source", "lang", F.lit("/"))).alias("folder"),
    )


@query
def text_match(spark: SparkSession, folder: str) -> DataFrame:
    body = F.col("text")
    return t.table(spark, folder, "documents").select(
        "doc_id",
        F.startswith(body, F.lit("Th")).alias("begins"),
        F.endswith(body, F.lit(".")).alias("ends"),
        F.contains(body, F.lit("é")).alias("includes"),
        text.includes_ignoring_case(body, "THE").alias("includes_i"),
        text.find_byte(body, "z").cast("bigint").alias("first_z"),
        text.find_last_byte(body, ".").cast("bigint").alias("last_dot"),
        text.compare_bytes(body, F.lit("Of")).cast("bigint").alias("order_to_of"),
    )


@query
def split_join(spark: SparkSession, folder: str) -> DataFrame:
    words = text.split_on(F.col("text"), " ")
    return t.table(spark, folder, "documents").select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_words"),
        F.md5(text.join_list(words, ", ")).alias("list_md5"),
        text.join_set(words, "|").alias("word_set"),
    )


@query
def template_format(spark: SparkSession, folder: str) -> DataFrame:
    values = [F.col("c_name"), F.concat(F.lit("$2"), "c_custkey"), F.col("c_mktsegment")]
    return t.table(spark, folder, "customer").select(
        "c_custkey", text.fill("$0 <$1> buys $2, $0$2; ten is $10", values).alias("line")
    )


@query
def metric_format(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    return t.table(spark, folder, "orders").select(
        "o_orderkey",
        numbers.metric_text(price).alias("price"),
        numbers.metric_text(price / 1e6).alias("millions"),
        numbers.metric_text(price / -1e10).alias("tiny"),
        numbers.metric_text(price * 2e6).alias("huge"),
        numbers.number_text(price).alias("plain"),
        numbers.number_text(price / 7.0).alias("seventh"),
        F.col("o_custkey").cast("string").alias("customer"),
        (F.col("o_orderstatus") == "O").cast("string").alias("is_open"),
    )


@query
def time_format(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("time_us")
    later = times.days_after(at, 1.25)
    week = F.lit(times.MICROS_PER_WEEK)
    return t.envelopes(spark, folder).select(
        "event_id",
        times.time_text(at).alias("at"),
        times.time_text(at, "%Y%m%dT%H:%M, day %j").alias("compact"),
        later.alias("later_us"),
        times.time_text(later).alias("later"),
        (at > F.lit(t.START_US) + week).alias("after_first_week"),
        envelope.whole(at - F.lit(t.START_US), times.MICROS_PER_HOUR).alias("hours"),
    )


@query
def json_sensor(spark: SparkSession, folder: str) -> DataFrame:
    events = t.envelopes(spark, folder).select("event_id", "event_name", "event_data")
    return sensors.parse_records(events, "k bigint, missing string").drop("event_data")


@query
def system_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics that hosts report as JSON, read back as columns."""
    disk = F.struct(F.lit("/").alias("mount"), (F.col("s_suppkey") * 1000).alias("used"), F.lit(5).alias("free"))
    report = F.struct(
        F.col("s_name").alias("hostname"),
        (F.col("s_acctbal") / 2).alias("cpu_user"),
        F.col("s_acctbal").alias("load_1m"),
        (F.col("s_suppkey") * 4096).alias("memory_used"),
        F.when(F.col("s_nationkey") < 20, F.array(disk)).alias("disks"),
    )
    reports = t.table(spark, folder, "supplier").select("s_suppkey", F.to_json(report).alias("event_data"))
    stats = sensors.parse_records(reports, sensors.SYSTEM_STATS)
    first = F.get("disks", F.lit(0))
    return stats.select(
        "s_suppkey", "hostname", "cpu_user", "cpu_system", "load_1m", "memory_used", "memory_free",
        first["mount"].alias("mount"), first["used"].alias("used"), first["free"].alias("free"),
    )


# --- the whole collection job --------------------------------------------------


@query
def collect_and_route(spark: SparkSession, folder: str) -> DataFrame:
    """Heartbeats and access logs through extraction, envelope and routing, in one job."""
    columns = ["tick_us", "event_name", "event_data"]
    alive = hb.heartbeat(
        t.hosts(spark, folder), t.START_US, t.SECOND_US, ticks=10, event_name="host.alive"
    )
    found = _document_lines(spark, folder)
    logs = extract.extract_payload(found, t.LINE_PATTERN).select(
        F.lit(t.START_US + t.SECOND_US).alias("tick_us"),
        F.lit("text.lines").alias("event_name"),
        "event_data",
    )
    events = combine.union_bindings(alive.select(columns), logs)
    return (
        routing.route_exact(events, t.LOG_ROUTES)
        .groupBy("database", "table")
        .agg(
            F.count("*").alias("n_events"),
            F.max("tick_us").alias("last_tick_us"),
            F.sum(F.octet_length("event_data")).alias("n_bytes"),
        )
    )
