"""Sending events to targets by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.config import Output, Route, routes_table
from sluiceway.operators import name_index

# Lists of more patterns are looked up by event name; shorter ones are tested inside the row.
SHORT = 16

BAD_TARGET = "target must be written as database/table"


def _parts(target: Column) -> Column:
    return F.split(target, "/", -1)


def _is_bad(target: Column) -> Column:
    return F.size(_parts(target)) != 2


def parse_target(df: DataFrame, target: str = "target") -> DataFrame:
    """Add ``database``, ``table`` and, where the target has not two parts, the error."""
    parts, bad = _parts(F.col(target)), _is_bad(F.col(target))
    return df.withColumns(
        {
            "database": F.when(~bad, parts[0]),
            "table": F.when(~bad, parts[1]),
            "error_code": F.when(bad, F.lit("EINVAL")),
            "error_message": F.when(bad, F.lit(BAD_TARGET)),
        }
    )


def resolve_routes(routes: DataFrame) -> DataFrame:
    """Parsed routes with ``stopped``: true behind the first bad route of the same event.

    The first bad route is found by an aggregate, which combines before its
    shuffle, and joined back; a window would put all routes of one event in one
    task.
    """
    parsed = parse_target(routes)
    first_bad = (
        parsed.filter(F.col("error_code").isNotNull())
        .groupBy("event_name_match")
        .agg(F.min("route_no").alias("first_bad"))
    )
    return (
        parsed.join(first_bad, "event_name_match", "left")
        .withColumn("stopped", F.coalesce(F.col("route_no") > F.col("first_bad"), F.lit(False)))
        .drop("first_bad")
    )


def _resolved(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    """Parsed routes with ``stopped``, of a list as of a table.

    Of a list all is known on the driver. It becomes a table of known size, so whether it
    is broadcast is left to Spark.
    """
    if isinstance(routes, DataFrame):
        return resolve_routes(routes)
    first_bad: dict[str, int] = {}
    for route in sorted(routes, key=lambda r: r.route_no):
        if len(route.target.split("/")) != 2:
            first_bad.setdefault(route.event_name_match, route.route_no)
    stopped = [r.route_no > first_bad.get(r.event_name_match, r.route_no) for r in routes]
    return parse_target(routes_table(events.sparkSession, routes, stopped))


def _on_name(events: DataFrame, routes: DataFrame, name: str = "event_name_match") -> DataFrame:
    """Events with the columns of each route of their name; these replace columns of the same names."""
    new = [c for c in routes.columns if c != name]
    kept = [F.col(f"e.`{c}`") for c in events.columns if c not in new]
    joined = events.alias("e").join(routes.alias("r"), F.col("e.event_name") == F.col(f"r.{name}"))
    return joined.select(*kept, *[F.col(f"r.`{c}`") for c in new])


def route_exact(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    """Events under each (database, table) they are delivered to, one row per route.

    By name alone: ``*`` and ``%E`` are plain text here; ``route`` takes them as patterns. The columns
    ``route_no``, ``target``, ``database`` and ``table`` replace any of the events'.
    """
    good = _resolved(events, routes).filter(F.col("error_code").isNull() & ~F.col("stopped"))
    return _on_name(events, good.drop("error_code", "error_message", "stopped"))


def route_errors(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    """The quarantine: events at a bad route, and those stopped behind it; routes may hold patterns."""
    if isinstance(routes, DataFrame) or has_patterns(routes):
        bad, name = _resolved_by_name(events, routes), "event_name"
    else:
        bad, name = _resolved(events, routes), "event_name_match"
    bad = bad.filter(F.col("error_code").isNotNull() | F.col("stopped"))
    return _on_name(events, bad.drop("database", "table"), name)


def _as_table(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    if isinstance(routes, DataFrame):
        return routes.select("route_no", "event_name_match", "target")
    return routes_table(events.sparkSession, routes)


def _fitting(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    """Every name that occurs, with each route that fits it."""
    names = events.select("event_name").filter("event_name IS NOT NULL").distinct()
    local = not isinstance(routes, DataFrame)
    if not local:
        # Names are short, and each of them looks up many keys: more tasks than their bytes ask for.
        names = names.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "event_name")
    return name_index.fitting(names, "event_name", _as_table(events, routes), "event_name_match", local)


def _resolved_by_name(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    """Parsed routes per event name, by patterns, with ``%E`` filled in and ``stopped`` behind the first bad one."""
    fits = _fitting(events, routes).drop("event_name_match")
    parsed = parse_target(fits.withColumn("target", F.expr("replace(target, '%E', event_name)")))
    # One window, so that the index is searched once; it holds the routes of one name, and sorts on disk if they are many.
    first_bad = F.expr("min(CASE WHEN error_code IS NOT NULL THEN route_no END) OVER (PARTITION BY event_name)")
    return parsed.withColumn("stopped", F.coalesce(F.col("route_no") > first_bad, F.lit(False)))


def has_patterns(routes: Sequence[Route]) -> bool:
    return any("*" in r.event_name_match or "%E" in r.target for r in routes)


def _fits_any(routes: Sequence[Route]) -> Column:
    """Whether the event name fits a route of a list."""
    fits = [_fits(r, F.col("event_name")) for r in routes if "*" in r.event_name_match]
    named = sorted({r.event_name_match for r in routes if "*" not in r.event_name_match})
    return F.coalesce(reduce(or_, fits, F.col("event_name").isin(named)), F.lit(False))


def _route_names(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    """The names that have a route."""
    if isinstance(routes, DataFrame) or has_patterns(routes):
        return _fitting(events, routes).select("event_name").distinct()
    names = {r.event_name_match: r for r in routes}
    table = routes_table(events.sparkSession, list(names.values()))
    return table.select(F.col("event_name_match").alias("event_name"))


def routed(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    """Events that have a route, each once; routes may hold patterns."""
    if _is_short(routes) and has_patterns(routes):
        return events.filter(_fits_any(routes))
    return events.join(_route_names(events, routes), "event_name", "left_semi").select(*_columns(events))


def unrouted(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    """Events that have none, those without a name among them; routes may hold patterns."""
    if _is_short(routes) and has_patterns(routes):
        return events.filter(~_fits_any(routes))
    return events.join(_route_names(events, routes), "event_name", "left_anti").select(*_columns(events))


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def _is_short(routes: Sequence[Route] | DataFrame) -> bool:
    """Whether routes are a list that is tested inside the row, which reads the events once only."""
    return not isinstance(routes, DataFrame) and len(routes) <= SHORT


def like_pattern(match: str) -> str:
    """A name pattern, where ``*`` stands for any run, as a LIKE pattern."""
    return re.sub(r"([\\%_])", r"\\\1", match).replace("*", "%")


def fill_template(target: str, event_name: Column) -> Column:
    """The target with ``%E`` replaced by the event name."""
    if "%E" not in target:
        return F.lit(target)
    return F.replace(F.lit(target), F.lit("%E"), event_name)


def _fits(route: Route, name: Column) -> Column:
    if "*" in route.event_name_match:
        return name.like(like_pattern(route.event_name_match))
    return name == route.event_name_match


def _is_bad_for(route: Route, name: Column) -> Column | None:
    """Whether the filled target has not two parts; None if it always has."""
    places = route.target.count("%E")
    slashes = route.target.count("/")
    if not places:
        return None if slashes == 1 else F.lit(True)
    in_name = F.octet_length(name) - F.octet_length(F.replace(name, F.lit("/"), F.lit("")))
    return F.lit(slashes) + F.lit(places) * in_name != 1


def _each_match(df: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """One row per fitting route before the first bad one among these, with its target.

    A fitting bad route is kept too, the first one only, for the caller to see.
    """
    name = F.col("event_name")
    entries = F.array(
        *[
            F.when(
                _fits(route, name),
                F.struct(
                    F.lit(route.route_no).alias("route_no"),
                    fill_template(route.target, name).alias("target"),
                ),
            )
            for route in routes
        ]
    )
    doubtful = [(r, bad) for r in routes if (bad := _is_bad_for(r, name)) is not None]
    found = df.select("*", F.explode(F.array_compact(entries)).alias("_r"))
    out = found.select(*df.columns, "_r.route_no", "_r.target")
    if not doubtful:
        return out
    stops = [F.when(_fits(r, name) & bad, F.lit(r.route_no)) for r, bad in doubtful]
    # The null keeps ``least``, which skips nulls, at two arguments or more.
    first_bad = F.least(*stops, F.lit(None).cast("int"), F.lit(None).cast("int"))
    return out.filter(F.col("route_no") <= F.coalesce(first_bad, F.lit(2**31 - 1)))


def route_template(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    """Events under each target of a route whose ``*`` pattern fits, with ``%E`` filled in.

    A list of up to ``SHORT`` routes is tested inside the row, so this reads its input once and neither joins
    nor shuffles. A longer list, or a table of routes, is looked up once per event name and joined
    back by name; that reads the names of the events before. The columns ``route_no``, ``target``, ``database`` and
    ``table`` replace any of the events'; events without a name fit nothing.
    """
    if _is_short(routes):
        rest = events.drop("route_no", "target", "database", "table")
        hits = _each_match(rest, sorted(routes, key=lambda r: r.route_no))
        parts = _parts(F.col("target"))
        return hits.filter(~_is_bad(F.col("target"))).withColumns({"database": parts[0], "table": parts[1]})
    good = _resolved_by_name(events, routes).filter(F.col("error_code").isNull() & ~F.col("stopped"))
    return _on_name(events, good.drop("error_code", "error_message", "stopped"), "event_name")


def reads_twice(routes: Sequence[Route] | DataFrame) -> bool:
    """Whether ``route`` goes over the events more than once."""
    return not _is_short(routes) and (isinstance(routes, DataFrame) or has_patterns(routes))


def route(events: DataFrame, routes: Sequence[Route] | DataFrame) -> DataFrame:
    """Events under each of their targets, by names, or by patterns where there are any, or may be in a table."""
    if isinstance(routes, DataFrame) or has_patterns(routes):
        return route_template(events, routes)
    return route_exact(events, routes)


def offer_to_outputs(
    events: DataFrame, outputs: Sequence[Output], outcome: Callable[[Output], Column]
) -> DataFrame:
    """Offer each event to every output.

    Adds ``deliveries``, one entry per output in order, and ``reported_error``,
    the error of the last output that failed. ``outcome`` gives the error code of
    an output as a column, null for success. A failing output stops no other.
    """
    entries = [
        F.struct(
            F.lit(o.output_no).alias("output_no"),
            F.lit(o.output_name).alias("output_name"),
            outcome(o).cast("string").alias("error_code"),
        )
        for o in sorted(outputs, key=lambda o: o.output_no)
    ]
    failed = F.filter(F.col("deliveries"), lambda d: d["error_code"].isNotNull())
    return events.withColumn("deliveries", F.array(*entries)).withColumn(
        "reported_error", F.try_element_at(failed, F.lit(-1))["error_code"]
    )


def per_output(offered: DataFrame) -> DataFrame:
    """One row per event and output."""
    kept = [c for c in offered.columns if c != "deliveries"]
    return offered.select(*kept, F.inline("deliveries"))


def routes_from_properties(outputs: DataFrame) -> DataFrame:
    """Routes out of the ``properties`` of an outputs table, one row per route property.

    A property without exactly two values becomes a row with an error.
    """
    listed = F.filter(F.col("properties"), lambda p: p["key"] == "route")
    kept = [c for c in outputs.columns if c != "properties"]
    out = outputs.select(*kept, F.posexplode(listed).alias("_pos", "_route"))
    values = F.col("_route.values")
    bad = F.coalesce(F.size(values), F.lit(0)) != 2
    return out.select(
        *kept,
        (F.col("_pos") + 1).cast("bigint").alias("route_no"),
        F.when(~bad, values[0]).alias("event_name_match"),
        F.when(~bad, values[1]).alias("target"),
        F.when(bad, F.lit("EINVAL")).alias("error_code"),
    )
