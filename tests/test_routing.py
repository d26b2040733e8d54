import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sluiceway import config
from sluiceway.config import Binding, ConfigError, Output, Property, Route, Source
from sluiceway.operators import delivery, listing, routing, severity, sinks
from sluiceway.sources.registry import default_registry


def events(spark, *names):
    rows = [(i, n, f'{{"i":{i}}}') for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "event_id int, event_name string, event_data string")


ROUTES = [
    Route(1, "a", "db/a"),
    Route(2, "a", "db/a2"),
    Route(3, "a", "bad"),
    Route(4, "a", "db/late"),
    Route(5, "b", "/b"),
    Route(6, "c", "x/y/z"),
]


@pytest.fixture(params=["list", "table"])
def routes(request, spark):
    return config.routes_table(spark, ROUTES) if request.param == "table" else ROUTES


def test_exact_routes(spark, routes):
    frame = events(spark, "a", "b", "c", "A", "none", "a")
    got = sorted(
        (r.event_id, r.route_no, r.database, r.table)
        for r in routing.route_exact(frame, routes).collect()
    )
    assert got == [
        (0, 1, "db", "a"),
        (0, 2, "db", "a2"),
        (1, 5, "", "b"),
        (5, 1, "db", "a"),
        (5, 2, "db", "a2"),
    ]
    bad = sorted(
        (r.event_id, r.route_no, r.error_code, r.stopped)
        for r in routing.route_errors(frame, routes).collect()
    )
    assert bad == [
        (0, 3, "EINVAL", False),
        (0, 4, None, True),
        (2, 6, "EINVAL", False),
        (5, 3, "EINVAL", False),
        (5, 4, None, True),
    ]
    assert sorted(r.event_id for r in routing.routed(frame, routes).collect()) == [0, 1, 2, 5]
    assert sorted(r.event_id for r in routing.unrouted(frame, routes).collect()) == [3, 4]


def test_numbers_that_events_share(spark):
    """A bad route of one event stops no route of another, whatever their numbers."""
    shared = [Route(1, "a", "bad"), Route(2, "a", "d/t"), Route(1, "b", "d/u"), Route(2, "b", "d/v")]
    frame = events(spark, "a", "b")
    for routes in (shared, config.routes_table(spark, shared)):
        got = {(r.event_name, r.table) for r in routing.route_exact(frame, routes).collect()}
        assert got == {("b", "u"), ("b", "v")}
        bad = {(r.event_name, r.route_no, r.stopped) for r in routing.route_errors(frame, routes).collect()}
        assert bad == {("a", 1, False), ("a", 2, True)}


def test_a_short_route_list_needs_no_shuffle(spark):
    plan = routing.route_exact(events(spark, "a"), ROUTES)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hash" not in text


@pytest.mark.parametrize("target", ["ops", "a/b/c", "", "a/", "/"])
def test_targets(spark, target):
    frame = spark.createDataFrame([(target,)], "target string")
    row = routing.parse_target(frame).head()
    if target.count("/") == 1:
        assert [row.database, row.table, row.error_code] == [*target.split("/"), None]
    else:
        assert [row.database, row.table, row.error_code] == [None, None, "EINVAL"]


def brute_template(names, routes):
    out = set()
    for number, name in enumerate(names):
        for route in routes:
            pattern = ".*".join(re.escape(p) for p in route.event_name_match.split("*"))
            if re.fullmatch(pattern, name, re.S):
                parts = route.target.replace("%E", name).split("/")
                if len(parts) != 2:
                    break
                out.add((number, route.route_no, *parts))
    return out


@pytest.mark.parametrize("length", [15, 130])
def test_wildcards_against_brute_force(spark, length):
    rng = random.Random(9)
    names = ["".join(p) for p in itertools.product("ab_%", repeat=2)] + ["a/b", "", "a\\b", "abab"]
    patterns = ["*", "a*", "*b", "*_*", "a%", "a_", "*%*", "a*b", "a\\*", "b", "*/*", "**"]
    routes = [
        Route(n, rng.choice(patterns), rng.choice(["db/%E", "%E/%E", "db/x", "bad%E", "d/%E.r"]))
        for n in range(1, length + 1)
    ]
    got = routing.route_template(events(spark, *names), routes)
    assert got.columns == ["event_id", "event_name", "event_data", "route_no", "target", "database", "table"]
    # Short lists are tested inside the row, longer ones looked up by name.
    assert ("Join" in got._jdf.queryExecution().executedPlan().toString()) == (length > routing.SHORT)
    rows = [(r.event_id, r.route_no, r.database, r.table) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute_template(names, routes)


def test_unrouted_honours_patterns(spark):
    frame = events(spark, "ab", "b", "c", None)
    routes = [Route(1, "a*", "db/%E"), Route(2, "c", "db/c")]
    assert [r.event_name for r in routing.routed(frame, routes).collect()] == ["ab", "c"]
    assert [r.event_name for r in routing.unrouted(frame, routes).collect()] == ["b", None]


def test_route_takes_names_and_patterns(spark):
    frame = events(spark, "a", "b")
    by_name = routing.route(frame, ROUTES)
    by_pattern = routing.route(frame, [Route(1, "*", "db/%E")])
    assert sorted(by_name.columns) == sorted(by_pattern.columns)
    assert sorted((r.event_id, r.table) for r in by_pattern.collect()) == [(0, "a"), (1, "b")]
    assert by_name.count() == 3


def test_outputs(spark):
    outputs = [Output(2, "two"), Output(1, "one"), Output(3, "three")]
    codes = {1: "EIO", 2: "EINVAL", 3: None}
    offered = routing.offer_to_outputs(
        events(spark, "a"), outputs, lambda o: F.lit(codes[o.output_no])
    )
    assert offered.head().reported_error == "EINVAL"
    got = [(r.output_no, r.error_code, r.reported_error) for r in routing.per_output(offered).collect()]
    assert got == [(1, "EIO", "EINVAL"), (2, "EINVAL", "EINVAL"), (3, None, "EINVAL")]
    fine = routing.offer_to_outputs(events(spark, "a"), outputs, lambda o: F.lit(None))
    assert fine.head().reported_error is None


PROPERTIES = (
    Property("host", ("h",)),
    Property("route", ("a", "db/a")),
    Property("empty"),
    Property("route", ("b", "db/b")),
)


def test_properties():
    assert config.first_value(PROPERTIES, "host") == "h"
    assert config.first_value(PROPERTIES, "empty") is None
    assert config.value_at(PROPERTIES, "route", 1, 0) == "b"
    assert config.value_at(PROPERTIES, "route", 1, 2) is None
    assert config.value_at(PROPERTIES, "route", 2, 0) is None
    assert config.routes_of(PROPERTIES) == [Route(1, "a", "db/a"), Route(2, "b", "db/b")]
    for values in ((), ("a",), ("a", "b", "c")):
        with pytest.raises(ConfigError):
            config.routes_of((*PROPERTIES, Property("route", values)))
    with pytest.raises(ConfigError):
        Binding("e", 0, ())


def test_routes_out_of_an_outputs_table(spark):
    bad = Property("route", ("x",))
    frame = config.outputs_table(spark, [Output(1, "o", properties=(*PROPERTIES, bad, Property("route")))])
    got = [tuple(r)[3:] for r in routing.routes_from_properties(frame).collect()]
    assert got == [
        (1, "a", "db/a", None),
        (2, "b", "db/b", None),
        (3, None, None, "EINVAL"),
        (4, None, None, "EINVAL"),
    ]


def test_plugins(spark):
    registry = default_registry()
    with pytest.raises(ConfigError) as failure:
        registry.source(spark, Source("nothing"))
    assert failure.value.code == "PLUGIN_NOT_FOUND"
    with pytest.raises(ConfigError):
        registry.source(spark, Source("logfile"))
    registry.add_source("table", lambda session, source: session.range(int(source.properties[0].key)))
    assert registry.source(spark, Source("table", (Property("3"),))).count() == 3


def test_listing(spark):
    bindings = config.bindings_table(
        spark, [Binding("e", 1, (Source("log"), Source("host"))), Binding("f", 1, (Source("log"),))]
    )
    listed = listing.list_bindings(bindings, config.routes_table(spark, [Route(1, "e", "d/e")]))
    assert {tuple(r) for r in listed.collect()} == {
        ("e", "source", 1, "log"),
        ("e", "source", 2, "host"),
        ("f", "source", 1, "log"),
        ("e", "target", 1, "d/e"),
    }
    assert {tuple(r) for r in listing.count_bindings(listed).collect()} == {("e", 2, 1), ("f", 1, 0)}


def deliveries(spark, *rows):
    return spark.createDataFrame(
        [("d", "t", f"{i}", *r) for i, r in enumerate(rows)],
        "database string, table string, event_data string, http_status int, attempt int",
    )


def test_outcomes(spark):
    expected = {201: "OK", 400: "EINVAL", 401: "EACCESS", 403: "EACCESS", 500: "EIO", 200: "EIO", None: "EIO"}
    frame = deliveries(spark, *[(status, 1) for status in expected])
    got = {r.http_status: r.outcome for r in delivery.with_outcome(frame).collect()}
    assert got == expected
    counts = {r.outcome: r.attempts for r in delivery.delivery_outcome(frame).collect()}
    assert counts == {"OK": 1, "EINVAL": 1, "EACCESS": 2, "EIO": 3}
    assert delivery.dead_letters(frame).count() == 6


def test_redelivery(spark):
    failed = delivery.dead_letters(deliveries(spark, (500, 1), (None, 2), (500, 3), (400, 1), (201, 1)))
    fresh = spark.createDataFrame([("d", "t", "new")], "database string, table string, event_data string")
    got = {(r.event_data, r.attempt) for r in delivery.redeliver(failed, fresh, 3).collect()}
    assert got == {("0", 2), ("1", 3), ("new", 1)}


def test_insert_body(spark):
    import json

    frame = spark.createDataFrame(
        [('d"b', "t\\", '{"a":[1,null]}')], "database string, table string, event_data string"
    )
    body = delivery.insert_payload(frame).head().body
    assert json.loads(body) == [{"database": 'd"b', "table": "t\\", "data": {"a": [1, None]}}]


def test_severity(spark):
    frame = spark.createDataFrame([(s,) for s in (*severity.LEVELS, "LOUD", "info", None)], "level string")
    kept = [r.level for r in severity.severity_filter(frame, "ALERT").collect()]
    assert kept == ["ALERT", "EMERGENCY", "FATAL"]
    assert {r.level for r in severity.unknown_severity(frame).collect()} == {"LOUD", "info", None}
    with pytest.raises(ConfigError):
        severity.severity_filter(frame, "LOUD")


def test_table_files(spark, tmp_path):
    frame = spark.createDataFrame(
        [("1", "a", "x"), ("", "a b/c", "y"), ("d", "", "z")],
        "database string, table string, event_data string",
    )
    path = str(tmp_path / "out")
    sinks.write_tables(frame, path)
    got = {(r.database, r.table, r.event_data) for r in sinks.read_tables(spark, path).collect()}
    assert got == {("1", "a", "x"), ("", "a b/c", "y"), ("d", "", "z")}
    plan = sinks.read_tables(spark, path).filter("database = '1'")
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*= 1", scan)


def test_line_files(spark, tmp_path):
    sinks.write_lines(events(spark, "a", "b"), str(tmp_path / "out"))
    got = {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert got == {'{"i":0}', '{"i":1}'}


# --- the index of patterns -----------------------------------------------------------------


def _delivered(names, routes):
    """What routing by patterns gives, tested pair by pair."""
    out = []
    for i, name in enumerate(names):
        if name is None:
            continue
        for r in sorted(routes, key=lambda r: r.route_no):
            pattern = ".*".join(re.escape(p) for p in r.event_name_match.split("*"))
            if re.fullmatch(pattern, name, re.S):
                target = r.target.replace("%E", name)
                if target.count("/") != 1:
                    break
                out.append((i, r.route_no, *target.split("/")))
    return sorted(out)


def _pattern_routes(many, seed):
    pick = random.Random(seed)
    out = []
    for no in range(1, many + 1):
        match = "".join(pick.choice("aab.%_\\*é") for _ in range(pick.randrange(0, 7)))
        target = pick.choice(["d/t", "d/%E", "%E/x", "d/t"] if pick.random() < 0.97 else ["bad", "a/b/c", "%E"])
        out.append(Route(no, match, target))
    return out


NAMES = [None, "", "a", "aa", "ab", "a.b", "a%b", "a_b", "a\\b", "b/a", "a\nb", "aaaa.bbbb", "é", "aé.b", "x" * 400 + "a"]


@pytest.mark.parametrize("kind", ["list", "table"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_many_patterns_against_every_pair(spark, kind, seed):
    pick = random.Random(seed)
    names = NAMES + ["".join(pick.choice("aab.%_\\é") for _ in range(pick.randrange(9))) for _ in range(80)]
    given = [*_pattern_routes(300, seed), Route(301, "*", "all/%E"), Route(302, "x" * 300 + "*", "long/name")]
    routes = config.routes_table(spark, given) if kind == "table" else given
    frame = events(spark, *names)
    got = sorted((r.event_id, r.route_no, r.database, r.table) for r in routing.route(frame, routes).collect())
    assert got == _delivered(names, given)
    bare = [r for r in given if r.event_name_match.strip("*")]
    routes = config.routes_table(spark, bare) if kind == "table" else bare
    fits = [re.compile(".*".join(re.escape(p) for p in r.event_name_match.split("*")), re.S) for r in bare]
    wanted = {i for i, n in enumerate(names) if n is not None and any(f.fullmatch(n) for f in fits)}
    assert {r.event_id for r in routing.routed(frame, routes).collect()} == wanted
    assert {r.event_id for r in routing.unrouted(frame, routes).collect()} == set(range(len(names))) - wanted
    delivered = {(r.event_id, r.route_no) for r in routing.route(frame, routes).collect()}
    errors = {(r.event_id, r.route_no) for r in routing.route_errors(frame, routes).collect()}
    every = {
        (i, r.route_no) for i, n in enumerate(names) if n is not None for r, f in zip(bare, fits) if f.fullmatch(n)
    }
    assert delivered | errors == every and not delivered & errors


def test_short_and_long_lists_agree(spark, monkeypatch):
    given = _pattern_routes(routing.SHORT, 7) + []
    frame = events(spark, *NAMES)
    rows = [sorted(routing.route_template(frame, given).collect()) for _ in range(1)]
    monkeypatch.setattr(routing, "SHORT", 0)
    rows.append(sorted(routing.route_template(frame, given).collect()))
    assert [tuple(r) for r in rows[0]] == [tuple(r) for r in rows[1]] and rows[0]


@pytest.mark.parametrize("many", [1, 40])
def test_route_columns_replace_those_of_the_events(spark, many):
    frame = events(spark, "a").selectExpr("*", "'own' AS target", "9 AS route_no", "true AS stopped", "'e' AS error_code")
    frame = frame.selectExpr("*", "'own' AS database", "'own' AS table", "'own' AS first_bad")
    given = [Route(n, "a", "d/t") for n in range(1, many + 1)]
    for routes in (given, config.routes_table(spark, given), [Route(r.route_no, "a*", "d/t") for r in given]):
        rows = routing.route(frame, routes).collect()
        assert len(rows) == many and {r.target for r in rows} == {"d/t"} and {r.database for r in rows} == {"d"}
        # What is only used on the way does not touch the events' own columns.
        assert all(r.stopped is True and r.error_code == "e" and r.first_bad == "own" for r in rows)
    rows = routing.route_exact(frame, given).collect()
    assert len(rows) == many and all(r.stopped is True and r.target == "d/t" for r in rows)
    assert len(routing.route_errors(frame, [Route(1, "a", "bad")]).select("target", "stopped").collect()) == 1


def test_no_routes_at_all(spark):
    frame = events(spark, "a", None)
    empty = config.routes_table(spark, [Route(1, "a", "b/c")]).filter("route_no > 1")
    assert routing.route(frame, empty).count() == routing.routed(frame, empty).count() == 0
    assert routing.unrouted(frame, empty).count() == 2


def test_patterns_meet_names_by_equal_keys(spark):
    """No pair of a pattern and a name is tested that shares no key."""
    table = config.routes_table(spark, [Route(n, f"p{n}*", "d/t") for n in range(50)])
    plan = routing.route(events(spark, *[f"p{n}x" for n in range(50)]), table)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
