import json
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.config import ConfigError
from sluiceway.operators import combine, envelope, ranks
from sluiceway.operators.ranks import _cut, _large_keys, position, with_previous
from sluiceway.sources.heartbeat import heartbeat


def brute_rounds(records, sources):
    """Rounds as they are drained: the n-th record of every source, '' when it has run out."""
    by_event = {}
    for event, source, order, record in sorted(records, key=lambda r: r[2]):
        by_event.setdefault(event, {s: [] for s in sources})[source].append(record)
    out = set()
    for event, queues in by_event.items():
        for n in range(max(len(q) for q in queues.values())):
            taken = [q[n] if n < len(q) else "" for q in queues.values()]
            out.add((event, n + 1, *taken))
    return out


@pytest.mark.parametrize("limit", [1, 3, 1 << 16])
def test_round_zip_against_draining(spark, limit):
    rng = random.Random(limit)
    sources = ["a", "b", "c"]
    # One event holds a third of all records, most of them from one source.
    events = ["hot"] * 50 + [f"e{i}" for i in range(100)]
    records, used = [], set()
    for event in events:
        for _ in range(rng.randrange(1, 9)):
            source = rng.choice("aab" if event == "hot" else sources)
            order = rng.randrange(0, 5000)
            if (event, source, order) not in used:
                used.add((event, source, order))
                records.append((event, source, order, rng.choice(["", "x", f"{source}{order}"])))
    frame = spark.createDataFrame(
        records, "event_name string, source string, byte_offset bigint, record string"
    )
    zipped = combine.round_zip(frame, ["event_name"], sources, limit=limit)
    expected = brute_rounds(records, sources)
    assert {tuple(r) for r in zipped.collect()} == expected
    last = {(e, n, c) for e, n, _, _, c in expected if c != ""}
    assert {tuple(r) for r in combine.merge_last(zipped, sources).collect()} == last
    direct = combine.last_source(frame, ["event_name"], "c", limit=limit)
    assert {tuple(r) for r in direct.collect()} == last


def test_a_sensor_has_a_record_in_every_round(spark):
    frame = spark.createDataFrame(
        [("e", "log", 0, "l1"), ("e", "log", 3, ""), ("e", "log", 4, "l3")],
        "event_name string, source string, byte_offset bigint, record string",
    )
    ticks = spark.createDataFrame([("e",), ("quiet",)], "event_name string")
    sensors = {"host": F.concat(F.lit("h-"), "event_name")}
    zipped = combine.round_zip(frame, ["event_name"], ["log"], sensors=sensors, ticks=ticks)
    got = {tuple(r) for r in combine.merge_last(zipped, ["log", "host"]).collect()}
    assert got == {("e", 1, "h-e"), ("e", 2, "h-e"), ("e", 3, "h-e"), ("quiet", 1, "h-quiet")}
    # With the log last, a round in which it has nothing yields nothing.
    got = {tuple(r) for r in combine.merge_last(zipped, ["host", "log"]).collect()}
    assert got == {("e", 1, "l1"), ("e", 3, "l3")}


def test_round_zip_with_known_positions(spark):
    frame = spark.createDataFrame(
        [("e", "a", 1, "a1"), ("e", "a", 2, "a2"), ("e", "b", 1, "b1")],
        "event_name string, source string, line_no bigint, record string",
    )
    zipped = combine.round_zip(frame, ["event_name"], ["a", "b"], round_no="line_no")
    assert {tuple(r) for r in zipped.collect()} == {("e", 1, "a1", "b1"), ("e", 2, "a2", "")}


@pytest.mark.parametrize(
    "base, top, merged",
    [
        ('{"a":1,"b":"x"}', '{"b":2.5}', '{"a":1,"b":2.5}'),
        ('{"a":{"x":1}}', '{"a":{"y":[1,"2"]},"c":null}', '{"a":{"y":[1,"2"]},"c":null}'),
        ('{"a":1}', "", '{"a":1}'),
        ("", '{"a":1}', '{"a":1}'),
        ("", None, None),
        # A side that is no object: the last record wins, and the round is kept.
        ('{"a":1}', "oops", "oops"),
        ('{"a":1}', "[1]", "[1]"),
        ('{"a":', '{"b":2}', '{"b":2}'),
        ("x", "", "x"),
    ],
)
def test_overlay(spark, base, top, merged):
    frame = spark.createDataFrame([(1, base, top)], "id int, a string, b string")
    got = [r.event_data for r in combine.merge_overlay(frame, ["a", "b"]).collect()]
    assert got == ([] if merged is None else [merged])


def test_overlay_of_many_sources_parses_each_once(spark):
    names = [f"s{i}" for i in range(9)]
    texts = [f'{{"k{i}":{i},"all":{i}}}' for i in range(9)]
    frame = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
    merged = combine.merge_overlay(frame, names)
    assert json.loads(merged.head().event_data) == {"all": 8} | {f"k{i}": i for i in range(9)}
    assert len(merged._jdf.queryExecution().analyzed().toString()) < 20_000


def test_overlay_needs_the_last_to_win(spark):
    frame = spark.createDataFrame([("{}", "{}")], "a string, b string")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        with pytest.raises(ConfigError):
            combine.merge_overlay(frame, ["a", "b"])
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")


def test_overlay_of_three(spark):
    frame = spark.createDataFrame(
        [('{"a":1}', '{"b":1}', '{"a":2}')], "x string, y string, z string"
    )
    assert combine.merge_overlay(frame, ["x", "y", "z"]).head().event_data == '{"a":2,"b":1}'


def test_ranges_follow_the_rows_and_not_the_values(spark):
    """One far value puts the others into no common range."""
    frame = spark.range(10_000).selectExpr("'k' AS k", "CASE WHEN id = 0 THEN 1000000000000 ELSE id END AS v")
    cut = _cut(frame, _large_keys(frame, ["k"], "v", 1000), ["k"], "v", "left")
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1200
    ranked = position(frame, ["k"], "v", "n", 1000)
    assert ranked.filter("n <> CASE WHEN v > 10000 THEN 10000 ELSE v END").count() == 0


def test_rows_of_equal_order_are_cut_by_their_ties(spark):
    frame = spark.range(20_000).selectExpr("'k' AS k", "0L AS v", "concat('/logs/', id % 10000) AS path", "id DIV 10000 AS n")
    ties = ["path", "n"]
    cut = _cut(frame, _large_keys(frame, ["k"], "v", 1000, ties), ["k"], "v", "left", ties)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1200
    ranked = position(frame, ["k"], "v", "at", 1000, ties)
    want = sorted((f"/logs/{i % 10000}", i // 10000) for i in range(20_000))
    assert [(r.path, r.n) for r in ranked.orderBy("at").collect()] == want
    assert ranked.agg(F.min("at"), F.max("at"), F.count_distinct("at")).first()[:] == (1, 20_000, 20_000)


def test_ranges_from_a_sample(spark, monkeypatch):
    """Rare values stand for each other, frequent ones count for themselves."""
    monkeypatch.setattr(ranks, "SAMPLE", 500)
    frame = spark.range(20_000).selectExpr("'k' AS k", "CASE WHEN id < 5000 THEN 700L ELSE id END AS v", "id")
    cut = _cut(frame, _large_keys(frame, ["k"], "v", 1000), ["k"], "v", "left")
    sizes = sorted(r["count"] for r in cut.groupBy("_range").count().collect())
    # The frequent value cannot be cut; no other range is far from the limit.
    assert sizes[-1] < 6500 and sizes[-2] < 2000 and sum(sizes) == 20_000
    ranked = position(frame, ["k"], "v", "at", 1000, ["id"])
    assert ranked.filter("at <> id + 1").count() == 0


def test_nulls_in_order_and_ties_come_first(spark):
    rows = [("k", v, t) for v in (None, 1, 2) for t in (None, "a", "b")] * 2
    frame = spark.createDataFrame(rows, "k string, v bigint, t string")
    for limit in (1, 5, 100):
        ranked = position(frame, ["k"], "v", "at", limit, ["t"]).orderBy("at").collect()
        assert [r.at for r in ranked] == list(range(1, 19))
        assert [(r.v, r.t) for r in ranked] == sorted(
            ((v, t) for _, v, t in rows), key=lambda p: (p[0] or 0, p[1] or "")
        )


def test_equal_offsets_of_several_files(spark):
    rows = [("e", "a", p, o, f"{p}{o}") for p in ("y", "x") for o in (0, 5)]
    frame = spark.createDataFrame(
        rows, "event_name string, source string, path string, byte_offset bigint, record string"
    )
    for limit in (1, 100):
        zipped = combine.round_zip(frame, ["event_name"], ["a"], ties=["path"], limit=limit)
        assert [r.a for r in zipped.orderBy("round_no").collect()] == ["x0", "y0", "x5", "y5"]


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_position_and_previous(spark, limit):
    rng = random.Random(3)
    values = {k: sorted(rng.sample(range(-50, 200), 60)) for k in ("a", "b")} | {"c": [5]}
    frame = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v bigint")
    ranked = position(frame, ["k"], "v", "n", limit)
    assert {tuple(r) for r in ranked.collect()} == {
        (k, v, i + 1) for k, vs in values.items() for i, v in enumerate(vs)
    }
    steps = with_previous(frame, ["k"], "v", "p", limit)
    got = [tuple(r) for r in steps.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, v, p) for k, vs in values.items() for p, v in zip(vs, vs[1:])}


def test_union_keeps_duplicates(spark):
    frame = spark.createDataFrame([("e", "x")], "event_name string, event_data string")
    assert combine.union_bindings(frame, frame.select("event_data", "event_name"), frame).count() == 3


def test_ticks(spark):
    # Start 100, interval 10: the first tick is 110, a record on a tick goes out at it.
    cases = {0: 110, 100: 110, 101: 110, 110: 110, 111: 120, 120: 120, 139: 140}
    frame = spark.createDataFrame([(t,) for t in cases], "time_us bigint")
    got = {r.time_us: r.tick_us for r in envelope.tick_assign(frame, 100, 10).collect()}
    assert got == cases


@pytest.mark.parametrize("limit", [1, 2, 1 << 16])
def test_missed_ticks(spark, limit):
    ticks = [("e", t) for t in (110, 120, 120, 150, 160, 200)] + [("f", 110)]
    frame = spark.createDataFrame(ticks, "event_name string, tick_us bigint")
    got = {tuple(r) for r in envelope.missed_ticks(frame, 100, 10, limit=limit).collect()}
    assert got == {("e", 150, 2), ("e", 200, 3)}


def test_events_of_one_batch_share_their_time(spark):
    events = envelope.to_event(spark.range(100).repartition(4), "e", F.col("id").cast("string"))
    assert events.columns == ["time", "event_name", "event_data"]
    assert events.select("time").distinct().count() == 1


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_heartbeat(spark, chunk):
    hosts = spark.createDataFrame([("h1", "h1.x"), ('q"', None)], "hostname string, hostname_fqdn string")
    beats = heartbeat(hosts, 100, 10, ticks=9, chunk=chunk).collect()
    assert {(r.tick_us, r.event_data) for r in beats} == {
        (100 + 10 * n, text)
        for n in range(1, 10)
        for text in (
            '{ "hostname": "h1", "hostname_fqdn": "h1.x" }',
            '{ "hostname": "q\\"", "hostname_fqdn": "" }',
        )
    }
    assert len(beats) == 18
