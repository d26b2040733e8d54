import json
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sluiceway.config import Binding, ConfigError, Output, Property, Route, Source
from sluiceway.operators import delivery, sinks
from sluiceway.sources.heartbeat import heartbeat_stream, host_record
from sluiceway.sources import tail
from sluiceway.sources.registry import default_registry
from sluiceway.sources.sensors import stream_records
from sluiceway.sources.tail import (
    find_end,
    load_progress,
    next_slice,
    progress_file,
    read_logs,
    tail_logs,
)
from sluiceway.streaming import run, writers


class Log:
    def __init__(self, folder, name="app.log"):
        self.path = os.path.join(folder, name)

    def append(self, data):
        with open(self.path, "ab") as file:
            file.write(data)

    def replace(self, data):
        """Rotation: another file under the same path."""
        os.rename(self.path, self.path + ".1")
        self.append(data)


@pytest.fixture
def log(tmp_path):
    return Log(str(tmp_path))


@pytest.fixture
def drain(spark, tmp_path, log):
    """Read what is pending, as a query that is restarted every time."""

    def lines(**options):
        got = []

        def collect(batch, batch_id):
            got.extend(r.line for r in batch.orderBy("path", "byte_offset").collect())

        stream = tail_logs(spark, options.pop("path", log.path), **options)
        run.start(stream, collect, str(tmp_path / "checkpoint"), drain=True).awaitTermination(60)
        return got

    return lines


@pytest.mark.parametrize("split", [1, 2, 3, 7, 1000])
def test_ranges_give_every_line_once(spark, log, split):
    log.append("l1\r\n\nlängere Zeile\nx\npart".encode())
    rows = read_logs(spark, log.path, splitBytes=split).orderBy("byte_offset").collect()
    assert [r.line for r in rows] == ["l1\r", "", "längere Zeile", "x"]
    assert [r.byte_offset for r in rows] == [0, 4, 5, 20]
    assert [r.byte_length for r in rows] == [3, 0, 14, 1]
    assert {r.inode for r in rows} == {os.stat(log.path).st_ino}


def test_bytes_that_are_no_text_keep_their_length(spark, log):
    log.append(b"a\xff\xfe\nok\n")
    rows = read_logs(spark, log.path).orderBy("byte_offset").collect()
    assert [(r.line, r.byte_length) for r in rows] == [("a��", 3), ("ok", 2)]


def test_lines_longer_than_a_block(spark, log):
    log.append(b"s\n" + b"x" * (3 << 20) + b"\ne\n" + b"y" * (2 << 20))
    rows = read_logs(spark, log.path, splitBytes=1 << 19).orderBy("byte_offset").collect()
    assert [r.byte_length for r in rows] == [1, 3 << 20, 1]


def test_tail_over_growth_truncation_rotation_and_absence(log, drain):
    log.append(b"l1\nl2\npart")
    assert drain() == ["l1", "l2"]
    assert drain() == []
    log.append(b"ial\nl4\n")
    assert drain() == ["partial", "l4"]
    os.truncate(log.path, 0)
    log.append(b"new\n")
    assert drain() == ["new"]
    log.replace(b"rotated, and longer than what was there before it\n")
    assert drain() == ["rotated, and longer than what was there before it"]
    os.rename(log.path, log.path + ".away")
    assert drain() == []
    os.rename(log.path + ".away", log.path)
    assert drain() == []
    log.append(b"back\n")
    assert drain() == ["back"]


def test_tail_before_the_file_exists(log, drain):
    assert drain() == []
    log.append(b"first\n")
    assert drain() == ["first"]


def test_tail_of_a_pattern(tmp_path, log, drain):
    pattern = str(tmp_path / "*.log")
    log.append(b"a1\n")
    assert drain(path=pattern) == ["a1"]
    Log(str(tmp_path), "other.log").append(b"b1\n")
    log.append(b"a2\n")
    assert drain(path=pattern) == ["a2", "b1"]


def test_a_long_unfinished_line_after_regrowth_is_no_truncation(log):
    log.append(b"x" * 50 + b"\n" + b"y" * 50)
    known = find_end(log.path, {})
    log.append(b"z" * 50)
    assert find_end(log.path, known) == known


def test_bounded_batches(spark, tmp_path, log):
    log.append(b"".join(b"line%d\n" % n for n in range(6)) + b"a line longer than the limit\nend\n")
    # By id: a batch that was stopped before its commit runs again after the restart.
    kept = {}

    def collect(batch, batch_id):
        kept[batch_id] = [r.line for r in batch.orderBy("byte_offset").collect()]

    def batches():
        return [kept[n] for n in sorted(kept) if kept[n]]

    options = {"maxBytesPerBatch": 14, "progressPath": str(tmp_path / "progress")}
    stream = tail_logs(spark, log.path, **options)
    query = run.start(stream, collect, str(tmp_path / "ck"), interval_us=100_000)
    try:
        deadline = time.time() + 60
        while sum(map(len, batches())) < 8 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    assert batches() == [
        ["line0", "line1"],
        ["line2", "line3"],
        ["line4", "line5"],
        ["a line longer than the limit"],
        ["end"],
    ]
    # Restarted, it goes on where it was, still in bounded steps.
    log.append(b"more1\nmore2\nmore3\n")
    query = run.start(tail_logs(spark, log.path, **options), collect, str(tmp_path / "ck"), 100_000)
    try:
        deadline = time.time() + 60
        while batches()[-1] != ["more3"] and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    assert batches()[5:] == [["more1", "more2"], ["more3"]]


def test_a_limit_needs_a_place_for_progress(spark, tmp_path, log):
    log.append(b"x\n")
    with pytest.raises(StreamingQueryException):
        stream = tail_logs(spark, log.path, maxBytesPerBatch=10)
        run.start(stream, lambda b, i: b.count(), str(tmp_path / "ck")).processAllAvailable()


def test_a_new_query_resumes_from_kept_progress(spark, tmp_path, log):
    progress = str(tmp_path / "progress")
    log.append(b"l1\n")

    def once(name):
        got = []
        stream = tail_logs(spark, log.path, progressPath=progress)
        write = lambda batch, i: got.extend(r.line for r in batch.collect())
        run.start(stream, write, str(tmp_path / name), drain=True).awaitTermination(60)
        return got

    assert once("ck1") == ["l1"]
    log.append(b"l2\n")
    assert once("ck2") == ["l2"]
    with open(progress_file(progress, log.path), "w") as file:
        file.write("short")
    assert load_progress(progress, log.path) == {}
    assert once("ck3") == ["l1", "l2"]


def test_batch_slices(spark, tmp_path, log):
    progress = str(tmp_path / "progress")
    log.append(b"l1\nl2\npart")
    first = next_slice(log.path, progress)
    log.append(b"ial\n")
    assert {r.line for r in first.read(spark).collect()} == {"l1", "l2"}
    # Not committed: read again, now with what came meanwhile.
    again = next_slice(log.path, progress)
    assert {r.line for r in again.read(spark).collect()} == {"l1", "l2", "partial"}
    again.commit()
    log.append(b"l4\n")
    assert [r.line for r in next_slice(log.path, progress).read(spark).collect()] == ["l4"]


def test_bytes_gone_before_they_are_read(spark, tmp_path, log):
    log.append(b"l1\nl2\n")
    planned = next_slice(log.path, str(tmp_path / "progress"))
    log.replace(b"other\nfile\n")
    assert planned.read(spark, failOnDataLoss=False).count() == 0
    with pytest.raises(Exception, match="rotated"):
        planned.read(spark).count()


ROUTES = [Route(1, "logs", "db/logs"), Route(2, "logs", "db/copy"), Route(3, "sys.alive", "db/alive")]


def test_tables_of_a_stream_and_replay(spark, tmp_path, log):
    out, lost, checkpoint = (str(tmp_path / n) for n in ("out", "lost", "ck"))
    log.append(b"a=1\nnothing\na=2\n")
    write = writers.table_writer(out, ROUTES, lost)

    def drain():
        events = run.log_events(spark, log.path, "logs", r"a=(?<a>\d)")
        run.start(events, write, checkpoint, drain=True).awaitTermination(60)
        rows = sinks.read_tables(spark, out).collect()
        return sorted((r.batch_id, r.database, r.table, r.event_data) for r in rows)

    first = drain()
    assert first == [
        (0, "db", "copy", '{"a":"1"}'),
        (0, "db", "copy", '{"a":"2"}'),
        (0, "db", "logs", '{"a":"1"}'),
        (0, "db", "logs", '{"a":"2"}'),
    ]
    # Without its commit record the batch runs again and replaces itself.
    os.remove(f"{checkpoint}/commits/0")
    crc = f"{checkpoint}/commits/.0.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert drain() == first
    log.append(b"a=3\n")
    assert [r[0] for r in drain()] == [0, 0, 0, 0, 1, 1]
    assert spark.read.parquet(lost).count() == 0


def test_deliveries_are_finished(spark, tmp_path):
    out = str(tmp_path / "sent")

    def send(bodies):
        return [500] * len(bodies)

    batch = spark.createDataFrame([("logs", "1"), ("logs", "2")], "event_name string, event_data string")
    writers.delivery_writer(out, ROUTES[:1], send)(batch, 0)
    made = writers.finish_deliveries(spark, out, 0, lambda b: [201 if '"data":1' in x else 503 for x in b])
    assert sorted((r.event_data, r.attempt, r.http_status) for r in made.collect()) == [
        ("1", 2, 201), ("2", 2, 503), ("2", 3, 503),
    ]
    # Nothing of it is sent again by the next batch, and a lost folder is an error.
    writers.delivery_writer(out, ROUTES[:1], send)(batch.limit(0), 1)
    assert spark.read.parquet(f"{out}/batch_id=1").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        writers.delivery_writer(out, ROUTES[:1], send)(batch, 7)


def test_answers_that_are_missing(spark, tmp_path):
    batch = spark.createDataFrame([("logs", "1"), ("logs", "2")], "event_name string, event_data string")
    writers.delivery_writer(str(tmp_path / "a"), ROUTES[:1], lambda bodies: [])(batch, 0)
    assert {r.http_status for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {None}

    def fault(bodies):
        raise TypeError("a bug")

    with pytest.raises(Exception, match="a bug"):
        writers.delivery_writer(str(tmp_path / "b"), ROUTES[:1], fault)(batch, 0)


def test_deliveries_and_retries(spark, tmp_path, log):
    out = str(tmp_path / "sent")

    def send(bodies):
        if any('"4"' in body for body in bodies):
            raise OSError("no answer")
        return [500 if '"1"' in b else 400 if '"2"' in b else 201 for b in bodies]

    write = writers.delivery_writer(out, ROUTES[:1], send, max_attempts=2)

    def drain(data):
        log.append(data)
        events = run.log_events(spark, log.path, "logs", r"a=(?<a>\d)")
        run.start(events, write, str(tmp_path / "ck"), drain=True).awaitTermination(60)
        rows = delivery.with_outcome(spark.read.parquet(out)).collect()
        return sorted((r.batch_id, r.event_data[6], r.attempt, r.outcome) for r in rows)

    first = [(0, "1", 1, "EIO"), (0, "2", 1, "EINVAL"), (0, "3", 1, "OK")]
    assert drain(b"a=1\na=2\na=3\n") == first
    second = [*first, (1, "1", 2, "EIO"), (1, "3", 1, "OK")]
    assert drain(b"a=3\n") == second
    third = [*second, (2, "4", 1, "EIO")]
    assert drain(b"a=4\n") == third


@pytest.mark.parametrize("overlay", [False, True])
def test_sources_of_one_event_on_a_stream(spark, tmp_path, overlay):
    left, right = Log(str(tmp_path), "left.log"), Log(str(tmp_path), "right.log")
    left.append(b"l1\nl2\nl3\n")
    right.append(b"r1\n\n")
    records = [
        tail_logs(spark, log.path).select(
            F.lit(name).alias("source"),
            "byte_offset",
            F.when(F.col("line") == "", "").otherwise(
                F.concat(F.lit(f'{{"{name}":"'), "line", F.lit('"}'))
            ).alias("record"),
        )
        for name, log in (("left", left), ("right", right))
    ]
    got = []

    def collect(batch, batch_id):
        got.extend(r.event_data for r in batch.collect())

    write = writers.zip_writer(
        "e", ["left", "right"], collect, sensors={"host": host_record(F.lit("h"), F.lit(None))}
        if overlay else None, overlay=overlay,
    )
    stream = records[0].unionByName(records[1])
    run.start(stream, write, str(tmp_path / "ck"), drain=True).awaitTermination(60)
    if overlay:
        host = '"hostname":"h","hostname_fqdn":""}'
        assert sorted(got) == [
            '{"left":"l1","right":"r1",' + host,
            '{"left":"l2",' + host,
            '{"left":"l3",' + host,
        ]
    else:
        assert got == ['{"right":"r1"}']


def test_a_sensor_goes_on_while_the_log_is_quiet(spark, tmp_path, log):
    log.append(b"l1\nl2\n")
    records = tail_logs(spark, log.path).select(
        F.lit("log").alias("source"), "byte_offset", F.col("line").alias("record")
    )
    ticks = []
    write = writers.zip_writer(
        "e",
        ["log"],
        lambda batch, i: ticks.append([r.event_data for r in batch.collect()]),
        sensors={"host": F.lit("alive")},
    )
    query = run.start(run.every_tick(records), write, str(tmp_path / "ck"), 200_000)
    try:
        deadline = time.time() + 60
        while len(ticks) < 3 and time.time() < deadline:
            time.sleep(0.1)
    finally:
        query.stop()
    assert ticks[0] == ["alive", "alive"]
    assert all(t == ["alive"] for t in ticks[1:]) and len(ticks) >= 3


def test_monitor(spark, log):
    log.append(b"seen\n")
    query = run.monitor(run.log_events(spark, log.path, "logs"), "monitored")
    try:
        query.processAllAvailable()
        log.append(b"as it comes\n")
        deadline = time.time() + 30
        while spark.table("monitored").count() < 2 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    got = [r.event_data for r in spark.table("monitored").orderBy("time").collect()]
    assert got == ['{ "data": "seen" }', '{ "data": "as it comes" }']


def settle(queries, done, seconds=60):
    """Let streams run until ``done`` says so."""
    try:
        deadline = time.time() + seconds
        while time.time() < deadline and not done():
            for query in queries:
                assert query.exception() is None
            time.sleep(0.2)
    finally:
        for query in queries:
            query.stop()


def test_a_whole_configuration(spark, tmp_path, log):
    """Two events, one of two sources, to two outputs of which one fails."""
    out = str(tmp_path / "out")
    registry = default_registry()
    failures = []

    def broken(output):
        def write(batch, batch_id):
            failures.append(output.output_name)
            raise ValueError("no room")

        return write

    registry.add_output("broken", broken)
    host = Source("hostname", (Property("hostname", ("h",)),))
    pattern = r"^(?<verb>[A-Z]+) (?<path>\S+)$"
    lines = Source("logfile", (Property("logfile", (log.path,)), Property("regex", (pattern,))))
    bindings = [
        Binding("web.requests", 200_000, (host, lines)),
        Binding("host.alive", 200_000, (host,)),
    ]
    routes = (
        Property("path", (out,)),
        Property("route", ("web.requests", "web/requests")),
        Property("route", ("host.alive", "hosts/alive")),
        Property("route", ("host.alive", "hosts/history")),
    )
    outputs = [Output(2, "tables", "table", routes), Output(1, "full", "broken")]
    log.append(b"GET /\nno request\nPUT /x\n")
    queries = run.run(spark, bindings, outputs, str(tmp_path / "ck"), registry)

    def read(event):
        schema = "time timestamp, event_name string, event_data string, route_no int, target string"
        frame = spark.createDataFrame([], schema)
        return sinks.read_tables(spark, f"{out}/{event}", frame.schema).collect()

    def done():
        ready = os.path.exists(f"{out}/web.requests") and os.path.exists(f"{out}/host.alive")
        return ready and len(read("web.requests")) >= 2 and len(read("host.alive")) >= 2

    settle(queries, done)
    # The log is the last source: rounds in which it has nothing give no event.
    assert [(r.database, r.table, r.event_data) for r in sorted(read("web.requests"), key=lambda r: r.event_data)] == [
        ("web", "requests", '{"verb":"GET","path":"/"}'),
        ("web", "requests", '{"verb":"PUT","path":"/x"}'),
    ]
    assert {r.table for r in read("host.alive")} == {"alive", "history"}
    assert {r.event_data for r in read("host.alive")} == {'{ "hostname": "h", "hostname_fqdn": "" }'}
    assert set(failures) == {"full"}


def test_the_last_error_is_reported(spark):
    def fail(text):
        def write(batch, batch_id):
            raise ValueError(text)

        return write

    seen = []
    offer = writers.Offer([("a", fail("x")), ("b", lambda batch, i: seen.append(batch.count())), ("c", fail("y"))])
    offer(spark.range(3), 0)
    assert seen == [3] and offer.last_error[0] == "c" and str(offer.last_error[1]) == "y"
    offer.writers = offer.writers[1:2]
    offer(spark.range(3), 1)
    assert offer.last_error is None


def test_sources_that_cannot_be_lined_up(spark, tmp_path):
    source = Source("json", (Property("path", (str(tmp_path),)),))
    with pytest.raises(ConfigError):
        run.run(spark, [Binding("e", 1000, (source, source))], [], str(tmp_path / "ck"))


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.log").write_bytes(b"x\n")
    frame = read_logs(spark, str(tmp_path / "*.log"))
    assert frame.count() == 300
    assert frame.select(F.spark_partition_id()).distinct().count() < 5


def test_positions_of_missing_files(tmp_path, log):
    log.append(b"a\n")
    gone = {str(tmp_path / "gone"): [1, 5]}
    assert set(find_end(log.path, gone)) == {log.path, *gone}
    assert set(find_end(log.path, gone, forget=True)) == {log.path}


def test_a_file_cut_while_it_is_read(tmp_path, log):
    log.append(b"line\n" * 300_000)
    inode = os.stat(log.path).st_ino
    value = (log.path, inode, 0, 1_500_000, 0, 1_500_000)
    lost = tmp_path / "lost"
    for fail in (True, False):
        parts = tail._read_range(value, fail, str(lost))
        first = next(parts).num_rows
        os.truncate(log.path, 10)
        if fail:
            with pytest.raises(RuntimeError):
                list(parts)
            os.truncate(log.path, 0)
            log.append(b"line\n" * 300_000)
        else:
            assert first + sum(p.num_rows for p in parts) < 300_000
    (record,) = [json.loads(p.read_text()) for p in lost.iterdir()]
    assert record["path"] == log.path and record["from"] == 5 * first and record["to"] == 1_500_000


def test_plugins_run_a_binding(spark, tmp_path, log):
    registry = default_registry()
    source = Source("logfile", (Property("logfile", (log.path,)), Property("regex", (r"(?<w>\w+)",))))
    output = Output(1, "o", "table", (Property("path", (str(tmp_path / "out"),)), Property("route", ("e", "d/t"))))
    log.append(b"word\n")
    events = registry.source(spark, source).select(
        F.current_timestamp().alias("time"), F.lit("e").alias("event_name"), "event_data"
    )
    run.start(events, registry.output(output), str(tmp_path / "ck"), drain=True).awaitTermination(60)
    assert sinks.read_tables(spark, str(tmp_path / "out")).head().event_data == '{"w":"word"}'


def test_sensor_files_stream(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.json").write_text('{"a":1}\n')
    got = []
    events = stream_records(spark, str(tmp_path / "in"), "app")
    write = lambda batch, i: got.extend(r.event_data for r in batch.collect())
    run.start(events, write, str(tmp_path / "ck"), drain=True).awaitTermination(60)
    assert got == ['{"a":1}']


def test_line_files_of_a_stream(spark, tmp_path, log):
    log.append(b"x\n")
    write = writers.line_writer(str(tmp_path / "out"))
    events = run.log_events(spark, log.path, "logs")
    run.start(events, write, str(tmp_path / "ck"), drain=True).awaitTermination(60)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{ "data": "x" }']


def test_one_heartbeat_per_tick(spark, tmp_path):
    ticks = []
    write = lambda batch, i: ticks.append([r.event_data for r in batch.collect()])
    query = run.start(heartbeat_stream(spark, "h", "h.x"), write, str(tmp_path / "ck"), 500_000)
    try:
        deadline = time.time() + 30
        while len(ticks) < 3 and time.time() < deadline:
            time.sleep(0.1)
    finally:
        query.stop()
    assert len(ticks) >= 3
    assert all(t == ['{ "hostname": "h", "hostname_fqdn": "h.x" }'] for t in ticks)


def test_ticks_are_milliseconds(spark, tmp_path):
    with pytest.raises(ConfigError):
        run.start(heartbeat_stream(spark, "h"), lambda b, i: None, str(tmp_path), interval_us=10)
