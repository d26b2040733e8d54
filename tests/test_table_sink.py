import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators import routing
from sluiceway.plans import tables as t
from sluiceway.streaming import table_sink

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("database", "table", "event_data")])
FOLDER = "/root/testdata/sf0.001"


def _batch(*rows):
    return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], pa.schema([(n, pa.string()) for n in SCHEMA.names]))


def _rows(spark, path, **of):
    return sorted(tuple(r) for r in table_sink.read_committed(spark, path, **of).collect())


@pytest.fixture
def sink(tmp_path):
    path = str(tmp_path / "tables")
    return path, table_sink.TableWriter(SCHEMA, {"path": path, "compactEvery": "3"})


def test_only_committed_batches_are_read(spark, sink):
    path, writer = sink
    with pytest.raises(FileNotFoundError):
        table_sink.read_committed(spark, path)
    one = writer.write(iter([_batch(("d", "t", "1"), ("d", "u", "2")), _batch(("d", "t", "3"))]))
    with pytest.raises(FileNotFoundError):
        table_sink.read_committed(spark, path)
    writer.commit([one, None], 0)
    wanted = [("d", "t", "1"), ("d", "t", "3"), ("d", "u", "2")]
    assert _rows(spark, path) == wanted
    assert _rows(spark, path, database="d", table="u") == [("d", "u", "2")]
    assert _rows(spark, path, database="e") == []


def test_a_killed_task_leaves_nothing_to_read(spark, sink):
    """A task dies in the middle of its rows; its second attempt counts, and the rest is swept up."""
    path, writer = sink

    def dies():
        yield _batch(("d", "t", "1"), ("d", "u", "2"))
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    writer.commit([writer.write(iter([_batch(("d", "t", "1"))]))], 0)
    assert _rows(spark, path) == [("d", "t", "1")]
    assert table_sink.vacuum(path) == []
    assert len(table_sink.vacuum(path, 0)) == 2
    assert _rows(spark, path) == [("d", "t", "1")]


def test_a_batch_that_runs_again_counts_once(spark, sink):
    path, writer = sink
    for _ in range(2):
        writer.commit([writer.write(iter([_batch(("d", "t", "1"))]))], 0)
    assert _rows(spark, path) == [("d", "t", "1")]
    assert sum(len(files) for _, _, files in os.walk(f"{path}/data")) == 1
    # An aborted batch takes its files back.
    writer.abort([writer.write(iter([_batch(("d", "t", "9"))])), None], 1)
    assert _rows(spark, path) == [("d", "t", "1")] and table_sink.vacuum(path, 0) == []


def test_commits_are_put_together(spark, sink):
    path, writer = sink
    for n in range(8):
        writer.commit([writer.write(iter([_batch(("d", f"t{n % 2}", str(n)))]))], n)
        assert [r[2] for r in sorted(_rows(spark, path), key=lambda r: r[2])] == [str(i) for i in range(n + 1)]
    compact = [f for f in os.listdir(f"{path}/commits") if ".compact" in f]
    assert len(compact) == 2
    # Those behind the last compact one and that itself are all a reader needs.
    for n in range(6):
        os.remove(f"{path}/commits/{n:020}.json")
    assert len(_rows(spark, path)) == 8


def test_odd_names(spark, sink, monkeypatch):
    path, writer = sink
    monkeypatch.setattr(table_sink, "MOST_OPEN", 2)
    rows = [("", "", "a"), (None, "t", "b"), ("d/..", "../x", "c"), ("ü %", "=", None), ("d", None, "e"), ("", "", "f")]
    writer.commit([writer.write(iter([_batch(*rows), _batch(*rows)]))], 0)
    found = table_sink.read_committed(spark, path).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, rows * 2))


def test_a_stream_with_a_replayed_batch(spark, tmp_path):
    """Read back equal to the routed table, also after the last batch is run again from its checkpoint."""
    table_sink.register(spark)
    path, checkpoint = str(tmp_path / "tables"), str(tmp_path / "checkpoint")
    schema = t.table(spark, FOLDER, "events").schema

    def drain():
        events = spark.readStream.schema(schema).parquet(f"{FOLDER}/{{events.parquet}}")
        named = events.select("event_id", F.col("event_type").alias("event_name"), F.col("props").alias("event_data"))
        routed = routing.route_exact(named, t.ROUTES).select("database", "table", "event_id", "event_data")
        out = routed.writeStream.format("event_tables").option("checkpointLocation", checkpoint).option("path", path)
        assert out.trigger(availableNow=True).start().awaitTermination(60) is not False

    drain()
    wanted = routing.route_exact(t.envelopes(spark, FOLDER), t.ROUTES).select("database", "table", "event_id", "event_data")
    wanted = sorted(map(tuple, wanted.collect()))
    assert _rows(spark, path) == wanted and wanted
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    os.remove(f"{checkpoint}/commits/{last}")
    crc = f"{checkpoint}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    drain()
    assert _rows(spark, path) == wanted


def test_columns_that_it_needs():
    with pytest.raises(ValueError):
        table_sink.TableWriter(T.StructType([T.StructField("x", T.StringType())]), {"path": "p"})
