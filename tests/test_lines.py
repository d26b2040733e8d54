import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.functions.arrays import BLOCK, exclusive_sums
from sluiceway.operators import progress
from sluiceway.sources.lines import scan_lines, split_lines


def test_scan_drops_the_unfinished_line_and_keeps_carriage_returns(spark):
    files = spark.createDataFrame(
        [(1, "l1\nl2\npart"), (2, "a|b\r\n\nß\nx"), (3, ""), (4, "\n"), (5, None), (6, "none")],
        "id int, text string",
    )
    found = {tuple(r) for r in scan_lines(files, keys=["id"]).collect()}
    assert found == {
        (1, 1, 0, "l1"),
        (1, 2, 3, "l2"),
        (2, 1, 0, "a|b\r"),
        (2, 2, 5, ""),
        (2, 3, 6, "ß"),
        (4, 1, 0, ""),
    }
    short = {(r[0], r[1], r[2]) for r in split_lines(files, keys=["id"]).collect()}
    assert short == {(i, n, line) for i, n, _, line in found}


def test_scan_of_a_long_file(spark):
    rng = random.Random(5)
    lines = ["é" * rng.randrange(4) + "x" * rng.randrange(9) for _ in range(3 * BLOCK + 17)]
    text = "\n".join(lines) + "\nrest"
    files = spark.createDataFrame([(text,)], "text string")
    found = scan_lines(files).orderBy("line_no").collect()
    assert [r.line for r in found] == lines
    at = 0
    for row, line in zip(found, lines):
        assert row.byte_offset == at
        at += len(line.encode()) + 1


@pytest.mark.parametrize("size", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 5 * BLOCK + 3])
def test_exclusive_sums(spark, size):
    values = [(i * 7) % 11 for i in range(size)]
    frame = spark.createDataFrame([(values,)], "v array<bigint>")
    got = frame.select(exclusive_sums(F.col("v"))).head()[0]
    assert got == [sum(values[:i]) for i in range(size)]


def test_scan_needs_no_shuffle(spark):
    files = spark.createDataFrame([("a\nb",)], "text string")
    plan = scan_lines(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_checkpoints_and_resume(spark):
    files = spark.createDataFrame(
        [("/a", 7, "l1\né2\npart"), ("/b", 8, "x\n"), ("/c", 9, "none")],
        "path string, inode bigint, text string",
    )
    lines = scan_lines(files, keys=["path", "inode"])
    saved = progress.checkpoints(lines)
    got = {r.checkpoint_key: (r.inode, r.offset) for r in saved.collect()}
    key_a, key_b = ("log_" + hashlib.sha1(p.encode()).hexdigest() for p in ("/a", "/b"))
    assert got == {key_a: (7, 7), key_b: (8, 2)}

    unchanged = spark.createDataFrame(
        [(key_a, 7, 7), (key_b, 8, 1)], "checkpoint_key string, inode bigint, offset bigint"
    )
    assert [r.checkpoint_key for r in progress.checkpoints(lines, unchanged).collect()] == [key_b]

    now = spark.createDataFrame(
        [("/a", 7, 20), ("/b", 99, 20), ("/c", 9, 3)], "path string, inode bigint, size bigint"
    )
    started = {r.path: r.start for r in progress.resume_offsets(now, saved).collect()}
    assert started == {"/a": 7, "/b": 0, "/c": 0}
    truncated = now.withColumn("size", F.lit(6))
    assert {r.start for r in progress.resume_offsets(truncated, saved).collect()} == {0}
