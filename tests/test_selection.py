import json
import os

import pytest

from sluiceway.sources import tail


@pytest.fixture
def logs(tmp_path):
    for n in range(6):
        (tmp_path / f"l{n}.log").write_text("".join(f"{n}:{i:04}\n" for i in range(100)))
    return tmp_path


@pytest.fixture
def opened(monkeypatch):
    """The files that the source opens."""
    paths, real = [], os.open

    def counting(path, *rest, **named):
        paths.append(os.path.basename(path))
        return real(path, *rest, **named)

    monkeypatch.setattr(os, "open", counting)
    return paths


def _read(logs, **options):
    reader = tail.LogTailReader({"path": f"{logs}/*.log", **options})
    rows = []
    for part in reader.partitions():
        for b in reader.read(part):
            rows += zip(map(os.path.basename, b["path"].to_pylist()), b["byte_offset"].to_pylist())
    return rows


def test_only_wanted_files_are_opened(logs, opened):
    two = [f"{logs}/l2.log", f"{logs}/l4.log"]
    inode = os.stat(two[0]).st_ino
    for options, files in [
        ({"onlyPaths": json.dumps(two)}, {"l2.log", "l4.log"}),
        ({"onlyPaths": "[]"}, set()),
        ({"onlyPaths": '["elsewhere"]'}, set()),
        ({"onlyInodes": json.dumps([inode])}, {"l2.log"}),
        ({"onlyInodes": json.dumps([inode]), "onlyPaths": json.dumps(two[1:])}, set()),
        ({"fromOffset": "700"}, set()),
    ]:
        opened.clear()
        rows = _read(logs, **options)
        assert {p for p, _ in rows} == files and len(rows) == 100 * len(files)
        # Where offsets decide, the ends of lines have to be looked for first, but nothing is read.
        assert set(opened) == files or "fromOffset" in options


def test_only_wanted_ranges_are_planned(logs):
    """A line is 7 bytes; ranges of 70 bytes hold ten."""
    path = json.dumps([f"{logs}/l1.log"])
    for low, high, begin, end in [("630", None, 630, 700), (None, "70", 0, 70), (None, "71", 0, 140), ("350", "351", 350, 420), ("300", "200", 0, 0)]:
        span = {k: v for k, v in (("fromOffset", low), ("toOffset", high)) if v}
        rows = _read(logs, onlyPaths=path, splitBytes="70", **span)
        assert [o for _, o in rows] == list(range(begin, end, 7))


def test_known_positions_that_are_not_wanted(logs):
    """Kept positions of other files plan nothing."""
    ends = tail.find_end(f"{logs}/*.log", {})
    begin = {p: [i, 0] for p, (i, _) in ends.items()}
    rows = _read(logs, startOffsets=json.dumps(begin), endOffsets=json.dumps(ends), onlyPaths=json.dumps([f"{logs}/l0.log"]))
    assert {p for p, _ in rows} == {"l0.log"} and len(rows) == 100


def test_rows_are_those_of_a_filter(spark, logs):
    every = sorted((os.path.basename(r.path), r.byte_offset, r.line) for r in tail.read_logs(spark, f"{logs}/*.log").collect())
    assert len(every) == 600
    some = [f"{logs}/l1.log", f"{logs}/l5.log"]
    for options, test in [
        ({"paths": some}, lambda r: r[0] in ("l1.log", "l5.log")),
        ({"paths": some, "from_offset": 100, "to_offset": 250}, lambda r: r[0] in ("l1.log", "l5.log") and 100 <= r[1] < 250),
        ({"from_offset": 7, "to_offset": 14}, lambda r: r[1] == 7),
        ({"inodes": [os.stat(some[0]).st_ino]}, lambda r: r[0] == "l1.log"),
        ({"to_offset": 0}, lambda r: False),
    ]:
        rows = tail.read_logs(spark, f"{logs}/*.log", splitBytes=100, **options).collect()
        assert sorted((os.path.basename(r.path), r.byte_offset, r.line) for r in rows) == list(filter(test, every))


def test_two_selections_in_one_query(spark, logs):
    """Each reads its own files, which pushed filters would mix up."""
    one, two = (tail.read_logs(spark, f"{logs}/*.log", paths=[f"{logs}/l{n}.log"]) for n in (1, 2))
    assert sorted({r.path[-6:] for r in one.union(two).collect()}) == ["l1.log", "l2.log"]


def test_long_lines_over_many_blocks(spark, tmp_path):
    long = "x" * (5 << 20) + "é"
    (tmp_path / "a.log").write_text(f"a\n{long}\nb\n{long}\n")
    rows = tail.read_logs(spark, f"{tmp_path}/a.log", splitBytes=1 << 20).orderBy("byte_offset").collect()
    assert [r.line for r in rows] == ["a", long, "b", long]
