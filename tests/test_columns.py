import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluiceway.functions import numbers, text, times
from sluiceway.operators.profile import field_profile
from sluiceway.sources import sensors

quick = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize("shape", list(text.SHAPES))
def test_empty_text_has_every_shape(rows, shape):
    assert rows("").select(text.has_shape(F.col("line"), shape)).head()[0]


@pytest.mark.parametrize(
    "value, shapes",
    [
        ("-", {"shell_safe", "number"}),
        (".", {"shell_safe", "number"}),
        ("1,5", {"number"}),
        ("1.2.3", {"shell_safe"}),
        ("12", set(text.SHAPES)),
        ("12\n", set()),
        ("fF", {"hex", "alphanumeric", "shell_safe"}),
        ("é", set()),
        ("a-b_c.d", {"shell_safe"}),
    ],
)
def test_shapes(rows, value, shapes):
    row = rows(value).select(*[text.has_shape(F.col("line"), s).alias(s) for s in text.SHAPES]).head()
    assert {s for s in text.SHAPES if row[s]} == shapes


def test_profile(rows):
    frame = rows("1", "a", "é", None)
    row = field_profile(frame, ["line"]).head()
    assert (row.n_values, row.n_digits, row.n_hex, row.n_shell_safe) == (3, 1, 2, 2)


@given(st.lists(st.text(alphabet="aAzÉé/$1.b\t\x00 _-", max_size=12), min_size=1, max_size=20))
@quick
def test_text_against_bytes(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    out = frame.select(
        v,
        text.ascii_lower(v).alias("lower"),
        text.ascii_upper(v).alias("upper"),
        text.strip_shell(v).alias("shell"),
        text.strip_trailing_slashes(v).alias("stripped"),
        text.replace_all(v, "a", "aa").alias("replaced"),
        text.includes_ignoring_case(v, "AZ").alias("includes"),
        text.find_byte(v, "/").alias("first"),
        text.find_last_byte(v, "/").alias("last"),
        text.find_last_byte(v, "é").alias("last_wide"),
        text.compare_bytes(v, F.lit("a")).alias("order"),
        text.split_on(v, "/").alias("parts"),
        text.split_on(v, "$1").alias("literal"),
        text.join_set(text.split_on(v, "/"), "|").alias("joined"),
        text.join_list(text.split_on(v, "/"), "+").alias("listed"),
    )
    for row in out.collect():
        raw = row.v.encode()
        assert row.lower.encode() == raw.lower() and row.upper.encode() == raw.upper()
        assert row.shell == "".join(c for c in row.v if c.isascii() and (c.isalnum() or c in "_.-"))
        assert row.stripped == row.v.rstrip("/") and row.replaced == row.v.replace("a", "aa")
        assert row.includes == (b"az" in raw.lower())
        assert (row["first"], row["last"]) == (raw.find(b"/"), raw.rfind(b"/"))
        assert row.last_wide == raw.rfind("é".encode())
        assert row.order == (raw > b"a") - (raw < b"a")
        assert row.parts == row.v.split("/") and row.literal == row.v.split("$1")
        assert row.joined == "|".join(sorted(set(row.v.split("/")), key=str.encode))
        assert row.listed == "+".join(row.v.split("/"))


def brute_metric(v):
    size = abs(v)
    if size == 0:
        return "0"
    for bound, factor, mark in ((1e-9, 1e12, "p"), (1e-6, 1e9, "n"), (1e-3, 1e6, "μ"), (0.1, 1e3, "m")):
        if size < bound:
            return f"{v * factor:.1f}{mark}"
    if size < 1000:
        return f"{v:.2f}" if size < 10 else f"{v:.1f}"
    for bound, mark in ((1e6, "K"), (1e9, "M"), (1e12, "G"), (float("inf"), "T")):
        if size < bound:
            return f"{v / {'K': 1e3, 'M': 1e6, 'G': 1e9, 'T': 1e12}[mark]:.1f}{mark}"


def test_numbers_as_the_c_library_prints_them(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 0.05, 0.5, 12.0, 1500.0, 405.95, 0.25, 0.125, 2.5, 1.5, 1.0, 100.25, 5e-7]
    values += [999999.95, 0.9999995, 123456789012.1, 1e15 + 0.3, -0.04, 1e-320, 2.0**53 - 1, 9.9999995]
    values += [round(rng.uniform(-1000, 1000), rng.randrange(1, 5)) for _ in range(1500)]
    values += [rng.choice([-1, 1]) * 10 ** rng.uniform(-14, 14) for _ in range(1500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    out = frame.select(
        v, numbers.fixed(v, 1), numbers.fixed(v, 6), numbers.number_text(v), numbers.metric_text(v)
    )
    for value, one, six, plain, metric in out.collect():
        assert one == f"{value:.1f}" and six == f"{value:.6f}"
        cut = f"{value:.6f}".rstrip("0")
        assert plain == (cut + "0" if cut.endswith(".") else cut)
        assert metric == brute_metric(value)


def test_odd_numbers(spark):
    frame = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [r[0] for r in frame.select(numbers.fixed(F.col("v"), 1)).collect()] == ["nan", "inf", "-inf"]


@pytest.mark.parametrize(
    "value, shown",
    [(0.0, "0"), (0.05, "50.0m"), (0.5, "0.50"), (12.0, "12.0"), (1500.0, "1.5K"), (5e-13, "0.5p")],
)
def test_metric_sizes(spark, value, shown):
    frame = spark.createDataFrame([(value,)], "v double")
    assert frame.select(numbers.metric_text(F.col("v"))).head()[0] == shown


@pytest.mark.parametrize(
    "template, values, line",
    [
        ("$0-$1", ["a", "b"], "a-b"),
        ("$10 $1", ["x", "y"], "y0 y"),
        ("$0", ["$1", "z"], "z"),
        ("$1", ["$0", "$0"], "$0"),
        ("none", ["x"], "none"),
    ],
)
def test_templates(spark, template, values, line):
    assert spark.range(1).select(text.fill(template, [F.lit(v) for v in values])).head()[0] == line


def test_times(spark):
    frame = spark.createDataFrame([(0,), (1704067211999999,)], "t bigint")
    t = F.col("t")
    out = frame.select(
        times.time_text(t),
        times.time_text(t, "%d/%b/%Y 'at' %I%p 100%%"),
        times.days_after(t, -0.5),
        times.days_after(t, F.lit(1) * 2.0),
    ).collect()
    day = times.MICROS_PER_DAY
    assert tuple(out[0]) == ("1970-01-01 00:00:00", "01/Jan/1970 'at' 12AM 100%", -day // 2, 2 * day)
    assert out[1][0] == "2024-01-01 00:00:11"
    with pytest.raises(ValueError):
        times.java_format("%Q")


def test_sensor_records(spark, tmp_path):
    frame = spark.createDataFrame(
        [('{"hostname":"h","load_1m":0.5,"disks":[{"mount":"/","used":1}]}',), ("broken",)],
        "event_data string",
    )
    good, broken = sensors.parse_records(frame, sensors.SYSTEM_STATS).collect()
    assert (good.hostname, good.load_1m, good.disks[0].mount, good.cpu_user) == ("h", 0.5, "/", None)
    assert broken.hostname is None and broken.event_data == "broken"
    (tmp_path / "out.json").write_text('{"a":1}\n\n{"a":2}\n')
    events = sensors.read_records(spark, str(tmp_path), "app.stats").collect()
    assert sorted((r.event_name, r.event_data) for r in events) == [
        ("app.stats", '{"a":1}'),
        ("app.stats", '{"a":2}'),
    ]
