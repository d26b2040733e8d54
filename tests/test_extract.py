import json
import random

import pytest
import regex
from pyspark.sql import functions as F

from sluiceway.config import ConfigError
from sluiceway.functions.json_text import json_literal, json_quote
from sluiceway.functions.patterns import compile_pattern, group_texts, matches, required_literals, translate
from sluiceway.operators import extract


def payloads(frame, pattern):
    return [r.event_data for r in extract.extract_payload(frame, pattern).collect()]


@pytest.mark.parametrize(
    "pattern, line, payload",
    [
        (r"(?<left>[^;]*)?(?<right>.*)", "a;b\r", '{"left":"a","right":";b\\r"}'),
        (r"(?<a>x)(?<b>y)?", "x", '{"a":"x"}'),
        (r"(?<a>x)(?<b>y)?", "zzxyx", '{"a":"x","b":"y"}'),
        (r"(?<a>q)?(?<b>y)", "y", '{"a":"","b":"y"}'),
        (r"(?<a>q)?(?<b>y)?(\d)?(?<c>z)?", "qz", '{"a":"q","b":"","c":"z"}'),
        (r"(?<a>q)?(?<b>y)?(\d)?(?<c>z)?", "qy3", '{"a":"q","b":"y"}'),
        (r"(?<a>q)?(?<b>y)?(\d)?(?<c>z)?", "n", "{}"),
        (r"(?<host>..)(?<id>..)", "abcd", '{"host":"ab","id":"cd"}'),
        (r"(?P<host_name>\w+) (\d+) (?<id>[[:alpha:]]+)", "w 1 x2", '{"host_name":"w","id":"x"}'),
        (r"(?'q'['\"])(?<in>.*?)\k<q>", 'say "hi" "ho"', '{"q":"\\"","in":"hi"}'),
        (r"(?<in>[]\[a&&]+)", "x[a]&y", '{"in":"[a]&"}'),
        (r"(?i)(?<v>AB|cd){1}(?#note)\b", "xcd, é", '{"v":"cd"}'),
        (r"(?<a>.)(?<b>.)\g{-1}", "abb", '{"a":"a","b":"b"}'),
        (r"(?<open>{)x{2}", "{xx", '{"open":"{"}'),
        (r"(?<l>\Q.*\E)", "a.*", '{"l":".*"}'),
    ],
)
def test_fields_of_the_first_match(rows, pattern, line, payload):
    assert payloads(rows(line), pattern) == [payload]


def expected_payload(pattern, line):
    """The first match as fields, with those behind the last group that was set left out."""
    found = regex.search(pattern, line)
    if line == "" or found is None:
        return None
    last = max((n for n in range(1, found.re.groups + 1) if found.group(n) is not None), default=0)
    named = sorted(found.re.groupindex.items(), key=lambda item: item[1])
    return {name: found.group(n) or "" for name, n in named if n <= last}


@pytest.mark.parametrize(
    "pattern",
    [
        r"(?<a>x+)(?<b>y)?(?<c>z|1)?",
        r"(?:(?<a>x)|(?<b>y))(?<c>[^x]*)",
        r"((?<a>1|2)(x)?)?(?<b>z)?y",
        r"(?<a>.*?)(?<b>[xy]{2,3})",
        r"^(?<a>\w*) ?(?<b>\d)$",
        r"(?<a>(x|y)\2)(?<b>.)?",
        r"(?<a>x)(?!y)(?<b>z)?|(?<c>\s)",
        r"(?<a>\bx)(?<b>\By)?",
    ],
)
def test_fields_against_another_engine(rows, pattern):
    rng = random.Random(pattern)
    lines = {"".join(rng.choice("xyz12 \r") for _ in range(rng.randrange(7))) for _ in range(300)}
    frame = rows(*sorted(lines))
    got = {r.line: json.loads(r.event_data) for r in extract.extract_payload(frame, pattern).collect()}
    expected = {line: expected_payload(pattern, line) for line in lines}
    assert got == {line: fields for line, fields in expected.items() if fields is not None}


def test_lines_that_yield_no_event(rows):
    frame = rows("", "x", "12", "\r")
    assert payloads(frame, r"^(?<n>\d+)$") == ['{"n":"12"}']
    assert [r.line for r in extract.drop_blank(frame).collect()] == ["x", "12", "\r"]


def test_a_carriage_return_is_an_ordinary_character(spark, rows):
    ready = compile_pattern(spark, r"(?<v>ab)$")
    got = rows("ab", "ab\r").select(matches(F.col("line"), ready)).collect()
    assert [r[0] for r in got] == [True, False]


@pytest.mark.parametrize(
    "pattern",
    [
        r"(\d+)",
        r"(?<n>x",
        r"(?<n>x))",
        r"(?<n>*)",
        r"(?<n>[a)",
        r"(?<n>a\K)",
        r"(?<n>(?R))",
        r"(?<n>a)(?<n>b)",
        r"(?<n>(?1))",
        r"(?|(?<n>a))",
        r"(?<n>a)\k<m>",
        r"(*UTF8)(?<n>a)",
    ],
)
def test_bad_patterns_are_refused_before_reading(spark, pattern):
    with pytest.raises(ConfigError) as failure:
        compile_pattern(spark, pattern)
    assert failure.value.code == "REGEX_ERROR"


def test_fields_that_may_be_missing_are_known():
    assert translate(r"(?<a>x)(?<b>y)?").unset == {2}
    assert translate(r"(?<a>x)?(?<b>y)").unset == frozenset()
    assert translate(r"(?<a>x)|(?<b>y)").unset == {1, 2}
    assert translate(r"((?<a>x)|z)(?<b>y){0,2}").unset == {2, 3}


def test_escapes(rows):
    value = '"\\\t\x01\x0b\x00/\x7fé\x1f\b\f\n\r'
    text = rows(value).select(json_quote(F.col("line"))).head()[0]
    assert text == '"\\"\\\\\\t\\u0001\\u000b\\u0000/\x7fé\\u001f\\b\\f\\n\\r"'
    assert json.loads(text) == value
    assert json_literal(value) == text


def test_wrap_and_encode(rows):
    frame = rows('say "x"', "")
    assert [r.event_data for r in extract.wrap_raw(frame).collect()] == ['{ "data": "say \\"x\\"" }']
    pair = rows("a\tb").withColumn("n", F.lit("c"))
    encoded = extract.encode_payload(pair, ["n", "line"]).head().event_data
    assert encoded == '{"n":"c","line":"a\\tb"}'


def test_record_keeps_the_place_of_a_line(spark, rows):
    ready = compile_pattern(spark, r"(?<n>\d+)")
    frame = rows("1", "", "x")
    got = frame.select(extract.record_of(F.col("line"), ready)).collect()
    assert [r[0] for r in got] == ['{"n":"1"}', "", ""]
    got = frame.select(extract.record_of(F.col("line"), None)).collect()
    assert [r[0] for r in got] == ['{ "data": "1" }', "", '{ "data": "x" }']


def test_ten_groups_and_more(spark, rows):
    """Back references take all their digits; what may be octal is refused."""
    letters = "".join(f"(?<g{i}>{c})" for i, c in enumerate("abcdefghij", 1))
    found = extract.extract_fields(rows("abcdefghijj", "abcdefghija0"), letters + r"\10$").collect()
    assert [r.line for r in found] == ["abcdefghijj"]
    with pytest.raises(ConfigError):
        translate(r"(?<a>x)\10")


@pytest.mark.parametrize(
    "pattern, literals",
    [
        (r"(?<a>\w+) \| (?<b>[a-m]+)[,.]?", [" | "]),
        (r"^(?<word>[A-Za-z]+) (?<rest>.*)\.$", [" ", "."]),
        (r"(?<a>x)abc*d+e?f{2}g{0,1}h", ["ab", "d", "f", "h"]),
        (r"(?<a>x)ab|cd", []),
        (r"(?i)(?<a>x)ab", []),
        (r"(?i:(?<a>x))ab", []),
        (r"(?:(?<a>x)|zz)ab(?=cd)ef(?!gh)", ["ab", "ef"]),
        (r"(?<a>[)\]x(]+)\)\\q[^(]z", [")\\q", "z"]),
        (r"(?<a>.)\d\x41b\Q.*\Ec\bd", ["b.*c", "d"]),
        (r"(?<a>x)+b*?c++d", ["c", "d"]),
        (r"(?<a>x){2}y{1,}?z", ["y", "z"]),
    ],
)
def test_literals_that_every_match_holds(pattern, literals):
    assert required_literals(translate(pattern).java) == literals


def test_literals_never_hide_a_match(spark, rows):
    """Random patterns find what they find without the test for a literal."""
    pick = random.Random(11)
    parts = ["a", "bc", "d?", "e*", "f+", "(?<x{}>a|b)", "(?:g|h)?", "[a-f]", ".", r"\.", "{2}", "^", "$", r"\w", "é", "(?=a)"]
    lines = ["".join(pick.choice("aabbccdefgh.é") for _ in range(pick.randrange(12))) for _ in range(300)]
    frame = rows(*lines).cache()
    for _ in range(40):
        pattern = "(?<first>a?)" + "".join(pick.choice(parts).replace("{}", str(i)) for i in range(pick.randrange(1, 6)))
        try:
            ready = compile_pattern(spark, pattern)
        except ConfigError:
            continue
        plain = frame.filter(F.col("line").rlike(f"(?d){ready.java}")).collect()
        assert frame.filter(matches(F.col("line"), ready)).collect() == plain, pattern
        got = extract.extract_fields(frame, pattern).collect()
        wanted = frame.filter(F.col("line").rlike(f"(?d){ready.java}")).select(
            "line", *[t.alias(n) for n, t in group_texts(F.col("line"), ready)]
        )
        assert got == wanted.collect(), pattern


def test_lines_with_the_byte_that_parts_groups(rows):
    frame = rows("a\x01b c", "\x01 \x01", "x y", "\x01")
    got = extract.extract_fields(frame, r"(?<l>\S*) (?<r>.*)").collect()
    assert [(r.l, r.r) for r in got] == [("a\x01b", "c"), ("\x01", "\x01"), ("x", "y")]
    assert payloads(frame, r"(?<l>\S*) (?<r>[xyc\x01])")[2] == '{"l":"x","r":"y"}'
