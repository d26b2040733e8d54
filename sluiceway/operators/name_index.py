"""An index of name patterns, in which ``*`` stands for any run of characters.

Each pattern stands in the index once, under the longest of its literal parts: the whole name if it has
no ``*``, how names begin, how they end, or what they hold. A name looks up its own
beginnings and ends of the lengths that the index has, and the runs of a few characters it holds, by an
equi-join, and only what is found is tested against the whole pattern. So the work is names times their
lengths and not names times patterns, and both sides may be tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Longer beginnings, ends and runs are looked up by so many of their characters.
LONGEST_EDGE = 256
LONGEST_RUN = 8

# How a part is marked in a key: the whole name, a beginning, an end, a run anywhere, no literal part at all.
WHOLE, BEGINS, ENDS, HOLDS, ANY = "=", "^", "$", "~", "*"


def keyed(patterns: DataFrame, match: str) -> DataFrame:
    """Patterns with ``_key``, the part they are looked up by. A null pattern fits nothing and is left out."""
    found = patterns.filter(f"`{match}` IS NOT NULL").withColumn("_parts", F.expr(f"split(`{match}`, '[*]', -1)"))
    found = found.selectExpr(
        "*",
        f"left(_parts[0], {LONGEST_EDGE}) AS _first",
        f"right(element_at(_parts, -1), {LONGEST_EDGE}) AS _last",
        f"""left(reduce(slice(_parts, 2, greatest(size(_parts) - 2, 0)), '',
            (a, b) -> if(length(b) > length(a), b, a)), {LONGEST_RUN}) AS _run""",
    )
    longest = "greatest(length(_first), length(_last), length(_run))"
    key = f"""CASE WHEN size(_parts) = 1 THEN concat('{WHOLE}', `{match}`)
        WHEN {longest} = 0 THEN '{ANY}'
        WHEN length(_first) = {longest} THEN concat('{BEGINS}', _first)
        WHEN length(_last) = {longest} THEN concat('{ENDS}', _last)
        ELSE concat('{HOLDS}', _run) END"""
    return found.withColumn("_key", F.expr(key)).drop("_parts", "_first", "_last", "_run")


def _lengths(index: DataFrame, small: bool) -> dict[str, list[int]]:
    """The lengths of the parts of each mark: at most ``2 * LONGEST_EDGE + LONGEST_RUN`` pairs reach the driver.

    Of a small table, which is part of the plan, all rows are read without a job.
    """
    pairs = index.selectExpr("left(_key, 1) AS mark", "length(_key) - 1 AS size").filter(f"mark <> '{WHOLE}'")
    found: dict[str, set[int]] = {}
    for row in (pairs if small else pairs.distinct()).collect():
        found.setdefault(row.mark, set()).add(row.size)
    return {mark: sorted(sizes) for mark, sizes in found.items()}


def _keys_of(name: str, lengths: dict[str, list[int]]) -> str:
    """SQL of all keys under which a name may find patterns."""
    lists = [f"array(concat('{WHOLE}', `{name}`))"]
    if ANY in lengths:
        lists.append(f"array('{ANY}')")
    each = {
        BEGINS: f"concat('{BEGINS}', left(`{name}`, n))",
        ENDS: f"concat('{ENDS}', right(`{name}`, n))",
        HOLDS: f"transform(sequence(1, length(`{name}`) - n + 1), at -> concat('{HOLDS}', substring(`{name}`, at, n)))",
    }
    for mark, key in each.items():
        if mark in lengths:
            sizes = f"filter(array({', '.join(map(str, lengths[mark]))}), n -> n <= length(`{name}`))"
            found = f"transform({sizes}, n -> {key})"
            lists.append(f"array_distinct(flatten({found}))" if mark == HOLDS else found)
    return f"concat({', '.join(lists)})"


def fitting(names: DataFrame, name: str, patterns: DataFrame, match: str, small: bool = False) -> DataFrame:
    """One row per name and pattern that fits it, with the columns of both.

    ``names`` should hold each name once; their columns must differ from those of ``patterns``. ``small``
    says that the patterns are a local table.
    """
    index = keyed(patterns, match)
    keys = _keys_of(name, _lengths(index, small))
    candidates = names.withColumn("_key", F.explode(F.expr(keys))).join(index, "_key")
    # As a pattern for LIKE, in which % stands for any run.
    like = rf"replace(regexp_replace(`{match}`, r'([\\%_])', r'\\$1'), '*', '%')"
    return candidates.filter(f"startswith(_key, '{WHOLE}') OR `{name}` LIKE {like}").drop("_key")
