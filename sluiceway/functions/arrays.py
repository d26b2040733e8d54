"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def bind(value: Column, use: Callable[[Column], Column] | str) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Inside a lambda Spark computes an outer expression anew for every element;
    as the argument of a one-element ``transform`` it is computed once. ``use`` may
    also be a lambda in SQL, which is much quicker to build when it is long.
    """
    if isinstance(use, str):
        return F.call_function("transform", F.array(value), F.expr(use))[0]
    return F.transform(F.array(value), use)[0]


def _running(values: str) -> str:
    """SQL of ``[0, v1, v1+v2, ...]``: one longer than the input. Quadratic, for short arrays."""
    return (
        f"aggregate({values}, array(0L),"
        " (done, n) -> array_append(done, element_at(done, -1) + n))"
    )


def exclusive_sums(values: Column) -> Column:
    """For each entry the sum of all entries before it.

    Works in blocks, so that growing the result array stays cheap on long input.
    """
    blocks = f"transform(sequence(1, size(v), {BLOCK}), at -> {_running(f'slice(v, at, {BLOCK})')})"
    bases = _running("transform(blocks, block -> element_at(block, -1))")
    shifted = (
        "flatten(zip_with(blocks, slice(bases, 1, size(blocks)),"
        " (block, base) -> transform(slice(block, 1, size(block) - 1), n -> n + base)))"
    )
    long = (
        f"transform(array({blocks}), blocks ->"
        f" transform(array({bases}), bases -> {shifted})[0])[0]"
    )
    return bind(
        values,
        f"""v -> CASE WHEN size(v) = 0 THEN cast(array() AS array<bigint>)
            WHEN size(v) <= {BLOCK} THEN slice({_running("v")}, 1, size(v))
            ELSE {long} END""",
    )
