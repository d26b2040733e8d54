"""Nearest neighbours against all cosines."""

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from sluiceway.llm import neighbours, registry
from tests.llm.conftest import FOLDER


def brute(rows, nearest=5):
    found = {}
    for q, v in rows:
        if q % 50:
            continue
        scored = {}
        for i, w in rows:
            if i != q:
                score = sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w))
                scored[i] = max(score, scored.get(i, -2))
        best = sorted(scored.items(), key=lambda s: (-round(s[1], 12), s[0]))[:nearest]
        found[q] = [(i, round(s, 9)) for i, s in best]
    return found


def searched(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert r.rank == len(found[r.query_id])
    return found


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_ties_copies_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    rng = random.Random(1)
    good = [(i, [float(rng.randint(-3, 3)) or 1.0 for _ in range(4)]) for i in range(150)]
    good += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(150, 300)] + [(300, [-1e-30, 0.0, 0.0, 0.0])]
    odd = [(400, None), (450, []), (500, [0.0] * 4), (550, [1.0, None, 1.0, 1.0]), (600, [math.nan, 1.0, 1.0, 1.0])]
    odd += [(650, [math.inf, 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows = [(i, v, "x") for i, v in good + good[:60] + odd]
    table = vectors(spark, rows).repartition(5)
    found = searched(neighbours.nearest_neighbours(table, F.col("vec_id") % 50 == 0))
    assert found == brute(good)


def test_repeated_ids_take_one_place_each(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "STEP_CANDIDATES", 7)
    rng = random.Random(3)
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0, 0.0])]
    # Many vectors of two ids stand nearer than all others, and some ids are near only by their last vector.
    rows += [(i, [1.0, rng.random() / 9, rng.random() / 9, 0.0]) for i in (1, 2) for _ in range(40)]
    rows += [(i, [rng.random() - 0.5 for _ in range(4)]) for i in range(3, 20) for _ in range(5)]
    rows += [(0, [rng.random() - 0.5 for _ in range(4)]) for _ in range(3)]
    table = vectors(spark, [(i, [float(np.float32(x)) for x in v], "") for i, v in rows]).repartition(3)
    found = searched(neighbours.nearest_neighbours(table, F.col("vec_id") % 50 == 0))
    want = {}
    held = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    for q in (0, 50):
        best = {}
        for v in (v for i, v in held if i == q):
            for i, w in held:
                if i != q:
                    score = sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w))
                    best[i] = max(score, best.get(i, -2))
        want[q] = [(i, round(s, 9)) for i, s in sorted(best.items(), key=lambda s: (-s[1], s[0]))[:5]]
    assert found == want


def test_extreme_values_against_exact_arithmetic(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        size = rng.choice((1e200, 1e-200, 1.0, 1e300, 1e-310))
        rows.append((i, [rng.choice((-3, -2, -1, 1, 2, 3)) * size for _ in range(4)]))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [Fraction(x) for x in v] for i, v in rows}
    for query, found in searched(neighbours.nearest_neighbours(table, F.col("vec_id") % 50 == 0)).items():
        v = exact[query]
        want = {}
        for i, w in exact.items():
            dot = sum(a * b for a, b in zip(v, w))
            square = dot * dot / (sum(a * a for a in v) * sum(b * b for b in w))
            want[i] = math.sqrt(square) if dot > 0 else -math.sqrt(square)
        del want[query]
        best = sorted(want.values(), reverse=True)[:5]
        assert [s for _, s in found] == [round(s, 9) for s in best]
        assert all(abs(want[i] - s) < 1e-9 for i, s in found)


def test_blocks_are_even_whatever_the_partitions(spark):
    table = vectors(spark, [(i, [1.0, float(i)], "") for i in range(4000)]).repartition(100)
    counts = table.groupBy(neighbours.dealt(8).alias("block")).count().collect()
    assert len(counts) == 8 and max(r["count"] for r in counts) < 700


def test_few_candidates_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [1.0, 1.0], ""), (2, [0.0, 1.0], ""), (50, [1.0, 0.0, 0.0], "")]
    found = searched(neighbours.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0))
    assert found == {0: [(1, round(math.sqrt(0.5), 9)), (2, 0.0)]}


def test_empty(spark):
    assert neighbours.nearest_neighbours(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_errors_are_bounded():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 16)), rng.normal(size=(60, 16)) * 1e6
    q, c = neighbours.Quantised(a), neighbours.Quantised(b)
    exact = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    near = (q.values.astype(float) @ c.values.T.astype(float)) * np.outer(q.scale, c.scale)
    assert (np.abs(exact - near) <= c.error + np.outer(q.error, c.length) + 1e-12).all()


def test_op3(spark, given):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in given("embeddings").collect()]
    assert searched(registry.op3_neighbours(spark, FOLDER)) == brute(rows)
