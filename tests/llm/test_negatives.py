import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import duck_rows, spark_rows
from trailspark.llm import negatives
from trailspark.llm.negatives import Vectors, angles_to, bounds, hard_negatives, op12_hard_negatives, pivots, scores

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, every=100):
    fit = []
    for name, label, vector in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            fit.append((name, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    place = lambda r: (r[0] is None, r[0] or 0)
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in fit:
        if a[0] is None or a[0] % every:
            continue
        scored = sorted(((score(a, b), b) for b in fit if b is not a), key=lambda p: (-p[0], place(p[1])))
        for ps, p in [x for x in scored if x[1][1] == a[1]][:5]:
            near = [(s, b) for s, b in scored if b[1] != a[1] and 30 * ps <= 100 * s <= 90 * ps][:10]
            out += [(a[0], p[0], k + 1, b[0], ps, s) for k, (s, b) in enumerate(near)]
    return sorted(out, key=str)


def found(df, every=100, **more):
    got = hard_negatives(df, F.col("vec_id") % every == 0, **more)
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("block", [32_768, 6])
def test_equals_scoring_all_pairs(spark, block, monkeypatch):
    """Clusters, ties, copies, nulls and unequal lengths; small tiles, so that bounds decide."""
    for name, value in (("TILE", 8), ("PENDING", 20), ("ANCHORS", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(n, rng.randrange(3), [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for n in range(150)]
    rows += [(n, n % 2, [0.5, 0.25, 0.0]) for n in range(200, 240)]  # copies
    rows += [(300, 1, []), (310, 0, [0.0] * 6), (320, 1, [1.0]), (320, 1, [1.0]), (None, 1, [1.0, 0.5]), (None, None, None)]
    rows += [(330, None, [1.0]), (340, 1, None), (350, 1, [1.0, None]), (360, 1, [float("nan")]), (370, 1, [float("inf")])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("own")).withColumn("slot", F.lit(0))
    assert found(df, 10, block=block) == plain(rows, 10)


def test_bounds_hold_and_leave_out():
    rng = np.random.default_rng(1)
    data = np.floor(np.vstack([rng.normal(size=(300, 8)) * 0.05 + c for c in rng.normal(size=(4, 8))]) * 256)
    norm = np.linalg.norm(data, axis=1)
    angles = angles_to(data, norm, pivots(data, 16)).astype(np.float32).astype(float)
    number = np.arange(len(data))
    rows = Vectors(number, number, number, data, norm, angles)
    anchors = rows.take(slice(0, 100))
    out = 0
    for at in range(0, len(data), 50):
        tile = rows.take(slice(at, at + 50))
        low, high = bounds(anchors, tile)
        exact = scores(anchors.vectors, tile.vectors)
        assert (exact >= low[:, None]).all() and (exact <= high[:, None]).all()
        out += (high < 0.9 * norm[:100] ** 2).sum()
    assert out > 1000


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2.0**30 + 1, 1.0]])
    assert scores(a, np.array([[2.0**30 + 3, 1.0]]))[0, 0] == (2**30 + 1) * (2**30 + 3) + 1


def test_no_rows(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], SCHEMA)
    assert found(df) == [] and found(df.limit(0)) == []
    assert found(spark.createDataFrame([(0, 1, [-1.0]), (1, 1, [1.0]), (2, 2, [1.0])], SCHEMA)) == []


def test_query_equals_sql(spark):
    columns, rows = spark_rows(op12_hard_negatives(spark, SF))
    assert (columns, rows) == duck_rows(negatives.SQL, SF)
    assert len(rows) > 100
