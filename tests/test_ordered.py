"""The cell-wise computations against plain windows on crowded, tied data."""

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from fixtures import T0
from trailspark.functions import ordered, quantiles
from trailspark.functions.ordered import top_n, with_next, with_rank
from trailspark.functions.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds a third of the rows; many share a second, some keys are tiny."""
    rng = random.Random(7)
    data = []
    for event_id in range(3000):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(200)}"
        second = rng.choice([0, 1, 599, 600, 601, rng.randrange(100_000)])
        data.append((event_id, T0 + timedelta(seconds=second), key, f"v{rng.randrange(9)}"))
    rng.shuffle(data)
    schema = "event_id long, ts timestamp_ntz, key string, v string"
    return spark.createDataFrame(data, schema).cache()


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    right = right.select(*left.columns)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def by_order():
    return Window.partitionBy("key").orderBy("ts", "event_id")


def cut_at(monkeypatch, rate, step):
    monkeypatch.setattr(ordered, "RATE", rate)
    monkeypatch.setattr(ordered, "STEP", step)


@pytest.mark.parametrize("rate, step", [(1 << 16, 16), (1, 1), (1, 3), (4, 2)])
def test_next_and_rank(rows, rate, step, monkeypatch):
    """Uncut, cut at every row, and cut at some rows of keys."""
    cut_at(monkeypatch, rate, step)
    for data in (rows, rows.withColumn("ts", F.lit("2025-01-01").cast("timestamp_ntz"))):
        both = with_next(data, ["key"], {"next_ts": "ts", "next_v": "v"})
        same(both, data.withColumns({"next_ts": F.lead("ts").over(by_order()), "next_v": F.lead("v").over(by_order())}))
        ranked = with_rank(data, ["key"], "k", first="start")
        plain = data.withColumns(
            {"k": F.row_number().over(by_order()).cast("bigint"),
             "start": F.min("ts").over(Window.partitionBy("key"))}
        )
        same(ranked, plain)


def test_rows_alike_in_order_stay_together(rows, monkeypatch):
    cut_at(monkeypatch, 1, 2)
    twice = rows.union(rows).withColumn("w", F.lit(1))
    ranked = with_rank(twice, ["key"], "k")
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    same(ranked.drop("v"), twice.withColumn("k", F.row_number().over(order).cast("bigint")).drop("v"))
    led = with_next(twice, ["key"], {"n": "event_id"})
    same(led.drop("v"), twice.withColumn("n", F.lead("event_id").over(order)).drop("v"))


@pytest.mark.parametrize("moments", [1, 7, 600_000_000])
def test_a_hot_key_and_a_hot_moment_spread_evenly(spark, moments, monkeypatch):
    cut_at(monkeypatch, 16, 8)
    at = F.timestamp_micros(F.col("id") * 31_013 % moments).cast("timestamp_ntz")
    rows = spark.range(100_000).select(F.lit("s").alias("key"), F.col("id").alias("event_id"), at.alias("ts"))
    cut = ordered.borders(rows, ["key"], ("ts", "event_id"))
    assert 500 < cut.select(F.size(ordered.BORDERS)).first()[0] < 1100
    pieces = ordered.in_pieces(rows, ["key"], ("ts", "event_id"), cut).groupBy(ordered.PIECE).count()
    assert pieces.agg(F.max("count")).first()[0] < 600
    ranked = with_rank(rows, ["key"], "k")
    assert ranked.filter(F.col("k") == 100_000).count() == 1
    order = F.struct("ts", "event_id")
    assert ranked.agg(F.max(F.struct("k", order.alias("o")))).first()[0]["o"] == rows.agg(F.max(order)).first()[0]
    led = with_next(rows, ["key"], {"n": "event_id"})
    assert led.filter("n IS NULL").count() == 1 and led.select("n").distinct().count() == 100_000


def scans(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    reused = final.count("ReusedExchange")
    return final.count("FileScan parquet"), final.count("Exchange hashpartitioning") - reused, reused


def test_one_scan_of_the_data_and_one_of_the_borders(spark, rows, tmp_path, monkeypatch):
    cut_at(monkeypatch, 4, 4)
    path = str(tmp_path / "rows")
    rows.withColumn("big", F.repeat("v", 50)).write.parquet(path)
    stored = spark.read.parquet(path)
    led = with_next(stored, ["key"], {"next_ts": "ts"}).filter("next_ts > ts")
    assert scans(led) == (2, 2, 1)
    ranked = with_rank(stored, ["key"], "k")
    assert scans(ranked)[0] <= 3  # and the count of the rows of cut keys


@pytest.mark.parametrize("n", [1, 50, 1500])
def test_top_n(rows, n):
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    plain = rows.withColumn("r", rank).filter(F.col("r") <= n).drop("r")
    same(top_n(rows, ["key"], order, n), plain)


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    values = {
        "hot": rng.integers(0, 5000, 2000).astype(float).tolist(),
        "same": [7.0] * 50, "one": [3.5], "two": [1.0, 2.0],
        "negative": (-rng.random(301) * 10_000).tolist(),
    }
    df = spark.createDataFrame(
        [(k, v) for k, vs in values.items() for v in vs] + [("hot", None)], "g string, x double"
    )
    found = exact_percentiles(df, ["g"], "x", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0})
    for row in found.collect():
        expected = np.percentile(values[row.g], [0, 50, 95, 100])
        assert [row.p0, row.p50, row.p95, row.p100] == pytest.approx(expected.tolist(), abs=1e-9)
    assert found.count() == len(values)


def test_percentile_cells_stay_small(spark, monkeypatch):
    """Distinct fractional values of one group spread over many cells."""
    seen = []
    plain = quantiles.in_cells
    monkeypatch.setattr(quantiles, "in_cells", lambda df, keys, order, *, cell, **more: (
        seen.append(df.groupBy(cell.alias("c")).count().agg(F.max("count")).first()[0]), plain(df, keys, order, cell=cell, **more)
    )[1])
    df = spark.range(100_000).select(F.lit("a").alias("g"), (F.col("id") / 97.0 + 200).alias("x"))
    found = exact_percentiles(df, ["g"], "x", {"p50": 0.5}).first()
    assert found.p50 == pytest.approx(200 + 99_999 / 97 / 2) and seen[0] < 100


@pytest.mark.parametrize("rate, step", [(1 << 16, 16), (1, 2), (8, 4)])
def test_deep_pages(rows, rate, step, monkeypatch):
    cut_at(monkeypatch, rate, step)
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    everything = [r.event_id for r in rows.orderBy(*order).collect()]
    for offset, limit in ((0, 10), (1234, 50), (2990, 50), (5000, 5)):
        page = ordered.newest_page(rows, ("ts", "event_id"), order, offset, limit)
        assert [r.event_id for r in page.collect()] == everything[offset : offset + limit]


def test_deep_pages_look_at_few_rows(spark, monkeypatch):
    """Of a moment that all rows share, too."""
    cut_at(monkeypatch, 64, 8)
    rows = spark.range(200_000).select(F.col("id").alias("event_id"), F.lit("2025-01-01").cast("timestamp_ntz").alias("ts"))
    page = ordered.newest_page(rows, ("ts", "event_id"), [F.col("ts").desc(), F.col("event_id").desc()], 150_000, 3)
    assert [r.event_id for r in page.collect()] == [49_999, 49_998, 49_997]
    assert "Exchange hashpartitioning(__piece" in page._jdf.queryExecution().executedPlan().toString()
