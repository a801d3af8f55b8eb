import math
import struct

import xxhash
from pyspark.sql import functions as F

from trailspark.llm.sharding import ROUNDS, op9_sharding, permuted, shard

SF = "/root/testdata/sf0.001"


def spark_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_permutation(row, n, seed):
    high = math.ceil(math.sqrt(n))
    low = -(-n // high)
    while True:
        left, right = row // low, row % low
        for number in range(ROUNDS):
            key = seed * 1000 + number
            if number % 2 == 0:
                left = (left + spark_hash(right, key) % high) % high
            else:
                right = (right + spark_hash(left, key) % low) % low
        row = left * low + right
        if row < n:
            return row


def test_permutation_is_the_plain_one_at_every_small_size(spark):
    for n in (1, 2, 3, 7, 11, 50, 120, 1000):
        rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), 3).alias("to")).collect()
        assert {r.id: r.to for r in rows} == {i: plain_permutation(i, n, 3) for i in range(n)}
        assert sorted(r.to for r in rows) == list(range(n))


def placed(df):
    return sorted((str(r), r.shard, r.slot) for r in df.collect())


def test_shards_are_level_gapless_and_the_same_however_rows_are_dealt(spark):
    df = spark.range(1003).select((F.col("id") % 400).alias("doc_id"), F.lit(5).alias("size"))
    out = shard(df, 7)
    rows = out.collect()
    assert len(rows) == 1003
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert placed(out) == placed(shard(df.repartition(13), 7))


def test_nulls_repeats_clashing_names_and_no_rows(spark):
    rows = [(None, None, 1)] * 70_000 + [(1, "a", 2), (2, "", None), (2, "x" * 100_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    out = shard(df, 4)
    assert out.columns == ["doc_id", "text", "row_number", "shard", "slot"]
    got = out.select("row_number").collect()
    assert sorted(r[0] for r in got) == list(range(70_003))
    assert shard(df.limit(0), 4).count() == 0


def test_query(spark):
    rows = op9_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib

    assert len(rows) == len(docs)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    assert sorted(r.slot * 40 + r.shard for r in rows) == list(range(len(docs)))
