import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trailspark.llm.components import component_roots
from trailspark.llm.simhash import ball_links, colliding, fingerprint, keep_one, masks, near_duplicates, op5_simhash

SF = "/root/testdata/sf0.001"


def plain_print(text, size):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    count = max(1, len(words) - size + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(count)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints():
    for text in (None, "", " \n", "One", "a B c", "Ä b c d E", "x y z w " * 30, "ab cd\x0bef\tgh ij " * 3, "long " * 200_000):
        assert fingerprint(text, 4) == signed(plain_print(text, 4) if len(text or "") < 1000 else plain_print("long long long long", 4))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("distance", [1, 2, 3, 4, 5])
def test_links_reach_what_comparing_all_pairs_reaches(spark, distance, seed):
    rng = random.Random(distance + 100 * (seed - 1))
    prints = [rng.getrandbits(64) for _ in range(60 if distance < 4 else 15)]
    for value in list(prints):  # chains of small steps
        for _ in range(4):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                value ^= 1 << bit
            prints.append(value)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = ball_links(df, distance, 6)
    for r in links.collect():
        assert r.a != r.b
    roots = {r.node: r.root for r in component_roots(links).collect()}
    groups, expected = {}, {}
    for p, root in zip(prints, plain_components(prints, distance)):
        groups.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
        expected.setdefault(root, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_parts_of_a_crowded_bucket_have_all_collisions():
    rng = random.Random(5)
    values = np.unique(np.array([(0xABCDEF << 40) ^ (1 << rng.randrange(24)) ^ rng.getrandbits(12) for _ in range(5000)], np.uint64))
    spent = np.bitwise_count((values ^ np.uint64(0b1011)) & np.uint64(0xFF))
    high = [masks(20, r) for r in range(3)]
    whole = set(zip(*map(np.ndarray.tolist, colliding(values, spent, 8, high, 0, 1))))
    parts = [set(zip(*map(np.ndarray.tolist, colliding(values, spent, 8, high, p, 7)))) for p in range(7)]
    roots = lambda pairs: plain_roots(len(values), pairs)
    assert len(whole) > 1000 and all(parts)
    assert roots(whole) == roots(set().union(*parts))


def plain_roots(n, pairs):
    root = list(range(n))
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                moved = True
    return root


def test_long_chain_and_loops_in_components(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.union(spark.createDataFrame([(1000, 1000), (1002, 1001)], "a long, b long"))
    rows = component_roots(edges).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(301)}, 1001: 1001, 1002: 1001}
    assert component_roots(edges.limit(0)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(d.text, 4) for d in docs]
    roots = plain_components(prints, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, SF).collect()}
    assert got == {d.doc_id: (f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, prints, roots)}


def test_nulls_repeats_and_no_rows(spark, documents):
    rows = [(None, "a b c d e"), (None, "q"), (3, "A b c d e"), (3, "A b c d e"), (5, None), (4, ""), (9, "z" * 300_000)]
    docs = documents(*rows).withColumn("fp", F.lit("own")).withColumn("root", F.lit(1))
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs, 4, 4).collect()), key=str)
    assert got == sorted([(None, 3), (None, None), (3, 3), (3, 3), (5, 4), (4, 4), (9, 9)], key=str)
    kept = keep_one(docs, 4, 4)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.fp) for r in kept.collect()), key=str) == sorted(
        [(None, "q", "own"), (3, "A b c d e", "own"), (4, "", "own"), (9, "z" * 300_000, "own")], key=str
    )
    assert keep_one(docs.limit(0), 4, 4).count() == 0
