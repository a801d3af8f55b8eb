import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from trailspark.llm.mixing import mix, mixed, op10_mixing, sized

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, weights=(5, 2, 1), passes=3):
    """Share again and again until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > passes * sizes[s]}
        if not over:
            return done | {s: left * w[s] / total for s in open_}
        for s in over:
            done[s] = passes * sizes[s]
            left -= done[s]
        open_ -= over
    return done


def held(rows, sizes):
    """Targets as plain, whole passes, the budget kept, and a queue cut at one time."""
    targets = plain_targets(sizes)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(targets[r.source])
        assert r.source_size == sizes[r.source]
        assert r["size"] == 0 and r.taken == 0 or r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    budget = sum(sizes.values())
    assert budget - max(longest.values()) <= sum(taken.values()) <= budget
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest[s] + 1e-6 + max(longest.values())


def test_query_against_the_plain_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, own = defaultdict(int), {}
    for r in docs.collect():
        own[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += own[r.doc_id]
    rows = mix(sized(docs)).collect()
    assert {r.doc_id: r["size"] for r in rows} == own
    held(rows, sizes)
    again = op10_mixing(spark, SF).collect()
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sorted(map(key, rows)) == sorted(map(key, mix(sized(docs.repartition(11))).collect()))


def test_a_small_source_is_filled_and_its_excess_goes_to_the_others(spark, documents):
    rows = [(i, "w " * 10, "en", "b") for i in range(50)] + [(100, "x y", "en", "a"), (101, "x y", "en", "a")]
    out = mix(sized(documents(*rows))).collect()
    held(out, {"a": 4, "b": 500})
    assert {r.taken for r in out if r.source == "a"} == {6}


def test_nulls_empty_texts_and_repeats(spark, documents):
    rows = [(None, None, None, None), (1, "", "en", None), (1, "a b c", "en", None)] + [(2, "a b", "en", "s")] * 9
    out = mix(sized(documents(*rows))).collect()
    assert len(out) == 12
    held(out, {None: 3, "s": 18})
    assert mix(sized(documents(*rows).limit(0))).count() == 0
    empty = mix(sized(documents((1, ""), (2, None)))).collect()
    assert [(r.taken, r.target) for r in empty] == [(0, 0.0)] * 2


def test_rows_come_out_as_often_as_they_are_taken(spark, documents):
    rows = [(i, f"w{i} " * (i % 7), "en", "ab"[i % 2]) for i in range(60)] + [(77, "x y z", "en", None)] * 5 + [(None, None, None, None)]
    docs = documents(*rows).withColumn("size", F.lit("own"))
    out = mixed(docs)
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.collect())
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size[r[0]]
    taken = defaultdict(int)
    for i, n in copies.items():
        assert n <= 3 * (5 if i == 77 else 1) and size[i]
        taken[source[i]] += n * size[i]
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= 12
    assert mixed(docs.limit(0)).count() == 0


def test_rows_that_differ_in_which_column_is_null_stay_apart(spark, documents):
    rows = [(1, "a b", None, "en"), (1, "a b", "en", None)]
    out = mixed(documents(*rows), weights=(1,)).collect()
    assert {(r.lang, r.source) for r in out} == {(None, "en"), ("en", None)}
