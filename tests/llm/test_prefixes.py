import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from compare import duck_rows, spark_rows
from trailspark.llm import prefixes
from trailspark.llm.prefixes import UNIT, op13_prefix_trie, paths_of, prefix_nodes, prefix_trie, rebuilt

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_nodes(paths):
    """The nodes of {conv_id: [(role, text), ...]}."""
    members, children = {}, {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                children.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))
    out = []
    for node, inside in members.items():
        subtree = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in inside if len(paths[c]) == len(node))
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children.get(node, ())),
            sum(n not in children for n in subtree),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in subtree if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def plain_rebuilt(paths):
    out = {}
    for c, turns in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = paths.get(c - c % 5, [])[:h] + turns[h:]
    return out


def table(spark, paths):
    rows = [(c, n, *turn) for c, turns in paths.items() for n, turn in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(nodes):
    return sorted((tuple(r) for r in nodes.select(*COLUMNS).collect()), key=str)


def crowd(seed, n=120):
    """Few different turns, so that containers are crowded; copies, prefixes and a hot start."""
    rng = random.Random(seed)
    turn = lambda: (rng.choice("ua"), rng.choice(["", "é", "text", "a\x00b"]))
    hot = [turn() for _ in range(12)]
    paths = {}
    for c in range(n):
        kind = rng.random()
        if kind < 0.3:
            paths[c] = hot[: rng.randrange(1, 13)] + [turn() for _ in range(rng.randrange(3))]
        elif kind < 0.5:
            paths[c] = hot
        else:
            paths[c] = [turn() for _ in range(rng.randrange(1, 6))]
    return paths


@pytest.mark.parametrize("container", [1, 7, 2000])
def test_equals_counting_prefixes(spark, container, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 8)
    paths = crowd(container, 60 if container == 1 else 120)
    got = rows_of(prefix_nodes(paths_of(table(spark, paths)), container))
    assert got == plain_nodes(paths)


def test_rebuilt_conversations(spark):
    rng = random.Random(2)
    paths = {c: [("u", f"{c} {i}") for i in range(rng.randrange(1, 12))] for c in [*range(-7, 30), 101, 102, 10**12 + 3] if c != 10}
    expected = {c: len(turns) for c, turns in plain_rebuilt({c: t for c, t in paths.items() if c >= 0}).items()}
    own = table(spark, {c: t for c, t in paths.items() if c >= 0})
    got = {r.conv_id: len(r.path) // UNIT for r in rebuilt(paths_of(own)).collect()}
    assert got == expected and 0 in expected.values()
    nodes = rows_of(prefix_nodes(rebuilt(paths_of(own)), 5))
    assert nodes == plain_nodes(plain_rebuilt({c: t for c, t in paths.items() if c >= 0}))


def test_nulls_ties_long_conversations_and_no_rows(spark):
    rows = [(1, None, "u", "first"), (1, 0, None, None), (2, 0, "", ""), (2, -5, "u", "first"), (None, 0, "u", "lost")]
    rows += [(3, 7, "u", "x"), (3, 7, "u", "x"), (4, 7, "u", "x" * 300_000)] + [(n, i, "u", str(i)) for n in (5, 6) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("own")).withColumn("head", F.lit(1))
    paths = {1: [("u", "first"), ("", "")], 2: [("u", "first"), ("", "")], 3: [("u", "x")] * 2, 4: [("u", "x" * 300_000)]}
    small = [r for r in rows_of(prefix_trie(df.filter("conv_id < 5 OR conv_id IS NULL")))]
    assert small == plain_nodes(paths)
    long = rows_of(prefix_nodes(paths_of(df.filter("conv_id > 4")), 1))
    assert len(long) == 3001 and (5, 3000, 5, 2, 0, 1, 4, hashlib.sha256(b"5,6").hexdigest()) in long
    assert prefix_trie(df.limit(0)).count() == 0


def test_query_equals_sql(spark):
    columns, rows = spark_rows(op13_prefix_trie(spark, SF))
    assert (columns, rows) == duck_rows(prefixes.SQL, SF)
    assert len(rows) > 30
