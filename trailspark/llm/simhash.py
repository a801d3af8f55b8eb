"""SimHash fingerprints and near-duplicates within a few bits, by meeting in the middle."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from trailspark.llm.components import component_roots
from trailspark.llm.shared import load, stored

BITS = 64
SEED = 42
SHINGLE_BLOCK = 65_536  # Hashes whose bits are counted at once.
VARIANTS = 1 << 22  # Variants that a task holds at once.
OWNERS = 4096  # Values whose variants are made at once.


def fingerprint(text: str | None, words: int) -> int:
    """Bit i is set if more than half of the shingles' hashes have it."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words, len(parts))
    spans = zip(starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLE_BLOCK):
        block = hashes[at : at + SHINGLE_BLOCK]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def with_fingerprints(docs: DataFrame, words: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the fingerprint of ``text`` as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch.column(0)]
            columns = [*batch.columns[1:], pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f"c{i}" for i in range(len(keep))), "fp"])

    given = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = given.mapInArrow(run, ", ".join([*fields, "fp long"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "fp")


def masks(bits: int, radius: int) -> np.ndarray:
    """All ways to flip up to ``radius`` of ``bits`` low bits."""
    flips = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return np.array(flips, np.uint64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def colliding(values: np.ndarray, spent: np.ndarray, shift: int, high_masks: list[np.ndarray], part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of ``values`` that share a variant of their bits above ``shift``: each
    owner with the one that flips least for it. Only variants that a hash puts into ``part``
    of ``parts``."""
    variants, owners, flipped = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.uint8)]
    radius = len(high_masks) - 1
    for r, flips in enumerate(high_masks):
        own = np.flatnonzero(spent == radius - r).astype(np.int32)
        for at in range(0, len(own), OWNERS):
            block = own[at : at + OWNERS]
            variant = ((values[block] >> np.uint64(shift))[:, None] ^ flips[None, :]).ravel()
            owner = np.repeat(block, len(flips))
            cost = np.tile(np.bitwise_count(flips) + np.uint8(radius - r), len(block))
            if parts > 1:
                mixed = (variant * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                here = mixed % np.uint64(parts) == part
                variant, owner, cost = variant[here], owner[here], cost[here]
            variants.append(variant)
            owners.append(owner)
            flipped.append(cost)
    variant = np.concatenate(variants)
    order = np.argsort(variant)
    variant = variant[order]
    alike = variant[1:] == variant[:-1]
    shared = np.append(alike, False) | np.append(False, alike)
    variant, order = variant[shared], order[shared]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.concatenate(owners)[order].astype(np.int64)
    cost = np.concatenate(flipped)[order].astype(np.int64)
    first = np.append(True, variant[1:] != variant[:-1])
    least = np.minimum.reduceat(cost << 32 | owner, np.flatnonzero(first)) & 0xFFFFFFFF
    lead = least[np.cumsum(first) - 1]
    other = lead != owner
    return lead[other], owner[other]


def ball_links(prints: DataFrame, distance: int, bucket_bits: int) -> DataFrame:
    """Links (a, b) that connect all distinct values of ``fp`` with at most ``distance``
    differing bits; not every pair, but a path of true pairs for each.

    Two such values have a variant in common that differs from one by half the distance
    rounded down at most, from the other by half rounded up. The owner that flips least for a
    variant is therefore within the distance of both, and every owner is tied to that one.
    Variants are shuffled by their low ``bucket_bits`` bits: a value goes once to
    each bucket in which it has variants, and its variants there are written out in the
    task of the bucket. Variants alike bring values together; each collision is verified
    by its bits. A bucket returns a forest.
    A crowded bucket writes its variants out in parts, so its memory grows with its values
    alone.
    """
    radius = (distance + 1) // 2
    low = (1 << bucket_bits) - 1
    flips = F.array(*[F.lit(int(m)).cast("long") for m in masks(bucket_bits, radius)])
    sent = prints.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseAND(F.lit(low)).bitwiseXOR(F.col("flip")).alias("bucket")
    )
    high_masks = [masks(BITS - bucket_bits, r) for r in range(radius + 1)]

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(rows["fp"].to_numpy().view(np.uint64))
        spent = np.bitwise_count((values ^ np.uint64(key[0])) & np.uint64(low))
        total = sum(int((spent == radius - r).sum()) * len(m) for r, m in enumerate(high_masks))
        parts = -(-total // VARIANTS)
        root = np.arange(len(values))
        for part in range(parts):
            a, b = colliding(values, spent, bucket_bits, high_masks, part, parts)
            true = np.bitwise_count(values[a] ^ values[b]) <= distance
            # What the parts before have tied together stays so.
            root = local_roots(len(values), np.append(a[true], np.arange(len(root))), np.append(b[true], root))
        moved = np.flatnonzero(root != np.arange(len(values)))
        return pd.DataFrame({"a": values[moved].view(np.int64), "b": values[root[moved]].view(np.int64)})

    return sent.groupBy("bucket").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, words: int, distance: int, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``fp``, ``root`` (least fingerprint of the component) and
    ``component_id``: the least doc_id that can be reached over links of at most ``distance`` bits.

    Null and empty texts have fingerprint zero and are linked like others. Equal
    fingerprints are one node, so a crowd of copies costs no more than one text. A null
    doc_id counts for a component only if there is no other. An empty table gives no rows.
    Columns in ``keep`` with the names of results are left out. Buckets are chosen by the number of distinct fingerprints, about 2**20 variants each.
    """
    names = [c for c in (keep or []) if c not in ("doc_id", "fp", "root", "component_id")]
    prints = stored(with_fingerprints(docs, words, ["doc_id", *names]), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    bucket_bits = min(max(10, nodes.count().bit_length() - 9), 32)
    roots = component_roots(ball_links(nodes.select("fp"), distance, bucket_bits))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.select("fp", "root").join(least, "root").select("fp", "component_id", "root")
    return prints.join(by_print, "fp").select("doc_id", *names, "fp", "component_id", "root")


def keep_one(docs: DataFrame, words: int, distance: int) -> DataFrame:
    """One row of each component: one with the least doc_id; same columns as ``docs``, whatever
    their names.

    Null, empty and wordless texts are one component. Where rows with the least doc_id are
    repeated one of them stays; a null doc_id stays only where there is no other. An
    empty table gives no rows.
    """
    names = docs.columns
    given = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    found = near_duplicates(given, words, distance, [f"k{i}" for i in range(len(names))])
    least = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
    return least.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


WORDS, DISTANCE = 4, 4


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(docs, WORDS, DISTANCE).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
