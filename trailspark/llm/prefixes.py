"""Prefix trie of conversations as a burst trie: containers of suffixes under heads, swept in order."""

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailspark.llm.shared import load, stored

UNIT = 20  # Bytes of a turn in a path: 16 of its hash, 4 of the length of its text.
CONTAINER = 2_000  # Rows of a container beyond which it bursts.
CHUNK = 256  # Ids in a row of a path, at most.
BATCH = 4_096  # Nodes in a batch of the sweep.
INNER, TOP, ENDS = 0, 1, 2  # Kinds of swept rows: inside, at the top of a container, ends of a head.
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SWEPT = "head string, above string, kind int, " + NODE
NONE = hashlib.sha256(b"").hexdigest()


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, path): each conversation's turns in order, as one binary value of UNIT bytes a turn.

    Only hashes of role and text are shuffled, not the texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    size = F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.concat(mark, size).alias("unit")
    )
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn"), F.col("unit"))))
    path = F.unhex(F.array_join(F.transform(ordered, lambda t: t["unit"]), ""))
    return rows.groupBy("conv_id").agg(path.alias("path"))


def turns_in(path: Column, first: Column | int, count: Column | None = None) -> Column:
    """``count`` or all turns of a path from number ``first`` (0 is the first) on."""
    start = (F.lit(first) * UNIT + 1).cast("int")
    return F.substring(path, start, F.length(path) if count is None else (count * UNIT).cast("int"))


def in_chunks(paths: DataFrame) -> DataFrame:
    """(path, chunk, n, least, ids): distinct paths, in rows of at most CHUNK ids each.

    A crowd of equal conversations is counted before the shuffle by path and spreads over
    its chunks of ids; each chunk's ids are joined in order.
    """
    chunk = F.floor(F.col("conv_id") / CHUNK).alias("chunk")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    return paths.groupBy("path", chunk).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")
    )


def common_turns(low: Column, high: Column, least: Column) -> Column:
    """Turns that the least and the largest path of a container, and so all, have in common."""
    longest = F.floor(F.least(F.length(low), F.length(high)) / UNIT)
    differ = lambda k: turns_in(low, k, F.lit(1)) != turns_in(high, k, F.lit(1))
    apart = F.filter(F.sequence(least, F.greatest(longest, least)), lambda k: (k >= longest) | differ(k))
    return F.get(apart, F.lit(0))


def crowded(rows: DataFrame, container: int) -> DataFrame:
    """The heads of containers to burst: those with more than ``container`` rows and two paths.

    ``stop`` is the depth to which all paths of the container agree: the nodes from the
    head's depth to there form a chain that needs no sorting.
    """
    large = rows.groupBy("head").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > container).select("head")
    # At most one head per ``container`` rows: small beside the rows, whatever their number.
    heads = rows.join(F.broadcast(large), "head", "left_semi").groupBy("head", "above", "depth", "parent_least").agg(
        F.min("path").alias("path"), F.max("path").alias("high"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"),
    ).filter(F.col("path") != F.col("high"))
    return heads.withColumn("stop", common_turns(F.col("path"), F.col("high"), F.col("depth"))).drop("high")


def burst(rows: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, moved): the rows whose container stays, and those of ``heads`` under new heads.

    Behind a head's chain the next turn's id gives the new head. Paths that end with the
    chain get a container of their own.
    """
    named = F.broadcast(heads.select("head", "stop", "conv_id"))
    both = rows.join(named, "head", "left")
    settled = both.filter(F.col("stop").isNull()).select(rows.columns)
    ends = F.length("path") == F.col("stop") * UNIT
    depth = F.col("stop") + F.when(ends, 0).otherwise(1)
    mark = F.when(ends, F.lit(bytearray(b"."))).otherwise(F.lit(bytearray()))
    moved = both.filter(F.col("stop").isNotNull()).select(
        F.md5(F.concat(turns_in(F.col("path"), 0, depth), mark)).alias("head"), F.col("head").alias("above"),
        depth.alias("depth"), F.col("conv_id").alias("parent_least"), ends.alias("at_end"),
        "path", "chunk", "n", "least", "ids",
    )
    return settled, moved


class Node:
    __slots__ = ("depth", "size", "n", "least", "children", "leaves", "saved", "sha", "below")

    def __init__(self, depth: int, size: int):
        self.depth, self.size, self.n, self.least = depth, size, 0, None
        self.children = self.leaves = self.saved = 0
        self.sha, self.below = NONE, []

    def row(self, parent: int | None) -> tuple:
        return (self.least, self.depth, parent, self.n, self.children, self.leaves, self.saved, self.sha)


def close(node: Node, above: Node | None) -> list[tuple]:
    """Rows of the node's children, whose parent is now known; its sums go to ``above``."""
    node.leaves += node.children == 0
    node.saved += (node.n - 1) * node.size
    rows = [child.row(node.least) for child in node.below]
    node.below = []
    if above is not None:
        above.n += node.n
        above.least = node.least if above.least is None else min(above.least, node.least)
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        above.below.append(node)
    return rows


def text_bytes(path: bytes, depth: int) -> int:
    return int.from_bytes(path[depth * UNIT - 4 : depth * UNIT], "big") if depth else 0


def sweep(rows: Iterator[dict]) -> Iterator[tuple]:
    """Nodes of containers (head and above, then the node's row) from rows sorted by head, path
    and chunk: open nodes lie on a stack, and each is closed when the order leaves it.

    Held are the open nodes and the closed children of these, which wait for their
    parent's least id.
    """
    stack: list[Node] = []
    head = path = sha = first = None

    def shut(depth: int) -> Iterator[tuple]:
        while stack and stack[-1].depth >= depth:
            node = stack.pop()
            for row in close(node, stack[-1] if stack else None):
                yield (first["head"], first["above"], INNER, *row)
            if not stack:
                kind = ENDS if first["at_end"] else TOP
                yield (first["head"], first["above"], kind, *node.row(first["parent_least"]))

    for row in rows:
        if row["head"] != head or row["path"] != path:
            if sha is not None:
                stack[-1].sha = sha.hexdigest()
            new, common = row["path"], row["depth"]
            if row["head"] != head:
                yield from shut(0)
                head, first = row["head"], row
            else:
                shared = min(len(new), len(path)) // UNIT
                while common < shared and new[common * UNIT : common * UNIT + UNIT] == path[common * UNIT : common * UNIT + UNIT]:
                    common += 1
                yield from shut(common + 1)
            for depth in range(common if not stack else common + 1, len(new) // UNIT + 1):
                stack.append(Node(depth, text_bytes(new, depth)))
            path, sha = new, hashlib.sha256()
        else:
            sha.update(b",")
        node = stack[-1]
        node.n += row["n"]
        node.least = row["least"] if node.least is None else min(node.least, row["least"])
        sha.update(row["ids"].encode())
    if sha is not None:
        stack[-1].sha = sha.hexdigest()
        yield from shut(0)


def as_nodes(rows: DataFrame, work) -> DataFrame:
    """(SWEPT) that ``work`` makes of an iterator over the rows, in batches."""
    names = [f.split()[0] for f in SWEPT.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    kinds = [types[f.split()[1]] for f in SWEPT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = work({k: v.as_py() for k, v in zip(batch.schema.names, row)} for batch in batches for row in zip(*batch.columns))
        while some := list(islice(nodes, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    return rows.mapInArrow(run, SWEPT)


def chains(heads: Iterator[dict]) -> Iterator[tuple]:
    """Nodes of burst heads, from the end of each chain up; ``kids``, ``leaves`` and ``saved`` of
    a head are the number and the sums of the containers below it."""
    for head in heads:
        saved, sha, children = head["saved"], head["ends_sha256"] or NONE, head["kids"]
        for depth in range(head["stop"], head["depth"] - 1, -1):
            saved += (head["n_convs"] - 1) * text_bytes(head["path"], depth)
            top = depth == head["depth"]
            parent = head["parent_least"] if top else head["conv_id"]
            yield (
                head["head"], head["above"], TOP if top else INNER, head["conv_id"], depth, parent,
                head["n_convs"], children, head["leaves"], saved, sha,
            )
            sha, children = NONE, 1


def prefix_nodes(paths: DataFrame, container: int = CONTAINER) -> DataFrame:
    """(NODE): the nodes of the trie of ``paths`` (conv_id, path), see ``paths_of``.

    A node is a distinct sequence of first turns. It has the least ``conv_id`` and the number
    ``n_convs`` of the paths that start with it, its ``depth``, its parent's conv_id (null for
    the root), its children, the childless nodes and the ``saved_tokens`` of its subtree (for
    each node n_convs - 1 times the bytes of its last text), and a hash of the ids that
    end there. Empty paths end at the root. No paths give no nodes.

    Distinct paths hang as suffixes in containers under heads, first all under the root.
    A container of more than ``container`` rows bursts: what its paths share becomes a
    chain, and their next turn deals them out. Rounds go on until no container is crowded,
    each over the crowded ones only. Then every container is sorted and swept in one task,
    and sums climb the burst heads round by round. Equal paths are counted before, so a
    crowd of copies is a few rows; its ids pass through the sweep as a stream.
    """
    rows = stored(in_chunks(paths).select(
        F.lit("").alias("head"), F.lit(None).cast("string").alias("above"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_least"), F.lit(False).alias("at_end"), "path", "chunk", "n", "least", "ids",
    ), "suffixes")
    rounds, settled = [], []
    while True:
        heads = stored(crowded(rows, container), "heads")
        if heads.isEmpty():
            settled.append(rows)
            break
        rounds.append(heads)
        stay, moved = burst(rows, heads)
        settled.append(stay)
        rows = stored(moved, "suffixes")
    dealt = reduce(DataFrame.union, settled).repartition("head")
    nodes = stored(as_nodes(dealt.sortWithinPartitions("head", "path", "chunk"), sweep), "nodes")
    parts, tops = [nodes], nodes
    for heads in reversed(rounds):
        below = tops.filter(F.col("kind") == TOP).groupBy(F.col("above").alias("head")).agg(
            F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
        ends = nodes.filter(F.col("kind") == ENDS).select(F.col("above").alias("head"), "ends_sha256")
        part = stored(as_nodes(heads.join(below, "head").join(ends, "head", "left"), chains), "chains")
        parts.append(part)
        tops = nodes.union(part)
    return reduce(DataFrame.union, parts).filter(F.col("kind") != ENDS).drop("head", "above", "kind")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_nodes`` of a table (conv_id, turn, role, text).

    Turns are ordered by number, null first; turns of one number by a hash of role and text.
    A null role or text counts as empty. Rows without conv_id are left out. Repeated rows
    are turns of their own. Other columns are ignored.
    """
    return prefix_nodes(paths_of(conversations))


def rebuilt(paths: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Every conversation with its first h turns replaced by those of the first of its group of
    ``group`` ids; h is a hash of the id below ``most``."""
    shared = paths.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), turns_in(F.col("path"), 0, F.lit(most - 1)).alias("first")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(shared, "base", "left")
    first = F.coalesce(turns_in(F.col("first"), 0, h), F.lit(bytearray()))
    return joined.select("conv_id", F.concat(first, turns_in(F.col("path"), h)).alias("path"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(rebuilt(paths_of(load(spark, sf_dir, "conversations"))))


SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, (xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, byte: list_reduce(
        list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda bits, step: xor(bits >> 1, 3988292384 * (bits & 1)))
    )) % 9) AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d,
    md5(len(role) || ':' || role || text) AS unit, strlen(text) AS size
  FROM (
    SELECT ids.conv_id, 0 AS part, i, role, text FROM ids JOIN own ON own.conv_id = base AND i <= h
    UNION ALL SELECT ids.conv_id, 1, i, role, text FROM ids JOIN own ON own.conv_id = ids.conv_id AND i > h
  )
), members AS (
  SELECT conv_id, 0 AS d, '' AS node, 0 AS size FROM ids
  UNION ALL
  SELECT conv_id, d, string_agg(unit, ',') OVER (PARTITION BY conv_id ORDER BY d), size FROM turns
), nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM members GROUP BY d, node
), lines AS (
  SELECT n.d, n.node, n.conv_id, p.node AS parent, p.conv_id AS parent_conv_id
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.d = n.d - 1 JOIN nodes p ON p.d = m.d AND p.node = m.node
), kids AS (
  SELECT d - 1 AS d, parent AS node, count(*) AS n FROM lines GROUP BY ALL
), sums AS (
  SELECT m.d, m.node, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved
  FROM nodes n LEFT JOIN kids ON kids.d = n.d AND kids.node = n.node
    JOIN members m ON m.conv_id = n.conv_id AND m.d <= n.d
  GROUP BY m.d, m.node
), ends AS (
  SELECT d, node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT * FROM members QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY d, node
)
SELECT n.conv_id, n.d::BIGINT AS depth, lines.parent_conv_id, n.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  sums.n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN lines USING (d, node) LEFT JOIN kids USING (d, node) JOIN sums USING (d, node) LEFT JOIN ends USING (d, node)
"""
