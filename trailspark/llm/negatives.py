"""Hard negatives by angular triangle bounds: integer scores only where the bounds leave a chance."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailspark.llm.shared import load, stored

SCALE = 256
DIRECTIONS = 16  # Reference directions.
SAMPLE = 2048  # Rows, at most, from which they are chosen.
TILE = 512  # Rows whose bounds are judged together.
ANCHORS = 1024  # Anchors scored against a tile at once.
BLOCK = 32_768  # Anchors that are broadcast at once, about.
SLACK = 1e-6  # Radians by which stored angles may be wrong; far above rounding.
EXACT = 2.0**53  # Sums of products below this are exact in doubles.
LAST = (1 << 63) - 1  # Place of a null id in ties.
PENDING = 200_000  # Found rows, at least, that wait before the best are kept.
ROW = "__asks boolean, __id long, __label long, __vector array<double>, __norm double, __angles array<float>"


class Vectors:
    """Rows as arrays. Shorter vectors end in zeros."""

    def __init__(self, row, ids, labels, vectors, norm, angles):
        self.row, self.ids, self.labels, self.vectors, self.norm, self.angles = row, ids, labels, vectors, norm, angles

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table) -> "Vectors":
        numbers = lambda name: batch.column(name).to_numpy()
        return Vectors(
            numbers("__row"), numbers("__id"), numbers("__label"), matrix(batch.column("__vector")),
            numbers("__norm"), matrix(batch.column("__angles")),
        )

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at) -> "Vectors":
        return Vectors(self.row[at], self.ids[at], self.labels[at], self.vectors[at], self.norm[at], self.angles[at])


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists as rows of doubles; shorter ones end in zeros."""
    sizes = pc.list_value_length(lists).to_numpy()
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(ends - sizes, sizes)] = pc.list_flatten(lists).to_numpy()
    return out


def angles_to(vectors: np.ndarray, norm: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles between rows and unit directions; a zero row counts as being at a right angle."""
    width = min(vectors.shape[1], directions.shape[1])
    product = vectors[:, :width] @ directions[:, :width].T
    cosine = np.divide(product, norm[:, None], out=np.zeros_like(product), where=norm[:, None] > 0)
    return np.arccos(np.clip(cosine, -1, 1))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, exact: by doubles where no sum can leave their
    whole numbers, else by Python's integers. Scores must fit 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return (whole(a) @ whole(b).T).astype(np.int64)


def pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit rows of the sample, each as far from those before as can be."""
    norm = np.linalg.norm(sample, axis=1)
    unit = sample[norm > 0] / norm[norm > 0, None]
    chosen = unit[:1]
    while 0 < len(chosen) < min(count, len(unit)):
        nearest = (unit @ chosen.T).max(axis=1)
        chosen = np.vstack([chosen, unit[nearest.argmin()]])
    return chosen


def prepared(df: DataFrame, vector: str, directions: int = DIRECTIONS) -> DataFrame:
    """(ROW, __row): integer vectors with norm and angles, ordered so that neighbours are alike.

    Rows with a null label or vector, or a null or non-finite component, are left out. The
    directions come from a sample of at most SAMPLE rows, those with the least hash; they
    only decide how much is scored, never what is found. Rows are dealt by nearest
    direction, angle, id and number, so no crowd of equal vectors meets in one task.
    """
    unfit = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = df.filter(
        F.col("__label").isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, unfit), F.lit(False))
    )
    whole = fit.select(
        "__asks", "__id", "__label", F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("__vector")
    )
    sample = whole.select(F.xxhash64("__id", "__vector").alias("h"), "__vector").orderBy("h").limit(SAMPLE)
    chosen = pivots(matrix(sample.toArrow().column("__vector")), directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("__vector"))
            norm = np.sqrt((vectors * vectors).sum(axis=1))
            angles = angles_to(vectors, norm, chosen)
            near = angles.argmin(axis=1) if len(chosen) else np.zeros(len(norm), np.int64)
            turn = angles.min(axis=1, initial=4)
            listed = pa.array(list(angles.astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norm), listed, pa.array(near), pa.array(turn)],
                [*batch.schema.names, "__norm", "__angles", "__near", "__turn"],
            )

    measured = whole.mapInArrow(run, ROW + ", __near long, __turn double")
    # A row's number is fixed by being written.
    numbered = stored(measured.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    order = ["__near", "__turn", "__id", "__row"]
    return stored(numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("__near", "__turn"), "vectors")


def bounds(anchors: Vectors, tile: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that each anchor can have with rows of the tile.

    By the triangle inequality the angle between two rows is at least the difference and at
    most the sum of their angles to any direction. The interval of angles gives one of
    cosines, which is multiplied by the norms and widened by far more than rounding.
    """
    low = np.zeros(len(anchors))
    high = np.full(len(anchors), np.pi)
    for j in range(anchors.angles.shape[1]):
        own, least, most = anchors.angles[:, j], tile.angles[:, j].min(), tile.angles[:, j].max()
        low = np.maximum(low, np.maximum(least - own, own - most))
        total = np.where(own + most <= np.pi, own + most, np.where(own + least >= np.pi, 2 * np.pi - own - least, np.pi))
        high = np.minimum(high, total)
    top, bottom = np.cos(np.maximum(low - SLACK, 0)), np.cos(np.minimum(high + SLACK, np.pi))
    small, large = tile.norm.min(), tile.norm.max()
    most = anchors.norm * np.where(top > 0, large, small) * top
    least = anchors.norm * np.where(bottom > 0, small, large) * bottom
    slack = 1 + SLACK * anchors.norm * large
    return least - slack, most + slack


def first_of(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each slot, by falling score, then id."""
    order = np.lexsort((ids, -score, slot))
    ordered = slot[order]
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < n]


class Best:
    """The first n rows of each slot found so far, and the score from which a row can enter."""

    def __init__(self, n: int, least: np.ndarray, patience: int):
        self.n, self.floor, self.patience = n, least.copy(), patience
        self.kept = [np.empty(0, np.int64)] * 4  # Slot, score, id, row.
        self.waiting: list[list[np.ndarray]] = []
        self.count = 0

    def add(self, *found: np.ndarray) -> None:
        self.waiting.append(found)
        self.count += len(found[0])
        if self.count > max(self.patience, len(self.kept[0])):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        both = [np.concatenate(parts) for parts in zip(self.kept, *self.waiting)]
        first = first_of(both[0], both[1], both[2], self.n)
        self.kept, self.waiting, self.count = [x[first] for x in both], [], 0
        slot, score = self.kept[:2]
        last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True)[: len(slot)])
        full = last[np.diff(np.append(-1, last)) == self.n]
        self.floor[slot[full]] = np.maximum(self.floor[slot[full]], score[full])
        return self.kept


def search(rows: DataFrame, shared: Broadcast, n: int, alike: bool) -> DataFrame:
    """The first n rows of each slot of the anchors, in each task: (slot, score, id, row).

    ``shared`` holds the anchors, and for each slot its anchor and the scores it asks for.
    With ``alike`` rows must have the anchor's label and not be the anchor, else another label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, owner, least, most = shared.value
        best = Best(n, least, PENDING)
        slots = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[slots], np.arange(len(anchors) + 1))
        most_of = np.full(len(anchors), np.iinfo(np.int64).min)
        np.maximum.at(most_of, owner, most)
        for batch in batches:
            block = Vectors.of(batch)
            for at in range(0, len(block), TILE):
                tile = block.take(slice(at, at + TILE))
                low, high = bounds(anchors, tile)
                floor = np.full(len(anchors), np.iinfo(np.int64).max)
                np.minimum.at(floor, owner, best.floor)
                able = np.flatnonzero((high >= floor) & (low <= most_of))
                for part in range(0, len(able), ANCHORS):
                    some = able[part : part + ANCHORS]
                    score = scores(anchors.vectors[some], tile.vectors)
                    same = anchors.labels[some, None] == tile.labels[None, :]
                    allowed = same & (anchors.row[some, None] != tile.row[None, :]) if alike else ~same
                    counts = starts[some + 1] - starts[some]
                    for k in range(counts.max(initial=0)):
                        with_k = np.flatnonzero(counts > k)
                        slot = slots[starts[some[with_k]] + k]
                        s = score[with_k]
                        i, j = np.nonzero(allowed[with_k] & (s >= best.floor[slot, None]) & (s <= most[slot, None]))
                        if len(i):
                            best.add(slot[i], s[i, j], tile.ids[j], tile.row[j])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.settle()], ["slot", "score", "id", "row"])

    found = rows.mapInArrow(run, "slot long, score long, id long, row long")
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(
    df: DataFrame, asks: Column, vector: str = "embedding", n_positives: int = 5, n_negatives: int = 10,
    low: int = 30, high: int = 90, block: int = BLOCK,
) -> DataFrame:
    """Hard negatives of each anchor and positive, from rows (vec_id, label, ``vector``).

    Anchors are the rows for which ``asks`` holds. The score of two rows is the inner product of
    their components times 256, rounded down. An anchor's positives are its ``n_positives``
    best other rows of the same label; the negatives of a positive are the ``n_negatives``
    best rows of other labels whose score is ``low`` to ``high`` percent of the positive's.
    Ties go to the smaller vec_id. Returns anchor_id, positive_id, rank, negative_id,
    positive_score and negative_score.

    Rows with a null label, vector or component, or an infinite one or NaN, take no part. A
    null vec_id is no anchor and comes last in ties. Rows that share a vec_id are rows of
    their own. Vectors of unequal length are as if they ended in zeros. Where a score is
    too small to leave room for a negative there is no row; an empty table gives none.
    Scores beyond 64 bits raise an error. Other columns are ignored.

    Anchors are read in blocks of about ``block``, which are broadcast in turn; rows are never
    shuffled for a search. Bounds from stored angles decide which tiles of rows are scored.
    """
    spark = df.sparkSession
    given = df.select(
        F.coalesce(asks & F.col("vec_id").isNotNull(), F.lit(False)).alias("__asks"),
        F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("__id"), F.col("label").cast("long").alias("__label"), F.col(vector).alias("__v"),
    )
    rows = prepared(given, "__v")
    asking = rows.filter("__asks")
    blocks = max(1, -(-asking.count() // block))
    out = None
    for number in range(blocks):
        mine = asking.filter(F.pmod(F.xxhash64("__row"), F.lit(blocks)) == number)
        own = Vectors.of(mine.toArrow())
        every = np.arange(len(own))
        whole = np.iinfo(np.int64)
        limits = np.full(len(own), whole.min), np.full(len(own), whole.max)
        shared = spark.sparkContext.broadcast((own, every, *limits))
        positives = search(rows, shared, n_positives, True).toArrow()
        owner, scored, names = (positives.column(c).to_numpy() for c in ("slot", "score", "id"))
        # Whole numbers between low and high percent of the score; none if it is negative.
        least = np.array([-(-low * int(s) // 100) for s in scored], np.int64)
        most = np.array([high * int(s) // 100 for s in scored], np.int64)
        slots = spark.sparkContext.broadcast((own, owner, least, most))
        found = search(rows, slots, n_negatives, False)
        named = spark.createDataFrame(pa.table({
            "slot": np.arange(len(owner)), "anchor_id": own.ids[owner], "positive_id": names, "positive_score": scored,
        }))
        part = found.join(F.broadcast(named), "slot").select(
            "anchor_id", F.nullif("positive_id", F.lit(LAST)).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.nullif("id", F.lit(LAST)).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        )
        part = stored(part, "negatives") if blocks > 1 else part
        out = part if out is None else out.union(part)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.col("label").cast("long")
    rows = given.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM given a JOIN given b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
