"""Ordered per-key computations that survive a hot key.

A plain ``Window.partitionBy(session)`` sends a whole session to one task. Here
keys with very many rows are cut into *pieces*:

1. one scan of keys and order keeps the rows whose hash ends in zeros, a fixed
   share of them, and takes every STEP-th of a key as a *border* of that key;
2. the rows are exchanged once, by (key, piece), and the window runs inside the
   piece: a session spreads over as many tasks as it has pieces;
3. borders are rows of the table, so the first row of every piece is known before
   the exchange: ``with_next`` adds it to the piece before, and ``with_rank`` adds the
   number of rows up to it.

Most keys have no border and are one piece. The share is of rows and not of
moments, so many events of one moment are cut by event id like others. Equal
rows of keys and order stay together. Keys must not be null.
"""

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

CELL = "__cell"
PIECE = "__piece"
BORDERS = "__borders"
ALL = "__all"
EVENT_ORDER = ("ts", "event_id")
# One row in so many is sampled (a power of two), and a piece has about STEP sampled rows: a million rows.
RATE = 1 << 16
STEP = 16
# Largest n for which Spark cuts each input partition to n rows per key
# before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
SALTS = 64

WindowFn = Callable[[WindowSpec], Column]
before = (Window.unboundedPreceding, -1)


def borders(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], carried: Sequence[str] = ()
) -> DataFrame:
    """(keys, BORDERS): the rows at which keys with many rows are cut, in order.

    A border holds the ordering columns and the ``carried`` ones. There is about one
    border per RATE * STEP rows of the table, so it stays small enough to be broadcast.
    """
    names = [*order, *[c for c in carried if c not in order]]
    sampled = F.xxhash64(*keys, *order).bitwiseAND(F.lit(RATE - 1)) == 0
    # Known keys are asked for here, or a join would ask and the uses would not share one exchange.
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = df.filter(sampled & known).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*names))).alias("__rows")
    )
    picked = F.filter("__rows", lambda _, i: (i > 0) & (i % STEP == 0))
    place = lambda row: F.struct(*[row[c] for c in order])
    fresh = lambda row, i: (i == 0) | (place(F.get("__picked", i - 1)) < place(row))
    some = rows.filter(F.size("__rows") > STEP).withColumn("__picked", picked)
    return some.select(*keys, F.filter("__picked", fresh).alias(BORDERS))


def piece_of(order: Sequence[str]) -> Column:
    """The number of BORDERS up to the row, found by halving."""
    at = F.struct(*order)

    def halve(seen: Column, _: Column) -> Column:
        middle = F.shiftright(seen["low"] + seen["high"], 1)
        border = F.get(BORDERS, middle)
        below = F.coalesce(F.struct(*[border[c] for c in order]) <= at, F.lit(False))
        unsure = seen["low"] < seen["high"]
        return F.struct(
            F.when(unsure & below, middle + 1).otherwise(seen["low"]).alias("low"),
            F.when(unsure & ~below, middle).otherwise(seen["high"]).alias("high"),
        )

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(BORDERS) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(BORDERS).alias("high"))
    return F.when(F.col(BORDERS).isNull(), 0).otherwise(F.aggregate(rounds, start, halve)["low"])


def in_pieces(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: DataFrame, how: str = "left"
) -> DataFrame:
    """The rows with BORDERS of their key and PIECE."""
    return df.join(F.broadcast(cut), list(keys), how).withColumn(PIECE, piece_of(order))


def in_cells(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    cell: Column,
    local: Mapping[str, WindowFn],
    summary: Mapping[str, Column],
    inherited: Mapping[str, WindowFn],
) -> DataFrame:
    """Add ``local`` columns (window inside the cell of a key) and ``inherited`` columns
    (window over the ``summary`` rows of the key, one per cell). Cells must not fall where
    the order rises."""
    keys = list(keys)
    rows = df.withColumn(CELL, cell)
    inside = Window.partitionBy(*keys, CELL).orderBy(*order)
    cells = rows.groupBy(*keys, CELL).agg(*[agg.alias(name) for name, agg in summary.items()])
    across = Window.partitionBy(*keys).orderBy(CELL)
    cells = cells.select(*keys, CELL, *[fn(across).alias(name) for name, fn in inherited.items()])
    rows = rows.withColumns({name: fn(inside) for name, fn in local.items()})
    return rows.join(cells, [*keys, CELL], "left").drop(CELL)


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    order: Sequence[str] = EVENT_ORDER,
) -> DataFrame:
    """``lead`` within the keys: ``columns`` maps output name to source column.

    The border behind a piece is added to it as a row of its own, which the window
    sees and the result does not: no summary and no join behind the window.
    """
    keys = list(keys)
    cut = borders(df, keys, order, list(columns.values()))
    rows = in_pieces(df, keys, order, cut).drop(BORDERS).withColumn("__border", F.lit(False))
    behind = cut.select(*keys, F.posexplode(BORDERS).alias(PIECE, "__row")).select(
        *keys, PIECE, "__row.*", F.lit(True).alias("__border")
    )
    inside = Window.partitionBy(*keys, PIECE).orderBy(*order)
    led = rows.unionByName(behind, allowMissingColumns=True).withColumns(
        {name: F.lead(column).over(inside) for name, column in columns.items()}
    )
    return led.filter(~F.col("__border")).select(*df.columns, *columns)


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    order: Sequence[str] = EVENT_ORDER,
    *,
    first: str | None = None,
) -> DataFrame:
    """``row_number`` within the keys; ``first`` also adds the key's first ordering value.

    Rows up to a border are counted in a scan of the cut keys alone, one number per piece.
    """
    keys = list(keys)
    cut = borders(df, keys, order)
    counted = in_pieces(df.select(*dict.fromkeys([*keys, *order])), keys, order, cut, "inner").groupBy(*keys, PIECE).agg(
        F.count(F.lit(1)).alias("__n"), F.min(order[0]).alias("__first")
    )
    key = Window.partitionBy(*keys)
    carried = counted.select(
        *keys, PIECE,
        F.sum("__n").over(key.orderBy(PIECE).rowsBetween(*before)).alias("__before"),
        F.min("__first").over(key).alias("__first"),
    )
    inside = Window.partitionBy(*keys, PIECE)
    rows = in_pieces(df, keys, order, cut).drop(BORDERS).withColumn("__rank", F.row_number().over(inside.orderBy(*order)))
    if first:
        rows = rows.withColumn("__least", F.min(order[0]).over(inside))
    out = rows.join(F.broadcast(carried), [*keys, PIECE], "left")
    more = {name: F.col("__rank").cast("bigint") + F.coalesce("__before", F.lit(0))}
    if first:
        more[first] = F.coalesce("__first", "__least")
    return out.withColumns(more).select(*df.columns, *more)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key.

    Each input partition is cut to n rows per key before the shuffle, so a key
    sends at most n rows per partition whatever its size. Above Spark's limit
    for that rewrite, a salted first round does the cutting.
    """
    keys = list(keys)
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        salted = Window.partitionBy(*keys, salt).orderBy(*order)
        df = df.withColumn("__top", F.row_number().over(salted)).filter(F.col("__top") <= n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__top", rank).filter(F.col("__top") <= n).drop("__top")


def newest_page(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], offset: int, limit: int
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a table in an order that falls in ``by``.

    The table is cut in pieces and these are counted; only pieces that the page touches
    are exchanged and numbered. However deep the page lies, no task and not the driver
    sees the rows before it: their number is known from one row per piece.
    """
    cut = borders(df.withColumn(ALL, F.lit(0)), [ALL], by).select(BORDERS).scalar()
    pieces = lambda rows: rows.withColumn(BORDERS, cut).withColumn(PIECE, piece_of(by))
    counted = pieces(df.select(*by)).groupBy(PIECE).agg(F.count(F.lit(1)).alias("__n"))
    newer = Window.orderBy(F.col(PIECE).desc()).rowsBetween(*before)
    placed = counted.withColumn("__before", F.coalesce(F.sum("__n").over(newer), F.lit(0)))
    touched = placed.filter((F.col("__before") < offset + limit) & (F.col("__before") + F.col("__n") > offset))
    inside = Window.partitionBy(PIECE).orderBy(*order)
    numbered = (
        pieces(df).join(F.broadcast(touched.select(PIECE, "__before")), PIECE)
        .withColumn("__place", F.col("__before") + F.row_number().over(inside))
        .filter((F.col("__place") > offset) & (F.col("__place") <= offset + limit))
    )
    return numbered.orderBy("__place").limit(limit).select(*df.columns)
