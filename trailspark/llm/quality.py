"""Quality rules whose thresholds come from quantile sketches per language and source."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailspark.llm.shared import load, same, stored

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

# How far from the middle half of its group a text may lie, as a multiple of the width of
# that half; widths below the second number (in the measure's own unit) count as that.
REACH = 4
MEASURES = {"word_length": 25, "symbols": 25, "dup_lines": 50, "repeats": 50}
LEAST_ROWS = 100


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW words that are found twice or more."""
    if len(ids) <= WINDOW:
        return 0
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        n = len(ids) - WINDOW + 1
        rolling = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            rolling = rolling * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    ordered = np.sort(rolling)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    rank = ids  # Exact: ranks of pairs, of pairs of pairs, and so on.
    step = 1
    while step < WINDOW:
        pairs = rank[:-step].astype(np.int64) * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one text; null counts as empty."""
    text = text or ""
    data = text.encode()
    words = data.split()
    blanks = len(data) - sum(map(len, words))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return (
        len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(ids), len(lines),
    )


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the STATS of ``text`` as longs, named with ``__``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t.as_py()) for t in batch.column(0)]
            found = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATS))]
            names = [*(f"c{i}" for i in range(len(keep))), *(f"__{s}" for s in STATS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], names)

    given = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = given.mapInArrow(run, ", ".join([*fields, *(f"__{s} long" for s in STATS)]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[f"__{s}" for s in STATS])


def measures() -> dict[str, Column]:
    """Whole numbers: letters per 100 words, and parts per 1000 in which short texts are smoothed."""
    words = F.greatest("__n_words", F.lit(1))
    ratio = lambda part, whole: F.floor(part / whole)
    return {
        "word_length": ratio(F.col("__word_chars") * 100, words),
        "symbols": ratio(F.col("__n_symbols") * 1000, words + 10),
        "dup_lines": ratio(F.col("__n_dup_lines") * 1000, F.col("__n_lines") + 10),
        "repeats": ratio(F.col("__n_repeat_words") * 1000, words + 50),
    }


def base_failed() -> Column:
    return (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))


def cell(value: Column) -> Column:
    """Lower end of the value's cell in the sketch: exact below 64, then 32 cells per doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    width = F.pow(F.lit(2.0), shift).cast("long")
    return F.floor(value / width) * width


def sketches(rows: DataFrame) -> DataFrame:
    """Counts per (lang, source, measure, cell) over texts that pass the base rules.

    Sketches of the same measure merge by adding counts, in any order and to the same
    result; a task adds up its own rows first, so a crowded source is a few rows a task.
    """
    kinds = F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("value")) for n, c in measures().items()])
    flat = rows.filter(~base_failed()).select("lang", "source", F.inline(kinds))
    return flat.groupBy("lang", "source", "measure", cell(F.col("value")).alias("cell")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _limits(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Lower and upper threshold of each merged sketch with enough rows."""
    merged = counts.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("total", F.sum("n").over(group)).withColumn(
        "up_to", F.sum("n").over(group.orderBy("cell"))
    )
    quartile = lambda q: F.min(F.when(F.col("up_to") * 4 >= F.col("total") * q, F.col("cell")))
    quarters = ranked.filter(F.col("total") >= LEAST_ROWS).groupBy(*keys, "measure").agg(
        quartile(1).alias("low"), quartile(3).alias("high")
    )
    least = F.element_at(F.create_map(*[x for n, w in MEASURES.items() for x in (F.lit(n), F.lit(w))]), F.col("measure"))
    reach = REACH * F.greatest(F.col("high") - F.col("low"), least)
    return quarters.select(*keys, "measure", (F.col("low") - reach).alias("lower"), (F.col("high") + reach).alias("upper"))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row per (lang, source): ``limits``, a map from measure to (lower, upper).

    A group with fewer than LEAST_ROWS texts uses the merged sketch of its language, and a
    small language that of all texts; with too few texts at all there is no threshold.
    """
    counts = stored(sketches(rows), "sketches")
    groups = rows.select("lang", "source").distinct()
    own, of_lang, of_all = (_limits(counts, k) for k in (["lang", "source"], ["lang"], []))
    as_map = lambda df, keys, name: df.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("measure", F.struct("lower", "upper")))).alias(name)
    )
    own, of_lang = as_map(own, ["lang", "source"], "own"), as_map(of_lang, ["lang"], "of_lang")
    of_all = as_map(of_all, [], "of_all").first()  # one row
    first = groups.join(own, same(groups, own, ["lang", "source"]), "left").select(groups["*"], "own")
    second = first.join(of_lang, same(first, of_lang, ["lang"]), "left").select(first["*"], "of_lang")
    entries = [x for k, v in sorted(of_all[0].items()) for x in (F.lit(k), F.struct(F.lit(v["lower"]).alias("lower"), F.lit(v["upper"]).alias("upper")))]
    fallback = [F.create_map(*entries)] if entries else []
    return second.select("lang", "source", F.coalesce("own", "of_lang", *fallback).alias("limits"))


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``lang``, ``source``, the columns ``keep``, the stats (named with ``__``), ``__failed`` and
    ``__kept``.

    A text is kept if it passes the base rules and each measure lies between the thresholds
    of its language and source; low ends bind only the word length. Null texts count as
    empty and fail; null languages and sources are groups of their own; repeated rows count
    each; an empty table gives no rows.
    """
    names = ["lang", "source", *[c for c in (keep or []) if c not in ("lang", "source")]]
    rows = stored(with_stats(docs, names), "stats")
    # Written first, the table of thresholds has a known size: while that is small Spark broadcasts
    # it and the rows stay where they are; a larger one is joined by a shuffle with skew handling.
    limits = stored(thresholds(rows).coalesce(4), "limits")
    joined = rows.join(limits, same(rows, limits, ["lang", "source"]), "left").select(rows["*"], limits["limits"].alias("__limits"))
    inside = F.lit(True)
    for name, value in measures().items():
        bound = F.try_element_at("__limits", F.lit(name))
        ok = value <= bound["upper"]
        if name == "word_length":
            ok = ok & (value >= bound["lower"])
        inside = inside & F.coalesce(ok, F.lit(True))
    return joined.withColumn("__failed", base_failed()).withColumn("__kept", ~F.col("__failed") & inside).drop("__limits")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``, whatever their names.

    Null and empty texts fail. Null languages and sources are values like others, and
    repeated rows have one verdict. An empty table gives no rows.
    """
    names = docs.columns
    given = docs.select("text", "lang", "source", *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    kept = judge(given, [f"k{i}" for i in range(len(names))]).filter("__kept")
    return kept.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(load(spark, sf_dir).select("doc_id", "text", "lang", "source"), ["doc_id"])
    return judged.select(
        "doc_id", *[F.col(f"__{s}").alias(s) for s in STATS[:5]],
        F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"),
    )
