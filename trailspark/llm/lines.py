"""Removal of repeated passages of lines, found by content-defined chunks."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailspark.llm.shared import WORD, load, same

SPREAD = 3  # One line in so many ends a chunk.
LONG = 50  # A line of so many words is a chunk of its own.
FACTOR = 31  # Of the rolling hash over line hashes.


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunks_of(text: Column) -> Column:
    """The text's lines in chunks of (text, lines, words), in order.

    Joined by newlines, the chunks are the text. A rolling hash over the hashes of a line
    and the one before decides whether the line ends a chunk, so the same passage is cut at
    the same lines wherever it stands, but for its first line. A long line has an end before
    and after it, and the last line is an end.
    """
    hash_of = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")
    fact_of = lambda x: F.struct(
        hash_of(x).alias("hash"), F.regexp_count(x, F.lit(WORD)).alias("words")
    )

    def stops_of(facts: Column) -> Column:
        def ends(fact: Column, i: Column) -> Column:
            before = F.coalesce(F.get(facts, i - 1)["hash"], F.lit(0))
            rolled = F.pmod(fact["hash"] * FACTOR + before, F.lit(SPREAD)) == 0
            beside = (fact["words"] >= LONG) | (F.coalesce(F.get(facts, i + 1)["words"], F.lit(0)) >= LONG)
            return rolled | beside | (i == F.size(facts) - 1)

        return F.filter(F.transform(facts, lambda f, i: F.when(ends(f, i), i)), lambda i: i.isNotNull())

    def pieces(lines: Column, facts: Column, stops: Column) -> Column:
        def piece(stop: Column, k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.get(stops, k - 1) + 1)
            count = stop - start + 1
            words = F.aggregate(F.slice(facts, start + 1, count), F.lit(0), lambda n, f: n + f["words"])
            body = F.array_join(F.slice(lines, start + 1, count), "\n")
            return F.struct(body.alias("text"), count.alias("lines"), words.alias("words"))

        return F.transform(stops, piece)

    return let(lines_of(text), lambda lines: let(
        F.transform(lines, fact_of), lambda facts: let(
            stops_of(facts), lambda stops: pieces(lines, facts, stops)
        )
    ))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, places): the numbers of the chunks to remove from each document.

    ``mark`` is a hash of the text. Chunks count if they have a word and two lines, or a
    long line. Their hashes are counted first; only the bytes of chunks with a repeated
    hash are shuffled, grouped by the bytes themselves, and the first by (doc_id, mark,
    number) stays. Counts are added up in each task before the shuffle.
    """
    listed = docs.select(
        "doc_id", "mark", F.posexplode(chunks_of(F.col("text"))).alias("place", "chunk")
    ).select("doc_id", "mark", "place", "chunk.*")
    able = listed.filter((F.col("words") > 0) & ((F.col("lines") > 1) | (F.col("words") >= LONG)))
    hashed = able.withColumn("hash", F.xxhash64("text"))
    often = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    candidates = hashed.join(often, "hash", "left_semi").select("hash", "text", "doc_id", "mark", "place")
    firsts = candidates.groupBy("hash", "text").agg(
        F.min(F.struct("doc_id", "mark", "place")).alias("first"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select("hash", F.col("text").alias("bytes"), "first")
    later = candidates.join(firsts, "hash").filter(F.col("text") == F.col("bytes")).filter(
        ~F.struct("doc_id", "mark", "place").eqNullSafe(F.col("first"))
    )
    return later.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("place")).alias("places"))


def without(chunks: Column, places: Column) -> Column:
    """The chunks that are not at the sorted ``places``: the runs between them."""

    def run(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get(places, k - 1) + 1)
        stop = F.coalesce(F.get(places, k), F.size(chunks))
        return F.slice(chunks, start + 1, stop - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), run))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, ``text`` without repeated chunks, ``n_lines`` of the given text and
    ``n_removed``, the lines taken out.

    All rows stay; a text may become empty. A null text stays null. Rows with equal doc_id
    and text are one document: their chunks do not repeat each other, and both rows lose
    the same ones. Columns of ``docs`` named like the two counts are replaced. An empty
    table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    given = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("mark"),
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names) if c != "text"],
    )
    gone = repeated_chunks(given.select("doc_id", "mark", "text"))
    joined = given.join(gone, same(given, gone, ["doc_id", "mark"]), "left").select(given["*"], "places")
    # Whole texts meet the places; only those that lose a chunk are cut again.
    places = F.col("places")
    left = joined.withColumn("left", F.when(
        places.isNotNull(), let(chunks_of(F.col("text")), lambda chunks: without(chunks, places))
    ))
    text = F.when(F.col("left").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform("left", lambda c: c["text"]), "\n")
    )
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    n_left = F.aggregate("left", F.lit(0), lambda n, c: n + c["lines"]).cast("long")
    return left.select(
        *[text.alias(c) if c == "text" else F.col(f"k{i}").alias(c) for i, c in enumerate(names)],
        n_lines.alias("n_lines"), F.coalesce(n_lines - n_left, F.lit(0).cast("long")).alias("n_removed"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir).select("doc_id", "text"))


SQL = rf"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), facts AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h,
    len(regexp_extract_all(line, '{WORD}')) AS words
  FROM lines
), ends AS (
  SELECT *,
    (h * {FACTOR} + coalesce(lag(h) OVER w, 0)) % {SPREAD} = 0 OR words >= {LONG}
      OR coalesce(lead(words) OVER w, 0) >= {LONG} AS stop
  FROM facts WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(stop::INT) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM ends
), chunks AS (
  SELECT doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n, sum(words) AS words
  FROM numbered GROUP BY doc_id, place
), judged AS (
  SELECT *, words > 0 AND (n > 1 OR words >= {LONG}) AND row_number() OVER (
    PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone
  FROM chunks
)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text, j.n_lines, j.n_removed
FROM documents d JOIN (
  SELECT doc_id, string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone) AS text,
    sum(n)::BIGINT AS n_lines, (coalesce(sum(n) FILTER (gone), 0))::BIGINT AS n_removed
  FROM judged GROUP BY doc_id
) j USING (doc_id)
"""
