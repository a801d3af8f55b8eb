"""Document fingerprints by a randomised edit embedding, with banding and verification."""

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailspark.llm.shared import load, same, stored

WALKS = 2
SAMPLES = 64  # Of each walk.
CLASSES = 256  # Characters are told apart by this many classes in the walks.
PERIOD = 1 << 14  # Steps after which the shared random bits repeat.
BLOCK = 1 << 19  # Characters that are walked at once.
BAND = 4  # Samples in a band.
SHINGLE = 5  # Words of a shingle.
MINIMA = 256  # Hash minima of a text's shingles, of two bits each.
LEAST = 0.77  # Estimated similarity of near copies: 0.8 less the standard error of the estimate.
BLOCK_ROWS = 1 << 14  # Fingerprints of a band that are compared in one task.
TEXTS = 2000  # Rows whose texts are walked together.
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mix of whole numbers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def stay_table(walk: int) -> np.ndarray:
    """[class, step]: how many steps a walk that reaches a character of this class at this
    step stays on it. Every step flips a coin that depends on step and class only."""
    steps = np.arange(2 * PERIOD, dtype=np.uint64)
    table = np.empty((CLASSES, PERIOD), np.uint8)
    for c in range(CLASSES):
        coins = mixed((steps % PERIOD) * np.uint64(CLASSES * WALKS) + np.uint64(c * WALKS + walk) + np.uint64(1)) & np.uint64(1)
        leaves = np.flatnonzero(coins)
        table[c] = leaves[np.searchsorted(leaves, np.arange(PERIOD))] - np.arange(PERIOD) + 1
    return table


def sample_places(walk: int) -> list[np.ndarray]:
    """For each sample, the places that it takes as texts grow.

    A sample of a text of length L is the last of its places below L: a uniform choice
    that two texts share unless it lies in what one has more. From place t - 1 the next
    lies at floor(t / u), the law of the records of a random sequence.
    """
    out = []
    for k in range(SAMPLES):
        draws = mixed(np.arange(400) + (walk * SAMPLES + k + 1) * 1_000_003)
        places, t = [0], 1
        for u in (draws >> np.uint64(11)).astype(float) / 2**53:
            t = int(t / max(u, 1e-9)) + 1
            places.append(t - 1)
            if t > 1 << 50:
                break
        out.append(np.array(places))
    return out


class Embedding:
    """The shared random walks."""

    def __init__(self) -> None:
        self.stay = [stay_table(w).ravel() for w in range(WALKS)]
        self.places = [sample_places(w) for w in range(WALKS)]

    def _walk(self, codes: list[np.ndarray], lengths: np.ndarray, walk: int) -> np.ndarray:
        """Samples of texts in order of falling length; a block of characters of all at once."""
        places = np.stack([p[np.searchsorted(p, 2 * lengths) - 1] for p in self.places[walk]], 1)
        out = np.ones((len(codes), SAMPLES), np.uint8)  # what a walk that has ended early shows
        clock = np.zeros(len(codes), np.int64)
        stay, start, most = self.stay[walk], 0, int(lengths[0])
        while start < most:
            live = int(np.searchsorted(-lengths, -start, "left"))
            size = min(max(256, BLOCK // live), most - start)
            # Columns are texts; one more character is read for the pairs.
            letters = np.zeros((size + 1, live), np.int64)
            for i in range(live):
                part = codes[i][start : start + size + 1]
                letters[: len(part), i] = part
            rows = ((letters[:-1] * 0x9E3779B1 >> 15) & (CLASSES - 1)) * PERIOD
            times = np.empty((size + 1, live), np.int64)
            times[0] = now = clock[:live]
            inside = np.searchsorted(-lengths, -np.arange(start, start + size), "left").tolist()
            for j, n in enumerate(inside):
                at = now[:n]
                place = at & (PERIOD - 1)
                place += rows[j, :n]
                at += stay.take(place)
                times[j + 1] = now
            wanted = places[:live]
            text, sample = np.nonzero((wanted >= times[0][:, None]) & (wanted < times[-1][:, None]))
            if len(text):
                span = int(times[-1].max()) + 1
                flat = (times + np.arange(live) * span).T.ravel()
                at = np.searchsorted(flat, wanted[text, sample] + text * span, "right") - 1 - text * (size + 1)
                pair = letters[at, text] * (1 << 21) + letters[at + 1, text]
                out[text, sample] = mixed(pair * 4096 + sample + 1) % np.uint64(254) + np.uint64(2)
            start += size
        return out

    def prints(self, texts: Sequence[str]) -> list[bytes]:
        """WALKS * SAMPLES bytes for each text; zeros for an empty one."""
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64)
        out = np.zeros((len(texts), WALKS * SAMPLES), np.uint8)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if len(order):
            own = [codes[i] for i in order]
            out[order] = np.hstack([self._walk(own, lengths[order], w) for w in range(WALKS)])
        return [r.tobytes() for r in out]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal samples in the walk in which most are equal."""
    equal = np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)
    return float(equal.reshape(WALKS, SAMPLES).mean(axis=1).max())


POWER = np.uint64(0x9E3779B97F4A7C15)  # Of the rolling hash over bytes; odd, so that it has an inverse.
INVERSE = np.uint64(pow(int(POWER), -1, 1 << 64))


class Sketches:
    """Hash minima of word shingles: the share of equal ones estimates how alike two texts are."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)
        seeds = mixed(np.arange(1, 2 * MINIMA + 1) * 1_000_033)
        # Half words: twice as many fit a vector instruction, and few shingles of a text share one.
        halves = (seeds >> np.uint64(32)).astype(np.uint32)
        self.factors, self.terms = halves[:MINIMA] | np.uint32(1), halves[MINIMA:]

    def _shingles(self, text: str) -> np.ndarray:
        """Hashes of all shingles; fewer words make one, none makes none."""
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) >= len(self.powers):
            size = 2 * len(data) + 1
            self.powers, self.inverses = (
                np.concatenate(([np.uint64(1)], np.full(size, f))).cumprod(dtype=np.uint64) for f in (POWER, INVERSE)
            )
        inside = np.concatenate(([False], (data != 32) & ((data < 9) | (data > 13)), [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate(([np.uint64(0)], ((data + np.uint64(1)) * self.powers[: len(data)]).cumsum(dtype=np.uint64)))
        words = mixed((sums[ends] - sums[starts]) * self.inverses[starts] + np.uint64(1))
        wide = min(SHINGLE, len(words))
        if not wide:
            return words
        out = np.zeros(len(words) - wide + 1, np.uint64)
        for k in range(wide):
            out = out * POWER + words[k : k + len(out)]
        return mixed(out)

    def sketch(self, text: str) -> bytes:
        """MINIMA values of two bits; zeros for a text without words."""
        least = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
        shingles = (self._shingles(text) >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(shingles), 512):
            part = shingles[start : start + 512, None] * self.factors
            part += self.terms
            np.minimum(least, part.min(axis=0), out=least)
        if not len(shingles):
            return bytes(MINIMA // 4)
        a, b, c, d = (mixed(least) & np.uint64(3)).astype(np.uint8).reshape(-1, 4).T
        return (a << 6 | b << 4 | c << 2 | d).tobytes()


def minima(sketches: list[bytes]) -> np.ndarray:
    """One row of MINIMA values for each sketch."""
    packs = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, MINIMA // 4)
    return np.stack([packs >> k & 3 for k in (6, 4, 2, 0)], 2).reshape(-1, MINIMA)


def least_equal(least: float) -> int:
    """Equal minima from which texts count as alike: one in 4 is equal by chance."""
    return math.ceil(MINIMA * (least + (1 - least) / 4))


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text as compressed bytes, null as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for batch in batches:
            texts = pa.array([pack((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text binary")


def with_next(docs: DataFrame, cells: int) -> DataFrame:
    """(doc_id, text, next_text) of ``packed`` rows: the text of the next row by falling doc_id; the first after the
    last. Null ids come last, equal ids by a hash of the text.

    Rows are cut into ranges of the order, of about equal numbers. Ids that many rows share
    are cut further by the hash. The first row of each range is also sent to the range
    before it, so each range finds its answers alone.
    """
    rows = docs.withColumn("hash", F.xxhash64("text"))
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)]) if cells > 1 else F.array(F.lit(0.5))
    bounds = docs.agg(F.percentile_approx("doc_id", shares, F.lit(100 * cells))).first()[0] or []
    crowded = sorted({b for i, b in enumerate(bounds[1:]) if b == bounds[i]})
    steps = sorted(set(bounds))
    # Number of bounds above the id: falling order.
    above = F.size(F.filter(F.lit(steps), lambda b: b > F.col("doc_id"))) if steps else F.lit(0)
    many = F.col("doc_id").isNull() | (F.col("doc_id").isin(crowded) if crowded else F.lit(False))
    part = F.floor((F.col("hash") / 2.0**64 + 0.5) * cells).cast("int")
    major = 2 * F.when(F.col("doc_id").isNull(), len(steps) + 1).otherwise(above)
    # A crowded id is the last of its range; its hash ranges follow the rest of the range.
    cell = F.when(many, (major + 1) * (cells + 1) + part).otherwise(major * (cells + 1)).cast("long")
    placed = rows.withColumn("cell", cell)
    order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), -F.col("hash").cast("decimal(20,0)"), F.col("hash").alias("hash"))
    firsts = placed.groupBy("cell").agg(F.max(order).alias("first")).select(
        "cell", F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias("hash")
    ).orderBy("cell").collect()  # a few rows for each of ``cells``
    if not firsts:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"))
    before = [firsts[i - 1]["cell"] for i in range(len(firsts))]
    heads = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["hash"], b) for r, b in zip(firsts, before)], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hash long, cell long"
    )
    heads = F.broadcast(heads)
    sent = rows.join(heads, same(rows, heads, ["doc_id", "hash"])).select(rows["*"], heads["cell"])
    both = placed.withColumn("head", F.lit(False)).union(sent.withColumn("head", F.lit(True)))
    falling = Window.partitionBy("cell").orderBy("head", F.col("doc_id").desc_nulls_last(), "hash", "text")
    return both.withColumn("next_text", F.lead("text").over(falling)).filter(~F.col("head")).select(
        "doc_id", "text", "next_text"
    )


def fingerprint_pairs(pairs: DataFrame) -> DataFrame:
    """Fingerprints of packed (doc_id, text, next_text): of the text and of its edited form, as bytes,
    and the ``sketch`` of the text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks, unpack, sketches = Embedding(), zstandard.ZstdDecompressor().decompress, Sketches()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                rows = batch.slice(start, TEXTS)
                ids = rows.column(0)
                texts, following = ([unpack(t.as_py()).decode() for t in rows.column(i)] for i in (1, 2))
                forms = [edited(t, f) for t, f in zip(texts, following)]
                distinct = [*{*texts, *following, *forms}]
                found = dict(zip(distinct, walks.prints(distinct)))
                words = {t: sketches.sketch(t) for t in {*texts}}
                own = [found[t] for t in texts]
                changed = [found[t] for t in forms]
                columns = [
                    ids, pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).digest() for t in forms], pa.binary()),
                    pa.array(own, pa.binary()), pa.array(changed, pa.binary()),
                    pa.array([likeness(a, b) for a, b in zip(own, changed)]),
                    pa.array([likeness(a, found[f]) for a, f in zip(own, following)]),
                    pa.array([words[t] for t in texts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*NAMES, "sketch"])

    return pairs.mapInArrow(run, (
        f"doc_id {pairs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 binary, "
        "fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, sketch binary"
    ))


def _first_alike(rows: np.ndarray, below: np.ndarray, others: np.ndarray, equal: int) -> np.ndarray:
    """For each row, the first of ``others`` with so many equal minima among as many as ``below`` says, or -1."""
    out = np.full(len(rows), -1, np.int64)
    for i, most in enumerate(below.tolist()):
        start, size = 0, 64
        while start < most:
            part = others[start : min(start + size, most)]
            same_bits = np.packbits(part == rows[i], axis=1).view(np.uint64)
            hits = np.flatnonzero(np.bitwise_count(same_bits).sum(axis=1) >= equal)
            if len(hits):
                out[i] = start + hits[0]
                break
            start, size = start + size, min(4 * size, 4096)
    return out


def nearest_known(prints: DataFrame, least: float = LEAST, block: int = BLOCK_ROWS) -> DataFrame:
    """(mark, near_id, n): the least doc_id among the verified partners of a text, its own included,
    from (doc_id, mark, fingerprint, sketch), where ``mark`` is a hash of the last two; ``n``
    rows have the mark.

    Rows of one mark are one. Each is cut into bands of BAND samples of its fingerprint, and the
    sketches of the texts' shingles decide for all pairs that share a band, however many do: pairs
    count as alike from an estimated similarity of ``least`` on. A band of more than ``block`` rows
    is dealt into blocks, and each pair of blocks is a cell of its own, so a task holds two blocks at
    most. In a cell rows go by doc_id and look for the first before them that is alike. Sketches are
    shuffled only for bands that two share.
    """
    own = prints.groupBy("mark", "fingerprint", "sketch").agg(F.min("doc_id").alias("own_id"), F.count(F.lit(1)).alias("rows"))
    bands = F.array(*[
        F.xxhash64(F.lit(i), F.substring("fingerprint", i * BAND + 1, BAND)) for i in range(WALKS * SAMPLES // BAND)
    ])
    cut = own.select("mark", F.explode(bands).alias("key"))
    shared = cut.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut.join(shared, "key")
    blocks = F.ceil(F.col("n") / block)
    mine = F.pmod(F.xxhash64("mark", "sketch"), F.col("blocks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("mine")).alias("low"), F.greatest(k, F.col("mine")).alias("high")
    ))
    placed = (
        own.join(met, "mark").withColumn("blocks", blocks).withColumn("mine", mine).withColumn("cell", F.explode(cells))
        .select("key", "cell.low", "cell.high", (F.col("mine") > F.col("cell.low")).alias("side"), "own_id", "mark", "sketch")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", F.col("own_id").asc_nulls_last(), "mark", "sketch")
    )
    equal = least_equal(least)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mark", "lead_id"]

        def found(run: pa.Table) -> list[tuple[pa.Array, pa.Array]]:
            rows = minima(run["sketch"].to_pylist())
            ids, marks = run["own_id"].combine_chunks(), run["mark"].combine_chunks()
            known = len(ids) - ids.null_count
            parts = [(np.arange(len(rows)),) * 2]
            if run["low"][0] != run["high"][0]:
                side = run["side"].to_numpy()
                one, other = np.flatnonzero(~side), np.flatnonzero(side)
                parts = [(one, other), (other, one)]
            out = []
            for at, against in parts:
                below = np.searchsorted(against, np.minimum(at, known))
                hit = _first_alike(rows[at], below, rows[against], equal)
                yes = hit >= 0
                if yes.any():
                    out.append((marks.take(pa.array(at[yes])), ids.take(pa.array(against[hit[yes]]))))
            return out

        def runs() -> Iterator[pa.Table]:
            """Rows of one cell at a time; a cell may go over several batches."""
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
                starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for a, b in zip(starts, starts[1:]):
                    cell = keys[a].tolist()
                    if held and cell != last:
                        yield pa.Table.from_batches(held)
                        held = []
                    last = cell
                    held.append(batch.slice(a, b - a))
            if held:
                yield pa.Table.from_batches(held)

        for run in runs():
            for marks, ids in found(run):
                yield pa.RecordBatch.from_arrays([marks, ids], names)

    kind = prints.schema["doc_id"].dataType.simpleString()
    true = placed.mapInArrow(verify, f"mark long, lead_id {kind}").groupBy("mark").agg(F.min("lead_id").alias("lead_id"))
    return own.join(true, "mark", "left").groupBy("mark").agg(
        F.min(F.least("own_id", "lead_id")).alias("near_id"), F.sum("rows").alias("n")
    )


def embed(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """One row per row of ``docs``: NAMES, and ``near_id``, the least doc_id of a text that shares a band
    of its fingerprint and 0.8 of its five-word shingles, as hash minima tell with a standard error
    of 0.03 (``nearest_known``).

    Null texts are empty; an empty text has a fingerprint of zeros and is like empty texts
    only. Texts of fewer than five words have one shingle. Null doc_ids and repeated rows are
    rows like others. A single row is its own next. An empty table gives no rows. Other
    columns are not read.
    """
    if cells is None:
        cells = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(fingerprint_pairs(with_next(packed(docs), cells)), "embedding")
    marked = found.withColumn("mark", F.xxhash64("fingerprint", "sketch"))
    near = stored(nearest_known(marked.select("doc_id", "mark", "fingerprint", "sketch")), "near")
    # Marks of more than a 1000th of all rows are fewer than 1000: their rows need no exchange.
    hot = F.broadcast(near.filter(F.col("n") > found.count() // 1000 + 1000))
    rest = marked.join(hot.select("mark"), "mark", "left_anti").join(near, "mark")
    both = marked.join(hot, "mark").unionByName(rest)
    text = {c: F.lower(F.hex(c)) for c in NAMES if dict(found.dtypes)[c] == "binary"}
    return both.select(*[text.get(c, F.col(c)).alias(c) for c in NAMES], "near_id")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(load(spark, sf_dir).select("doc_id", "text"))
