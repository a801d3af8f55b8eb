"""Exact removal of byte strings that stand more than once, by merging sorted suffix runs."""

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailspark.llm.shared import load, stored

LENGTH = 200  # Bytes of a string that counts.
GRAM, SPAN = 16, 56  # An anchor has the least hash of a gram among SPAN places in a row.
BEFORE, AFTER = 56, 89  # All strings of an anchor contain these bytes around it.
SUFFIXES = 400_000  # Suffixes in a range of the merge, about.
SAMPLE = 50_000  # Strings, at most, from which the borders of ranges are taken.
RUN = 20_000  # Suffixes in a piece of a run.
EVERY = -1  # All strings of an anchor, as bits.
CROWD = 256  # Contexts of a core that are compared in one place.


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    with np.errstate(over="ignore"):
        h, size = data.astype(np.uint64) + np.uint64(1), 1
        while size < GRAM:
            h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
            h ^= h >> np.uint64(32)
            size *= 2
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, best: np.ufunc) -> np.ndarray:
    """``best`` of each SPAN values in a row."""
    size = 1
    while 2 * size <= SPAN:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = SPAN - size
    return best(values[: len(values) - rest], values[rest:])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last, core): anchors, the starts of the strings that belong to each, and a
    hash of the bytes that all of these contain.

    A string belongs to the first anchor from its byte BEFORE on. What is an anchor there is
    decided by bytes of the string alone, so equal strings have equal anchors; every start
    belongs to exactly one.
    """
    n = len(data)
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return none, none, none, none
    h = _hashes(np.frombuffer(data, np.uint8))
    least = _sliding(h, np.minimum)
    pad = np.zeros(SPAN - 1, np.uint64)
    chosen = _sliding(np.concatenate((pad, least, pad)), np.maximum)
    place = np.flatnonzero(chosen == h)
    first = np.maximum(np.concatenate(([-n], place[:-1])) - BEFORE + 1, 0)
    last = np.minimum(place - BEFORE, n - LENGTH)
    good = last >= first
    place, first, last = place[good], first[good], last[good]
    core = np.zeros(len(place), np.uint64)
    with np.errstate(over="ignore"):
        for at in (*range(-BEFORE, AFTER - GRAM, GRAM), AFTER - GRAM):
            core = (core ^ (core >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[place + at]
    return place, first, last, core.view(np.int64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _core(data: bytes, place: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data[place - BEFORE : place + AFTER]))


def packed_place(place, first, last):
    """The three numbers in one."""
    return (first << 13) | ((last - first) << 7) | (place - first)


def unpacked_place(code: int) -> tuple[int, int, int]:
    first = code >> 13
    return first + (code & 127), first, first + (code >> 7 & 63)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(core, mark, place): a hash of the bytes around each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py().encode()
                place, first, last, core = anchors(data)
                if len(place):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(core), pa.array(np.full(len(place), mark)), pa.array(packed_place(place, first, last))],
                        ["core", "mark", "place"],
                    )

    return docs.select("mark", "text").mapInArrow(run, "core long, mark long, place long")


def contexts(docs: DataFrame) -> DataFrame:
    """(core, context, mark, place, bytes) of the ``places`` of each row: all bytes of the
    strings of an anchor, and a hash of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, text, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data, rows = text.encode(), []
                for code in sorted(places):
                    place, first, last = unpacked_place(code)
                    part = data[first : last + LENGTH]
                    rows.append((_core(data, place), _signed(xxhash.xxh64_intdigest(part, place - first)), mark, code, part))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["core", "context", "mark", "place", "bytes"]
                )

    return docs.select("mark", "text", "places").mapInArrow(
        run, "core long, context long, mark long, place long, bytes binary"
    )


# Sorted runs ----------------------------------------------------------------

FACT = np.dtype([("same", "<u2"), ("rest", "<u2"), ("owners", "<u4")])
OWNER = np.dtype([("core", "<i8"), ("context", "<i8"), ("offset", "u1"), ("n", "<i8")])


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    low, high = known, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def front_coded(strings: list[tuple[bytes, list]]) -> tuple[bytes, bytes, bytes]:
    """A sorted run: for each string the common prefix with the one before, the length of the
    rest and the number of owners; the rests; the owners."""
    facts, rests, before = [], [], b""
    for s, own in strings:
        same = common(before, s, 0)
        facts.append((same, len(s) - same, len(own)))
        rests.append(s[same:])
        before = s
    owners = np.array([tuple(o) for _, own in strings for o in own], OWNER)
    return np.array(facts, FACT).tobytes(), b"".join(rests), owners.tobytes()


def read_run(facts: bytes, rests: bytes, owners: bytes) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(common prefix with the string before, string, owners) in order."""
    at = start = 0
    own, before = np.frombuffer(owners, OWNER), b""
    for same, size, count in np.frombuffer(facts, FACT).tolist():
        before = before[:same] + rests[at : at + size]
        yield same, before, own[start : start + count]
        at, start = at + size, start + count


def merged(runs: Iterable[Iterator[tuple[int, bytes, np.ndarray]]]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """All runs in one order, each string with the length it shares with the one before.

    A loser tree. Every waiting string keeps the length it shares with the last winner of
    its node. Of two strings the one that shares more with the last output is the smaller,
    so bytes are compared only behind equal lengths, and never those known to be common.
    """
    runs = list(runs)
    size = 1 << max(len(runs) - 1, 0).bit_length()
    head: list = [None] * size
    shared = [-1] * size  # -1: at the end

    def advance(i: int) -> None:
        item = next(runs[i], None) if i < len(runs) else None
        shared[i], head[i] = (item[0], item[1:]) if item else (-1, None)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        if shared[a] < 0:
            return a, b
        s, t = head[a][0], head[b][0]
        same = common(s, t, shared[a])
        winner, loser = (a, b) if s[same:] <= t[same:] else (b, a)
        shared[loser] = same
        return winner, loser

    for i in range(size):
        advance(i)
    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if size > 1 else 0
    while head[best] is not None:
        yield shared[best], *head[best]
        advance(best)
        node = (size + best) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


RUN_FIELDS = ("range", "facts", "rests", "owners")


def run_pieces(strings: dict[bytes, list], borders: list[bytes], head: int) -> Iterator[dict]:
    """A sorted run, cut at the borders of ranges (first ``head`` bytes) and into pieces."""
    ordered = sorted(strings.items())
    ranges = [bisect_right(borders, s[:head]) for s, _ in ordered]
    start = 0
    while start < len(ordered):
        end = bisect_right(ranges, ranges[start])
        for at in range(start, end, RUN):
            coded = front_coded(ordered[at : min(at + RUN, end)])
            yield dict(zip(RUN_FIELDS, (ranges[start], *coded)))
        start = end


def merge_sorted(classes: DataFrame, split: Callable, head: int, total: int, decide: Callable) -> DataFrame:
    """(core, context, offset) that ``decide`` finds in the global order of the strings into which
    ``split`` turns each class.

    Every task sorts its strings, equal ones once, and sends front-coded runs; a range of
    the order merges its runs. Borders come from a sample of bounded size.
    """
    count = max(1, total // SUFFIXES)
    some = classes.orderBy(F.xxhash64("core", "context")).limit(min(SAMPLE, 50 * count))
    sample = sorted(split(*r)[0][0][:head] for r in some.collect()) if count > 1 else []
    borders = sorted({sample[i * len(sample) // count] for i in range(1, count)} if sample else ())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        strings: dict[bytes, list] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                for s, owner in split(*row):
                    strings.setdefault(s, []).append(owner)
                if len(strings) >= SUFFIXES // 4:
                    yield pd.DataFrame(run_pieces(strings, borders, head))
                    strings = {}
        if strings:
            yield pd.DataFrame(run_pieces(strings, borders, head))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        runs = [read_run(*r) for r in zip(rows["facts"], rows["rests"], rows["owners"])]
        found = list(decide(merged(runs)))
        every = np.array([(o["core"], o["context"], o["offset"]) for o in found] if found else np.empty((0, 3)), np.int64)
        return pd.DataFrame(every, columns=["core", "context", "offset"])

    runs = classes.mapInPandas(run, "range int, facts binary, rests binary, owners binary")
    return runs.groupBy("range").applyInPandas(merge, "core long, context long, offset long")


def strings_of(core: int, context: int, lead: int, n: int, part: bytes) -> list[tuple[bytes, tuple]]:
    """All strings of a context, each a suffix cut at LENGTH."""
    part = bytes(part)
    return [(part[o : o + LENGTH], (core, context, o, n)) for o in range(len(part) - LENGTH + 1)]


def turned(core: int, context: int, lead: int, n: int, part: bytes) -> list[tuple[bytes, tuple]]:
    """A context as its suffix from the core on, then what stands before."""
    part, start = bytes(part), lead - BEFORE
    return [(part[start:] + part[:start], (core, context, start, n))]


def neighbours(strings: Iterator[tuple[int, bytes, np.ndarray]]) -> Iterator[np.void]:
    """Owners of strings that stand more than once: neighbours that share all bytes."""
    group: list = []

    def close() -> Iterator[np.void]:
        if len(group) > 1 or group and group[0]["n"] > 1:
            yield from group
        group.clear()

    for same, _, owners in strings:
        if same < LENGTH:
            yield from close()
        group.extend(owners)
    yield from close()


def within_cores(strings: Iterator[tuple[int, bytes, np.ndarray]]) -> Iterator[dict]:
    """Repeated strings of turned contexts: those that share the core are neighbours, and only
    they can have a string in common."""
    group: list = []

    def close() -> Iterator[dict]:
        seen: dict[bytes, list] = {}
        for s, owners in group:
            for core, context, start, n in owners.tolist():
                part = s[len(s) - start :] + s[: len(s) - start]
                own = (core, context, n)
                for offset in range(len(part) - LENGTH + 1):
                    seen.setdefault(part[offset : offset + LENGTH], []).append((own, offset))
        for owners in seen.values():
            if len(owners) > 1 or owners[0][0][2] > 1:
                for own, offset in owners:
                    yield {"core": own[0], "context": own[1], "offset": offset}
        group.clear()

    for same, s, owners in strings:
        if same < BEFORE + AFTER:
            yield from close()
        group.append((s, owners))
    yield from close()


def repeated_strings(classes: DataFrame) -> DataFrame:
    """(core, context, offset) of the strings that stand more than once, from contexts with the
    number ``n`` of places where each stands.

    Contexts are merged whole, turned to begin with the core. Cores with more than CROWD
    contexts would put them all in one range: there each string goes its own way.
    """
    crowded = classes.groupBy("core").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWD).select("core")
    columns = ["core", "context", "lead", "n", "bytes"]
    many = classes.join(crowded, "core", "left_semi").select(*columns)
    few = classes.join(crowded, "core", "left_anti").select(*columns)
    strings = many.agg(F.sum(F.length("bytes") - (LENGTH - 1))).first()[0] or 0
    apart = merge_sorted(many, strings_of, LENGTH, strings, neighbours)
    # A context counts as the strings in it that its range looks at.
    together = merge_sorted(few, turned, BEFORE + AFTER, 8 * few.count(), within_cores)
    return together.union(apart)


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) from rows with ``text`` and ``strings``:
    anchors with the offsets of their repeated strings as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, strings in zip(batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py().encode()
                if not strings:
                    rows.append((len(data), 0, 0, data))
                    continue
                edge = np.zeros(len(data) + 1, np.int32)
                for s in strings:
                    _, first, last = unpacked_place(s["place"])
                    bits = s["offsets"]
                    if bits == EVERY:
                        edge[first] += 1
                        edge[last + LENGTH] -= 1
                        continue
                    for offset in range(last - first + 1):
                        if bits >> offset & 1:
                            edge[first + offset] += 1
                            edge[first + offset + LENGTH] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), spans, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "strings").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes outside all strings
    of LENGTH bytes that start anywhere else too.

    Null texts are empty. Repeated rows are documents of their own that repeat each other.
    Null doc_ids are values like others. An empty table gives no rows; other columns are
    not read.

    Anchors whose surroundings are unique leave first, by counting hashes. Of the others,
    equal contexts are one class. A class of several that stands alone among those with its
    core is repeated as a whole. All other classes are sorted in each task, exchanged as
    front-coded runs and merged with the lengths they share: whole contexts from their core
    on, or, where a core has very many, their strings one by one.
    """
    text = F.coalesce("text", F.lit(""))
    given = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("mark"))
    rows = anchor_rows(given)
    # Rows of one core meet in order, so that each sees from its neighbours whether it is alone.
    alike = Window.partitionBy("core").orderBy("mark", "place")
    twin = F.coalesce(F.lag("place").over(alike), F.lead("place").over(alike)).isNotNull()
    places = rows.withColumn("twin", twin).filter("twin").groupBy("mark").agg(F.collect_set("place").alias("places"))
    found = stored(contexts(given.select("mark", "text").join(places, "mark")), "contexts")
    # A core that stands once here came by a collision of the first hash: nothing is known to repeat it.
    mixed_cores = found.groupBy("core").agg(
        F.min("context").alias("a"), F.max("context").alias("b"), F.count(F.lit(1)).alias("n")
    ).filter("a != b OR n = 1").select("core")
    classes = stored(
        found.join(mixed_cores, "core", "left_semi").groupBy("core", "context").agg(
            F.count(F.lit(1)).alias("n"), F.min("bytes").alias("bytes"),
            F.min(F.col("place").bitwiseAND(127)).alias("lead"),
        ), "classes",
    )
    one = F.expr("shiftleft(1L, cast(offset AS int))")
    bits = repeated_strings(classes).groupBy("core", "context").agg(F.bit_or(one).alias("bits"))
    known = classes.select("core", "context", "n").join(bits, ["core", "context"], "left").withColumn("known", F.lit(True))
    every = F.lit(EVERY).cast("long")
    offsets = F.when(F.col("known").isNull() | (F.col("n") > 1), every).otherwise(F.coalesce("bits", F.lit(0).cast("long")))
    strings = (
        found.select("core", "context", "mark", "place").join(known, ["core", "context"], "left")
        .select("mark", "place", offsets.alias("offsets")).filter("offsets != 0")
        .groupBy("mark").agg(F.collect_set(F.struct("place", "offsets")).alias("strings"))
    )
    return cut(given.join(strings, "mark", "left"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
