"""Byte-pair encoding and decoding in batched rounds over flat arrays."""

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailspark.llm.shared import load

END = "</w>"
# White space as the vocabulary's normalizer knows it, and its split of words.
SPACES = regex.compile("[\t-\r \x85\xa0  -     　]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+")
NO_RANK = np.iinfo(np.int64).max
LONG = 512  # Rounds grow with the longest word; longer ones are merged one by one.
DOCS = 1000  # Texts whose words are merged together.
MEMORY = 300_000  # Words whose ids a task remembers.


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file (lower-casing, word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for token, number in [*ids.items(), *self.special.items()]:
            self.tokens[number] = token
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + END] for c in letters], np.int64)
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]
        keys = np.array([a * self.size + b for a, b, _ in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array([c for _, _, c in merges], np.int64)
        self.split = regex.compile("|".join(map(regex.escape, self.special)))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where it is never merged: a binary search over the keys."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_one(symbols: list[int], voc: Vocabulary) -> list[int]:
    """All merges of one long word, by rank and then from the left."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    ranks = voc.pair_ranks(np.array(symbols[:-1]), np.array(symbols[1:]))
    heap = [(int(r), i, symbols[i], symbols[i + 1]) for i, r in enumerate(ranks) if r != NO_RANK]
    heapq.heapify(heap)
    alive = [True] * n

    def push(i: int) -> None:
        k = after[i]
        rank = int(voc.pair_ranks(np.array([symbols[i]]), np.array([symbols[k]]))[0])
        if rank != NO_RANK:
            heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))

    while heap:
        rank, i, a, b = heapq.heappop(heap)
        k = after[i]
        if not alive[i] or symbols[i] != a or k < 0 or symbols[k] != b:
            continue
        symbols[i], alive[k] = int(voc.made[rank]), False
        after[i] = after[k]
        if after[k] >= 0:
            before[after[k]] = i
            push(i)
        if before[i] >= 0:
            push(before[i])
    return [s for s, live in zip(symbols, alive) if live]


def merge_words(words: Sequence[str], voc: Vocabulary) -> list[np.ndarray]:
    """Ids of each word.

    The symbols of all words lie in one array. In a round every word merges its pair of
    lowest rank, at all places from left to right; no pair that such a merge makes has a
    lower rank, so rounds give what merging one by one gives. Words without a pair to
    merge leave the array.
    """
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    encoded = [w.encode() for w in words]
    short = [i for i, b in enumerate(encoded) if len(b) <= LONG]
    for i, b in enumerate(encoded):
        if len(b) > LONG:
            data = np.frombuffer(b, np.uint8)
            symbols = [*voc.inner[data[:-1]].tolist(), int(voc.last[data[-1]])]
            out[i] = np.array(merge_one(symbols, voc), np.int64)
    if not short:
        return out
    sizes = np.array([len(encoded[i]) for i in short])
    flat = np.frombuffer(b"".join(encoded[i] for i in short), np.uint8)
    word = np.repeat(np.arange(len(short)), sizes)
    symbol = voc.inner[flat]
    ends = np.cumsum(sizes) - 1
    symbol[ends] = voc.last[flat[ends]]
    while len(symbol):
        inside = word[1:] == word[:-1]
        rank = np.where(inside, voc.pair_ranks(symbol[:-1], symbol[1:]), NO_RANK)
        rank = np.append(rank, NO_RANK)
        starts = np.flatnonzero(np.append(True, ~inside))
        counts = np.diff(np.append(starts, len(symbol)))
        least = np.minimum.reduceat(rank, starts)
        done = least == NO_RANK
        if done.any():
            for s, c in zip(starts[done].tolist(), counts[done].tolist()):
                out[short[word[s]]] = symbol[s : s + c]
            stay = np.repeat(~done, counts)
            symbol, word, rank = symbol[stay], word[stay], rank[stay]
            least, counts = least[~done], counts[~done]
            if not len(symbol):
                break
        hit = rank == np.repeat(least, counts)
        # In a run of overlapping places every second one counts, from the left.
        places = np.flatnonzero(hit)
        fresh = np.append(True, np.diff(places) > 1)
        run_start = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))]
        places = places[(places - run_start) % 2 == 0]
        symbol[places] = voc.made[rank[places]]
        keep = np.ones(len(symbol), bool)
        keep[places + 1] = False
        symbol, word = symbol[keep], word[keep]
    return out


def pieces(text: str, voc: Vocabulary) -> list[str | int]:
    """Words of the normalized text, and ids of the special tokens that stand in it."""

    def plain(part: str) -> list[str]:
        part = SPACES.sub(" ", unicodedata.normalize("NFC", part))
        return PIECES.findall(part.replace("Σ", "σ").lower())

    found: list[str | int] = []
    at = 0
    for m in voc.split.finditer(text):
        found += plain(text[at : m.start()])
        found.append(voc.special[m[0]])
        at = m.end()
    return found + plain(text[at:]) if at else plain(text)


def encode_texts(texts: Sequence[str | None], voc: Vocabulary, known: dict) -> list[np.ndarray]:
    """Ids of each text; ``known`` remembers words over calls, a bounded number of them."""
    parts = [pieces(t or "", voc) for t in texts]
    new = [*{p for part in parts for p in part if p not in known}]
    if len(known) + len(new) > MEMORY:
        known.clear()
        new = [*{p for part in parts for p in part}]
    words = [p for p in new if isinstance(p, str)]
    known.update({p: np.array([p]) for p in new if not isinstance(p, str)})
    known.update(zip(words, merge_words(words, voc)))
    empty = np.empty(0, np.int64)
    return [np.concatenate([known[p] for p in part]) if part else empty for part in parts]


def decode_ids(ids: Sequence[int], voc: Vocabulary) -> str:
    """The vocabulary has no decoder of its own: its tokens joined by blanks."""
    return " ".join(map(voc.tokens.__getitem__, ids))


def with_ids(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with ``ids`` (token numbers of the whole text) and ``decoded``.

    ``path`` is a vocabulary file that every executor has. Null counts as an empty text and
    has no ids. Tasks merge the words they have not met, many at once. Columns named
    ``ids`` or ``decoded`` are replaced; repeated rows give equal results; an empty table
    gives no rows.
    """
    names = [c for c in (keep or docs.columns) if c not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, known = vocabulary(path), {}
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                rows = batch.slice(start, DOCS)
                found = encode_texts(rows.column(0).to_pylist(), voc, known)
                flat = np.concatenate(found) if found else np.empty(0, np.int64)
                offsets = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                decoded = pa.array([decode_ids(x.tolist(), voc) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[1:], ids, decoded], [*(f"c{i}" for i in range(len(names))), "ids", "decoded"]
                )

    given = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    out = given.mapInArrow(run, ", ".join([*fields, "ids array<int>", "decoded string"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "ids", "decoded")


def digests() -> dict[str, Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of the columns ``ids`` and ``decoded``."""
    return {
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join("ids", " "), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir).select("doc_id", "text")
    return with_ids(docs, default_vocabulary(), ["doc_id"]).withColumns(digests()).drop("ids", "decoded")
