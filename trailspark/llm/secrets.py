"""Secrets in texts: fixed forms, and values of credential fields that are costly to guess."""

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailspark.llm.shared import load, stored

# The forms of the base, with the least length of what counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "guess")
# A text without any of these, in lower case, has no credential field.
HINTS = ("passw", "pwd", "passphrase", "passcode", "secret", "token", "api_key", "apikey", "api key", "api-key", "credential", "private_key", "access_key", "auth")
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_ -]?key|access_key|private_key|credentials?|auth)"""
    r"""["']?[ \t]*(?:[:=]|=>|:=|\bis\b)[ \t]*(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"'<>,;]+))""", re.A | re.I
)
GUESSES = 36.0  # Bits: values whose cheapest way to guess costs less are no secrets.

# Rows of keys, and common parts of passwords, the most common first.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qazwsxedc", "1qaz2wsx")
WORDS = (
    "password", "pass", "admin", "user", "login", "welcome", "letmein", "secret", "test", "guest", "root", "master",
    "hello", "dragon", "monkey", "shadow", "sunshine", "princess", "football", "baseball", "iloveyou", "love",
    "change", "changeme", "default", "example", "sample", "dummy", "token", "key", "value", "your", "here", "none",
    "null", "true", "false", "my", "the", "new", "old", "me", "it", "is", "not", "set", "env", "api", "access",
    "private", "public", "server", "database", "data", "summer", "winter", "spring", "autumn", "monday", "friday",
    "god", "star", "magic", "computer", "internet", "system", "manager", "required", "optional", "string", "text",
)
JOINS = "-_./"
RANKED = 50_000  # Words of the corpus that get a rank, which bounds what is broadcast.
LONGEST = 24  # Letters of a ranked word, at most.
COPIES = 32  # A repeat has 2 to so many copies, or all that stand in a row.
LEET = str.maketrans("@4301!57$", "aaeoiists")
DAY, MONTH, YEAR, BETWEEN = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d", "[-/._]?"
DATES = [re.compile(BETWEEN.join(parts), re.A) for parts in ((YEAR, MONTH, DAY), (DAY, MONTH, YEAR), (YEAR,))]
DATE_BITS, YEAR_BITS = math.log2(365 * 120), math.log2(120)
UNIT = 8  # Characters of what is repeated, at most.


def letter_bits(c: str) -> float:
    """Cost of one character when all of its class are tried."""
    if c.isdigit():
        return math.log2(10)
    if c.isalpha():
        return math.log2(26 if c.islower() else 52)
    return math.log2(95)


class Guesser:
    """Costs of guessing with words of given ranks; the fixed words come first."""

    def __init__(self, words: Iterable[str] = ()):
        ranked = dict.fromkeys([*WORDS, *words])
        self.ranks = {w: i + 1 for i, w in enumerate(ranked)}
        self.bits = lru_cache(maxsize=10_000)(self._bits)

    def word_bits(self, part: str) -> float | None:
        """The rank, what is written large, and two bits for digits and signs that stand for letters."""
        lower = part.lower()
        rank, extra = self.ranks.get(lower), 0.0
        if rank is None and (rank := self.ranks.get(lower.translate(LEET))):
            extra = 2.0
        if rank is None:
            return None
        upper = sum(c.isupper() for c in part)
        return math.log2(rank) + extra + (0 if not upper else 1 if upper == len(part) or part[0].isupper() and upper == 1 else upper)

    def spans(self, value: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, bits) of every word, date, walk and sign that joins words."""
        n, lower = len(value), value.lower()
        for i in range(n):
            for k in range(i + 2, min(i + LONGEST, n) + 1):
                if (bits := self.word_bits(value[i:k])) is not None:
                    yield i, k, bits
            if value[i] in JOINS:
                yield i, i + 1, 2.0
            if value[i].isdigit():
                for form in DATES:
                    if m := form.match(value, i):
                        yield i, m.end(), YEAR_BITS if m.end() - i == 4 else DATE_BITS
        for row in (*WALKS, *(w[::-1] for w in WALKS)):
            steps, after = 0, dict(zip(row, row[1:]))
            for i in range(n - 1, -1, -1):
                steps = steps + 1 if i + 1 < n and after.get(lower[i]) == lower[i + 1] else int(lower[i] in row)
                for end in range(i + 3, i + steps + 1):
                    yield i, end, math.log2(len(WALKS) * 2) + math.log2(len(row)) + math.log2(end - i)

    def _bits(self, value: str) -> float:
        """Least cost of guessing ``value``, in bits, over all ways to cut it into words, dates,
        repeats, keyboard walks and spans of any letters.

        best[i] is the cost of the first i characters; each part ends a cheaper beginning. A
        part costs one bit besides, for the choice of its kind; one more letter of an open
        span costs only itself. A repeat costs its unit, guessed alone, and the number of
        its copies.
        """
        n = len(value)
        ending: dict[int, list[tuple[int, float]]] = {}
        for start, end, bits in self.spans(value):
            ending.setdefault(end, []).append((start, bits))
        best, brute = [0.0] * (n + 1), [math.inf] * (n + 1)
        same = [[0] * (n + 1) for _ in range(UNIT + 1)]  # Characters before i that stand one unit earlier too.
        for i in range(1, n + 1):
            letter = letter_bits(value[i - 1])
            brute[i] = min(best[i - 1] + 1 + letter, brute[i - 1] + letter)
            costs = [brute[i], *(best[s] + 1 + bits for s, bits in ending.get(i, ()))]
            for unit in range(1, min(UNIT, i - 1) + 1):
                same[unit][i] = same[unit][i - 1] + 1 if value[i - 1] == value[i - 1 - unit] else 0
                most = same[unit][i] // unit + 1
                if most > 1:
                    one = self.unit_bits(value[i - unit : i])
                    for copies in {*range(2, min(most, COPIES) + 1), most}:
                        costs.append(best[i - copies * unit] + 1 + one + math.log2(copies))
            best[i] = min(costs)
        return best[n]

    def unit_bits(self, unit: str) -> float:
        return min(sum(map(letter_bits, unit)), self.bits(unit))


def ranked_words(docs: DataFrame, most: int = RANKED) -> list[str]:
    """Words by the number of documents they stand in, the most common first; ties by word.

    A word is a run of 2 to LONGEST letters, in lower case. All words of all documents are
    counted, in each task before the shuffle. Of words as common as each other all are
    ranked or none, so that ``most`` are at most: the driver gets no others.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), 0)
    words = docs.select(F.explode(F.array_distinct(runs)).alias("word")).filter(F.length("word").between(2, LONGEST))
    counted = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    # One row per number of documents, of which there are few.
    by_count = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    so_far = F.sum("words").over(Window.orderBy(F.col("n").desc()))
    least = by_count.withColumn("ranked", so_far).filter(F.col("ranked") <= most).agg(F.min("n")).first()[0]
    ranked = counted.filter(F.col("n") >= least).collect() if least else []
    return [r.word for r in sorted(ranked, key=lambda r: (-r.n, r.word))]


def find_secrets(text: str | None, guesser: Guesser) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order of start, then of KINDS; null has none."""
    text = text or ""
    lower = text.lower()
    spans = []
    if any(h in lower for h in HINTS):
        spans += [
            (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH
        ]
        for m in CONTEXT.finditer(text):
            group = m.lastindex
            start, end = m.span(group)
            value = m[group].rstrip(".!?)]}") if group == 3 else m[group]
            if value and guesser.bits(value) >= GUESSES:
                spans.append((start, start + len(value), "guess"))
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def with_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with ``secrets``: (start, end, kind) in code points of the whole
    text, end exclusive.

    What a value of a credential field costs to guess depends on the ranks of words, which
    are counted over the texts of ``docs``: common words are no secrets. Null and empty
    texts have none; repeated rows have equal ones; a column named
    ``secrets`` is replaced; an empty table gives no rows. Long values cost time in
    proportion to their length.
    """
    names = [c for c in (keep or docs.columns) if c != "secrets"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    shared = docs.sparkSession.sparkContext.broadcast(ranked_words(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(shared.value)
        for batch in batches:
            found = [
                [{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(t.as_py(), guesser)]
                for t in batch.column(0)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(found, kind)], [*(f"c{i}" for i in range(len(names))), "secrets"]
            )

    given = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    out = given.mapInArrow(run, ", ".join([*fields, "secrets array<struct<start: bigint, end: bigint, kind: string>>"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "secrets")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir).select("doc_id", "text")
    found = with_secrets(docs, ["doc_id"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )
