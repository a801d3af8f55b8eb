import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from trailspark.llm import quality
from trailspark.llm.quality import LEAST_ROWS, MEASURES, REACH, cell, judge, keep_good, op6_quality, text_stats

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    lines = [x for x in lines if WORD.search(x)]
    for line in lines:
        again += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), len(lines)


def plain_cell(v):
    shift = max(v.bit_length() - 6, 0)
    return v >> shift << shift


def plain_measures(s):
    words = max(s[0], 1)
    return dict(zip(MEASURES, (s[1] * 100 // words, s[2] * 1000 // (words + 10), s[3] * 1000 // (s[5] + 10), s[4] * 1000 // (words + 50))))


def plain_verdicts(docs):
    """docs: (key, text, lang, source)."""
    stats = {k: plain_stats(t) for k, t, _, _ in docs}
    failed = {k: s[0] < 20 or 100 * s[4] > 30 * s[0] for k, s in stats.items()}
    groups = defaultdict(list)
    for k, _, lang, source in docs:
        if not failed[k]:
            for g in ((lang, source), (lang,), ()):
                groups[g].append(plain_measures(stats[k]))

    def limits(g, name):
        if len(groups[g]) < LEAST_ROWS:
            return None
        cells = sorted(plain_cell(m[name]) for m in groups[g])
        n = len(cells)
        low, high = cells[-(-n // 4) - 1], cells[-(-3 * n // 4) - 1]
        reach = REACH * max(high - low, MEASURES[name])
        return low - reach, high + reach

    out = {}
    for k, _, lang, source in docs:
        kept = not failed[k]
        for name, value in plain_measures(stats[k]).items():
            found = next((x for g in ((lang, source), (lang,), ()) if (x := limits(g, name))), None)
            if found:
                kept &= value <= found[1] and (name != "word_length" or value >= found[0])
        out[k] = (*stats[k][:5], failed[k], kept)
    return out


def test_statistics_of_odd_texts():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "x " * 50, "é ü # |\n\n\x0b\nq\nq\n q", "w" * 400_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(8, 60))) for _ in range(50)]
    texts += ["\n".join(rng.choice(["a b", "c", " ", "d e f g h i j k l"]) for _ in range(20)) for _ in range(20)]
    for text in texts:
        assert text_stats(text) == plain_stats(text)


def test_cells(spark):
    rows = spark.range(5000).select("id", cell(F.col("id")).alias("c")).collect()
    assert all(r.c == plain_cell(r.id) for r in rows)


def test_query(spark):
    docs = [(d.doc_id, d.text, d.lang, d.source) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r[0]: tuple(r[1:]) for r in op6_quality(spark, SF).collect()}
    assert got == plain_verdicts(docs)


def test_labelled_documents(spark):
    kept = {r.doc_id: r.kept for r in op6_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    long = {d.doc_id for d in spark.read.parquet(f"{SF}/documents.parquet").collect() if text_stats(d.text)[0] >= 20}
    good = [kept[r.doc_id] for r in labels if r.quality == 1 and r.doc_id in long]
    bad = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_nulls_repeats_clashing_names_and_no_rows(spark, documents):
    fair = "some plain words in a row that nobody would ever want to throw away because they read like any other text"
    rows = [(i, f"{fair} {i}", "en", "s") for i in range(150)] + [(None, None, None, None), (7, "", "en", None)]
    rows += [(500, fair + " |" * 60, None, "s")] * 2 + [(501, fair, None, None)] * 3
    docs = documents(*rows).withColumn("limits", F.lit("own")).withColumn("n_words", F.lit("own"))
    good = keep_good(docs)
    assert good.columns == docs.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter([*range(150), 501, 501, 501])
    assert {(r.limits, r.n_words) for r in good.collect()} == {("own", "own")}
    assert keep_good(docs.limit(0)).count() == 0
    assert judge(documents((1, fair))).select("__kept").collect() == [(True,)]
    assert quality.REACH > 0
