import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from trailspark.llm.embedding import (
    BAND, CLASSES, LEAST, MINIMA, PERIOD, SAMPLES, WALKS, Embedding, Sketches, edited, embed, least_equal, likeness, minima, mixed,
    nearest_known, op1_fingerprints,
)

SF = "/root/testdata/sf0.01"


def plain_print(walks, text):
    """Step by step: show the pair at the pointer, then flip the coin of step and class."""
    if not text:
        return bytes(WALKS * SAMPLES)
    codes = [*map(ord, text), 0]
    out = bytearray()
    for w in range(WALKS):
        shown, i, step, entered = [], 0, 0, 0
        while i < len(text) and step < 2 * len(text):
            shown.append(codes[i] * (1 << 21) + codes[i + 1])
            if step == entered:
                leave = step + int(walks.stay[w][(codes[i] * 0x9E3779B1 >> 15 & CLASSES - 1) * PERIOD + step % PERIOD])
            step += 1
            if step == leave:
                i, entered = i + 1, step
        for k in range(SAMPLES):
            place = max(int(p) for p in walks.places[w][k] if p < 2 * len(text))
            out.append(int(mixed(np.array([shown[place] * 4096 + k + 1]))[0] % 254 + 2) if place < len(shown) else 1)
    return bytes(out)


def test_prints_are_the_plain_walks():
    walks = Embedding()
    rng = random.Random(2)
    texts = ["", "a", "ab", "é\U0001f600x", "q" * 300] + ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    assert walks.prints(texts) == [plain_print(walks, t) for t in texts]


def test_coins_depend_on_step_and_class_and_are_fair():
    walks = Embedding()
    assert 1.9 < np.mean(walks.stay[0]) < 2.1
    assert not np.array_equal(walks.stay[0], walks.stay[1])


def test_likeness_follows_edits():
    walks = Embedding()
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("etaoinshrdlu ") for _ in range(n))
    near, half, far = [], [], []
    for _ in range(40):
        a = text(2000)
        b = a
        for _ in range(4):
            i = rng.randrange(len(b))
            b = b[:i] + rng.choice(["", "x", "yz"]) + b[i + 1 :]
        p = walks.prints([a, b, edited(a, text(2000)), text(2000)])
        near.append(likeness(p[0], p[1]))
        half.append(likeness(p[0], p[2]))
        far.append(likeness(p[0], p[3]))
    assert np.mean(near) > 0.75 and 0.4 < np.mean(half) < 0.65 and np.mean(far) < 0.1
    assert min(half) > max(far)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    following = {d.doc_id: docs[(i + 1) % len(docs)].text for i, d in enumerate(docs)}
    rows = {r.doc_id: r for r in op1_fingerprints(spark, SF).collect()}
    assert len(rows) == len(docs)
    by_text = {}
    for d in docs:
        r = rows[d.doc_id]
        form = edited(d.text, following[d.doc_id])
        assert (r.n_chars, r.edited_sha256) == (len(d.text), hashlib.sha256(form.encode()).hexdigest())
        assert by_text.setdefault(d.text, r.fingerprint) == r.fingerprint
        assert r.near_edited == likeness(bytes.fromhex(r.fingerprint), bytes.fromhex(r.edited_fingerprint))
        other = by_text.get(following[d.doc_id])
        assert other is None or r.near_next == likeness(bytes.fromhex(r.fingerprint), bytes.fromhex(other))
        assert r.near_id <= d.doc_id
    first = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        assert rows[d.doc_id].near_id <= first.setdefault(d.text, d.doc_id)


def test_order_with_nulls_ties_repeats_and_few_rows(spark, documents):
    rows = [(None, "n1 text"), (None, "n2 text"), (5, "five five"), (5, "other five"), (5, "other five"), (1, None), (9, "x" * 30_000)]
    docs = documents(*rows).withColumn("hash", F.lit("own"))
    for cells in (1, 3, 40):
        got = embed(docs, cells).collect()
        ids = sorted(str(r.doc_id) for r in got)
        assert ids == sorted(["None", "None", "5", "5", "5", "1", "9"])
        forms = {(t, f): hashlib.sha256(edited(t or "", f or "").encode()).hexdigest() for _, t in rows for _, f in rows}
        used = [next(k for k, v in forms.items() if v == r.edited_sha256 and len(k[0] or "") == r.n_chars) for r in got]
        assert len(used) == 7
        assert embed(docs, cells).filter("doc_id = 1").first().fingerprint == "00" * WALKS * SAMPLES
    one = embed(documents((3, "abcdef")), 4).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abcabc").hexdigest()]
    assert embed(docs.limit(0), 4).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text):
    words = words_of(text)
    wide = min(5, len(words))
    return {tuple(words[i : i + wide]) for i in range(len(words) - wide + 1)} if wide else set()


def test_sketches_estimate_the_share_of_shingles():
    rng, made = random.Random(6), Sketches()
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    for n, changed in ((3, 1), (60, 1), (300, 5), (5000, 200), (5000, 40), (200, 200)):
        a = [rng.choice(vocabulary) for _ in range(n)]
        b = list(a)
        for i in rng.sample(range(n), changed):
            b[i] = "new" + b[i]
        one, two = shingles(" ".join(a)), shingles("\n".join(b))
        equal = (minima([made.sketch(" ".join(a))]) == minima([made.sketch("\x0b".join(b) + " ")])).mean()
        assert abs((equal - 1 / 4) * 4 / 3 - len(one & two) / len(one | two)) < 0.16
    assert made.sketch(" a  b\tc\n") == made.sketch("a b c") != made.sketch("a c b")
    assert made.sketch("") == made.sketch(" \n") == bytes(MINIMA // 4) != made.sketch("a")
    assert made._shingles("x y " * 40).size == 76 and len({*made._shingles("x y " * 40).tolist()}) == 2


def test_near_copies_are_found(spark, documents):
    """Copies with a few other words, as many as leave 0.81 to 0.97 of the shingles."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    rows, sizes = [], ((100, 1), (300, 6), (1000, 10), (3000, 10), (3000, 30))
    for size, changed in sizes:
        for _ in range(40):
            a = [rng.choice(vocabulary) for _ in range(size)]
            b = list(a)
            for i in rng.sample(range(size), changed):
                b[i] = rng.choice(vocabulary)
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = {r.doc_id: r.near_id for r in embed(documents(*rows)).select("doc_id", "near_id").collect()}
    assert all(near in (i, i - i % 2) for i, near in got.items())
    for k in range(len(sizes)):
        linked = [got[i] == i - 1 for i in range(80 * k + 1, 80 * k + 81, 2)]
        assert np.mean(linked) >= 0.9, sizes[k]


def test_all_pairs_of_a_crowded_band_are_verified(spark):
    rng = random.Random(8)
    size, half = WALKS * SAMPLES, MINIMA // 4
    fresh = lambda n: bytes(rng.randrange(256) for _ in range(n))
    template = fresh(BAND)
    rows = []
    for i in range(150):  # all share the first band; only two at a time are alike by their sketches
        sketch = fresh(half)
        near = bytearray(sketch)
        for k in rng.sample(range(half), rng.randint(30, 60)):
            near[k] ^= 0x10
        rows += [(2 * i, template + fresh(size - BAND), sketch)]
        rows += [(None if i % 9 == 0 else 2 * i + 1, template + fresh(size - BAND), bytes(near))]
    rng.shuffle(rows)
    alike = lambda a, b: (minima([a]) == minima([b])).sum() >= least_equal(LEAST)
    plain = {}
    for own, p, sketch in rows:
        plain[p] = min((i for i, _, other in rows if i is not None and alike(sketch, other)), default=own)
    assert 60 < sum(plain[p] != i for i, p, _ in rows if i is not None and i % 2)
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint binary, sketch binary")
    prints = prints.withColumn("mark", F.xxhash64("fingerprint", "sketch"))
    for block in (7, 1 << 14):
        got = prints.join(nearest_known(prints, block=block), "mark")
        assert {bytes(r.fingerprint): r.near_id for r in got.collect()} == plain
