import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trailspark.llm import suffixes
from trailspark.llm.suffixes import LENGTH, OWNER, anchors, front_coded, merged, op4_suffixes, read_run, remove_repeats

SF = "/root/testdata/sf0.001"


def plain(texts):
    seen = Counter()
    for t in texts:
        seen.update({} if len(t) < LENGTH else [hash(t[i : i + LENGTH]) for i in range(len(t) - LENGTH + 1)])
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - LENGTH + 1):
            if seen[hash(t[i : i + LENGTH])] > 1:
                gone[i : i + LENGTH] = True
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_every_start_has_one_anchor_and_equal_strings_the_same(spark):
    rng = random.Random(1)
    piece = bytes(rng.choice(b"abcd ") for _ in range(LENGTH))
    for alphabet in (b"a", b"ab", b"abcdefghijklmnop "):
        data = bytes(rng.choice(alphabet) for _ in range(1500))
        data = data[:700] + piece + data[700:]
        place, first, last, core = anchors(data)
        starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
        assert starts == list(range(len(data) - LENGTH + 1))
        assert (last - first < 64).all() and (place - first < 128).all()
        owner = next(i for i in range(len(place)) if first[i] <= 700 <= last[i])
        alone = anchors(b"x" * 300 + piece + b"y" * 77)
        other = next(i for i in range(len(alone[0])) if alone[1][i] <= 300 <= alone[2][i])
        assert place[owner] - 700 == alone[0][other] - 300
        assert core[owner] == alone[3][other]


def test_runs_and_the_merge():
    rng = random.Random(2)
    for k in (1, 2, 3, 7):
        pool = [bytes(rng.choice(b"ab") for _ in range(rng.choice([3, 150]))).ljust(LENGTH, b"c") for _ in range(30)]
        runs, given = [], []
        for r in range(k):
            own = sorted({*rng.sample(pool, 12)})
            runs.append([(s, [(r, i, 0, 1)]) for i, s in enumerate(own)])
            given += own
        coded = [front_coded(r) for r in runs]
        for r, c in zip(runs, coded):
            assert [(s, o.tolist()) for _, s, o in read_run(*c)] == [(s, np.array(o, OWNER).tolist()) for s, o in r]
        out = list(merged([read_run(*c) for c in coded]))
        assert [s for _, s, _ in out] == sorted(given)
        before = b""
        for same, s, _ in out:
            assert same == next((i for i in range(min(len(s), len(before))) if s[i] != before[i]), min(len(s), len(before)))
            before = s
    assert list(merged([])) == []


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def test_against_brute_force(spark, documents, monkeypatch):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvwxyz  é") for _ in range(n))
    base, passage = text(2000), text(260)
    rows = [base, base, base[:900] + "#" + base[901:], base[37:], passage + text(500), text(333) + passage, text(50) + passage[:199] + text(9), text(70) + passage[5:205]]
    for _ in range(12):  # edits in shared text, strings that overlap, periods
        a, b = sorted(rng.sample(range(2000), 2))
        rows.append(text(rng.randint(0, 90)) + base[a:b] + text(rng.randint(0, 90)))
    rows += ["xy" * 300, "q" * 450, "Und " * 60, passage[:200] * 3, "", "short", text(199), text(200)]
    docs = documents(*enumerate(rows))
    expected = sorted((str(i), *r) for i, r in enumerate(plain([r.encode() for r in rows])))
    assert result(remove_repeats(docs)) == expected
    import trailspark.llm.suffixes as module

    monkeypatch.setattr(module, "SUFFIXES", 50)  # many ranges and runs
    assert result(remove_repeats(docs.repartition(5))) == expected
    monkeypatch.setattr(module, "CROWD", 2)  # strings one by one
    monkeypatch.setattr(module, "SUFFIXES", 500)
    assert result(remove_repeats(docs.repartition(3))) == expected


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    expected = plain([(d.text or "").encode() for d in docs])
    got = {r.doc_id: tuple(r[1:]) for r in op4_suffixes(spark, SF).collect()}
    assert got == {d.doc_id: e for d, e in zip(docs, expected)}


def test_nulls_repeats_and_no_rows(spark, documents):
    body = "".join(random.Random(3).choice("abcdefg ") for _ in range(400))
    rows = [(None, None), (None, body), (2, ""), (3, "z" * 30_000), (3, "z" * 30_000), (4, "u" + body)]
    docs = documents(*rows).withColumn("mark", F.lit("own")).withColumn("core", F.lit(1))
    expected = sorted((str(i), *e) for (i, _), e in zip(rows, plain([(t or "").encode() for _, t in rows])))
    assert result(remove_repeats(docs)) == expected
    assert remove_repeats(docs.limit(0)).count() == 0


def test_a_collision_of_core_hashes_removes_nothing(spark, documents, monkeypatch):
    own = suffixes.anchor_rows
    monkeypatch.setattr(suffixes, "anchor_rows", lambda docs: own(docs).withColumn("core", F.lit(1).cast(own(docs).schema["core"].dataType)))
    rng = random.Random(11)
    docs = documents(*[(i, "".join(rng.choice("abcdefghij") for _ in range(600))) for i in range(3)])
    assert [r.n_removed for r in suffixes.remove_repeats(docs).collect()] == [0] * 3
