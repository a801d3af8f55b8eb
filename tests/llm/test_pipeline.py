"""The pipeline against the plain versions of its stages."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from test_lines import plain_dedup
from test_mixing import plain_targets
from test_quality import plain_verdicts
from test_simhash import plain_components, plain_print
from trailspark.llm.bpe import default_vocabulary
from trailspark.llm.quality import text_stats

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark):
    docs = corpus_pipeline.load(spark, SF)
    names = docs.columns
    rows = {d.doc_id: d for d in docs.collect()}
    kept = {k for k, v in plain_verdicts([(d.doc_id, d.text, d.lang, d.source) for d in rows.values()]).items() if v[-1]}
    lines = plain_dedup([(k, rows[k].text) for k in sorted(kept)])
    ids = sorted(kept)
    roots = plain_components([plain_print(lines[k][0], 4) for k in ids], 4)
    single = {ids[r] for r in roots}

    out = docs
    found = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, out, SF), "test")
        found.append(out)
    for df in found[:4]:
        assert df.columns == names
    assert {r.doc_id for r in found[0].collect()} == kept
    assert {r.doc_id: (r.text, r.n_chars) for r in found[1].collect()} == {k: (v[0], len(v[0])) for k, v in lines.items()}
    third = found[2].collect()
    assert {r.doc_id for r in third} == single and len(third) == len(single)
    size = {k: text_stats(lines[k][0])[0] for k in single}
    by_source = defaultdict(int)
    for k in single:
        by_source[rows[k].source] += size[k]
    copies = Counter(r.doc_id for r in found[3].collect())
    assert set(copies) <= single and max(copies.values()) <= 3
    taken = defaultdict(int)
    for k, n in copies.items():
        taken[rows[k].source] += n * size[k]
    longest = max(size.values())
    for source, target in plain_targets(by_source).items():
        assert abs(taken[source] - target) <= 2 * longest
    library = Tokenizer.from_file(default_vocabulary())
    last = found[4].collect()
    assert Counter(r.doc_id for r in last) == copies
    for r in last:
        ids = library.encode(lines[r.doc_id][0], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_registered():
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_documents(spark, documents):
    rows = [(None, None, None, None), (1, "", "en", "s"), (2, "a b c " * 10, "en", None)] + [(3, "plain words " + " ".join(f"w{i}" for i in range(40)), "en", "s")] * 2
    out = documents(*rows)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert {r.doc_id for r in out.collect()} <= {2, 3}
    out = documents(*rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0


def test_columns_named_like_counts_stay(spark, documents):
    line = lambda name: " ".join(f"{name}{i}" for i in range(40))
    docs = documents(*[(n, "\n".join([line(f"own{n}x"), line("a"), line("b"), line("c")])) for n in range(3)])
    for name in ("n_lines", "n_removed", "k0", "mark", "fp", "own0", "a.b"):
        docs = docs.withColumn(name, F.lit(f"is {name}"))
    out = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[name] == f"is {name}" for r in rows for name in docs.columns[5:])
