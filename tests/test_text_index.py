"""The gram index: whole results, few files, batches that did not finish."""

import random

import pytest
from pyspark.sql import functions as F

from trailspark.operators.tools import search_text
from trailspark.session import names_in
from trailspark.sources import text_index as X

LETTERS = "abcdefghij ÄßéI\n😀İ"


def texts(spark, count=600, parts=6, seed=3):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 60)))) for i in range(count)]
    rows += [(count, None), (count + 1, ""), (count + 2, "ab"), (count + 3, "x" * 300_000 + "Needle" + "y" * 300_000)]
    return spark.createDataFrame(rows, "id long, text string").repartitionByRange(parts, "id")


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    for seed in (3, 4):
        X.index_texts(texts(spark, seed=seed), path, block_bits=4)
    return path


@pytest.mark.parametrize("terms", [
    ["abc"], ["needle"], ["ÄSS", "éi"], ["ab"], ["😀"], ["😀ab", "hij"], ["i\na", "jjj"], ["nowhere at all"], ["a.c"], ["", "bad"], ["İab"],
])
def test_same_rows_as_a_scan(spark, store, terms):
    everything = texts(spark, seed=3).unionByName(texts(spark, seed=4))
    assert found(X.search_indexed(spark, store, terms)) == found(search_text(everything, terms))


def test_a_rare_term_reads_few_files_and_blocks(spark, store):
    rows = X.rows_to_search(spark, store, ["needle"])
    assert len(rows.inputFiles()) == 2
    pushed = rows._jdf.queryExecution().executedPlan().toString().partition("PushedFilters:")[2]
    assert 0 < rows.count() <= 2 * 2**4 and "(__block," in pushed
    assert X.rows_to_search(spark, store, ["nowhere at all"]).count() == 0
    postings = X.candidate_blocks(spark, store, X.batches_of(spark, store)[0], ["needle"])
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.partition("PartitionFilters:")[2].partition("]")[0]


def test_many_candidates_read_everything(spark, store, monkeypatch):
    monkeypatch.setattr(X, "LISTED", 3)
    everything = texts(spark, seed=3).unionByName(texts(spark, seed=4))
    assert found(X.search_indexed(spark, store, ["abc"])) == found(search_text(everything, ["abc"]))
    assert len(X.rows_to_search(spark, store, ["abc"]).inputFiles()) > 10


def test_a_batch_that_did_not_finish_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    with pytest.raises(ValueError):
        X.search_indexed(spark, path, ["abc"])
    df = texts(spark).withColumns({"gram": F.lit("own"), "file": F.lit(1), "block": F.lit(2)})

    def fails(*_):
        raise OSError

    with monkeypatch.context() as m:
        m.setattr(X, "create_json", fails)
        with pytest.raises(OSError):
            X.index_texts(df, path)
    assert X.batches_of(spark, path) == [] and names_in(spark, path)
    X.index_texts(df, path)
    assert found(X.search_indexed(spark, path, ["abc"])) == found(search_text(df, ["abc"]))
    X.index_texts(df.limit(0), path)
    assert found(X.search_indexed(spark, path, ["abc"])) == found(search_text(df, ["abc"]))


def test_postings_hold_each_gram_once_a_block(spark, store):
    batch = X.batches_of(spark, store)[0]
    rows = spark.read.schema(X.POSTINGS).parquet(f"{store}/{batch}/grams")
    assert rows.count() == rows.distinct().count()
    stored = spark.read.parquet(f"{store}/{batch}/texts")
    expected = set()
    for r in stored.select("text", "__block").collect():
        low = (r.text or "").lower()
        expected |= {(r["__block"], low[i:i + 3]) for i in range(len(low) - 2)}
    got = {(r.block, r.gram) for r in rows.collect()}
    # A character of two code units may add a gram that starts in its middle.
    plain = {p for p in expected if p[1].isascii()}
    assert plain <= got and {g for g in got if g[1].isascii() and "?" not in g[1]} <= expected
