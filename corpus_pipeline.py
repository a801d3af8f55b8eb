"""From raw documents to token ids of a cleaned corpus that is mixed to target weights, in stages.

Stages take documents with doc_id, text, lang and source. Any column may be null, texts may
be empty or long, rows may be repeated, and further columns of any name go through all
stages but the last as they are. A table without rows gives none.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailspark.llm.bpe import default_vocabulary, digests, with_ids
from trailspark.llm.lines import dedup_lines
from trailspark.llm.mixing import mixed
from trailspark.llm.quality import keep_good
from trailspark.llm.shared import load, stored
from trailspark.llm.simhash import DISTANCE, WORDS, keep_one


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail the rules; a null language
    or source is a value like others; repeated rows have one verdict."""
    return keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of lines that stand earlier; ``n_chars`` follows the text.

    Every document stays, also one whose text is empty then. A null text stays null and
    keeps its ``n_chars``. Repeated rows are one document and keep the same lines.
    """
    # Names of its own for the other columns, so that none meets a count of the operator.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = {f"own{i}": c for i, c in enumerate(others)}
    given = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for k, c in own.items()])
    found = dedup_lines(given).select("doc_id", "text", *own).withColumnsRenamed(own)
    out = found.select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, one with the least doc_id. Null and empty
    texts are one group; of repeated rows one stays."""
    return keep_one(docs, WORDS, DISTANCE)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them. A null source is the
    last one; documents without words take no part of a target and are left out."""
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the token ids of each text and digests of them and of what they
    decode to. A null text is empty and has no ids."""
    encoded = with_ids(docs, default_vocabulary(), ["doc_id", "lang", "source"])
    return encoded.withColumns(digests()).drop("decoded")


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing", mixed_sources),
    ("BPE", token_ids),
]

# Several stages have no SQL form; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = load(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
