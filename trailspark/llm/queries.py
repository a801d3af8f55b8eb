"""The queries of this subpackage, by name."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailspark.llm import bpe, decontamination, embedding, lines, mixing, negatives, prefixes, quality, secrets, sharding, simhash, suffixes, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        embedding.op1_fingerprints, bpe.op2_bpe, lines.op3_line_dedup, suffixes.op4_suffixes,
        simhash.op5_simhash, quality.op6_quality, secrets.op7_secrets, urls.op8_url_filters, sharding.op9_sharding, mixing.op10_mixing,
        decontamination.op11_decontamination, negatives.op12_hard_negatives,
        prefixes.op13_prefix_trie,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": lines.SQL, "op11_decontamination": decontamination.SQL,
        "op12_hard_negatives": negatives.SQL, "op13_prefix_trie": prefixes.SQL,
    }
