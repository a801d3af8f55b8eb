"""URL filtering by association rules mined from labelled URLs."""

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailspark.llm.shared import load

# The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label:"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(?s)(.*)$", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, domain, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        out = out.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict")))
    return out


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """Distinct tokens: labels of the host, folders of the path, names in the query.

    Numbers count by their length only.
    """

    def named(kind: str, values: Column) -> Column:
        shape = lambda v: F.when(v.rlike(r"^[0-9]+$"), F.concat(F.lit("#"), F.length(v).cast("string"))).otherwise(v)
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind), shape(v)))

    query = F.regexp_extract_all(rest, F.lit(r"[?&]([^=&#]+)"), 1)
    return F.array_distinct(F.concat(
        named("host:", F.split(host, r"\.")), named("path:", F.split(path, r"[/.]")), named("query:", query)
    ))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, max_items: int) -> DataFrame:
    """(items, verdict, confidence, support) from rows of ``tokens`` and ``verdict``.

    FP-growth counts the token sets together with the label. A rule stays if it reaches the
    confidence and no part of it is as confident for the same verdict. Sets have at most
    ``max_items`` tokens and a share of ``min_support`` of all rows, which bounds their
    number whatever the number of rows.
    """
    baskets = labelled.select(
        F.array_append("tokens", F.concat(F.lit(LABEL), "verdict")).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets)
    sets = model.freqItemsets
    is_label = lambda item: item.startswith(LABEL)
    labels = F.filter("items", is_label)
    plain = sets.select(
        F.array_sort(F.filter("items", lambda item: ~is_label(item))).alias("items"),
        F.get(labels, F.lit(0)).alias("label"), "freq",
    ).filter(F.size("items").between(1, max_items))
    whole = plain.filter(F.col("label").isNull()).select("items", F.col("freq").alias("total"))
    rules = plain.filter(F.col("label").isNotNull()).join(whole, "items").select(
        "items", F.expr(f"substring(label, {len(LABEL) + 1})").alias("verdict"),
        (F.col("freq") / F.col("total")).alias("confidence"), F.col("freq").alias("support"),
    ).filter(F.col("confidence") >= min_confidence)
    part = rules.select("items", "verdict", F.col("confidence").alias("part_confidence"))
    # Parts share the first or another token: an index on single tokens finds them.
    wide = rules.withColumn("token", F.explode("items"))
    parts_by = part.withColumn("token", F.get("items", F.lit(0))).withColumnRenamed("items", "part")
    weaker = (
        wide.join(parts_by, ["token", "verdict"])
        .filter((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0))
        .filter(F.col("part_confidence") >= F.col("confidence"))
        .select("items", "verdict").distinct()
    )
    return rules.join(weaker, ["items", "verdict"], "left_anti")


def match_rules(pages: DataFrame, rules: DataFrame, fallback: str) -> Column:
    """Verdict of the strongest rule whose tokens a row has all.

    The rules (few, see ``mine_rules``) become an inverted index: a map from one token of
    each rule to the rules behind it. A row looks up its own tokens only.
    """
    found = rules.collect()
    if not found:
        return F.lit(fallback)
    by_token: dict[str, list] = {}
    for r in found:
        by_token.setdefault(r["items"][-1], []).append(r)
    entry = lambda r: F.struct(
        F.lit(r["confidence"]).alias("confidence"), F.lit(r["support"]).alias("support"),
        F.lit(" ".join(r["items"])).alias("name"), F.lit(r["verdict"]).alias("verdict"),
        F.array(*[F.lit(i) for i in r["items"]]).alias("items"),
    )
    index = F.create_map(*[
        x for token, rs in sorted(by_token.items()) for x in (F.lit(token), F.array(*map(entry, rs)))
    ])
    hits = F.flatten(F.filter(
        F.transform("__tokens", lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull()
    ))
    fits = F.filter(hits, lambda r: F.size(F.array_except(r["items"], F.col("__tokens"))) == 0)
    best = F.array_max(fits)
    return F.coalesce(best["verdict"], F.lit(fallback))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, min_support: float = 0.01,
    min_confidence: float = 0.9, max_items: int = 3, fallback: str = "allow",
) -> DataFrame:
    """All columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    Listed rules decide first. The URLs they decide are the labelled rows from which token
    combinations are mined; those judge the other URLs, and ``fallback`` what no combination
    fits. A null URL, or one without ``://``, has empty host and path and gets ``fallback``.
    Repeated rows get equal verdicts; with no labelled row there are no combinations.
    Columns of ``pages`` with the names of results are replaced.
    """
    host, path, rest = parts(F.col("url"))
    named = pages.withColumns({"host": host, "path": path, "__rest": rest})
    ruled = named.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("__tokens", tokens(F.col("host"), F.col("path"), F.col("__rest")))
    labelled = ruled.filter(F.col("__rule").isNotNull()).select(F.col("__tokens").alias("tokens"), F.col("__rule.verdict").alias("verdict"))
    mined = mine_rules(labelled, min_support, min_confidence, max_items)
    verdict = F.coalesce(F.col("__rule.verdict"), match_rules(ruled, mined, fallback))
    judged = ruled.withColumns({"verdict": verdict, "rule": F.col("__rule.rule")})
    return judged.drop("__rule", "__rest", "__tokens")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
