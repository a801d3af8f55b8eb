import itertools
import re
from collections import Counter

from trailspark.llm import urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return host.translate(str.maketrans(urls.UPPER, urls.LOWER)), path


def rule(host, path):
    fits = [(len(d + p), d + p, v) for v, d, p in urls.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_hosts_paths_and_rules(spark):
    given = [
        None, "", "no scheme", "http://", "http://A.Example.ORG/es/1", "https://org", "https://org/", "x://y://z/p",
        "http://example.org/en/12?q", "http://badexample.org/es/", "http://com/fr/", "http://É.com/de/#x", "http://a.net?u=//b/",
        "http://h.com/de/a\nb#c", "http://spam.com/fr" + "/x" * 50_000,
    ]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(given)], "page_id long, url string, host string")
    for r in urls.judge_urls(df).collect():
        host, path = parse(given[r.page_id])
        assert (r.host, r.path) == (host, path)
        expected = rule(host, path)
        assert r.rule == (expected and expected[0])
        if expected:
            assert r.verdict == expected[1]
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_mined_rules_against_counting(spark):
    baskets = [(["a", "b"], "block")] * 9 + [(["a", "c"], "allow")] * 9 + [(["a", "b", "c"], "allow")] + [(["d"], "block")] * 3
    df = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    got = {(tuple(r["items"]), r.verdict): (r.support, r.confidence) for r in urls.mine_rules(df, 0.1, 0.85, 3).collect()}
    counts, whole = Counter(), Counter()
    for items, verdict in baskets:
        for n in (1, 2, 3):
            for part in itertools.combinations(sorted(items), n):
                counts[part, verdict] += 1
                whole[part] += 1
    strong = {k: (n, n / whole[k[0]]) for k, n in counts.items() if n >= 2.2 and n / whole[k[0]] >= 0.85}
    expected = {
        k: v for k, v in strong.items()
        if not any(o[1] == k[1] and set(o[0]) < set(k[0]) and strong[o][1] >= v[1] for o in strong)
    }
    assert got == expected


def test_combinations_judge_other_pages(spark):
    rows = [(i, f"http://h{i}.com/de/{i}") for i in range(30)] + [(100 + i, f"http://h{i}.com/fr/{i}") for i in range(30)]
    rows += [(500, "http://x.net/de/1"), (501, "http://x.net/fr/1"), (502, "http://x.net/it/1")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    verdicts = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert verdicts[500] == (None, "block")
    assert verdicts[501] == verdicts[502] == (None, "allow")
    from_others = urls.judge_urls(df.selectExpr("*", "'own' AS tokens"))
    assert {r.tokens for r in from_others.collect()} == {"own"}


def plain_tokens(url):
    host, path = parse(url)
    rest = re.split(r"[?#]", url, maxsplit=1) if url and "://" in url else [""]
    query = url[len(rest[0]):] if len(rest) > 1 else ""
    shape = lambda v: f"#{len(v)}" if re.fullmatch(r"[0-9]+", v) else v
    named = [("host:", host.split(".")), ("path:", re.split(r"[/.]", path)), ("query:", re.findall(r"[?&]([^=&#]+)", query))]
    return sorted({kind + shape(v) for kind, values in named for v in values if v})


def test_query_against_counting_all_combinations(spark):
    """Every verdict of the registered query, from plain counts over the whole table."""
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()}
    ruled = {i: rule(*parse(u)) for i, u in pages.items()}
    labelled = [(plain_tokens(pages[i]), r[1]) for i, r in ruled.items() if r]
    counts, whole = Counter(), Counter()
    for items, verdict in labelled:
        for n in (1, 2, 3):
            for part in itertools.combinations(items, n):
                counts[part, verdict] += 1
                whole[part] += 1
    strong = {
        (part, verdict): (n / whole[part], n) for (part, verdict), n in counts.items()
        if n >= 0.01 * len(labelled) and n / whole[part] >= 0.9
    }
    rules = [
        (*v, " ".join(k[0]), k[1], set(k[0])) for k, v in strong.items()
        if not any((p, k[1]) in strong and strong[p, k[1]][0] >= v[0]
                   for n in range(1, len(k[0])) for p in itertools.combinations(k[0], n))
    ]
    expected = {}
    for i, url in pages.items():
        own = set(plain_tokens(url))
        best = max((r[:4] for r in rules if r[4] <= own), default=None)
        expected[i] = (*parse(url), *(ruled[i] or (None, best[3] if best else "allow")))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.op8_url_filters(spark, "/root/testdata/sf0.01").collect()}
    assert got == expected
    assert len({v[3] for v in got.values() if v[2] is None}) == 2
