import re

import pytest

from rainframe.llm import queries, urlfilter

URLS = ["http://a.com/en/7", "https://Example.COM/en/71?x=/de/", "http://example.com/en/", "http://notexample.com/en/7", "http://com/en/x", "http://x.net/de", "http://x.net/de/", "//x.net/de/", "http://example.net/de/8#a", "http://org", "http://b.org/es/?q", "http://user@c.org:80/es/", "", None, "http://", "a://b://c.org/es/", "http://x.com/EN/", "ftp://É.com/en/é", "http://a..com/en/", "http://.com/en/", "http://ocom/en/", "http://x.com\n/en/"]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, rule string").repartition(2).cache()


@pytest.mark.parametrize("most_sent", [64 << 20, 0])
@pytest.mark.parametrize("rules", [queries.RULES, [*queries.RULES, ("com", "", "block"), ("example.com", "/", "allow"), ("", "", "block"), ("a.com", "/en", "block")]])
def test_matches_brute_force(spark, pages, rules, most_sent):
    got = urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), most_sent=most_sent)
    want = sorted((i, *brute(u, rules)) for i, u in enumerate([*URLS, URLS[0]]))
    if ("", "", "block") in rules:  # an empty host is that of URLs without one
        want = [w if w[3] or w[1] else (*w[:3], "", "block") for w in want]
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).selectExpr("concat('host', id, '.com/') as rule")
    filt, blocks = urlfilter.build_filter(keys, "rule", 20_000)
    asked = keys.selectExpr("rule as name", "array(rule, concat('other', rule)) as keys")
    for way in (urlfilter._pass_local, urlfilter._pass_joined):
        hit = way(asked, filt, blocks).selectExpr("explode(keys) as k").selectExpr("sum(int(k like 'other%')) as wrong", "count(*) as n").first()
        assert hit.n - hit.wrong == 20_000 and hit.wrong < 400


def test_no_rules_and_empty_table(spark, pages):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urlfilter.judge(pages, none).collect()} == {"allow"}
    some = spark.createDataFrame(queries.RULES, none.schema)
    assert urlfilter.judge(pages.limit(0), some).count() == 0


def test_a_host_of_many_labels_is_cheap(spark):
    import time

    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "com/en/1"), (2, "http://x.org/es/"), (3, None)], "page_id long, url string")
    urlfilter.judge(pages, rules).collect()
    began = time.time()
    got = {r.page_id: r.rule for r in urlfilter.judge(pages, rules).collect()}
    assert got == {1: "com/en/", 2: "org/es/", 3: None} and time.time() - began < 5


@pytest.mark.parametrize("name", ["rule_verdict", "_url", "own", "keys", "x", "host_len", "k", "_", "verdict"])
def test_clashing_columns(spark, name):
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.com/en/1", 7)], f"page_id long, url string, `{name}` long")
    got = urlfilter.judge(pages, rules)
    r = got.first()
    assert r.rule == "com/en/" and r.verdict == "block" and (name == "verdict" or r[name] == 7)
    assert len(got.columns) == len(set(got.columns))
