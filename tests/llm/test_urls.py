from __future__ import annotations

import random
import re

import pytest

from demandflow.llm.urls import default_rules, judge, query

SCHEMA = "page_id long, url string, host string, path string, rule long, salt string, verdict int"
RULES = "host string, path string, verdict string"


def plain(url, rules):
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: f[:3], default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def test_equals_trying_every_rule(spark):
    rng = random.Random(2)
    hosts = ["example.net", "EXAMPLE.Net", "a.b.example.net", "notexample.net", "net", "org", "x.org", "example.com", "www.example.com", "example.com.org", "", ".net", "net.", "É.net"]
    paths = ["", "/", "/en", "/en/", "/en/x?y", "/de/a/b#c", "/fr/", "/fr//x", "//en/", "/en/?q=/de/", "?x=/en/", "#/en/", "/a b/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    urls += [None, "", "no scheme/en/", "example.net/en/", "a://b://net/", "http://net/" + "d/" * 5000, "http://net/\n/en/", "://org/fr/x"]
    rows = [(i, u, "h", "p", 1, "s", 2) for i, u in enumerate(urls)] + [(3, urls[3], "", "", 0, "", 0), (None, urls[5], "", "", 0, "", 0)]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("B.example.net", "/en/", "block"), ("org", "/", "block")]
    got = judge(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(rules, RULES)).collect()
    lower = [(h.lower(), p, v) for h, p, v in rules]
    want = sorted(((r[0], *plain(r[1], lower)) for r in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_equal_rules_and_bad_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a/b", "", "", 0, "", 0)], SCHEMA)
    both = spark.createDataFrame([("x.net", "/a/", "block"), ("X.net", "/a/", "allow"), ("net", "/", "block"), (None, "/", "block")], RULES)
    assert [(r.rule, r.verdict) for r in judge(pages, both).collect()] == [("x.net/a/", "allow")]
    # Of rules of one length the longer host wins.
    even = spark.createDataFrame([("x.net", "/a/", "block"), ("net", "/a/b/", "allow")], RULES)
    again = spark.createDataFrame([(1, "http://x.net/a/b/", "", "", 0, "", 0)], SCHEMA)
    assert [r.rule for r in judge(again, even).collect()] == ["x.net/a/"]
    for bad in (("net", "a/", "block"), ("net", "/a", "block"), ("", "/", "block"), ("net", "/", "maybe"), ("net", "/", None)):
        with pytest.raises(ValueError, match="a rule needs"):
            judge(pages, spark.createDataFrame([bad], RULES))


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert judge(empty, default_rules(spark)).count() == 0
    pages = spark.createDataFrame([(1, "http://net/", "", "", 0, "", 0)], SCHEMA)
    assert [tuple(r) for r in judge(pages, spark.createDataFrame([], RULES)).collect()] == [(1, "net", "/", None, "allow")]
    empty.write.parquet(f"{tmp_path}/pages.parquet")
    assert query(spark, str(tmp_path)).count() == 0
