"""Verdicts against a loop over all rules."""

import random

import pytest

from tideline.llm.url_filters import judge

RULES = "host string, path string, verdict string"


def plain(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    size, _, blocks, rule = max(fits, default=(0, 0, None, None))
    return host, path, rule, default if blocks is None else "block" if blocks else "allow"


def check(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, spark.createDataFrame(rules, RULES), default=default).collect()}
    assert got == {i: plain(u, rules, default) for i, u in enumerate(urls)}


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_random_rules(spark, limit):
    """Broadcast and shuffled."""
    rng = random.Random(1)
    host = lambda: ".".join(rng.choices(["a", "b", "org", "com", "é"], k=rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choices(["x", "y", "xy", ""], k=rng.randint(0, 3)))
    rules = list({(host(), path() if rng.random() < 0.8 else ""): None for _ in range(150)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"{rng.choice(['http', ''])}://{host().upper()}{path()}{rng.choice(['', '?q=/x', '#f', '?://a.org/'])}" for _ in range(400)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        check(spark, urls, rules, default="block")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_edges(spark):
    """Nulls, no scheme, repeats, long URLs, hosts of dots, ports, a rule twice, rules that fit nothing."""
    rules = [("org", "/", "allow"), ("org", "/", "block"), ("", "/e", "block"), ("a/b", "/", "block"), ("com", "x", "block"), ("b.a.org", "/x", "allow"), ("a.org", "/x/y", "block")]
    urls = [None, "", "org/x", "http://", "http://ORG", "http://org/", "http://org/", "x://y://org/", "http://org:80/", "http://notorg/", "http:///e", "http://./e", "http://com?x", "http://a.org/" + "x" * 50_000, "http://" + "." * 5_000 + "org/", "http://b.a.org/x/y"]
    check(spark, urls, rules)
    check(spark, urls, [])
    pages = spark.createDataFrame([(None, "http://org/"), (1, "http://org/"), (1, "http://org/")], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in judge(pages, spark.createDataFrame(rules, RULES)).collect()) == [(0, "block"), (1, "block"), (1, "block")]
    assert judge(pages.limit(0), spark.createDataFrame(rules, RULES)).count() == 0


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://org/")], "page_id long, url string")
    plan = judge(pages, spark.createDataFrame([("org", "/", "block")], RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
