import random

from gridloom.llm import url_rules


def plain(rules, host, path, default="allow"):
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h) or h == "") and path.startswith(p)]
    return (max(fits)[3], max(fits)[4]) if fits else (None, default)


def run(spark, urls, rules):
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "1 as key", "2 as part")
    return {r.id: r for r in url_rules.judge(frame, spark.createDataFrame(rules, url_rules.RULES)).collect()}


def test_sql(compare, small):
    assert compare("op6_url_filter", small) == ""


def test_against_all_rules_one_by_one(spark):
    rng = random.Random(3)
    labels, parts = ["a", "b", "com", "www", "", "é"], ["/", "/x", "/x/", "/x/y", "", "/X", "/xé"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    rules = [(host(3), rng.choice(parts), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"http://{host(5)}{rng.choice(parts)}{rng.choice(['', '?q', '#f', '/x/y'])}" for _ in range(800)]
    urls += ["HTTP://A.B.COM/x"] * 500 + [None, "", "no scheme/x", "://", "a://b.com", "x://com?/x", "http://a\nb.com/x\ny?z"]
    got = run(spark, urls, rules)
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        h = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        p = rest[cut:].split("?")[0].split("#")[0]
        assert (got[i].host, got[i].path) == (h, p)
        assert (got[i].rule, got[i].verdict) == plain(rules, h, p), url


def test_empty_tables(spark):
    none = spark.createDataFrame([], url_rules.RULES)
    frame = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judge(frame, none).collect()] == [(1, "a.com", "/x", None, "allow")]
    assert url_rules.judge(frame.limit(0), none).count() == 0
    assert url_rules.judge(frame.limit(0), spark.createDataFrame([("com", "/", "block")], url_rules.RULES)).count() == 0


def test_one_rule_for_everything(spark):
    assert {r.verdict for r in run(spark, ["http://a.com/", "", None], [("", "", "block")]).values()} == {"block"}
