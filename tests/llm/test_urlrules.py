import random

from sourceweave.llm.urlrules import RULES, judge_urls, rules_frame


def brute(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else None
    host = path = ""
    if rest is not None:
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h), len(p), verdict, rule))
    return host, path, best[3] if best else None, best[2] if best else default


def test_against_brute_force(spark):
    rng = random.Random(3)
    labels, ends = ["a", "b", "net", "org", "example", "xnet"], ["", "/", "/en/", "/en/x?q=/de/", "?a", "#f", "/fr/1"]
    urls = [None, "", "net", "://", "http://", "x://net/", "http://A.NET/en", "ftp://net.example./", "http://é.net/"]
    urls += ["h://" + ".".join(rng.choices(labels, k=rng.randint(1, 4))) + rng.choice(ends) for _ in range(400)]
    rules = [*RULES, ("block", "b.net/en/"), ("allow", "net/en/"), ("block", "a.b.net"), ("allow", "a.b.net"), ("allow", "example/en/x")]
    frame = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = judge_urls(frame, rules_frame(spark, [*rules, (None, "x/"), ("block", None)]))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules), urls[r.page_id]


def test_repeated_and_empty(spark):
    frame = spark.createDataFrame([(1, "http://a.net/")] * 50, "page_id long, url string")
    assert [r.verdict for r in judge_urls(frame, rules_frame(spark)).collect()] == ["block"] * 50
    assert judge_urls(frame.limit(0), rules_frame(spark)).collect() == []
