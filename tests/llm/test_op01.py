from tandem.llm.op01_url_filter import RULES, Rule, judge_urls

URLS = ["https://www.example.com/en/1", "https://m.example.com/en/", "http://example.com/de/x?y#z", "http://EXAMPLE.Com/en/a",
        "http://a.net/es/1", "http://a.net/es", "http://net/fr/", "http://b.net/de/", "com/en/", None, "", "x://", "://com/",
        "http://notexample.com/en/", "http://example.com", "http://example.com?/en/", "http://u@example.com:80/en/",
        "http://a.net/ES/1", "http://example.com/en", "http://.com/", "ftp://a//b://c.com/", "http://com.evil.org/en/",
        "http://a.net\n/es/"]


def split(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    host = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[host:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:host]), path[:end]


def brute(url, rules, default="allow"):
    host, path = split(url)
    fits = []
    for r in rules:
        h, _, p = r.pattern.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(r.pattern), r.pattern, r.action))
    best = min(fits) if fits else (0, None, default)
    return host, path, best[1], best[2]


def test_equals_brute_force_in_any_block(spark):
    pages = spark.createDataFrame([(i % 20, u) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string")
    pages = pages.selectExpr("*", "1 as host", "'q' as rule", "null as action")
    rules = [*RULES, Rule("block", "example.com/e"), Rule("allow", "org/")]
    want = sorted(((i % 20, *brute(u, rules)) for i, u in enumerate(URLS + URLS[:3])), key=str)
    for block in (100, 1, 2):
        assert sorted(map(tuple, judge_urls(pages, rules, block=block).collect()), key=str) == want


def test_rarest_token_and_wildcards(spark):
    assert Rule("block", "example.com/e").tokens == {"example", "com"}
    assert Rule("block", "a.com/*x/y/").tokens == {"a", "com", "y"}
    pages = spark.createDataFrame([(1, "http://a.com/qqx/y/z"), (2, "http://a.com/x/z/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in judge_urls(pages, [Rule("block", "a.com/*x/y/")]).collect()}
    assert got == {1: "block", 2: "allow"}


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(pages, []).collect()] == ["allow"]
    assert judge_urls(pages.limit(0)).collect() == []


def test_a_hundred_thousand_rules(spark):
    """A long list: the plan stays small, and only the rules that a url asks for are compiled."""
    from tandem.llm.op01_url_filter import RuleIndex
    rules = [Rule("block", f"site{i}.org/a{i % 7}/") for i in range(100_000)] + list(RULES)
    urls = [f"http://www.site{i}.org/a{i % 5}/x" for i in range(0, 100_000, 1999)] + URLS
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = judge_urls(pages, rules)
    assert len(out._jdf.queryExecution().toString()) < 100_000
    few = [r for r in rules if r in RULES or int(r.pattern[4:r.pattern.index(".")]) % 1999 == 0]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, *brute(u, few)) for i, u in enumerate(urls)), key=str)
    index = RuleIndex(rules, {})
    assert index.best("www.site5.org", "/a5/", None) == ("site5.org/a5/", "block") and len(index.compiled) <= 2
