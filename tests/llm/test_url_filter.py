import random

from keyfold.llm import url_filter
from keyfold.llm.queries import SITES


def plain(url, sites):
    host, path = url_filter.split_url(url)
    fit = [(len(s), v == "block", s, v) for v, s in sites
           if (host == s.split("/")[0] or host.endswith("." + s.split("/")[0])) and path.startswith("/" + s.split("/", 1)[1])]
    if fit:
        _, _, rule, verdict = max(fit, key=lambda f: (f[0], f[1]))
        return host, path, rule, verdict
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in host).split()
    return host, path, None, "block" if set(words) & set(url_filter.UNWANTED) else "allow"


def test_against_plain_rules(spark):
    rng = random.Random(2)
    hosts = ["example.com", "www.example.com", "a.example.com", "com", "notexample.com", "EXAMPLE.com", "x.net", "spam-farm.org", "spamfarm.org", "my.ads.net", "", "net", "é.com", "a.com:80"]
    tails = ["", "/", "/en/", "/en", "/en/x?y=/fr/", "?q", "#f", "/es/1", "/fr/", "/EN/", "/en/#a", "/es"]
    urls = [s + h + t for s in ("http://", "https://", "ftp://a://", "") for h in hosts for t in tails] + [None, "", "://", "no scheme"]
    rng.shuffle(urls)
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, SITES).collect()}
    assert got == {i: plain(u, SITES) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), SITES).count() == 0


def test_rarest_token_index():
    rules = [url_filter.site_rule("block", "example.com/"), url_filter.site_rule("block", "rare.example.com/deep/pa"), url_filter.site_rule("allow", "com/")]
    index = url_filter.RuleIndex(rules)
    assert set(index.by_token) == {"example", "deep", "com"} or set(index.by_token) == {"example", "rare", "com"}
    assert [r.name for r in index.matches("rare.example.com", "/deep/path")].count("rare.example.com/deep/pa") == 1
    assert not url_filter.RuleIndex([url_filter.Rule("any", "block", ".*", ())]).by_token
