"""Url rules against a scan over all rules, trees against a walk of each row, labels against held-out urls."""

import random

import numpy as np

from planlens.llm import urlfilter

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, score double, block int"
URLS = ["http://a.net/x", "HTTP://A.NET", "https://www.Example.NET/en/1?x=2", "https://example.net/EN/1", "https://notexample.net/en/", "x://example.com/de/9#top", "http://example.com/de",
        "http://org/fr/", "http://b.org/fr/1/2.html", "http://b.org?/fr/", "//b.org/fr/", "", None, "no scheme", "http://", "http:///fr/", "a://b://c.net/", "http://x.net\n/y", "http://é.org/fr/É?é",
        "http://a..net/", "http://net/en/", "http://u@example.net:80/en/", "http://example.net./en/", "http://example.net/en/" + "9" * 100_000]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    end = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def plain(url, rules):
    host, path = parts(url)
    fits = [(len(rule), rule, verdict) for verdict, rule in rules
            for h, p in [(rule[:rule.index("/")], rule[rule.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "clash", "c", "c", 1.0, 1) for i, u in enumerate(urls)], SCHEMA)


def test_rules(spark):
    urls = URLS + URLS[:5]
    got = {r["page_id"]: r for r in urlfilter.judge(frame(spark, urls)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain(u, urlfilter.RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] > 0.5 else "allow"))


def test_many_rules(spark):
    r = random.Random(3)
    names = ["a", "b", "a.b", "b.a", "c.a.b", "com"]
    rules = [(r.choice(["block", "allow"]), f"{r.choice(names)}/{r.choice(['', 'x', 'xy/', 'x/y', 'z/'])}") for _ in range(25)]
    rules = list({rule: (v, rule) for v, rule in reversed(rules)}.values())
    urls = [f"http://{'.'.join(r.choice('abc') for _ in range(r.randint(1, 4)))}/{''.join(r.choice('xyz/') for _ in range(r.randint(0, 5)))}" for _ in range(400)]
    for row, u in zip(urlfilter.judge(frame(spark, urls), rules).orderBy("page_id").collect(), urls):
        host, path, rule, _ = plain(u, rules)
        assert (row["host"], row["path"]) == (host, path) and len(row["rule"] or "") == len(rule or "")


def test_no_rows_and_no_labels(spark):
    assert urlfilter.judge(frame(spark, [])).collect() == []
    rows = urlfilter.judge(frame(spark, ["http://a.dev/", None])).collect()
    assert {(r["verdict"], r["score"]) for r in rows} == {("allow", 0.5)}


def spam(r):
    """A blocking url is long and full of digits and parameters; another one may have one of these."""
    bad = r.random() < 0.4
    host = r.choice(["shop", "news", "wiki", "blog"]) + r.choice(["a", "b", "c"]) + r.choice([".dev", ".info"])
    path = "/".join("".join(r.choice("abcdefgh0123456789" if bad else "abcdefgh") for _ in range(r.randint(4, 9))) for _ in range(r.randint(2, 6) if bad else r.randint(1, 4)))
    query = "?" + "&".join(f"p{i}={r.randint(1, 9999)}" for i in range(r.randint(1, 4))) if r.random() < (0.7 if bad else 0.2) else ""
    return f"https://{host}/{path}{query}", int(bad)


def test_learns_from_labelled_urls(spark):
    r = random.Random(8)
    known, held = [spam(r) for _ in range(3000)], [spam(r) for _ in range(600)]
    labelled = spark.createDataFrame([*known, (None, 1), ("http://x.dev/", None), ("http://x.dev/", 7)], "url string, block int")
    rows = urlfilter.judge(frame(spark, [u for u, _ in held]), (), labelled).orderBy("page_id").collect()
    right = np.mean([(row["verdict"] == "block") == bool(y) for row, (_, y) in zip(rows, held)])
    assert right > 0.93, right
    again = urlfilter.judge(frame(spark, [u for u, _ in held]), (), labelled.repartition(7)).orderBy("page_id").collect()
    assert [a["score"] for a in again] == [a["score"] for a in rows]


def test_trees_row_by_row():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, urlfilter.FEATURES))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.2)).astype(float)
    start, trees = urlfilter.boost(x, y)
    loss = lambda s: float(np.mean(np.log1p(np.exp(-s * (2 * y - 1)))))
    assert loss(urlfilter.raw_score(x, start, trees)) < 0.3 < loss(np.full(len(y), start))
    for row, whole in zip(x[:40], urlfilter.raw_score(x[:40], start, trees)):
        score = start
        for feature, cut, leaf in zip(*trees):
            node = 0
            for _ in range(urlfilter.DEPTH):
                node = 2 * node + 2 if row[feature[node]] > cut[node] else 2 * node + 1
            score += leaf[node - len(feature)]
        assert abs(score - whole) < 1e-9
