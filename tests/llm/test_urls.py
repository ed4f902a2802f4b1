"""URL filter: hosts and rules against plain Python, propagation against dense power iteration."""

import random
import re

import numpy as np
import pytest

from leafgrain.llm import url_filter
from leafgrain.llm.queries import URL_RULES

PAGES = "page_id bigint, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0])) if fits else (None, None)


def dense(pages, rules):
    """{host: (trust, distrust)} by plain power iteration."""
    ruled, links = {}, {}
    for _, url, html in pages:
        host, path = split(url)
        verdict = rule_of(host, path, rules)[1]
        if verdict and host:
            ruled.setdefault(host, []).append(verdict == "allow")
        for to in {m.lower() for m in re.findall(r"""href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", html or "", re.I)}:
            if host and to != host:
                links[host, to] = links.get((host, to), 0) + 1
    names = sorted({*ruled, *(h for e in links for h in e)})
    at = {h: i for i, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for (a, b), n in links.items():
        m[at[a], at[b]] = n
    forward = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
    backward = forward.T / np.maximum(forward.T.sum(1, keepdims=True), 1e-300)
    out = []
    for matrix, share in ((forward, lambda v: np.mean(v)), (backward, lambda v: 1 - np.mean(v))):
        seed = np.array([share(ruled[h]) if h in ruled else 0.0 for h in names])
        score = seed * 0.15
        for _ in range(200):
            score = seed * 0.15 + 0.85 * score @ matrix
        out.append(score)
    return {h: (out[0][i], out[1][i]) for h, i in at.items()}


def judged(spark, pages, rules):
    return sorted([tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(pages, PAGES), rules).collect()], key=str)


def expected(pages, rules):
    scores = dense(pages, rules)
    out = []
    for i, url, _ in pages:
        host, path = split(url)
        rule, verdict = rule_of(host, path, rules)
        trust, distrust = scores.get(host, (0, 0))
        out.append((i, host, path, rule, verdict or ("block" if distrust - trust > 1e-9 else "allow")))
    return sorted(out, key=str)


ODD = [
    (1, None, None), (2, "", ""), (3, "no scheme", "<a href=x>"), (4, "HTTP://Blog.Example.ORG/es/1?x#y", None), (5, "a://b://c/d", ""), (6, "x://org", ""),
    (7, "x://org/", ""), (8, "http://org?/fr/", ""), (9, "http://example.org/en/19", ""), (10, "http://notexample.org/es/", ""), (11, "s://É.com/fr/é#", "x"),
    (12, "s://u@h.com:80/de/", "x"), (None, "s://h.com/de/x\ny", "x"), (12, "s://h.com/dex", "x"), (13, "a\n://h.com/fr/", ""), (14, "x://h.com./de/", ""),
    (15, "://", ""), (16, "s:///fr/", ""), (17, "x://" + "a" * 100_000 + ".com/de/" + "b" * 100_000, "y" * 100_000),
]


def test_rules_on_odd_urls(spark):
    assert judged(spark, ODD, URL_RULES) == expected(ODD, URL_RULES)
    assert judged(spark, [], URL_RULES) == [] and len(judged(spark, ODD, [])) == len(ODD)


@pytest.mark.parametrize("rules", [URL_RULES, [("block", "org", "/"), ("block", "net", "/en"), ("allow", "net", "/fr")]])
def test_propagation_equals_power_iteration(spark, monkeypatch, rules):
    monkeypatch.setattr(url_filter, "SLICE", 2)  # hosts of several slices
    r = random.Random(1)
    hosts = [f"h{i}.{r.choice(['com', 'net', 'org', 'example.org'])}" for i in range(60)]
    link = lambda h: r.choice([f'<a href="http://{h.upper()}/x">', f"<a HREF = '//{h}'>", f"<link href=https://{h}?q>"])
    pages = [
        (i, f"http://{h}/{r.choice(['en', 'fr', 'de', 'es'])}/{r.randrange(99)}", "".join(link(r.choice(hosts)) for _ in range(r.randrange(5))))
        for i, h in enumerate(r.choices(hosts, k=300))]
    got, want = judged(spark, pages, rules), expected(pages, rules)
    assert got == want
    assert {v for _, _, _, rule, v in want if rule is None} == {"allow", "block"}


def test_links_decide_without_rules(spark):
    pages = [
        (1, "http://good.org/a", '<a href="http://friend.net/">'), (2, "http://shop.com/de/", ""), (3, "http://friend.net/x", ""),
        (4, "http://farm.net/1", '<a href="http://shop.com/">'), (5, "http://alone.net/", "<a href=/x>")]
    got = {r[0]: r[4] for r in judged(spark, pages, URL_RULES)}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow"}


def test_broken_html_is_linear(spark):
    html = "href=" * 200_000 + "<a href" * 100_000 + " " * 500_000
    assert judged(spark, [(1, "http://a.net/", html)], URL_RULES)[0][4] == "allow"


def test_clashing_columns(spark):
    df = spark.createDataFrame(ODD, PAGES)
    for name in ("host", "path", "rule", "by_rule", "verdict", "_host", "kind", "score"):
        df = df.selectExpr("*", f"'clash' as `{name}`")
    assert sorted([tuple(r) for r in url_filter.judge_urls(df, URL_RULES).collect()], key=str) == expected(ODD, URL_RULES)
