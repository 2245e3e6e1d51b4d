"""Rules and trust over a link graph, against plain computation."""

import re

import numpy as np
import pytest

from trialframe.llm import url_trust as u
from trialframe.llm.catalog import QUERIES, table

RULES = u.RULES


def slow_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def slow_rule(host, path):
    fits = [(n + p, v) for v, n, p in RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/enx", "http://net/", "http://xnet/", "http://a.net", "http://a.org/fr/x?y#z",
    "http://example.com/de/", "http://www.example.com/en/de/", "no scheme", None, "", "://", "x://h?a/b", "http://h:8080/p#f", "ftp://É.net/é", "http://a.org/fr",
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, x, "", "h") for i, x in enumerate(URLS)] + [(0, URLS[0], None, "h")], "page_id long, url string, html string, host string")
    for r in u.verdicts(df).collect():
        host, path = slow_parts(URLS[r.page_id])
        rule, verdict = slow_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        # without a rule for the path, a host that is blocked as a whole is what the method blocks
        assert r.verdict == (verdict or ("block" if slow_rule(host, "/")[1] == "block" else "allow"))
    assert u.verdicts(df.limit(0)).count() == 0
    assert u.verdicts(df).columns == ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]


def slow_rank(edges, seeds, hosts, damping=0.85):
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        m[at[b], at[a]] += n
    total = m.sum(axis=0)
    m = np.divide(m, total, where=total > 0, out=np.zeros_like(m))
    s = np.zeros(len(hosts))
    for h, v in seeds.items():
        s[at[h]] = v / sum(seeds.values())
    r = s
    for _ in range(400):
        moved = m @ r
        r = damping * moved + s * ((1 - damping) + damping * (1 - moved.sum()))
    return r


def test_trust_spreads_over_links(spark):
    link = lambda *hosts: " ".join(f'<p><a class=x href="https://{h}/p">t</a>' for h in hosts)
    pages = [
        (1, "http://good.org/fr/1", link("friend.com", "friend.com", "other.com") + '<a href="/rel">r</a><a href="//good.org/x">self</a>'),
        (2, "http://good.org/en/2", link("friend.com")), (3, "http://friend.com/1", link("other.com")),
        (4, "http://shady.com/1", link("spam.net", "worse.net", "friend.com")), (5, "http://farm.com/1", link("shady.com", "shady.com")),
        (6, "http://spam.net/1", link("friend.com")), (7, "http://lone.com/", None), (8, "http://mixed.com/", link("good.org", "spam.net")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in u.verdicts(df).collect()}
    edges = [("good.org", "friend.com", 3), ("good.org", "other.com", 1), ("friend.com", "other.com", 1), ("shady.com", "spam.net", 1), ("shady.com", "worse.net", 1),
             ("shady.com", "friend.com", 1), ("farm.com", "shady.com", 2), ("spam.net", "friend.com", 1), ("mixed.com", "good.org", 1), ("mixed.com", "spam.net", 1)]
    hosts = sorted({h for a, b, _ in edges for h in (a, b)} | {"lone.com"})
    trust = dict(zip(hosts, slow_rank(edges, {"good.org": 1}, hosts)))
    distrust = dict(zip(hosts, slow_rank([(b, a, n) for a, b, n in edges], {"spam.net": 1, "worse.net": 1}, hosts)))
    assert {(r.src, r.dst, r.links) for r in u.host_edges(df).collect()} == set(edges)
    for r in got.values():
        assert r.trust == pytest.approx(trust[r.host], abs=1e-5) and r.distrust == pytest.approx(distrust[r.host], abs=1e-5)
        assert r.verdict == (slow_rule(r.host, r.path)[1] or ("block" if distrust[r.host] > trust[r.host] else "allow"))
    assert {i for i, r in got.items() if r.verdict == "block"} == {4, 5, 6, 8}
    assert sorted(r.page_id for r in u.allowed_pages(df).collect()) == [1, 2, 3, 7]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    urls = {r.page_id: r.url for r in table(spark, folder, "pages").collect()}
    got = QUERIES["op10_url_trust"](spark, folder).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = slow_parts(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, slow_rule(host, path)[0])
