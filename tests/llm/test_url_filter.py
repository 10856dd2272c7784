"""The URL filter against rules and power iteration written by hand."""

import re
from collections import Counter, defaultdict

import pytest

from attestor.llm import urlfilter
from attestor.llm.urlfilter import DAMPING, UNIT, Rule

SCHEMA = "page_id bigint, url string, html string"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parted(url):
    _, found, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest if found else "")[0]
    return host.translate(A_TO_Z), re.match("[^?#]*", (rest if found else "")[len(host):])[0]


def ruled(host, path, rules=urlfilter.RULES):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


def by_hand(rows, rules=urlfilter.RULES):
    """The result rows, by plain loops over the rows (page_id, url, html)."""
    of, links, nodes = defaultdict(Counter), Counter(), set()
    for _, url, html in rows:
        host, path = parted(url)
        if not host:
            continue
        rule = ruled(host, path, rules)
        of[host][rule.verdict if rule else None] += 1
        nodes.add(host)
        for target in {h.translate(A_TO_Z) for h in re.findall(r'\shref\s*=\s*["\']?\s*(?:https?:)?//([^/?#"\'<>\s]+)', html or "", re.I | re.A)}:
            nodes.add(target)
            if target != host:
                links[host, target] += 1
    kin = set()
    for host in nodes:
        labels = host.split(".")
        if len(host) <= 253:
            kin |= {(".".join(labels[i:]), ".".join(labels[i + 1:])) for i in range(len(labels) - 2)}
    for low, high in kin:
        links[low, high] += 1
        links[high, low] += 1
    scores = {}
    for side, verdict in enumerate(("allow", "block")):
        arcs = [(a, b, w) if side == 0 else (b, a, w) for (a, b), w in links.items()]
        out = Counter()
        for a, _, w in arcs:
            out[a] += w
        seed = {h: c[verdict] * UNIT // c.total() for h, c in of.items()}
        now = dict(seed)
        for _ in range(urlfilter.rounds()):
            then = Counter(seed)
            for a, b, w in arcs:
                then[b] += now.get(a, 0) * w * DAMPING // (out[a] * 100)
            now = then
        scores[side] = now
    result = []
    for page_id, url, _ in rows:
        host, path = parted(url)
        rule = ruled(host, path, rules)
        t, d = scores[0].get(host, 0), scores[1].get(host, 0)
        verdict = rule.verdict if rule else "block" if d - t >= urlfilter.THRESHOLD else "allow"
        result.append((page_id, host, path, rule and rule.host + rule.path, verdict, t, d))
    return result


def link(*hosts):
    return "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)


PAGES = [
    (1, "http://bad.net/es/1", link("worse.org")), (2, "http://farm.org/", link("bad.net", "BAD.net", "mirror.org")),
    (3, "https://farm.org/a", link("bad.net")), (4, "http://mirror.org", "<a href='//bad.net/fr/'>x</a> <a HREF = //mirror.org>self</a>"),
    (5, "http://good.com/", link("friend.org", "farm.org")), (6, "http://friend.org/x?y://z", link("good.com")),
    (7, "http://friend.org/x#://", None), (8, "HTTP://WWW.Example.COM/en/1?q", "<p>"), (9, "http://shop.www.example.com/en/", ""),
    (10, "http://example.com/en/x", link("a.b.c.example.com")), (11, "http://example.com/EN/x", None), (12, "http://notexample.com/en/", None),
    (13, "http://good.com", None), (14, "http://good.com?/", None), (15, "no scheme", link("bad.net")), (16, None, link("bad.net")), (17, "", ""),
    (18, "http:///es/", link("bad.net")), (19, "x://net/es/", None), (20, "x://net/fr", None), (None, "http://bad.net/fr/", None),
    (21, "http://bad.net/de/1", None), (21, "http://bad.net/de/1", None), (22, "http://" + "a." * 200 + "org/", link("bad.net")),
    (23, "http://deep.er.mirror.org/", "href=//bad.net " + "<b href" + " " * 20000 + "x"), (24, "http://good.com:80/", None)]


def compared(spark, rows, **kwargs):
    found = urlfilter.judged(spark.createDataFrame(rows, SCHEMA), **kwargs)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(by_hand(rows, **kwargs), key=repr)
    return found


def test_verdicts_and_scores(spark):
    rows = {r.page_id: r for r in compared(spark, PAGES).collect()}
    assert rows[4].distrust > 0 and rows[2].distrust > 0 and rows[2].trust > 0  # they link to a blocked host, and one is linked to
    assert rows[6].verdict == "allow" and rows[6].trust > 0  # a trusted host links to it
    assert rows[8].rule == "www.example.com/en/" and rows[10].verdict == "block" and rows[13].rule is None
    assert (rows[16].host, rows[16].path, rows[16].verdict) == ("", "", "allow")


def test_a_hub_that_everything_links_to(spark):
    rows = [(i, f"http://h{i}.org/", link("bad.net")) for i in range(200)] + [(500 + i, "http://bad.net/es/", link("h0.org")) for i in range(200)]
    assert {r.host for r in compared(spark, rows).collect() if r.verdict == "block"} == {"bad.net"}
    lone = [(1, "http://bad.net/es/", ""), (2, "http://farm.org/", link("bad.net")), (3, "http://other.org/", link("farm.org", "good.com"))]
    assert {r.host for r in compared(spark, lone).collect() if r.verdict == "block"} == {"bad.net", "farm.org"}


def test_other_rules(spark):
    compared(spark, PAGES, rules=())
    compared(spark, PAGES, rules=(Rule("block", "org", ""), Rule("allow", "farm.org", "/")))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert urlfilter.judged(empty).collect() == []
    df = spark.createDataFrame(PAGES, SCHEMA)
    more = df.selectExpr("*", "'x' AS host", "1 AS trust", "url AS rule", "0 AS side", "page_id AS w")
    assert sorted(map(tuple, urlfilter.judged(more).collect()), key=repr) == sorted(by_hand(PAGES), key=repr)


@pytest.mark.parametrize("url", ["http://A.b/C?d#e", "a://b://c/d", "://", "://x", "http://u:p@H:1/x", "é://É/é?", None, "#://x/"])
def test_host_and_path(spark, url):
    from pyspark.sql import functions as F
    host, path = urlfilter.host_and_path(F.col("url"))
    assert tuple(spark.createDataFrame([(url,)], "url string").select(host, path).first()) == parted(url)
