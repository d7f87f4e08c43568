import random
import re
from collections import Counter, defaultdict

import pytest

from triplane.llm import url_rank as U


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "nothing", "http://A.Example.NET/en/x?y#z", "https://example.net/de/", "http://net/a", "http://net", "http://x.org/fr/1", "http://x.org/en/1?a=://b/", "//x", "a://b://c/d", "http://bnet/x", "http://ÄB.example.com/de/ü", "http://x.com?q=1/2", "http://u.example.com/en/\nnew"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in U.verdicts(pages).collect()}
    for i, u in enumerate(URLS):
        host, path = plain(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict


def test_walk_against_plain_iteration(spark):
    edges = {("a", "b"): 1, ("a", "c"): 3, ("b", "c"): 1, ("c", "a"): 2, ("d", "a"): 1}
    seeds = {"a": 1.0, "d": 0.5}
    rank = {h: 0.15 * s for h, s in seeds.items()}
    for _ in range(200):
        new = {h: 0.15 * s for h, s in seeds.items()}
        for (a, b), n in edges.items():
            new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * n / sum(m for (x, _), m in edges.items() if x == a)
        rank = new
    df = U.walk(spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, seed double"))
    got = {r.host: r.rank for r in df.collect()}
    assert got.keys() == rank.keys()
    assert all(got[h] == pytest.approx(rank[h], abs=0.01) for h in rank)


def test_distrust_flows_to_those_who_link_to_blocked_hosts(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://bad.net/x", "<p>no links</p>"),
            (2, "http://farm.io/", '<a class=x href="http://bad.net/y">1</a> <A HREF=\'//bad.net/z\'>2</A>'),
            (3, "http://good.org/fr/", '<a href="https://fine.io/a">x</a><a href="/local">y</a>'),
            (4, "http://fine.io/a", None),
            (5, "http://fine.io/a", None),
            (6, "http://lone.io/", ""),
        ],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r.verdict for r in U.verdicts(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


def plain_walk(edges, seeds):
    total = Counter()
    for (a, _), n in edges.items():
        total[a] += n
    rank = {}
    for _ in range(300):
        new = {h: (1 - U.DAMPING) * s for h, s in seeds.items()}
        for (a, b), n in edges.items():
            if a in rank:
                new[b] = new.get(b, 0.0) + U.DAMPING * rank[a] * n / total[a]
        rank = new
    return rank


def plain_verdicts(pages):
    """page_id to verdict, by plain loops."""
    rules, edges, seen = {}, Counter(), defaultdict(list)
    for i, url, html in pages:
        host, path = plain(url)
        rules[i] = (host, plain_rule(host, path)[1])
        if host:
            seen[host].append(rules[i][1])
        shown = re.sub(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\b|\Z)", " ", html or "")
        for link in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)""", shown):
            to = plain("x:" + link if link.startswith("//") else link)[0]
            if host and to and to != host:
                edges[(host, to)] += 1
    share = lambda what: {h: v.count(what) / len(v) for h, v in seen.items() if what in v}
    trust, bad = plain_walk(edges, share("allow")), plain_walk({(b, a): n for (a, b), n in edges.items()}, share("block"))
    return {i: v or ("block" if bad.get(h, 0.0) >= U.THRESHOLD and bad.get(h, 0.0) > trust.get(h, 0.0) else "allow") for i, (h, v) in rules.items()}


def test_a_web_of_hosts_against_plain_iteration(spark):
    r = random.Random(6)
    hosts = [f"h{i}.{t}" for i in range(30) for t in ("io", "net", "org", "com")] + ["a.example.com", "b.example.net"]
    pages = []
    for i in range(300):
        host = r.choice(hosts)
        links = "".join(f'<a href="{r.choice(["http:", "HTTPS:", ""])}//{r.choice(hosts)}/x">t</a>' for _ in range(r.randrange(0, 6)))
        hidden = f'<!-- <a href="http://{r.choice(hosts)}/">no</a> --><script>"<a href=http://{r.choice(hosts)}/>"</script>'
        pages.append((i, f"http://{host}/{r.choice(['en', 'fr', 'de'])}/{i}", r.choice([None, "", links, links + hidden, hidden + links])))
    pages += [(1000, None, '<a href="http://h1.net/">x</a>'), (1001, "http://long.io/" + "p" * 50_000, "<p>" * 50_000 + '<a href="http://h2.net/">x</a>')]
    df = spark.createDataFrame([(*p, "c", "d") for p in pages], "page_id long, url string, html string, by_rule string, rank string")
    got = {x.page_id: x.verdict for x in U.verdicts(df).collect()}
    want = plain_verdicts(pages)
    assert got == want and len({v for i, v in got.items() if plain_rule(*plain(dict((p[0], p[1]) for p in pages)[i]))[1] is None}) == 2


def test_given_pages_and_none(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = U.verdicts(pages).collect()
    assert len(rows) == pages.count()
    want = plain_verdicts([(x.page_id, x.url, x.html) for x in pages.collect()])
    for r in rows:
        assert r.rule == plain_rule(r.host, r.path)[0] and r.verdict == want[r.page_id]
    assert U.verdicts(pages.limit(0)).count() == 0
