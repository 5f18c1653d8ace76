"""Hosts, paths and rules against plain Python, and verdicts of learnt templates."""

from __future__ import annotations

import random
import re

from tidewheel.llm.queries import RULES
from tidewheel.llm.url_filter import judge

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/en/1x?q", "http://example.org/es/", "http://notexample.org/es/a", "https://a.b.com/fr/x/y/z/w/v#f", "http://com/de/", "http://x.com/de", "http://x.com?/fr/", "http://ÄX.com/fr/é", "a://b://c/d", "http://x.org", "http://x.org/", "http://u@x.org:80/p"]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in judge(df, RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain(u)
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.name), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule.name)
        assert got[i]["verdict"] == rule.verdict if rule else got[i]["verdict"] in ("allow", "block")


def brute(pages, labels):
    """Verdict and template of (page_id, url) by the tree built over plain lists."""
    import math

    from tidewheel.llm.url_filter import DIFFERENT, PRIOR

    wild = re.compile(r"^(\d+|[0-9a-fA-F-]{8,}|[^/]*\d{4,}[^/]*)(\.[A-Za-z]{1,5})?$")
    rows = []
    for i, u in pages:
        host, path = plain(u)
        rows.append([i, host, ["*" if wild.match(s) else s for s in re.split("/+", path.strip("/"))], "", False])
    rate = lambda some, prior: (sum(labels[r[0]] for r in some if r[0] in labels) + PRIOR * prior) / (sum(r[0] in labels for r in some) + PRIOR)
    for level in range(max(len(r[2]) for r in rows)):
        parents, steps = {}, {}
        for r in rows:
            if not r[4]:
                parents.setdefault((r[1], r[3]), {}).setdefault(r[2][level], []).append(r)
        for parent, children in parents.items():
            count = lambda some: (sum(labels[r[0]] for r in some if r[0] in labels), sum(r[0] in labels for r in some))
            all_a, all_l = count([r for c in children.values() for r in c])
            for s, some in children.items():
                a, n = count(some)
                rest, z = all_l - n, None
                if n and rest and 0 < all_a < all_l:
                    p = all_a / all_l
                    z = abs(a / n - (all_a - a) / rest) / math.sqrt(p * (1 - p) * (1 / n + 1 / rest))
                same = len(children) > 1 and not (z is not None and z >= DIFFERENT)
                steps[parent, s] = "" if s == "" else "/**" if not 0 < all_a < all_l else "/*" if same else "/" + s
        for r in rows:
            if not r[4]:
                step = steps[(r[1], r[3]), r[2][level]]
                r[3] += step
                r[4] = step == "/**" or len(r[2]) <= level + 1
    known = [labels[r[0]] for r in rows if r[0] in labels]
    total = sum(known) / len(known) if known else 0.5
    domain = lambda h: m[0] if (m := re.search(r"[^.]*\.[^.]*$", h)) else ""
    out = {}
    for r in rows:
        p = rate([x for x in rows if domain(x[1]) == domain(r[1])], total)
        p = rate([x for x in rows if x[1] == r[1]], p)
        p = rate([x for x in rows if (x[1], x[3]) == (r[1], r[3])], p)
        out[r[0]] = ("allow" if p >= 0.5 else "block", r[3])
    return out


def test_templates_against_brute_force(spark):
    r = random.Random(4)
    pages, labels = [], {}
    for i in range(1500):
        depth = r.randrange(7)
        parts = [r.choice(["news", "spam", "shop", f"id{r.randrange(99999)}", f"s{r.randrange(60)}"]) for _ in range(depth)]
        url = f"http://{r.choice(['a.x.org', 'b.x.org', 'y.com', 'z'])}/{'/'.join(parts)}"
        pages.append((i, url))
        if r.random() < 0.6:
            labels[i] = r.random() < (0.1 if "spam" in parts else 0.9 if "news" in parts[3:] else 0.6)
    # branches that differ only in their sixth segment, and rare sections of their own kind
    for i in range(1500, 1900):
        kind = "spam" if i % 2 else "news"
        pages.append((i, f"http://deep.net/a/b/c/d/e/{kind}/p{i % 3}"))
        labels[i] = kind == "news"
    for i in range(1900, 3900):
        pages.append((i, f"http://wide.net/s{'x' * (i % 100)}/q"))
        labels[i] = i % 100 != 7
    want = brute(pages, labels)
    rows = judge(spark.createDataFrame(pages, "page_id long, url string"), [], labels=spark.createDataFrame(list(labels.items()), "page_id long, allowed boolean")).collect()
    got = {x["page_id"]: (x["verdict"], x["template"]) for x in rows}
    assert got == want
    assert all((got[i][0] == "allow") == (i % 2 == 0) for i in range(1500, 1900))
    assert all((got[i][0] == "allow") == (i % 100 != 7) for i in range(1900, 3900))


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
