import re

from millrace.llm import urls as U


def parsed(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def scores(rows, damping=0.85, rounds=20, tolerance=1e-4):
    pages = [(*parsed(u), h or "") for u, h in rows]
    hosts, links = {}, {}
    for host, path, html in pages:
        if host:
            hosts.setdefault(host, []).append(rule(host, path)[1])
            for dst in dict.fromkeys(re.findall(U.HREF, html)):
                dst = dst.lower()
                if dst != host:
                    links[host, dst] = links.get((host, dst), 0) + 1
    names = set(hosts) | {d for _, d in links}
    good = {n: sum(v == "allow" for v in hosts.get(n, [])) / max(len(hosts.get(n, [])), 1) for n in names}
    bad = {n: sum(v == "block" for v in hosts.get(n, [])) / max(len(hosts.get(n, [])), 1) for n in names}
    out, into = {}, {}
    for (a, b), n in links.items():
        out[a] = out.get(a, 0) + n
        into[b] = into.get(b, 0) + n
    t, d = ({n: (1 - damping) * s[n] for n in names} for s in (good, bad))
    for _ in range(rounds if links else 0):
        t2, d2 = ({n: (1 - damping) * s[n] for n in names} for s in (good, bad))
        for (a, b), n in links.items():
            t2[b] += damping * t[a] * n / out[a]
            d2[a] += damping * d[b] * n / into[b]
        moved = max(max(abs(t2[n] - t[n]), abs(d2[n] - d[n])) for n in names)
        t, d = t2, d2
        if moved <= tolerance:
            break
    return t, d


LINK = '<a href="http://{}/x">x</a>'
ROWS = [
    ("http://a.com/x", LINK.format("friend.org")), ("https://Sub.A.COM/en/?q#f", None), ("http://example.com/en/1", ""), ("http://www.example.com/en/2", ""), ("http://x.www.example.com/en/2", ""), ("http://example.com/de/", ""), ("http://b.net/es/1", LINK.format("c.org")), ("http://b.net/es/2", ""),
    ("http://b.net/de/3", ""), ("http://com", ""), ("http://com/", ""), ("notcom://xcom/", ""), ("nothing", "x"), (None, None), ("", ""), ("://h.net/fr/9", ""), ("http://friend.org/1", LINK.format("b.net") * 3), ("http://bad.org/1", LINK.format("b.net") + LINK.format("only.net")), ("http://bad.org/2", "<A HREF='//b.net'>"), ("http://only.net/fr/", ""),
    ("http://u:p@h.org:80?x=/com", ""), ("http://a.com/x", LINK.format("friend.org")), ("http://c.org/\nline", LINK.format("bad.org")),
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(k, u, h, "t", 0) for k, (u, h) in enumerate(ROWS)] + [(None, "http://a.com/", "", "t", 1)], "page_id long, url string, html string, host string, trust int").repartition(3)
    rows = [*ROWS, ("http://a.com/", "")]
    t, d = scores(rows)
    got = {r.page_id: r for r in U.filter_urls(df).collect()}
    assert len(got) == len(rows)
    verdicts = set()
    for k, (u, _) in zip([*range(len(ROWS)), None], rows, strict=True):
        host, path = parsed(u)
        name, verdict = rule(host, path)
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert abs(r.trust - t.get(host, 0)) < 1e-9 and abs(r.distrust - d.get(host, 0)) < 1e-9
        want = verdict or ("block" if d.get(host, 0) >= 0.1 and d.get(host, 0) > t.get(host, 0) else "allow")
        assert r.verdict == want
        verdicts.add((name is None, want))
    assert verdicts == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}


def test_empty(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    one = U.filter_urls(spark.createDataFrame([(1, "http://x.org/", None)], "page_id long, url string, html string")).first()
    assert (one.host, one.path, one.rule, one.verdict) == ("x.org", "/", None, "allow")


def test_every_host_that_links_to_a_blocked_one_is_blocked(spark):
    n = 300
    rows = [(0, "http://spam.net/es/1", "")] + [(k, f"http://s{k}.org/", LINK.format("spam.net")) for k in range(1, n + 1)]
    rows += [(1000, "http://mixed.org/", LINK.format("spam.net") + "".join(LINK.format(f"fine{k}.org") for k in range(9))), (1001, "http://apart.org/", LINK.format("fine1.org"))]
    got = {r.page_id: r.verdict for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v == "block"} == set(range(n + 1))
