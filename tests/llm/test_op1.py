from codequery.llm import op1_url_filters as op1


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    stop = min([rest.index(c, end) for c in "?#" if c in rest[end:]] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:stop]


def rule(host, path):
    best = None
    for action, r in op1.RULES:
        d, _, p = r.partition("/")
        if (host == d or host.endswith("." + d)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
            best = (r, action)
    return best


EDGES = [None, "", "no scheme/x", "http://", "HTTP://Example.COM/en/7", "x://a.example.com/en/8?q=http://y/z", "a://b#c/d", "http://net/de/1", "http://xnet/de/1", "http://example.net/de/8", "http://h\n/p\nq?x", "http://ÄA.org/es/", "http://h/" + "a/" * 500]


def test_hosts_paths_and_rules(spark):
    urls = [*EDGES, *(r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect())]
    rows = [(i, u, 0, "h") for i, u in enumerate(urls)] + [(None, "http://a.com/en/1", 0, "h"), (0, None, 0, "h")]
    got = op1.judge(spark.createDataFrame(rows, "page_id long, url string, segs int, host string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u, *_ in rows[: len(urls)]:
        host, path = parts(u)
        found = rule(host, path)
        assert (by[i].host, by[i].path) == (host, path)
        assert by[i].rule == (found and found[0])
        assert by[i].verdict == found[1] if found else by[i].verdict in ("allow", "block")


def test_templates_follow_labels(spark):
    rows = [(i, f"http://a.com/en/{i}") for i in range(30)] + [(100 + i, f"http://a.com/zz/{i}") for i in range(30)]
    rows += [(200 + i, f"http://b.net/de/{i}.html") for i in range(30)] + [(300 + i, f"http://b.net/xx/u{chr(97 + i)}z") for i in range(20)] + [(400, "http://c.edu/q")]
    got = {r.page_id: r for r in op1.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0].verdict == "block" and got[0].template == "en/*"
    assert got[100].verdict == "block" and got[100].rule is None  # the host's purity
    assert got[200].rule == "net/de/" and got[300].verdict == "allow" and got[400].verdict == "allow"
    assert got[300].template == "xx/*"  # many children, few urls each


def test_similar_branches_merge_and_different_ones_do_not(spark):
    rows = [("h", [s, "*"], a) for s, blocks, n in (("a", 20, 40), ("b", 21, 40), ("c", 40, 40)) for a in ["block"] * blocks + ["allow"] * (n - blocks)]
    got = {r.raw: r.template for r in op1.templates(spark.createDataFrame(rows, "host string, segs array<string>, action string")).collect()}
    assert got["c/*"] == "c/*"
    assert op1.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
