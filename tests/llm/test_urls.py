import itertools

from colloquy.llm import urls

URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "https://EXAMPLE.org/en/1?x", "http://a.example.org/en/12/", "http://example.org/EN/1", "http://badexample.org/es/1", "http://x.y.example.org/es/", "http://example.org/es", "http://www.example.com/de/3#top", "http://com/fr/", "http://example.com?/fr/1", "http://a.com#/de/", "ftp://u@h.org:80/x", "x://y://z.org/es/", "http://a..org/q", "http://org./", "http://Straße.example.org/es/ü", "http://a\n.org/x"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_against_brute_force(spark):
    many = URLS + [f"http://{s}{h}{p}" for s, h, p in itertools.product(["", "a.", "b.c."], ["example.org", "example.com", "org", "net"], ["", "/", "/en/1", "/en/2", "/es/x", "/de/1?q", "/fr/#a"])]
    rows = [(i, u, "clash", 7) for i, u in enumerate(many)] + [(0, many[5], "again", 8), (None, many[6], "no id", 9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, short int")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judged(df).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u, *_ in rows), key=str)
    assert urls.judged(df.where("false")).count() == 0
