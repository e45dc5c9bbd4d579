import random
from urllib.parse import urlsplit

from small import as_rows

from paperloom.llm import urls

ENTRIES = "kind string, pattern string, day int, action string"
CAPTURES = "page_id long, url string, day int, blocked string, host string, kind string"


def plain(captures, entries):
    good = [e for e in entries if None not in e]
    states = {}
    for kind, pattern, day, action in good:
        states.setdefault((kind, pattern), {}).setdefault(day, set()).add(action)
    out = []
    for page, url, day, *_ in captures:
        best = None
        try:
            split = urlsplit(url or "")
            host, path = (split.hostname or "", split.path) if split.scheme and "//" in (url or "") else ("", "")
        except ValueError:
            host, path = "", ""
        for (kind, pattern), days in states.items():
            if not host or day is None:
                continue
            past = [d for d in days if d <= day]
            if not past or "block" not in days[max(past)]:
                continue
            if kind == "host":
                fits = host == pattern
            elif kind == "domain":
                fits = host == pattern or host.endswith("." + pattern)
            else:
                fits = (host + path.rstrip("/") + "/").startswith(pattern + "/")
            if fits:
                best = max(best or (), ({"domain": 1, "host": 2, "path": 3}[kind], len(pattern), kind, pattern, max(past)))
        out.append((page, best is not None, *(best[2:] if best else (None,) * 3)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "hot.net"]
    entries = []
    for _ in range(120):
        host = rng.choice(hosts)
        kind = rng.choice(["host", "domain", "path"])
        pattern = host + "/" + "/".join(rng.choices("xy", k=rng.randint(1, 3))) if kind == "path" else host
        entries.append((kind, pattern, rng.randint(0, 300), rng.choice(["block", "drop"])))
    entries += [("host", None, 1, "block"), (None, "d.org", 1, "block"), ("host", "d.org", None, "block"), ("host", "d.org", 5, None)] + entries[:5]
    captures = []
    for i in range(300):
        host = rng.choice([*hosts, "hot.net", "hot.net", "A.com"])
        path = "/".join(rng.choices("xyz", k=rng.randint(0, 4)))
        url = rng.choice([f"http://{host}/{path}", f"https://u:p@{host}:8080/{path}/?q=/x/y", f"http://{host}", f"http://{host}/{path}#top"])
        captures.append((i, url, rng.randint(0, 400), "x", "x", "x"))
    captures += [(1, None, 5, None, None, None), (None, "http://a.com/x", None, None, None, None), (2, "", 3, None, None, None), (3, "no url", 3, None, None, None)]
    captures += [(4, "http://a.com/" + "x/" * 5000, 200, None, None, None), captures[0], captures[0]]
    got = urls.filter_captures(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    names = ["page_id", "blocked", "list_kind", "list_pattern", "list_since"]
    want = plain(captures, entries)
    assert as_rows(got.select(names)) == want and sum(r[1] for r in want) > 50


def test_empty_tables(spark):
    captures, entries = spark.createDataFrame([], CAPTURES), spark.createDataFrame([], ENTRIES)
    one = spark.createDataFrame([(1, "http://a.com", 3, None, None, None)], CAPTURES)
    assert urls.filter_captures(captures, entries).count() == 0
    assert [r.blocked for r in urls.filter_captures(one, entries).collect()] == [False]
