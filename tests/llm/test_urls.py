import random

from ledgerlens.llm import urls


def brute(captures, entries):
    out = {}
    for i, url, at in captures:
        lists, keys = set(), set()
        if url is not None and at is not None:
            rest = url.split("//", 1)[1] if "//" in url else ""
            host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].lower()
            host = host[: host.index("]") + 1] if host.startswith("[") else host.split(":")[0]
            path = rest[len(rest.split("/")[0]) :].split("?")[0].split("#")[0].lower() if "/" in rest.split("?")[0].split("#")[0] else ""
            labels = host.split(".")
            steps = [s for s in path.split("/") if s]
            listed = {(e[1] or "").lower() for e in entries} - {""}
            own = {k for k in listed if "/" not in k and (k == host or host.endswith("." + k) and ("." in k or len(labels) == 1))}
            own |= {k for k in listed if "/" in k and k.split("/")[0] == host and steps[: len(k.split("/")) - 1] == k.split("/")[1:]}
            for name in {e[0] for e in entries}:
                for key in own:
                    past = [e for e in entries if e[0] == name and (e[1] or "").lower() == key and e[3] is not None and e[3] <= at and e[2] in ("add", "remove")]
                    if past and max((e[3], e[2] == "add") for e in past)[1]:
                        lists.add(name)
                        keys.add(key)
        out[i, url, at] = (sorted(lists), sorted(keys))
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    hosts = ["a.example.com", "example.com", "b.org", "WWW.B.org", "c"]
    captures = [(i, rng.choice(["http://", "https://u:p@", "//"]) + rng.choice(hosts) + rng.choice(["", ":8080"]) + rng.choice(["", "/", "/x", "/X/y?q=/z", "/x/y/z#/w", "?a=/b"]), rng.randint(0, 30)) for i in range(300)]
    captures += [(910, "http://[2001:db8::1]:80/x", 9), (911, "http://b.org/" + "x/" * 60_000, 9), (912, "http://" + "a." * 60_000 + "example.com/", 9)]
    captures += [(900, None, 5), (901, "http://b.org/x", None), (902, "no address", 5), (903, "", 5)]
    entries = [(rng.choice(["spam", "adult"]), rng.choice(["example.com", "a.example.com", "B.org", "c/x", "b.org/x/y", "com"]), rng.choice(["add", "remove"]), rng.randint(0, 30)) for _ in range(80)]
    entries += [("spam", None, "add", 1), ("spam", "c", "add", None), ("spam", "c", "renew", 1), ("spam", "[2001:db8::1]", "add", 2), *entries[:5]]
    c = spark.createDataFrame(captures + captures[:3], "page_id long, url string, fetched_at long").selectExpr("*", "'x' as list", "'y' as key")
    e = spark.createDataFrame(entries, "list string, key string, action string, at long")
    got = urls.judge(c, e).collect()
    want = brute(captures, entries)
    assert len(got) == len(captures) + 3
    assert all((r.lists, r.keys) == want[r.page_id, r.url, r.fetched_at] and r.blocked == bool(r.lists) for r in got)
    assert sum(r.blocked for r in got) > 20
    assert urls.judge(c.where("false"), e).count() == 0 and not any(r.blocked for r in urls.judge(c, e.where("false")).collect())
