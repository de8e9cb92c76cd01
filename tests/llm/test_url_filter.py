import pytest

from lacuna.llm import url_filter as U


def brute(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = rest[cut : min((rest.index(c, cut) for c in "?#" if c in rest[cut:]), default=len(rest))]
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if under(h) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(under(b) for b in blocked) else "allow"


URLS = [
    "https://a.net/", "https://A.NET", "http://x.example.net/en/1?x#y", "http://example.net/en", "http://b.example.com/de/", "http://b.example.com/fr/?de/", "http://org/fr/x", "http://notorg/fr/x", "http://k.org/en/",
    "http://spam-farm.example.com/en/", "http://www.spam-farm.example.com?q=/de/", "http://spam-farm.example.com.evil.io/", "http://myspam-farm.example.com/en/", "x://y://z/w", "noscheme.net/", "", None, "://", "http:///only", "http://h#a/b?c", "http://h?/net/",
    "http://é.net/ü", "http://a..net/", "http://.net/", "http://net", "http://net/" + "x" * 100_000,
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)] + [(None, "http://a.net/", "h", 1), (0, URLS[0], "h", 1)], "page_id long, url string, host string, rule int")
    got = sorted((tuple(r) for r in U.judge_urls(df).collect()), key=str)
    want = [(i, *brute(u, U.RULES, U.BLOCKED_HOSTS)) for i, u in [*enumerate(URLS), (None, "http://a.net/"), (0, URLS[0])]]
    assert got == sorted(want, key=str)
    assert U.judge_urls(df.limit(0)).collect() == []


def array(keys, tmp_path):
    (tmp_path / "list").write_bytes(U.DigestArray.image(keys))
    return U.DigestArray(str(tmp_path / "list"))


def test_equal_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(U, "digests", lambda keys: __import__("numpy").array([len(k) for k in keys], "uint64"))
    keys = ["aa", "bb", "ccc", "dd"]
    a = array(keys, tmp_path)
    assert a.contains(["aa", "bb", "dd", "ee", "ccc", "ddd", ""]).tolist() == [True, True, True, False, True, False, False]


def test_empty_list(tmp_path):
    assert not array([], tmp_path).contains(["a"]).any()


def test_published_lists(spark, tmp_path):
    (tmp_path / "hosts.txt").write_text("# list\n0.0.0.0 Ads.example.io # x\n127.0.0.1 localhost\n||tracker.io^\n! no.example.io\nplain.example.io\n\n10.0.0.1\nplain.example.io.\n")
    hosts = U.read_hosts(spark.read.text(str(tmp_path)))
    assert hosts == ["ads.example.io", "plain.example.io", "tracker.io"]
    df = spark.createDataFrame([(1, "http://a.tracker.io/x"), (2, "http://nottracker.io/"), (3, "https://plain.example.io")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge_urls(df, (), hosts).collect()} == {1: "block", 2: "allow", 3: "block"}
    many = [f"h{i}.example.io" for i in range(50_000)]
    assert array(many, tmp_path).contains([*many[::7], "h50000.example.io", "x.example.io"]).sum() == len(many[::7])


def test_a_list_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(U, "LIST_BYTES", 10)
    with pytest.raises(ValueError, match="above"):
        U.judge_urls(spark.createDataFrame([(1, "u")], "page_id long, url string"))
