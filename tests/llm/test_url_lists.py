from datetime import datetime

from quire.llm import url_lists


def at(day):
    return datetime.fromisoformat(day)


ENTRIES = [
    ("Bad.com ", "block", at("2024-01-01")), ("bad.com", "drop", at("2024-02-01")), ("bad.com", "block", at("2024-03-01")), ("ok.bad.com", "allow", at("2024-03-05")),
    ("x.org/Spam", "block", at("2024-01-01")), ("tie.net", "allow", at("2024-01-01")), ("tie.net", "block", at("2024-01-01")), (None, "block", at("2024-01-01")), ("n.com", None, at("2024-01-01")), ("m.com", "block", None),
]
CASES = [
    ("http://bad.com/a", "2024-01-01", True), ("http://bad.com/a", "2023-12-31", False), ("http://www.bad.com:80/", "2024-01-31 23:59:59", True), ("http://bad.com", "2024-02-01", False), ("https://u@BAD.com?x", "2024-03-01", True),
    ("http://ok.bad.com/", "2024-03-04", True), ("http://a.ok.bad.com/", "2024-03-05", False), ("http://notbad.com/", "2024-01-05", False), ("http://x.org/spam/1", "2024-05-01", True), ("http://x.org/spammy", "2024-05-01", False),
    ("http://y.x.org/spam", "2024-05-01", False), ("http://tie.net/", "2024-05-01", True), ("http://n.com", "2024-05-01", False), ("http://m.com", "2024-05-01", False), (None, "2024-05-01", False), ("", "2024-05-01", False), ("no url", "2024-05-01", False), ("http://bad.com/" + "p" * 50_000, "2024-03-02", True), ("http://Bad.com./x", "2024-01-05", True), ("http://x.org../spam", "2024-05-01", True), ("http://./", "2024-05-01", False),
]


def run(spark, cases):
    captures = spark.createDataFrame([(i, u, at(t), "clash", True) for i, (u, t, _) in enumerate(cases)] + [(99, "http://bad.com/", None, "c", True)], "page_id long, url string, fetched timestamp_ntz, entry string, blocked boolean")
    entries = spark.createDataFrame(ENTRIES, "entry string, action string, since timestamp_ntz")
    return url_lists.judge(captures.unionByName(captures), entries).collect()


def test_cases_by_either_join(spark, monkeypatch):
    first = sorted(map(str, run(spark, CASES)))
    got = {r.page_id: r.blocked for r in run(spark, CASES)}
    assert [got[i] for i in range(len(CASES))] == [b for _, _, b in CASES]
    assert got[99] is False and len(first) == len(CASES) + 1
    monkeypatch.setattr(url_lists, "BROADCAST_BYTES", 0)
    assert sorted(map(str, run(spark, CASES))) == first


def test_empty_tables(spark):
    captures = spark.createDataFrame([], "page_id long, url string, fetched timestamp_ntz")
    entries = spark.createDataFrame([], "entry string, action string, since timestamp_ntz")
    assert url_lists.judge(captures, entries).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/", at("2024-01-01"))], captures.schema)
    assert [r.blocked for r in url_lists.judge(one, entries).collect()] == [False]
