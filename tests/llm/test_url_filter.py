"""URL filter against SQL and by cases."""

import pytest

pytest.importorskip("markerlake.llm")
from markerlake.llm.url_filter import OP8_SQL, op8_url_filter, url_filter  # noqa: E402

from .helpers import same_as_sql  # noqa: E402


def test_sql(spark):
    for d in ("sf0.001", "sf0.01"):
        same_as_sql(op8_url_filter(spark, f"/root/testdata/{d}"), OP8_SQL, f"/root/testdata/{d}")


def test_cases(spark):
    urls = [
        (1, "http://A.example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "https://org/a#b", "org", "/a", "org/", "allow"),
        (3, "x://borg.net/", "borg.net", "/", None, "allow"),
        (4, "http://a.org", "a.org", "", None, "allow"),
        (5, None, "", "", None, "allow"),
        (6, "no scheme.org/", "", "", None, "allow"),
        (7, "http://example.org/en/12?x", "example.org", "/en/12", "example.org/en/1", "block"),
        (8, "http://x.com/de/http://y.org/", "x.com", "/de/http://y.org/", "com/de/", "block"),
        (9, "http://com?/fr/", "com", "", None, "allow"),
    ]
    bad = [(100 + i, "http://bad.test/p") for i in range(40)] + [(200 + i, f"http://h{i}.good.test/") for i in range(40)]
    pages = spark.createDataFrame([r[:2] for r in urls] + bad, "page_id long, url string").selectExpr("*", "1 AS verdict", "'h' AS host")
    good = spark.createDataFrame([(100 + i, 0) for i in range(40)] + [(200 + i, 1) for i in range(40)] + [(3, 1), (3, 0), (4, None)], "page_id long, good int")
    got = {r.page_id: r for r in url_filter(pages, good).collect()}
    for i, _, host, path, rule, verdict in urls:
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert got[100].verdict == "block" and got[200].verdict == "allow"
    assert url_filter(pages.filter("page_id < 0"), good).count() == 0
    assert {r.verdict for r in url_filter(pages.filter("page_id > 99"), good.filter("page_id < 0")).collect()} == {"allow"}
