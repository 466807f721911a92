"""URL parts against the public reference parser and fixed cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import with_url_parts

FIXED = [
    ("/index.html?q=1", (None, "/index.html", "q=1")),
    ("http://example.com/home", ("example.com", "/home", None)),
    ("-", ("-", None, None)),
    ("", (None, None, None)),
    ("/cgi-bin/.%2e/%2e%2e/etc/passwd", (None, "/cgi-bin/.%2E/%2E%2E/etc/passwd", None)),
    ("/a/../../etc/passwd", (None, "/etc/passwd", None)),
    ("/a b|c", (None, "/a%20b%7Cc", None)),
    ("/x?a=${jndi:ldap://e/a}", (None, "/x", "a=$%7Bjndi:ldap://e/a%7D")),
    ("http://Example.COM:80/Home?x=1#f", ("example.com", "/Home", "x=1")),
    ("index.html", ("index.html", None, None)),
    ("/é%zz%41", (None, "/%C3%A9%25zz%2541", None)),
]


def parts(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    rows = with_url_parts(df, "u", "url").orderBy("i").collect()
    return [(r.url_ok, (r.url_host, r.url_path, r.url_query)) for r in rows]


def test_fixed_cases(spark):
    got = parts(spark, [u for u, _ in FIXED])
    assert got == [(True, want) for _, want in FIXED]


def test_null_url(spark):
    assert parts(spark, [None]) == [(None, (None, None, None))]


@pytest.mark.parametrize(
    "url", ["http://h:99999/", "http://[::1", "http://a:b/", "http://münchen.de/", "//a%zz/"]
)
def test_unparseable_urls_are_flagged(spark, url):
    assert parts(spark, [url]) == [(False, (None, None, None))]


def test_very_long_texts(spark):
    long_path = "/" + "a/../b./" * 3000 + "é" * 5000
    long_host = "http://" + "h" * 20000 + "/x"
    got = parts(spark, [long_path, long_host])
    assert got[0][0] and got[0][1][1].endswith("%C3%A9")
    assert got[1] == (True, ("h" * 20000, "/x", None))


def test_random_urls_against_urllib3(spark):
    parse_url = pytest.importorskip("urllib3").util.parse_url
    from urllib3.exceptions import LocationParseError

    rng = random.Random(7)
    atoms = ["a", "B", ".", "..", "/", "//", "?", "#", "%", "%2e", "%4F", "%zz", ":", "@", "=", "&",
             "é", "|", "{", "}", " ", "\\", "+", "~", "*", "'", ",", ";", "!", "$", "(", ")", "\n", "-"]
    heads = ["", "/", "http://", "HTTPS://", "ftp://", "http://user:pw@", "//", "x:", "mailto:", "http://h.Ex:80",
             "http://h:0080/", "http://[::1]:8080/", "http://[FE80::1%25eth0]/", "http://[1:2::3.4.5.6]",
             "http://[::]", "http://[1:2:3:4:5:6:7:8]/", "http://[1:2:3:4:5:6:7::]/", "http://[::%25]/", "http://[::1%ab]/",
             "http://1.2.3.4", "/..", "/.", ".", ".."]
    urls = [rng.choice(heads) + "".join(rng.choice(atoms) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    checked = 0
    for url, (ok, got) in zip(urls, parts(spark, urls)):
        try:
            u = parse_url(url)
        except LocationParseError:
            # Newer releases also refuse blanks, line ends and percent signs in hosts.
            assert not ok or any(c in url for c in "% \n"), url
            continue
        if got[0] and "%" in got[0] and "[" not in got[0]:
            # Newer releases decode percent triplets in host names.
            continue
        if not ok:
            # Encoded international names are outside native expressions.
            assert u.host and "xn--" in u.host, url
            continue
        assert got == (u.host, u.path, u.query), url
        checked += 1
    assert checked > 2000
