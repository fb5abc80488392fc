"""URL normalization against the JDK itself, which the tests have at hand, and against a table of traps."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from refweave.functions import urls as U
from refweave.operators import extract

TRAPS = [
    ("http://a.com/p/q?z=1", "?y=2", "http://a.com/p/?y=2"),
    ("http://a.com/p/q", "../../../up", "http://a.com/../../up"),
    ("http://a.com/", "http://b.com/a/../b/./c", "http://b.com/a/../b/./c"),
    ("http://a.com", "x.html", "http://a.com/x.html"),
    ("http://a.com/", "//B.com:80/x", "http://b.com/x"),
    ("http://a.com/", "http://u:p@b.com/x", "http://b.com/x"),
    ("http://a.com/", "http://under_score.com/x", None),
    ("http://a.com/", "http://bücher.de/x", None),
    ("http://a.com/", "http:/x", None),
    ("http://a.com/", "/has space", None),
    ("http://a.com/", "/p|q", None),
    ("http://a.com/", "/x[1]", None),
    ("http://a.com/", "/bad%zz", None),
    ("http://a.com/", '/a"b', None),
    ("http://a.com/", "/x?a=[1]", "http://a.com/x?a=[1]"),
    ("http://a.com/", "/a%2Fb%20c%25d", "http://a.com/a/b%20c%25d"),
    ("http://a.com/", "/s?q=a%26b%3Dc+d", "http://a.com/s?q=a&b=c+d"),
    ("http://a.com/", "/%ff", "http://a.com/%EF%BF%BD"),
    ("http://a.com/", "/é", "http://a.com/%C3%A9"),
    ("http://a.com/", "http://b.com:443/x", "http://b.com:443/x"),
    ("http://a.com/", "https://b.com:443/x", "https://b.com/x"),
    ("http://a.com/", "/~u/%7Eu", "http://a.com/~u/~u"),
    ("http://a.com/", "mailto:x@y.z", None),
    ("http://a.com/", " JavaScript:void(0)", None),
    ("http://a.com/", "#top", None),
    ("http://a.com/", "  \t ", None),
    ("http://a.com/", None, None),
    (None, "/x", None),
    (None, " HTTP://WWW.A.com ", "http://www.a.com/"),
    ("http://a.com/x/", "a//b/./c/..", "http://a.com/x/a/b/"),
    ("http://a.com/x/", ".", "http://a.com/x/"),
    ("http://a.com/", "/" + "x" * 2000, None),
]


def resolve(spark, rows):
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(rows)], "i int, b string, h string")
    return [r["out"] for r in U.with_resolved(df, "out", F.col("h"), U.parse_base(F.col("b"))).orderBy("i").collect()]


def test_traps(spark):
    got = resolve(spark, [(b, h) for b, h, _ in TRAPS])
    assert [(t[0], t[1], g) for t, g in zip(TRAPS, got, strict=True)] == TRAPS


def jdk(spark, base, href):
    """The rules, one after another, on java.net.URI."""
    uri = spark._jvm.java.net.URI
    href = href.strip("".join(map(chr, range(33))))
    if not href or href.startswith("#") or href.lower().startswith(("javascript:", "mailto:", "tel:", "data:", "about:", "ftp:")):
        return None
    try:
        found = uri(base).resolve(href)
        scheme, host = found.getScheme(), found.getHost()
        if not scheme or scheme.lower() not in ("http", "https") or not host:
            return None
        port = -1 if (scheme.lower(), found.getPort()) in (("http", 80), ("https", 443)) else found.getPort()
        out = uri(scheme.lower(), None, host.lower(), port, found.getPath() or "/", found.getQuery() or None, None).toASCIIString()
        return out if len(out) <= 2000 else None
    except Exception:
        return None


def test_random_links_against_the_jdk(spark):
    rng = random.Random(8)
    bits = ["a", "b.html", "..", ".", "/", "//", "?", "q=1", "&", "%20", "%2F", "%e9", "%C3%A9", "+", ":", "8080", "é", "é", "#f", "http://", "https://", "H.com", "x.org:80", "@", "~", " ", "[", "*", "(", ";", " ", "日", "''"]
    bases = ["http://a.com", "http://a.com/p/q?z=1", "https://a.com:444/p/./q/", "http://a.com/p/../x", "http://a.com//d//e"]
    rows = [(rng.choice(bases), "".join(rng.choice(bits) for _ in range(rng.randint(1, 6)))) for _ in range(600)]
    got = resolve(spark, rows)
    wrong = [(b, h, g, w) for (b, h), g in zip(rows, got, strict=True) if g != (w := jdk(spark, b, h))]
    assert not wrong, wrong[:5]
    assert sum(g is not None for g in got) > 60


def test_composing_is_nfc_but_for_blanks_and_takes_no_python(spark):
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x400), *range(0x1100, 0x11F0), *range(0x1E00, 0x2070), *range(0xAC00, 0xAC40), *range(0xF900, 0xF940)]]
    pool += ["e", "\u0301", "\u0327", "\u0308", " ", "\u2000", "\u2001", "\u3000"] * 60
    texts = [None, "", "plain", "\u2000e\u0301\u2001"] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    nfc = lambda t: None if t is None else "".join(x if x in "\u2000\u2001" else unicodedata.normalize("NFC", x) for x in re.split("([\u2000\u2001])", t))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", U.composed(F.col("t")).alias("t"))
    assert [r["t"] for r in df.orderBy("i").collect()] == [nfc(t) for t in texts]
    pages = spark.createDataFrame([("http://a.com/", '<a href="/e\u0301">x</a>')], "url string, html string")
    edges = extract.pages_to_edges(pages, include_internal=True, max_pages=1)
    assert "EvalPython" not in edges._jdf.queryExecution().optimizedPlan().toString() and edges.first()["target"] == "http://a.com/%C3%A9"


@pytest.mark.parametrize("a,b,same", [("www.a.com", "a.com", True), ("www.www.a.com", "a.com", False), ("m.a.com", "a.com", False)])
def test_same_site(spark, a, b, same):
    assert spark.range(1).select(U.same_site(F.lit(a), F.lit(b))).first()[0] is same


def test_plan_computes_each_step_once(spark):
    df = spark.createDataFrame([("http://a.com/", "/x")], "b string, h string")
    plan = U.with_resolved(df, "out", F.col("h"), F.col("b"), unicode=False).where("out like 'http%'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_url") + plan.count("ParseUrl") <= 12, plan
