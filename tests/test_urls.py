"""URL resolution by columns against the standard library's."""

import random
from urllib.parse import urljoin

from ohmlake.operators import crawl as W

BASES = ["http://h.x/a/b/c?q=1#f", "https://h", "https://h/", "http://h.x/a/b/;p?q", "HTTP://H.X/a//b/", "ftp://h/a/b", "", None, "a/b/c", "/a/b", "//h/a", "mailto:x@y", "http://u@h:80/a/../b/./c", "http:///a/b", "file:///a/b", "  http://h/x\ty/z"]
LINKS = ["", None, "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "http:g", "https:g", "http://o.x/a/../b", "mailto:z", "javascript:void(0)", "x:y", "1:2", "//[::1]/a", "//[oops", "http://a]b/", "http://[zz]/", "//h／x", "g//h", "//", "///g", "a b", " g ", "g\nh", "é/ñ?ü#ß", "..;x", "g/..;x", "?", "#", "g?", "a:b/c"]


def one(b, h):
    try:
        return urljoin(b or "", h or "")
    except ValueError:
        return None


def test_resolved(spark):
    rng = random.Random(3)
    bits = ["..", ".", "", "a", "b;c", "d.e", "é"]
    more = [rng.choice(["", "/", "//h/"]) + "/".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) + rng.choice(["", "?q", "#f"]) for _ in range(300)]
    pairs = [(b, h) for b in BASES for h in LINKS] + [(rng.choice(BASES), h) for h in more]
    df = spark.createDataFrame(pairs, "b string, h string").select("b", "h", W.resolved("b", "h").alias("r"))
    wrong = [(r.b, r.h, r.r, one(r.b, r.h)) for r in df.collect() if r.r != one(r.b, r.h)]
    assert not wrong, wrong[:20]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
