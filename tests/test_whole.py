"""Queries over all rows against brute force, where SQL cannot follow or follows a part."""

import re
from urllib.parse import urljoin

from ohmlake.operators import crawl as W
from ohmlake.queries import QUERIES
from ohmlake.queries.base import derived

AT = "/root/testdata/sf0.001"


def test_every_link_is_resolved(spark):
    pages = spark.read.parquet(f"{AT}/pages.parquet").collect()
    want = sorted((p.page_id, i, urljoin(p.url, h)) for p in pages for i, h in enumerate(re.findall(r'<a\s[^>]*href="([^"]*)"', p.html)))
    got = sorted((r.page_id, r.pos, r.link) for r in QUERIES["crl2_all_resolved"](spark, AT).collect())
    assert got == want and len(got) > QUERIES["crl2_resolved"](spark, AT).count()


def test_kinds_of_links(spark):
    cases = {"/p": "http://h/p", "x": "http://h/a/x", "../x": "http://h/x", "./x?q=1#f": "http://h/a/x?q=1#f", "?q": "http://h/a/b?q", "#f": "http://h/a/b#f", "//o/y": "http://o/y", "https://o/z": "https://o/z", "/é-1": "http://h/é-1", "": "http://h/a/b", "mailto:a@b": "mailto:a@b", "http://[": None}
    df = spark.createDataFrame([("http://h/a/b", h) for h in cases], "url string, href string")
    assert {r.href: r.link for r in df.select("href", W.resolved("url", "href").alias("link")).collect()} == cases


def test_documents_of_all_types(spark):
    rows = QUERIES["cir12_all_documents"](spark, AT).collect()
    comps = derived(spark, AT, "comps").collect()
    assert sum(r.type == "circuit_overview" for r in rows) == len({c.schematic_id for c in comps})
    starts = sorted((c.schematic_id, f"Component {c.reference}: {c.value}\n") for c in comps)
    assert sorted((r.schematic_id, r.content.split("\n")[0] + "\n") for r in rows if r.type == "component") == starts
    part = [r for r in rows if r.type in ("functional_group", "network")]
    assert sorted(map(tuple, part)) == sorted(map(tuple, QUERIES["cir12_retrieval_documents"](spark, AT).collect()))


def test_requirements_are_all_in_three_queries(spark):
    from ohmlake.operators import datasheet as D
    from ohmlake.queries.texts import sheets

    parts = sum(QUERIES[q](spark, AT).count() for q in ("dtx9_pull_ups_and_capacitors", "dtx10_spi_requirements", "dtx11_i2c_requirements"))
    assert D.requirements(sheets(spark, AT)).count() == parts


def test_dead_letters_read_every_receive(spark):
    seen = {}
    for r in spark.read.parquet(f"{AT}/events.parquet").collect():
        seen.setdefault(str(r.user_id), []).append(r.value > 200)
    want = {k: len(v) for k, v in seen.items() if not any(v) and len(v) >= 3}
    got = {r.key: r.receives for r in QUERIES["str8_all_dead_letters"](spark, AT).collect()}
    assert got == want and 0 < len(got) < len(seen)
