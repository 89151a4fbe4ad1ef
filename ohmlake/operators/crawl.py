"""Operators over fetched pages and fetch logs (CRL-1 to CRL-27). Nothing is fetched; pages are rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ohmlake.functions.columns import basename, has_any, keep_first, let, top_n_per, url_path
from ohmlake.plans.storage import stored

MAX_LINKS_PER_SITE = 20
MAX_PAGES = 50
MAX_FILE_BYTES = 50 * 1024 * 1024
#: Rows of one key that a task may count on its own.
LARGEST = 100_000
# The file host of a wiki, words of links to products, and the pattern of part numbers.
WIKI_FILES = "files.waveshare.com"
PRODUCT_WORDS = ["components", "products", "parts", "ics", "semiconductors"]
PART_NUMBER = r"^[A-Z0-9\-_]+\z"

ANCHOR = ArrayType(StructType().add("pos", IntegerType()).add("href", StringType()).add("text", StringType()).add("button", BooleanType()))


@F.pandas_udf(ANCHOR)
def _anchors(pages: pd.Series) -> pd.Series:
    """Anchors of each page; button: inside an element marked as the datasheet button."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.open, self.stack, self.button = [], None, [], 0

        def handle_starttag(self, tag, attrs):
            facts = dict(attrs)
            mark = facts.get("data-testid") == "datasheet-button"
            if tag not in ("br", "img", "input", "meta", "link", "hr", "source", "wbr", "area", "base", "col", "embed", "track"):
                self.stack.append((tag, mark))
                self.button += mark
            if tag == "a" and facts.get("href") is not None:
                self.open = {"pos": len(self.found), "href": facts["href"], "text": "", "button": self.button > 0 and not mark}
                self.found.append(self.open)

        def handle_endtag(self, tag):
            if tag == "a" and self.open is not None:
                self.open = None
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self.button -= sum(m for _, m in self.stack[i:])
                    del self.stack[i:]
                    break

        def handle_data(self, data):
            if self.open is not None:
                self.open["text"] += data

    out = []
    for page in pages:
        reader = Reader()
        reader.feed(page or "")
        for a in reader.found:
            a["text"] = "".join(x.strip() for x in a["text"].split("\n")).strip()
        out.append(reader.found)
    return pd.Series(out, dtype=object)


def anchors(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """CRL-1: the columns of pages (but html) with pos, href, text and button of every anchor with an href."""
    kept = keep if keep is not None else [c for c in pages.columns if c not in (html, "pos", "href", "text", "button")]
    return pages.select(*kept, F.explode(_anchors(html)).alias("_a")).select(*kept, "_a.pos", "_a.href", "_a.text", "_a.button")


def hrefs(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """CRL-1 without nesting or text: double-quoted hrefs of anchor tags, within the JVM."""
    kept = keep if keep is not None else [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


# Schemes whose references are resolved against a base, those of them without a host, and schemes with parameters.
RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]
WITH_PARAMS = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
HOSTLESS = ["nntp", "imap", "wais", "prospero", "svn", "svn+ssh"]

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


@cache
def _bad_host() -> str:
    """A pattern of hosts that are no hosts: half a bracket, brackets around something else than an address, and letters that stand for a separator."""
    odd = "".join(chr(c) for c in range(0x2000, 0x10000) if set(unicodedata.normalize("NFKC", chr(c))) & set("/?#@:") and not 0xD800 <= c < 0xE000)
    return rf"[{odd}]|^(?!.*\[.*\]).*[\[\]]|^(?!(?:[^@]*@)?\[(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\[\]]*)?|v[0-9A-Fa-f]+\.[^\[\]]+)\](?::[^\[\]]*)?\z).*\["


def _parsed(url: Column, scheme: Column) -> Column:
    """Parts of a URL; its scheme is the given one if it has none."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    part = lambda i: F.regexp_extract(clean, _URL, i)
    own = F.lower(part(1))
    path = part(3)
    scheme = F.when(own == "", scheme).otherwise(own)
    cut = F.length(F.when(scheme.isin(*WITH_PARAMS), F.regexp_extract(path, r"(?s)^((?:[^/]*/)*[^;/]*)", 1)).otherwise(path))
    return F.struct(
        scheme.alias("scheme"), part(2).alias("host"), F.substring(path, F.lit(1), cut).alias("path"),
        F.substring(path, cut + 2, F.length(path)).alias("params"), part(4).alias("query"), part(5).alias("fragment"),
    )


def _joined_path(base: Column, path: Column) -> Column:
    """A path against the base's: below its folder unless it begins with a slash, without empty parts there, and without . and .."""
    below = F.split(base, "/", -1)
    below = F.when(F.element_at(below, -1) == "", below).otherwise(F.slice(below, F.lit(1), F.size(below) - 1))
    lean = lambda s: F.when(F.size(s) < 3, s).otherwise(F.concat(F.slice(s, 1, 1), F.filter(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x != ""), F.slice(s, -1, 1)))
    segments = F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(let(F.concat(below, F.split(path, "/", -1)), lean))
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    walked = lambda s: F.concat(F.aggregate(s, F.array().cast("array<string>"), step), F.when(F.element_at(s, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    return let(let(segments, walked), lambda s: F.coalesce(F.nullif(F.array_join(s, "/"), F.lit("")), F.lit("/")))


def resolved(base: str | Column, href: str | Column) -> Column:
    """CRL-2: a link against the page or site that it stands on; null where it cannot be resolved. Column expressions only.

    A null base or link is an empty one; an empty link is the base, and without a base a link stays as it is. So does one of another
    scheme. A host that is none (half a bracket, letters that stand for a separator) gives null.
    """
    base, href = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (base, href))

    def put_together(scheme: Column, host: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
        after = F.concat(path, F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""))
        hosted = ~scheme.isin(*HOSTLESS, "")
        slashes = F.when(host != "", F.concat(F.lit("//"), host, F.when((after != "") & ~after.startswith("/"), "/").otherwise(""), after)).when(after.startswith("//"), F.concat(F.lit("//"), after))
        slashes = slashes.when(hosted & ((after == "") | after.startswith("/")), F.concat(F.lit("//"), after)).otherwise(after)
        more = lambda sign, x: F.when(x != "", F.concat(F.lit(sign), x)).otherwise("")
        return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), slashes, more("?", query), more("#", fragment))

    def join(b: Column, u: Column) -> Column:
        own_host = ~u["scheme"].isin(*HOSTLESS) & (u["host"] != "")
        host = F.when(u["scheme"].isin(*HOSTLESS), u["host"]).otherwise(b["host"])
        same_path = (u["path"] == "") & (u["params"] == "")
        return (
            F.when(b["host"].rlike(_bad_host()) | u["host"].rlike(_bad_host()), F.lit(None))
            .when((u["scheme"] != b["scheme"]) | ~u["scheme"].isin(*RELATIVE), href)
            .when(own_host, put_together(u["scheme"], u["host"], u["path"], u["params"], u["query"], u["fragment"]))
            .when(same_path, put_together(u["scheme"], host, b["path"], b["params"], F.when(u["query"] == "", b["query"]).otherwise(u["query"]), u["fragment"]))
            .otherwise(put_together(u["scheme"], host, _joined_path(b["path"], u["path"]), u["params"], u["query"], u["fragment"]))
        )

    found = let(_parsed(base, F.lit("")), lambda b: let(_parsed(href, b["scheme"]), lambda u: join(b, u)))
    return F.when(base == "", href).when(href == "", base).otherwise(found)


def is_pdf_link(href: Column, text: Column | None = None, variant: str = "contains") -> Column:
    """CRL-3: contains; ends (case counts); wiki; keywords (the end, or words in the link's text)."""
    if variant == "contains":
        return F.lower(href).contains(".pdf")
    if variant == "ends":
        return href.endswith(".pdf")
    if variant == "wiki":
        return href.endswith(".pdf") | (href.contains("File:") & href.contains(".pdf")) | (href.contains(WIKI_FILES) & href.contains(".pdf"))
    if variant == "keywords":
        low = F.lower(F.coalesce(text, F.lit("")))
        return href.endswith(".pdf") | has_any(low, ["datasheet", "data sheet", "specification"])
    raise ValueError(f"unknown variant {variant}")


def capped(links: DataFrame, site: str, n: int = MAX_LINKS_PER_SITE) -> DataFrame:
    """CRL-4: the first n links of a site in page order."""
    return top_n_per(links, [site], ["pos"], n)


def manufacturers(links: DataFrame, prefix: str | None = None) -> DataFrame:
    """CRL-5: links of one path segment but /manufacturers; the caller sorts by lower(name)."""
    name = F.regexp_replace("href", r"^/+|/+$", "")
    own = links.where(F.col("href").startswith("/") & (F.size(F.split("href", "/", -1)) == 2) & (F.col("href") != "/manufacturers")).withColumn("name", name)
    return own.where(F.upper("name").startswith(prefix)) if prefix else own


def manufacturers_by_letter(links: DataFrame) -> DataFrame:
    """CRL-6: /manufacturers/<slug> on the page of a letter (column letter), first of each slug."""
    slug = F.element_at(F.split(F.trim("href"), "/", -1), -1)
    own = links.withColumn("slug", slug).where(F.trim("href").startswith("/manufacturers/") & (F.size(F.split(F.trim("href"), "/", -1)) == 3) & (F.length("slug") > 1) & (F.col("slug") != F.col("letter")))
    return keep_first(own, ["letter", "slug"], ["pos"]).withColumn("name", F.replace("slug", F.lit("-"), F.lit(" ")))


def component_links(links: DataFrame, by: list[str]) -> DataFrame:
    """CRL-7: distinct links of two slashes or more for each manufacturer."""
    return links.where((F.size(F.split("href", "/", -1)) >= 3) & ~F.col("href").endswith("/manufacturers")).select(*by, "href").distinct()


def categories(links: DataFrame, by: list[str]) -> DataFrame:
    """CRL-8: product category links, or where a manufacturer has none, links with product words; first of each URL.

    One pass: every link knows whether its manufacturer has a link of the first kind.
    """
    href, text = F.trim("href"), F.coalesce("text", F.lit(""))
    first = href.contains("/products/") & (F.length(text) > 3) & ~href.endswith(".pdf")
    second = has_any(F.lower(text), PRODUCT_WORDS) | has_any(F.lower(href), PRODUCT_WORDS)
    own = links.withColumns({"_first": first, "_second": second}).where("_first or _second")
    some = own.where("_first").select(*by).distinct().withColumn("_some", F.lit(True))
    own = own.join(some, by, "left").where(F.col("_first") | F.col("_some").isNull())
    return keep_first(own, [*by, "href"], ["pos"]).select(*by, "pos", F.col("text").alias("name"), "href")


def has_next(links: DataFrame, by: list[str]) -> DataFrame:
    """CRL-10: (by, has_next): whether a page has an anchor that says Next or >."""
    return links.groupBy(*by).agg(F.bool_or(F.coalesce("text", F.lit("")).rlike("Next|>") & (F.coalesce("href", F.lit("")) != "")).alias("has_next"))


def products(links: DataFrame, by: list[str], page: str = "page", most: int = MAX_PAGES) -> DataFrame:
    """CRL-9: product links of paginated listings up to the first page without products or without a next one."""
    href, text = F.trim("href"), F.coalesce("text", F.lit(""))
    like_part = text.rlike(PART_NUMBER)
    ok = (F.length(text) > 3) & ~href.endswith(".pdf") & (like_part | href.contains("/product/") | F.lower(href).contains("part"))
    pages = links.groupBy(*by, page).agg(F.count_if(ok).alias("n"), F.bool_or(text.rlike("Next|>") & (F.coalesce("href", F.lit("")) != "")).alias("next"))
    w = Window.partitionBy(*by).orderBy(page)
    # a page is reached if all pages before it stand one after another, have products and a next one
    fine = pages.withColumn("_i", F.row_number().over(w)).withColumn("_ok", (F.col("n") > 0) & F.col("next") & (F.col(page) == F.col("_i")))
    before = F.coalesce(F.bool_and("_ok").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    reached = fine.withColumn("_before", before).where(F.col("_before") & (F.col(page) <= most) & (F.col(page) == F.col("_i")))
    part = F.when(like_part, text).otherwise(F.element_at(F.split(href, "/", -1), -1))
    own = links.where(ok).join(reached.select(*by, page), [*by, page], "left_semi").withColumn("part_number", part)
    return keep_first(own, [*by, "href"], [page, "pos"]).select(*by, page, "pos", "part_number", "href")


def datasheet_links(links: DataFrame, sections: DataFrame, by: list[str]) -> DataFrame:
    """CRL-11: datasheet links of product pages, then PDF links of marked sections not seen before; with file names.

    links: (by, part_number, pos, href, text); sections: (by, part_number, pos, href).
    """
    first = links.where(is_pdf_link(F.trim("href"), F.col("text"), "keywords")).select(*by, "part_number", "pos", F.trim("href").alias("href"), F.lit(0).alias("pass"))
    second = sections.where(F.trim("href").endswith(".pdf")).select(*by, "part_number", "pos", F.trim("href").alias("href"), F.lit(1).alias("pass"))
    second = keep_first(second.join(first.select(*by, "href"), [*by, "href"], "left_anti"), [*by, "href"], ["pos"])
    name = basename(url_path(F.col("href")))
    return first.unionByName(second).withColumn("filename", F.when(name.endswith(".pdf"), name).otherwise(F.concat(F.coalesce("part_number", F.lit("datasheet")), F.lit("_datasheet.pdf"))))


def button_links(links: DataFrame, by: list[str]) -> DataFrame:
    """CRL-12: the first link inside the datasheet button of each page."""
    return keep_first(links.where("button"), by, ["pos"]).select(*by, "href")


def discovered(seeds: DataFrame, pages: DataFrame, max_hops: int = 1) -> DataFrame:
    """CRL-13: (name) of seeds and of wiki pages with Datasheets in their links, by hops from the seeds.

    pages: (name, href). Each hop is one join; the number of hops is fixed.
    """
    link = pages.where((F.col("href").contains("Datasheets") | F.lower("href").contains("datasheet")) & F.col("href").startswith("/wiki/")).select("name", F.replace("href", F.lit("/wiki/"), F.lit("")).alias("to")).distinct()
    out = seeds.select("name").distinct()
    for _ in range(max_hops):
        out = out.union(out.join(link, "name").select("to")).distinct()
    return out


def wiki_pdfs(links: DataFrame, file_links: DataFrame) -> DataFrame:
    """CRL-14: (category, url): PDF links of wiki pages, then the first PDF of each linked File: page; first of each URL.

    links: (category, pos, href); file_links: (file_href, pos, href) of the File: pages.
    """
    direct = links.where(is_pdf_link(F.col("href"), variant="wiki")).select("category", F.lit(0).alias("hop"), "pos", F.col("href").alias("url"))
    target = keep_first(file_links.where(F.col("href").endswith(".pdf") | F.col("href").contains(WIKI_FILES)), ["file_href"], ["pos"]).select("file_href", F.col("href").alias("url"))
    hop = links.where(F.col("href").contains("/wiki/File:") & F.col("href").contains(".pdf")).join(target, links["href"] == target["file_href"]).select("category", F.lit(1).alias("hop"), "pos", "url")
    return keep_first(direct.unionByName(hop), ["category", "url"], ["hop", "pos"])


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """CRL-15."""
    return keep_first(rows, keys, order)


def not_downloaded(urls: DataFrame, log: DataFrame) -> DataFrame:
    """CRL-16: urls without a success in the log."""
    return urls.join(log.where("status = 'success'").select("url").distinct(), "url", "left_anti")


def batched(rows: DataFrame, by: list[str], order: list, size: int) -> DataFrame:
    """CRL-17: rows with their batch number from 0 and the number of batches of their group."""
    w = Window.partitionBy(*by)
    return rows.withColumns({"batch": F.floor((F.row_number().over(w.orderBy(*order)) - 1) / size), "n_batches": F.ceil(F.count("*").over(w) / size)})


def resumed(items: DataFrame, progress: DataFrame, by: list[str], order: list) -> DataFrame:
    """CRL-18: items from the resume point on: after the last completed, else at the current one, else all.

    progress: (by, last_completed, current); items: (by, name, ...). A name that is not found means the start.
    """
    w = Window.partitionBy(*by)
    own = items.withColumn("_i", F.row_number().over(w.orderBy(*order))).join(progress, by, "left")
    after = F.max(F.when(F.col("name") == F.col("last_completed"), F.col("_i") + 1)).over(w)
    at = F.max(F.when(F.col("last_completed").isNull() & (F.col("name") == F.col("current")), F.col("_i"))).over(w)
    return own.withColumn("_from", F.coalesce(after, at, F.lit(1))).where(F.col("_i") >= F.col("_from")).drop("_i", "_from", "last_completed", "current")


def not_completed(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """CRL-19: rows whose composite key is not completed."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def outcome_totals(log: DataFrame, by: list[str]) -> DataFrame:
    """CRL-20: success, error and skipped of each group, and running totals in the order of the groups' last column.

    Rows of the log meet only in counts. With a single column the groups themselves may be many, so they are dealt by ranges of it: each range
    has its own running totals, to which those of the ranges before it are added.
    """
    names = ("success", "error", "skipped")
    own = log.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])
    so_far = lambda w: {f"{c}_so_far": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in names}
    if len(by) > 1:
        return own.withColumns(so_far(Window.partitionBy(*by[:-1]).orderBy(by[-1])))
    ranged = stored(own.repartitionByRange(by[0]).withColumn("_range", F.spark_partition_id()), "totals")
    sums = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in names])  # a row a range
    before = sums.select("_range", *[F.coalesce(F.sum(c).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}") for c in names])
    within = ranged.withColumns(so_far(Window.partitionBy("_range").orderBy(by[0]))).join(F.broadcast(before), "_range")
    return within.select(*by, *names, *[(F.col(f"{c}_so_far") + F.col(f"_{c}")).alias(f"{c}_so_far") for c in names])


def sanitized(name: Column, most: int = 200) -> Column:
    """CRL-21: forbidden characters and white space as _, no . or _ at the ends, at most 200 characters with the extension."""
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"(?U)\s+", "_"), r"^[._]+|[._]+$", "")
    ext = F.regexp_extract(n, r"[^.](\.[^.]*)$", 1)
    stem = F.substring(n, F.lit(1), F.length(n) - F.length(ext))
    return F.when(F.length(n) > most, F.concat(F.substring(stem, F.lit(1), F.lit(most) - F.length(ext)), ext)).otherwise(n)


def filename_from_url(url: Column, fallback: Column) -> Column:
    """CRL-22: the last path segment if it is a PDF, else the fallback's name."""
    n = basename(url_path(url))
    return F.when(F.lower(n).endswith(".pdf"), n).otherwise(F.concat(fallback, F.lit(".pdf")))


def filename_from_headers(url: Column, disposition: Column) -> Column:
    """CRL-23: from the Content-Disposition header, else the URL's path, else file_<8 digits of the URL's hash>."""
    take = lambda p, g: F.nullif(F.regexp_extract(F.coalesce(disposition, F.lit("")), "(?i)" + p, g), F.lit(""))
    star = F.try_url_decode(F.replace(take(r"filename\*\s*=\s*([^']*)'[^']*'([^;]+)", 2), F.lit("+"), F.lit("%2B")))
    plain = F.coalesce(star, take(r'filename\s*=\s*"([^"]+)"', 1), take(r"filename\s*=\s*([^;]+)", 1))
    plain = F.regexp_replace(F.trim(plain), r'^"+|"+$', "")
    path = basename(F.coalesce(F.try_url_decode(F.replace(url_path(url), F.lit("+"), F.lit("%2B"))), url_path(url)))
    name = F.regexp_replace(F.trim(F.coalesce(plain, path)), r"^\.+|\.+$", "")
    name = F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("file_"), F.substring(F.sha2(url, 256), 1, 8))).otherwise(name)
    name = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._\-]+", "_"), r"[ .]+$", "")
    return F.when(name == "", "download").otherwise(name)


def running(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """rows with running sums of values (in their place) within keys, its own row included.

    If no key has more than LARGEST rows, they are sums over the keys' rows; else a key's rows are dealt by ranges of the order.
    """
    rows = stored(rows, "rows")
    if (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= LARGEST:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({v: F.sum(v).over(w) for v in values})
    ranged = stored(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_range", *keys).agg(*[F.sum(v).alias(v) for v in values])  # a row a range and key
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", *keys, *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_before_{v}") for v in values])
    w = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({v: F.sum(v).over(w) for v in values}).join(before, ["_range", *keys])
    return own.withColumns({v: F.col(v) + F.col(f"_before_{v}") for v in values}).drop("_range", *[f"_before_{v}" for v in values])


def _slots_won(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each name that was asked for with its number k, sorted by stem and k, whether it is free for its first row, and the count of the stem's spare rows at which it is passed over.

    A stem's spare rows come to number k with their (k - passed)th; only those two numbers are held.
    """
    last, passed = None, 0
    for rows in batches:
        won, at = [], []
        for folder, stem, ext, k, spare in zip(rows["_dir"], rows["_stem"], rows["_ext"], rows["_k"], rows["_spare"]):
            if (folder, stem, ext) != last:
                last, passed = (folder, stem, ext), 0
            at.append(k - passed)
            won.append(spare < k - passed)
            passed += won[-1]
        yield rows.drop(columns="_spare").assign(_won=won, _at=at)


def unique_names(files: DataFrame, by: list[str], order: list[str], name: str = "filename") -> DataFrame:
    """CRL-24: files with ``unique_name``: in order, a name that is taken gets -1, -2, ... until it is free.

    The first row of a name has it, unless a row of the name without its last -number took it before; the others are spare rows of the name,
    and go to its numbers in order, passing over those that rows which asked for them had before. Who has a number is found from the shortest chains of
    numbers to the longest, one join each: names meet only those one number shorter. Ranks are running counts by ranges, so equal names
    are no group; a null name stays null, null folders are one folder.
    """
    keys = ["_dir", "_stem", "_ext"]
    n_order = [f"_o{i}" for i in range(len(order))]
    stem = F.regexp_replace(F.col(name), r"(?<=.)\.[^.]*$", "")
    own = files.where(F.col(name).isNotNull()).select(F.struct(*files.columns).alias("_row"), F.to_json(F.struct(*by)).alias("_dir") if by else F.lit("").alias("_dir"), stem.alias("_stem"), F.col(name).alias("_name"), *[F.col(c).alias(o) for c, o in zip(order, n_order)])
    numbered = r"(?s)^(.+)-([1-9][0-9]{0,17})$"  # what appending a number gives
    own = own.withColumns({
        "_ext": F.substring("_name", F.length("_stem") + 1, F.length("_name")),
        "_k": F.nullif(F.regexp_extract("_stem", numbered, 2), F.lit("")).cast("long"),
        "_depth": F.length(F.regexp_replace(F.regexp_extract("_stem", r"(?s)(?<=.)(?:-[1-9][0-9]{0,17})+$", 0), "[0-9]", "")),
    })
    rows = own.select(*keys, *n_order, F.lit(1).alias("_n"), "_row", F.lit(None).cast("long").alias("_k"), F.lit(None).cast("int").alias("_depth"))
    asked = own.where("_k is not null").select("_dir", F.regexp_extract("_stem", numbered, 1).alias("_stem"), "_ext", *n_order, F.lit(0).alias("_n"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), "_k", (F.col("_depth") - 1).alias("_depth"))
    ranked = stored(running(rows.unionByName(asked), keys, n_order, ["_n"]), "ranked")
    asked = stored(ranked.where("_k is not null").groupBy(*keys, "_k", "_depth").agg(F.min("_n").alias("_n")), "asked")  # rows of the stem before the first that asks
    depths = asked.agg(F.max("_depth")).first()[0]
    marks = None  # places at which a stem's spare rows pass over a number, and names whose first row came too late
    late = None
    for depth in range(0 if depths is None else depths + 1):
        level = asked.where(F.col("_depth") == depth)
        level = level.withColumn("_late", F.lit(False)) if late is None else level.join(late.withColumn("_late", F.lit(True)), keys, "left").fillna(False, "_late")
        first = F.when(F.col("_late"), 0).otherwise(1)
        level = level.select(*keys, "_k", F.greatest(F.col("_n") - first, F.lit(0)).alias("_spare"), first.alias("_first")).repartition(*keys).sortWithinPartitions(*keys, "_k")
        schema = StructType([*level.drop("_spare").schema.fields, StructField("_won", BooleanType()), StructField("_at", LongType())])
        level = stored(level.mapInPandas(_slots_won, schema), "numbers")
        late = level.where("not _won").select("_dir", F.concat("_stem", F.lit("-"), F.col("_k").cast("string")).alias("_stem"), "_ext")
        none = F.lit(None).cast(own.schema["_row"].dataType).alias("_row")
        own_marks = level.where("_won").select(*keys, (F.col("_at") + F.col("_first")).alias("_place"), F.lit(1).alias("_passed"), F.lit(0).alias("_late"), none)
        own_marks = own_marks.unionByName(late.select(*keys, F.lit(-1).cast("long").alias("_place"), F.lit(0).alias("_passed"), F.lit(1).alias("_late"), none))
        marks = own_marks if marks is None else marks.unionByName(own_marks)
    placed = ranked.where("_row is not null").select(*keys, F.col("_n").cast("long").alias("_place"), F.lit(0).alias("_passed"), F.lit(0).alias("_late"), "_row")
    if marks is not None:
        placed = placed.unionByName(marks).withColumn("_kind", F.col("_row").isNotNull())
        placed = running(placed, keys, ["_place", "_kind"], ["_passed", "_late"]).where("_row is not null")
    spare = F.col("_place") - 1 + F.col("_late")
    full = F.when(spare == 0, F.concat("_stem", "_ext")).otherwise(F.concat("_stem", F.lit("-"), (spare + F.col("_passed")).cast("string"), "_ext"))
    named = placed.select("_row.*", full.alias("unique_name"))
    return named.unionByName(files.where(F.col(name).isNull()).withColumn("unique_name", F.lit(None).cast("string")))


def content_type(value: Column) -> Column:
    """CRL-25: without parameters, in lower case; null for empty."""
    return F.nullif(F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1)))), F.lit(""))


def fetch_outcome(log: DataFrame, most: int = MAX_FILE_BYTES) -> DataFrame:
    """CRL-26: log rows with ok and error; blank URLs go.

    log: (url, http_status, content_length, bytes).
    """
    url = F.trim("url")
    own = log.where(F.coalesce(url, F.lit("")) != "")
    error = (
        F.when(~F.lower(url).rlike("^https?:"), "Unsupported URL scheme")
        .when(F.col("content_length") > most, F.concat(F.lit("File too large ("), F.col("content_length").cast("string"), F.lit(f" bytes > {most})")))
        .when(F.col("http_status") >= 400, F.concat(F.lit("HTTP error "), F.col("http_status").cast("string")))
        .when(F.col("bytes") > most, f"File exceeded max size while downloading (> {most} bytes)")
    )
    return own.withColumn("url", url).withColumn("error", error).withColumn("ok", F.col("error").isNull())


def invalid_payload(body: Column, content_type_: Column | None = None) -> Column:
    """CRL-27: under 1000 bytes, or HTML at the start; the wiki's rule (with a type) needs no pdf type, few bytes and HTML."""
    small = F.length(body) < 1000
    page = F.lower(F.decode(F.substring(body, 1, 100), "ISO-8859-1")).contains("<html")
    return small | page if content_type_ is None else ~F.lower(F.coalesce(content_type_, F.lit(""))).contains("pdf") & small & page
