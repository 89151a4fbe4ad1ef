"""Small idioms over rows and columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Java's classes are ASCII and its $ and . know more line ends; these flags make patterns behave as Python's do.
PY = "(?dU)"
PYI = "(?diuU)"


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order that the caller makes total; the others go."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_n_per(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; their rank stays as a column if it has a name."""
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def ordered(columns: Column, value: str) -> Column:
    """Aggregate: the field ``value`` of structs, as an array in the structs' order. array_sort would interpret a comparison for each pair."""
    return F.transform(F.sort_array(F.collect_list(columns)), lambda x: x[value])


def natural_key(text: str | Column) -> Column:
    """A sort key that takes runs of digits, however long, as numbers (R2 before R10)."""
    text = F.col(text) if isinstance(text, str) else text
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda x: F.ltrim(x, F.lit("0"))
    number = lambda x: F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), number(x)).otherwise(x)), "")


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words as it stands."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_match(text: str | Column, pattern: str, group: int = 1, flags: str = PYI) -> Column:
    """A group of the first match, null without a match."""
    text = F.col(text) if isinstance(text, str) else text
    # the first match takes the rest of the text along, so that no more are looked for
    found = F.regexp_extract_all(text, F.lit(f"{flags}(?:{pattern})(?s:.*)"), F.lit(group))
    return F.get(found, F.lit(0))


def all_matches(text: str | Column, pattern: str, group: int = 1, flags: str = PYI) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def matches(text: str | Column, pattern: str, flags: str = PYI) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(flags + pattern)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(sizes: Column, block: int = 256) -> Column:
    """Sums of an int array before each entry, and the sum of all at the end: as blocks, so that long arrays are not copied entry by entry."""
    add = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
    sums = lambda start, own: F.aggregate(own, F.array(start), add)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(block)), lambda i: F.slice(sizes, i + 1, F.lit(block)))
    total = lambda own: F.aggregate(own, F.lit(0), lambda a, x: a + x)
    inner = lambda own: let(sums(F.lit(0), F.transform(own, total)), lambda starts: F.flatten(F.transform(own, lambda x, i: F.slice(sums(F.get(starts, i), x), 1, F.size(x)))))
    return let(blocks, lambda own: F.concat(inner(own), F.array(total(F.flatten(own)))))


def match_spans(text: Column, pattern: str, flags: str = PYI) -> Column:
    """array<struct<start, end, match>> of all matches, as code points from 0; no match may be empty.

    The text between matches and the matches themselves, laid end to end, are the text: their lengths add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))
    between = F.split(text, flags + pattern, -1)
    span = lambda m, at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("match"))
    # a piece before each match, so the i-th match starts after i + 1 pieces and i matches
    sizes = lambda own, rest: F.transform(own, lambda m, i: F.length(F.get(rest, i)) + F.when(i > 0, F.length(F.get(own, i - 1))).otherwise(0))
    places = lambda own: let(between, lambda rest: F.slice(running_sums(sizes(own, rest)), 2, F.size(own)))
    some = lambda own: let(places(own), lambda at: F.transform(own, lambda m, i: span(m, F.get(at, i))))
    return let(found, lambda own: F.when(F.size(own) > 0, some(own)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>")))


def blocks_of(text: Column, size: int = 4096) -> Column:
    """A text in blocks of so many code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def cut(blocks: Column, start: Column, length: Column, size: int = 4096) -> Column:
    """A stretch of a text, from code point ``start`` (0 is the first), by the blocks it touches rather than from the text's beginning."""
    first = F.floor(start / size).cast("int")
    number = F.greatest(F.floor((start + length - 1) / size).cast("int") - first + 1, F.lit(0))
    return F.substring(F.array_join(F.slice(blocks, first + 1, number), ""), F.pmod(start, F.lit(size)) + 1, F.greatest(length, F.lit(0)))


def lines(text: str | Column) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, "\n", -1)


def valid_url(url: Column) -> Column:
    """Whether a URL has a scheme and a host part (LNK-3); never fails on odd text."""
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path of a URL without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def uuid_bytes(text: Column) -> Column:
    """16 bytes of a UUID text; null stays null (REG-8)."""
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def uuid_text(data: Column) -> Column:
    """UUID text of 16 bytes; null stays null (REG-8)."""
    h = F.lower(F.hex(data))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def unit_suffix(unit: Column) -> Column:
    """A..Z, AA..ZZ for units from 1; empty below 1 (PRJ-11)."""
    n = unit - 1
    letter = lambda i: F.char((i + 65).cast("long"))
    return F.when(unit < 1, "").when(n < 26, letter(n % 26)).otherwise(F.concat(letter(F.floor(n / 26) - 1), letter(n % 26)))
