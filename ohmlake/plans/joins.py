"""Joins whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key that one row in so many has is hot; so there are no more hot keys than this.
HOT_SHARE = 1000


def lookup(df: DataFrame, table: DataFrame, on: list[str], rows: str = "rows", share: int = HOT_SHARE) -> DataFrame:
    """df joined with the columns of table; rows of df without a match are not in the result.

    table has one row for each key, and in ``rows`` how many rows of df have the key. Keys with a
    thousandth of them or more (a thousand keys at most) are broadcast, so that their rows stay where
    they are; only the others are shuffled. Both are read more than once, so they should be stored.
    Rows with a null in a key have no match.
    """
    total = table.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * share >= total
    often, seldom = F.broadcast(table.where(hot).drop(rows)), table.where(~hot).drop(rows)
    shuffled = df.join(often.select(*on), on, "left_anti").join(seldom.hint("merge"), on)
    return df.join(often, on).unionByName(shuffled)
