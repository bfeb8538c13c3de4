"""Column functions over tickers, hosts and column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticker_of(ric: Column) -> Column:
    """``AAPL.O`` -> ``AAPL``; a code without a dot stays whole, null stays null."""
    return F.substring_index(ric, ".", 1)


def domain_label(domain: Column, part: int = -2) -> Column:
    """The dot-separated part at ``part`` (the second-last by default), null where there is none."""
    return F.try_element_at(F.split(domain, r"\."), F.lit(part))


def host_of(url: Column) -> Column:
    """Host of a URL without its port; null for text that is no URL."""
    return F.try_parse_url(url, F.lit("HOST"))


def name_part(category: str) -> str:
    """A category as used inside a column name."""
    return category.replace(" ", "_")


def csv_line(*columns: Column) -> Column:
    """The columns joined by commas, a null shown as ``None``."""
    return F.concat_ws(",", *(F.coalesce(c.cast("string"), F.lit("None")) for c in columns))
