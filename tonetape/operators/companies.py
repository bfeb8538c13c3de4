"""From one row per share event to one clean row per (event, company)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonetape.functions.text import ticker_of



def explode_companies(events: DataFrame, column: str = "companies", alias: str = "company") -> DataFrame:
    """One row per array item, the array dropped. Events with a null or empty array give no row."""
    others = [c for c in events.columns if c != column]
    return events.select(*others, F.explode(column).alias(alias))


def select_company(exploded: DataFrame, column: str = "company") -> DataFrame:
    """Typed company fields; rows without a ticker or a readable score go.

    An empty RIC is a ticker of empty text and stays.
    """
    company = F.col(column)
    others = [c for c in exploded.columns if c != column]
    return exploded.select(
        *others,
        company["count"].try_cast("int").alias("company_count"),
        company["sentiment_score"].try_cast("double").alias("company_sentiment_score"),
        ticker_of(company["ric"]).alias("Ticker"),
    ).filter(F.col("Ticker").isNotNull() & F.col("company_sentiment_score").isNotNull())


def select_company_text(exploded: DataFrame, column: str = "company") -> DataFrame:
    """Company fields as the text they came as; rows without a RIC or a score go."""
    company = F.col(column)
    others = [c for c in exploded.columns if c != column]
    return exploded.select(
        *others,
        company["count"].alias("company_count"),
        company["sentiment_score"].alias("company_sentiment_score"),
        company["ric"].alias("company_ric"),
    ).filter(F.col("company_ric").isNotNull() & F.col("company_sentiment_score").isNotNull())


def slim_companies(events: DataFrame, column: str = "companies", keep: tuple[str, ...] = ()) -> DataFrame:
    """Only stamp, score and RIC, all as text, both company fields present."""
    exploded = explode_companies(events.select(*keep, "standardTimestamp", column), column)
    return select_company_text(exploded).drop("company_count")


def flatten_companies(events: DataFrame, column: str = "companies") -> DataFrame:
    """Each company field as its own ``companies_<field>`` column next to the event's columns."""
    others = [c for c in events.columns if c != column]
    fields = [f.name for f in events.schema[column].dataType.elementType]
    return events.select(*others, F.inline(column).alias(*(f"{column}_{f}" for f in fields)))


def with_companies(events: DataFrame, column: str = "companies") -> DataFrame:
    """Events that name at least one company."""
    return events.filter(F.size(column) > 0)


def useful_fraction(events: DataFrame, column: str = "companies") -> DataFrame:
    """How many events there are, how many name a company, and the share of those."""
    useful = F.coalesce(F.size(column) > 0, F.lit(False))
    return events.agg(
        F.count("*").alias("events"),
        F.count_if(useful).alias("useful_events"),
        F.avg(useful.cast("double")).alias("useful_fraction"),
    )


def keep_listed(rows: DataFrame, listed: DataFrame, key: str = "Ticker") -> DataFrame:
    """Rows whose key is in the list.

    Spark broadcasts a list below its own size limit; a longer one is joined by shuffle, where adaptive
    execution splits the rows of a hot key.
    """
    return rows.join(listed.select(key).distinct(), key, "left_semi")
