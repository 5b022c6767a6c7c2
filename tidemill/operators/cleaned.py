"""Whole items from what sources say: postings as openings, feed entries as articles; what has no title or link is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.steps import once


def openings(postings: DataFrame, now: Column, summary_limit: int = 400, company: str = "") -> DataFrame:
    """Openings: postings with their columns cleaned, experience_min and experience_max.

    postings: title, url, summary, location, posted, company, experience (texts) and any others. Years asked for are
    read from the field, the title and the summary, in this order; a posting without a company gets the source's; an age
    is told back from now.
    """
    plain = lambda c: F.coalesce(X.strip_html(F.col(c), postings=True), F.lit(""))
    d = once(postings.withColumnsRenamed({c: f"_raw_{c}" for c in ("title", "url", "summary", "location", "posted", "company", "experience")}), {f"_{c}": plain(f"_raw_{c}") for c in ("title", "summary", "company", "experience")} | {"url": X.canonical_url(F.coalesce("_raw_url", F.lit("")), True, X.OPENING_TRACKING)})
    d = d.where("_title != '' and url != ''")
    asked = F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("_experience", "_title", "_summary")))
    d = once(d, {"_asked": X.experience(asked), "posted": X.posted_date(F.col("_raw_posted"), now), "location": F.coalesce(X.location(F.col("_raw_location")), F.lit(""))})
    d = d.withColumns(
        {
            "title": X.truncate(F.col("_title"), 160),
            "summary": X.truncate(F.col("_summary"), summary_limit),
            "company": X.truncate(F.coalesce(F.nullif("_company", F.lit("")), F.lit(company)), 80),
            "experience": X.truncate(F.col("_experience"), 60),
            "experience_min": F.col("_asked.min"),
            "experience_max": F.col("_asked.max"),
        }
    )
    return d.drop("_asked", *(c for c in d.columns if c.startswith("_raw_")), "_title", "_summary", "_company", "_experience")


def entries(items: DataFrame, aliases: dict[str, str] | None = None, summary_limit: int = 320) -> DataFrame:
    """Articles: feed entries with title, publisher, summary and published cleaned, and url from their link.

    items: title, link, summary, publisher, published (texts) and any others. A summary that only echoes the title and
    publisher is dropped, before it is cut.
    """
    d = items.withColumnsRenamed({c: f"_raw_{c}" for c in ("title", "link", "summary", "publisher", "published")})
    d = once(d, {"publisher": F.coalesce(X.clean_publisher(F.col("_raw_publisher"), aliases), F.lit("")), "url": X.canonical_url(F.coalesce("_raw_link", F.lit("")))})
    d = once(d, {"_title": F.coalesce(X.clean_title(F.col("_raw_title"), F.col("publisher")), F.lit("")), "_summary": F.coalesce(X.strip_html(F.col("_raw_summary")), F.lit(""))}).where("_title != '' and url != ''")
    d = once(d, {"_echo": X.echoes_title(F.col("_summary"), F.col("_title"), F.col("publisher")), "published": X.parse_date(F.col("_raw_published"))})
    d = d.withColumns({"title": X.truncate(F.col("_title"), 200), "summary": F.when(F.col("_echo"), "").otherwise(X.truncate(F.col("_summary"), summary_limit))})
    return d.drop("_echo", "_title", "_summary", *(c for c in d.columns if c.startswith("_raw_")))
