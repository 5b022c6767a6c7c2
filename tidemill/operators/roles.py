"""Openings as roles: titles and companies in comparable form, search links, and removal of repeated openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.steps import once
from . import dedupe

#: Grades and functions that are written in several ways (fixed values).
SYNONYMS = {
    "avp": "assistantvicepresident",
    "assistant vice president": "assistantvicepresident",
    "associate vice president": "assistantvicepresident",
    "dvp": "deputyvicepresident",
    "deputy vice president": "deputyvicepresident",
    "svp": "seniorvicepresident",
    "senior vice president": "seniorvicepresident",
    "evp": "executivevicepresident",
    "executive vice president": "executivevicepresident",
    "vp": "vicepresident",
    "vice president": "vicepresident",
    "banca": "bancassurance",
    "kam": "keyaccountmanagement",
    "key account management": "keyaccountmanagement",
    "key accounts": "keyaccountmanagement",
    "key account": "keyaccountmanagement",
}
#: Words of a title that do not tell jobs apart (fixed values).
STOPWORDS = "a an the and or of to in for at by with from as is are on role position opening opportunity job vacancy hiring urgent immediate required wanted new exciting leading reputed".split()
#: Words that make two jobs of one title (fixed values).
DISCRIMINATORS = "north south east west central northern southern eastern western mumbai delhi ncr gurgaon gurugram bangalore bengaluru hyderabad chennai pune kolkata dubai abudhabi riyadh doha singapore hongkong".split()
#: Corporate words that a company's name may lack (fixed values).
CORPORATE = "ltd limited pvt private plc inc llc co company group holdings india insurance".split()
#: Least similarity of two titles of one company (a fixed value).
SIMILAR = 0.85
#: Phrases in one search.
PHRASES = 3


def _words(c: Column) -> Column:
    return X.squeeze(F.regexp_replace(c, r"(?U)[^\w\s]+", " "))


def normal_title(c: Column) -> Column:
    """Lower case without marks, synonyms as one word, of those that begin alike the longest."""
    phrases = "|".join(sorted(SYNONYMS, key=len, reverse=True))
    # one scan puts marks round the phrases; what stands between two marks is then looked up
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"(?U)\b({phrases})\b", "\u0001$1\u0001"), "\u0001")
    word = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    told = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(word, x), x)).otherwise(x))
    return _words(F.array_join(told, ""))


def normal_company(c: Column) -> Column:
    """Lower case without marks and corporate words, unless nothing else is left."""
    t = _words(F.lower(F.coalesce(c, F.lit(""))))
    short = F.array_join(F.filter(F.split(t, " "), lambda w: ~w.isin(CORPORATE)), " ")
    return F.coalesce(F.nullif(short, F.lit("")), t)


def words_of(normal: Column) -> Column:
    """Distinct words of a normal title, of over two letters and no stopwords, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normal, " "), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))))


def title_words(c: Column) -> Column:
    """words_of() a title as it is written."""
    return words_of(normal_title(c))


def marks(words: Column) -> Column:
    """The region and city words among a title's words."""
    return F.filter(words, lambda w: w.isin(DISCRIMINATORS))


def url_key(url: Column) -> Column:
    """Where an opening was found."""
    return X.key("u:", F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^([^:]*)://www\.", "$1://"))


def role_key(normal_company: Column, normal_title: Column) -> Column:
    """Which job it is."""
    return X.key("r:", F.concat(normal_company, F.lit("|"), normal_title))


def normal(openings: DataFrame) -> DataFrame:
    """openings with _title and _company in comparable form and the title's _words, each computed once."""
    d = once(openings, {"_title": normal_title(F.col("title")), "_company": normal_company(F.col("company"))})
    return once(d, {"_words": words_of(F.col("_title"))})


def keys(openings: DataFrame) -> DataFrame:
    """Openings with url_key and role_key."""
    return normal(openings).withColumns({"url_key": url_key(F.col("url")), "role_key": role_key(F.col("_company"), F.col("_title"))}).drop("_title", "_company", "_words")


def one_of_each(openings: DataFrame, key: str = "key", similar: float = SIMILAR) -> DataFrame:
    """Key, slot, duplicates: what is left when, in order of place, each opening joins a kept one that is the same job.

    The same job: an equal URL, an equal company and title, or titles of one company (which must be known) that are
    similar and name the same regions. openings: key, place, url, company, title, in falling order of rank, so that
    the first of a slot is its best.
    """
    d = normal(openings.select(F.col(key).alias("id"), "place", "url", "company", "title"))
    k = d.select("id", "place", url_key(F.col("url")).alias("key_a"), role_key(F.col("_company"), F.col("_title")).alias("key_b"), F.col("_words").alias("s"), marks(F.col("_words")).alias("p"), F.nullif("_company", F.lit("")).alias("g"))
    return dedupe.greedy(k, similar, same_marks=True).withColumnRenamed("id", key)


def searches(boards: DataFrame, phrases: list[str]) -> DataFrame:
    """Label and url of a past-week search for each board of each region; no phrases, no searches.

    boards: region_title, site.
    """
    said = [p for p in phrases if p][:PHRASES]
    if not said:
        return boards.select(F.lit("").alias("label"), F.lit("").alias("url")).limit(0)
    query = F.concat(F.lit("site:"), "site", F.lit(" (" + " OR ".join(f'"{p}"' for p in said) + ")"))
    return boards.select(F.concat("site", F.lit(" · "), "region_title", F.lit(" (past week)")).alias("label"), F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(query), F.lit("&tbs=qdr:w")).alias("url"))


def first_of_url(links: DataFrame, order: str = "place") -> DataFrame:
    """Of links with one URL the first."""
    return links.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy(order))).where("_r = 1").drop("_r")


def queries_of(sources: DataFrame, phrases: list[str]) -> DataFrame:
    """A row for each source and phrase that it is to be asked: its own query, or all phrases, or one empty one."""
    every = F.array(*map(F.lit, phrases or [""]))
    own = F.nullif(F.col("query"), F.lit(""))
    return sources.withColumn("phrase", F.explode(F.when(own.isNotNull(), F.array(own)).otherwise(every)))


def goes_out(published: Column, when_empty: Column, weekday: Column, day: Column) -> Column:
    """Why a brief is sent, or null: it has items, empty ones are wanted, or this is the day on which an empty one proves that all runs."""
    today = F.lower(F.date_format(day, "EEEE"))
    return F.when(published > 0, "items").when(when_empty, "send_when_empty is on").when(today == F.lower(weekday), F.concat(F.lit("empty, but "), F.lower(weekday), F.lit(" is the proof-of-life day")))
