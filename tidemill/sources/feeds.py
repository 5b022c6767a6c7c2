"""Feeds and job boards as rows; what cannot be read is a row with its error."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["title", "link", "summary", "published", "guid", "publisher"]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _text(item: ET.Element, *names: str) -> str | None:
    """The first of names that has text, in this order."""
    for name in names:
        for child in item:
            if _local(child.tag) == name and "".join(child.itertext()).strip():
                return "".join(child.itertext()).strip()
    return None


def _link(item: ET.Element) -> str | None:
    """An alternate link, any other link's address, a link's text, or an http guid."""
    links = [c for c in item if _local(c.tag) == "link"]
    for wanted in (lambda c: c.get("rel", "alternate") == "alternate", lambda c: True):
        for c in links:
            if c.get("href") and wanted(c):
                return c.get("href")
    guid = _text(item, "guid", "id")
    return _text(item, "link") or (guid if guid and guid.startswith("http") else None)


def repaired(xml: str) -> str:
    """Named entities by number, bare ampersands escaped, control characters dropped."""
    xml = re.sub(r"&(?!(?:amp|lt|gt|quot|apos);)([A-Za-z]\w*);", lambda m: f"&#{ord(c)};" if len(c := html.unescape(m.group())) == 1 else m.group(), xml)
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", re.sub(r"&(?!#?\w+;)", "&amp;", xml))


def parse(xml: str) -> list[dict]:
    """Items of RSS 2.0, RSS 1.0 or Atom, whatever the namespaces; repaired only if it cannot be read as it is."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        root = ET.fromstring(repaired(xml))
    return [
        {"title": _text(i, "title"), "link": _link(i), "summary": _text(i, "description", "summary", "encoded", "content"), "published": _text(i, "pubdate", "published", "updated", "date"), "guid": _text(i, "guid", "id"), "publisher": _text(i, "source")}
        for i in root.iter()
        if _local(i.tag) in ("item", "entry")
    ]


def read_feeds(documents: DataFrame, source: str = "source_id", body: str = "body") -> DataFrame:
    """Source, ordinal, the fields of each item, error; a feed that cannot be read, or is empty, is one row with an error."""
    schema = f"{source} string, ordinal int, {', '.join(f'{f} string' for f in FIELDS)}, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    items = parse(x or "")
                    rows += [(s, i, *(item[f] for f in FIELDS), None) for i, item in enumerate(items)] or [(s, 0, *[None] * len(FIELDS), "empty feed")]
                except ET.ParseError as e:
                    rows.append((s, 0, *[None] * len(FIELDS), f"unreadable: {e}"))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.string()) for i, c in enumerate(columns)], names=[source, "ordinal", *FIELDS, "error"])

    return documents.select(F.col(source).cast("string").alias(source), body).mapInArrow(run, schema)


#: Kinds of sources that are known, and those of them that need a key.
KINDS = ["rss", "workday", "greenhouse", "lever", "adzuna", "careerjet", "jooble"]
KEYED = ["adzuna", "careerjet", "jooble"]


def askable(sources: DataFrame, keys: set[str]) -> DataFrame:
    """Sources with state: ok, skipped where a kind needs a key that is not there, error for an unknown kind."""
    kind = F.col("kind")
    lacking = [k for k in KEYED if k not in keys]
    return sources.withColumn("state", F.when(~kind.isin(KINDS), "error").when(kind.isin(lacking) if lacking else F.lit(False), "skipped").otherwise("ok"))


def states(items: DataFrame, source: str = "source_id") -> DataFrame:
    """One row for each source read: ok or error, how many items it gave, and what was wrong."""
    got = items.groupBy(source).agg(F.count_if(F.col("error").isNull()).alias("items"), F.max("error").alias("error"))
    return got.select(source, F.when(F.col("error").isNotNull(), "error").otherwise("ok").alias("state"), "items", "error")


#: For each kind of board, the list in its answer and where the fields are.
BOARDS = {
    "workday": ("jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>", "jobPostings", {"title": "title", "link": "externalPath", "location": "locationsText", "posted": "postedOn"}),
    "greenhouse": ("jobs array<struct<title:string,absolute_url:string,location:struct<name:string>,updated_at:string,content:string>>", "jobs", {"title": "title", "link": "absolute_url", "location": "location.name", "posted": "updated_at", "summary": "content"}),
    "adzuna": ("results array<struct<title:string,redirect_url:string,location:struct<display_name:string>,created:string,description:string>>", "results", {"title": "title", "link": "redirect_url", "location": "location.display_name", "posted": "created", "summary": "description"}),
    "careerjet": ("jobs array<struct<title:string,url:string,locations:string,date:string,description:string>>", "jobs", {"title": "title", "link": "url", "location": "locations", "posted": "date", "summary": "description"}),
    "jooble": ("jobs array<struct<title:string,link:string,location:string,updated:string,snippet:string>>", "jobs", {"title": "title", "link": "link", "location": "location", "posted": "updated", "summary": "snippet"}),
}


def read_board(answers: DataFrame, kind: str, source: str = "source_id", body: str = "body") -> DataFrame:
    """Postings of stored board answers; of postings with one link the first stays; unreadable answers give no rows.

    kind lever, whose answer is a bare list with dates in milliseconds, is read likewise.
    """
    if kind == "lever":
        schema = "array<struct<text:string,hostedUrl:string,categories:struct<location:string>,createdAt:bigint,descriptionPlain:string>>"
        items = answers.select(source, F.posexplode(F.from_json(body, schema)))
        got = items.select(source, "pos", F.col("col.text").alias("title"), F.col("col.hostedUrl").alias("link"), F.col("col.categories.location").alias("location"), F.date_format(F.timestamp_millis("col.createdAt"), "yyyy-MM-dd").alias("posted"), F.col("col.descriptionPlain").alias("summary"))
    else:
        schema, items_at, fields = BOARDS[kind]
        items = answers.select(source, F.posexplode(F.from_json(body, schema)[items_at]))
        got = items.select(source, "pos", *((F.col(f"col.{fields[f]}") if f in fields else F.lit(None).cast("string")).alias(f) for f in ("title", "link", "location", "posted", "summary")), *(["col.bulletFields"] if kind == "workday" else []))
        if kind == "workday":  # some sites say when only among the bullets
            told = F.get(F.filter("bulletFields", lambda b: F.lower(b).startswith("posted")), F.lit(0))
            got = got.withColumn("posted", F.coalesce(F.nullif("posted", F.lit("")), told)).drop("bulletFields")
    first = got.groupBy(source, "link").agg(F.min_by(F.struct("pos", "title", "location", "posted", "summary"), "pos").alias("s"))
    return first.select(source, "link", "s.title", "s.location", "s.posted", "s.summary", F.col("s.pos").alias("ordinal"))
