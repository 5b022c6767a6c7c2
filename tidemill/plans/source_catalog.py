"""Queries that write exports, feeds and board answers from the test tables and read them back as the engine's sources do."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.steps import cut
from ..operators import ingest
from ..sources import asked, config, delimited, feeds, files, workbooks
from . import bindings as B
from .registry import query


def _files(s, what: str, files: dict[str, bytes], folder: str | None = None) -> str:
    """A new shared folder, or the given one, with these few, small files, each written through Spark's own file system."""
    folder = folder or B.scratch(s, what)
    jvm = s.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for name, data in files.items():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(base, name), True)
        out.write(bytearray(data))
        out.close()
    return folder


def _laid(s, what: str, files) -> str:
    """A new shared folder with a file for each row of files (name, content), written by tasks as text and then named."""
    folder = B.scratch(s, what)
    files.write.partitionBy("name").text(folder)
    jvm = s.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for at in [x.getPath() for x in fs.listStatus(base)]:
        if at.getName().startswith("name="):
            part = next(x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-"))
            fs.rename(part, jvm.org.apache.hadoop.fs.Path(base, at.getName()[5:]))
        fs.delete(at, True)
    return folder


_EXPORT = "select c_custkey::varchar as id, case when c_custkey % 10 = 0 then null else c_name || ', ' || chr(233) end as name, c_mktsegment as segment from customer"


def _export(s, d):
    c = B.table(s, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 10 == 0, "N/A").otherwise(F.concat("c_name", F.lit(", é"))).alias("name"), F.col("c_mktsegment").alias("segment"))


def _with_total(rows, k: int):
    """Third k of the rows as one file's, in order, and a totals row at its end."""
    some = rows.where(F.col("id").cast("long") % 3 == k).withColumn("_o", F.col("id").cast("long"))
    total = some.agg(F.lit("Total").alias("id"), F.count(F.lit(1)).cast("string").alias("name"), F.lit("").alias("segment"), F.lit(2**62).alias("_o"))
    return some.unionByName(total).coalesce(1).sortWithinPartitions("_o").drop("_o")


@query("delimited_scan", _EXPORT)
def delimited_scan(s, d):
    """Several files with headers, nothing-words and a totals row each."""
    folder = B.scratch(s, "exports")
    for k in range(3):
        _with_total(_export(s, d), k).write.mode("append").option("header", True).option("sep", ";").option("quoteAll", True).csv(folder)
    return delimited.read_delimited(s, f"{folder}/part-*").select("id", "name", "segment")


@query("delimited_layouts", _EXPORT)
def delimited_layouts(s, d):
    """Three files of two encodings, three delimiters and two orders of columns, with empty columns, empty rows and totals rows."""
    folder = B.scratch(s, "layouts")
    rows = _export(s, d)
    for k, (encoding, sep) in enumerate((("ISO-8859-1", "|"), ("UTF-8", "\t"), ("ISO-8859-1", ";"))):
        one = _with_total(rows, k)
        some = one.withColumns({"Empty": F.lit("n/a"), "Unnamed: 9": F.lit("")}).select("id", "name", "segment", "Empty", "Unnamed: 9") if k else one.select("id", "Segment", "name").withColumnRenamed("Segment", "segment")
        some.write.mode("append").option("header", True).option("sep", sep).option("encoding", encoding).option("quoteAll", True).csv(folder)
    return delimited.read_delimited(s, f"{folder}/part-*").select("id", "name", "segment")


query("header_scan", "select n_name || '.csv' as file, case when n_nationkey % 2 = 0 then 'id|name|' || n_name else 'code|' || n_name end as names from nation")(
    lambda s, d: files.headers(s, _laid(s, "heads", B.table(s, d, "nation").select(F.concat("n_name", F.lit(".csv")).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("id; name;"), "n_name", F.lit("\n1;2;3"))).otherwise(F.concat(F.lit("code\t"), "n_name", F.lit("\n1\t2"))).alias("content"))))
    .select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file"), F.array_join("names", "|").alias("names"))
)


def _xlsx(rows: list[list]) -> bytes:
    """A workbook of two sheets; ("d", n) is a cell with a date's format."""

    def cell(r: int, c: int, v) -> str:
        at = f"{chr(65 + c)}{r}"
        if v is None:
            return ""
        if isinstance(v, tuple):
            return f'<c r="{at}" s="1"><v>{v[1]}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(x))}</row>' for r, x in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Notes" sheetId="1" r:id="rId1"/><sheet name="Data" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet7.xml"/><Relationship Id="rId2" Target="worksheets/sheet3.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="165" formatCode="yyyy-mm-dd"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet7.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet3.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


@query("excel_scan", "select c_custkey::varchar as \"Id\", case when c_custkey % 10 = 0 then null else c_name end as \"Name\", (date '2020-01-01' + (c_custkey % 1000)::int)::varchar as \"Joined\" from customer")
def excel_scan(s, d):
    """A workbook for each nation, the sheet by name, headers in row 3, dates, nothing-words, an empty column, a totals row."""
    per = B.table(s, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("x"))
    books = {}
    for r in per.toLocalIterator():
        rows = [[x.c_custkey, "n/a" if x.c_custkey % 10 == 0 else x.c_name, ("d", 43831 + x.c_custkey % 1000)] for x in r.x]
        books[f"{r.c_nationkey}.xlsx"] = _xlsx([["Members"], [], ["Id", "Name", "Joined", "Empty"], *rows[:1], [], *rows[1:], ["Total", len(rows)]])
    return workbooks.read_workbooks(s, _files(s, "books", books), "Data", 3).select("Id", "Name", "Joined")


_INBOX = "case c_nationkey % 5 when 0 then concat('hr_roster_', c_nationkey, '.csv') when 1 then concat('campaign_registry_', c_nationkey, '.csv') else concat('export_', c_nationkey, '.csv') end"


@query("inbox_sweep", f"""with t as (select c_nationkey, {_INBOX} as file, 'id,name' || chr(10) || string_agg(c_custkey || ',' || c_name, chr(10) order by c_custkey) || chr(10) as body from customer group by 1, 2)
 select file, case c_nationkey % 5 when 0 then 0 when 1 then 1 else 2 end as load_order, sha256(body) as sha256 from t where c_nationkey % 3 <> 0""")
def inbox_sweep(s, d):
    """A file for each nation and a copy of every fourth; the loads of every third are in the ledger."""
    c = B.table(s, d, "customer")
    body = F.concat(F.lit("id,name\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.concat(x["c_custkey"].cast("string"), F.lit(","), x["c_name"])), "\n"))
    own = cut(c.groupBy("c_nationkey").agg(body.alias("content")).selectExpr("c_nationkey", f"{_INBOX} as name", "content"))
    copies = own.where("c_nationkey % 4 = 0").withColumn("name", F.concat(F.lit("zz_employee_"), "name"))
    folder = _laid(s, "inbox", own.unionByName(copies.where("c_nationkey % 5 = 0")).select("name", "content"))
    ledger = own.where("c_nationkey % 3 = 0").select(F.sha2(F.concat("content", F.lit("\n")), 256).alias("sha256"), F.lit("loaded").alias("status"))
    ledger = ledger.unionByName(own.where("c_nationkey % 3 = 1").select(F.sha2(F.concat("content", F.lit("\n")), 256).alias("sha256"), F.lit("rejected").alias("status")))
    return files.new_files(s, folder, ledger).select(F.element_at(F.split("path", "/"), -1).alias("file"), "load_order", "sha256")


@query("archive_moves", """select case when n_nationkey % 3 = 0 then 'rejected/' else 'archive/2024-01/' end || n_name || case when n_nationkey % 3 <> 0 and n_nationkey % 4 = 0 then '__1' else '' end || '.csv' as target, sha256(n_name || chr(10)) as sha256 from nation
 union all select 'archive/2024-01/' || n_name || '.csv', sha256('old' || chr(10)) from nation where n_nationkey % 4 = 0""")
def archive_moves(s, d):
    """A file for each nation is put away; every fourth finds its name taken in the archive."""
    n = B.table(s, d, "nation")
    named = n.select("n_nationkey", F.concat("n_name", F.lit(".csv")).alias("name"), F.col("n_name").alias("content"))
    folder = _laid(s, "sweep", named.select("name", "content"))
    old = named.where("n_nationkey % 4 = 0")
    for r in old.select("name").toLocalIterator():  # what an earlier sweep has put away
        _files(s, "old", {r["name"]: b"old\n"}, f"{folder}/archive/2024-01")
    loads = named.select(F.col("name").alias("file"), F.when(F.col("n_nationkey") % 3 == 0, "rejected").otherwise("loaded").alias("status"), F.col("n_nationkey").alias("at"))
    taken = old.select(F.concat(F.lit("archive/2024-01/"), "name").alias("target"))
    files.put_away(s, folder, ingest.archive_names(loads, taken, "2024-01"))
    got = files.content_hashes(s, f"{folder}/*/").unionByName(files.content_hashes(s, f"{folder}/archive/*/"))
    return got.distinct().select(F.url_decode(F.regexp_extract("path", "/((?:rejected|archive/2024-01)/[^/]*)$", 1)).alias("target"), "sha256")


_PRINTS = {"email": {"name": "^mail", "strong": ["Recipient Email"], "weak": ["Bounced"]}, "lms": {"strong": ["Course Name"], "weak": ["Progress"], "exclude": ["Bounced"]}}
_HEADS = [["recipient_email", "Bounced"], ["Course Name", "progress"], ["Course Name", "Bounced"], ["a"], ["Recipient Email", "Course Name", "progress"], ["Recipient Email"]]
query("source_detection", """select case when s_suppkey % 2 = 0 then 'mail_' else 'x_' end || s_suppkey as file, case when s_suppkey % 6 = 0 or (s_suppkey % 6 = 5 and s_suppkey % 12 = 2) then 'email' when s_suppkey % 6 = 1 then 'lms' end as source,
 case s_suppkey % 6 when 0 then 6 when 1 then 4 when 2 then 3 when 3 then 0 when 4 then 5 else 3 end::bigint as points from supplier""")(
    lambda s, d: files.detected(B.table(s, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "mail_").otherwise("x_"), F.col("s_suppkey").cast("string")).alias("file"), F.element_at(F.array(*(F.array(*map(F.lit, h)) for h in _HEADS)), (F.col("s_suppkey") % 6 + 1).cast("int")).alias("names")), _PRINTS)
)

# feeds and boards, one document for each source
_ITEM = "concat('<item><title>A &amp; ', o_orderkey, '</title><link>http://x.example/', o_orderkey, '</link><description>D</description><pubDate>Tue, 19 Aug 2025 06:30:00 +0530</pubDate><source>P</source></item>')"
_ENTRY = "concat('<entry><title>A & ', o_orderkey, '</title><link rel=\"self\" href=\"http://self.example/\"/><link href=\"http://x.example/', o_orderkey, '\"/><updated>2025-08-19T06:30:00Z</updated><id>i</id></entry>')"


def _feeds(s, d):
    o = B.table(s, d, "orders")
    rss = o.where("o_custkey % 4 < 2").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.expr(_ITEM))), "").alias("x")).select("o_custkey", F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>")).alias("body"))
    atom = o.where("o_custkey % 4 = 2").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.expr(_ENTRY))), "").alias("x")).select("o_custkey", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "x", F.lit("</feed>")).alias("body"))
    bad = o.where("o_custkey % 4 = 3").select("o_custkey").distinct().select("o_custkey", F.lit("<rss").alias("body"))
    return feeds.read_feeds(rss.unionByName(atom).unionByName(bad).withColumnRenamed("o_custkey", "source_id"))


query("feed_items", "select o_custkey::varchar as source_id, 'A & ' || o_orderkey as title, 'http://x.example/' || o_orderkey as link, case when o_custkey % 4 < 2 then 'P' end as publisher, timestamp '2025-08-19 01:00:00' + to_minutes(case when o_custkey % 4 = 2 then 330 else 0 end) as published from orders where o_custkey % 4 <> 3")(
    lambda s, d: _feeds(s, d).where("error is null").select("source_id", "title", "link", "publisher", X.parse_date(F.col("published")).alias("published"))
)
query("feed_states", "select case when o_custkey % 4 = 3 then 'error' else 'ok' end as state, count(distinct o_custkey) as sources from orders group by 1")(
    lambda s, d: feeds.states(_feeds(s, d)).groupBy("state").agg(F.count(F.lit(1)).alias("sources"))
)
_POST = "named_struct('title', concat('Role ', o_orderkey), 'externalPath', concat('/', o_orderkey), 'locationsText', 'Pune; Goa', 'bulletFields', array('R1', 'Posted 3 Days Ago'))"


def _board(s, d, kind: str, item: str, wrap: str):
    o = B.table(s, d, "orders")
    body = F.expr(f"to_json(named_struct('{wrap}', collect_list({item})))") if wrap else F.expr(f"to_json(collect_list({item}))")
    return feeds.read_board(o.groupBy(F.col("o_custkey").alias("source_id")).agg(body.alias("body")), kind)


query("board_workday", "select o_custkey as source_id, 'Role ' || o_orderkey as title, 'Posted 3 Days Ago' as posted, 'Pune (+1 more)' as location from orders")(
    lambda s, d: _board(s, d, "workday", _POST, "jobPostings").select("source_id", "title", "posted", X.location(F.col("location")).alias("location"))
)
query("board_greenhouse", "select o_custkey as source_id, 'Role ' || o_orderkey as title, 'http://g.example/' || o_orderkey as link from orders")(
    lambda s, d: _board(s, d, "greenhouse", "named_struct('title', concat('Role ', o_orderkey), 'absolute_url', concat('http://g.example/', o_orderkey), 'location', named_struct('name', 'Goa'))", "jobs").select("source_id", "title", "link")
)
query("board_lever", "select o_custkey as source_id, 'Role ' || o_orderkey as title, '1970-01-02' as posted from orders")(
    lambda s, d: _board(s, d, "lever", "named_struct('text', concat('Role ', o_orderkey), 'hostedUrl', concat('u', o_orderkey), 'createdAt', 86400000L)", "").select("source_id", "title", "posted")
)
for _kind, _list, _link in (("adzuna", "results", "redirect_url"), ("careerjet", "jobs", "url"), ("jooble", "jobs", "link")):
    query(f"board_{_kind}", "select o_custkey as source_id, 'Role ' || o_orderkey as title, 'u' || o_orderkey as link from orders")(
        lambda s, d, kind=_kind, wrap=_list, link=_link: _board(s, d, kind, f"named_struct('title', concat('Role ', o_orderkey), '{link}', concat('u', o_orderkey))", wrap).select("source_id", "title", "link")
    )
query("keyed_boards", """with k as (select s_suppkey as source_id, ['adzuna', 'jooble', 'rss', 'nobody', 'lever'][s_suppkey % 5 + 1] as kind from supplier)
 select source_id, kind, case kind when 'jooble' then 'skipped' when 'nobody' then 'error' else 'ok' end as state from k""")(
    lambda s, d: feeds.askable(B.table(s, d, "supplier").selectExpr("s_suppkey as source_id", "element_at(array('adzuna', 'jooble', 'rss', 'nobody', 'lever'), cast(s_suppkey % 5 as int) + 1) as kind"), {"adzuna"}).select("source_id", "kind", "state")
)
_TOPICS = """
sections:
  - {id: metal, strong: [brass, steel], supporting: [plated], multiplier: 1.2, certifies: true}
  - {id: size, strong: [large, small], supporting: [medium]}
least: 2.0
"""
query("config_topics", """with k(section, place, kind, keyword) as (values ('metal', 0, 'strong', 'brass'), ('metal', 0, 'strong', 'steel'), ('metal', 0, 'supporting', 'plated'), ('size', 1, 'strong', 'large'), ('size', 1, 'strong', 'small'), ('size', 1, 'supporting', 'medium')),
 w as (select unnest(string_split(lower(p_type), ' ')) as keyword from part) select section, place, kind, keyword, count(*) as parts from w join k using (keyword) group by all""")(
    lambda s, d: B.table(s, d, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("keyword")).join(F.broadcast(config.keyword_table(s, config.topics(_TOPICS))), "keyword").groupBy("section", "place", "kind", "keyword").agg(F.count(F.lit(1)).alias("parts"))
)


@query("feeds_source", """with k as (select o_custkey, o_custkey % 5 as k, o_orderkey from orders), n as (select o_custkey::varchar as source_id, ['rss', 'greenhouse', 'jooble', 'nobody', 'rss'][k + 1] as kind,
 case when k in (0, 1) then 'ok' when k = 2 then 'skipped' else 'error' end as state, case when k = 0 then 'A & ' || o_orderkey when k = 1 then 'Role ' || o_orderkey end as title, case when k = 0 then 'http://x.example/' || o_orderkey when k = 1 then 'http://g.example/' || o_orderkey end as link,
 case k when 2 then 'jooble needs a key' when 3 then 'no adapter for nobody' when 4 then 'unreadable: ParseError' end as error from k)
 select distinct source_id, kind, state, title, link, error from n""")
def feeds_source(s, d):
    """S13, S18-S22 as a data source: answers of several kinds, some without key, adapter or sense."""
    o = B.table(s, d, "orders")
    rss = F.concat(F.lit("<rss><channel>"), F.array_join(F.sort_array(F.collect_list(F.expr(_ITEM))), ""), F.lit("</channel></rss>"))
    jobs = F.expr("to_json(named_struct('jobs', collect_list(named_struct('title', concat('Role ', o_orderkey), 'absolute_url', concat('http://g.example/', o_orderkey), 'location', named_struct('name', 'Goa')))))")
    k = F.col("o_custkey") % 5
    told = o.groupBy("o_custkey").agg(rss.alias("rss"), jobs.alias("jobs"))
    answers = told.select(F.col("o_custkey").cast("string").alias("source_id"), F.element_at(F.array(*map(F.lit, ["rss", "greenhouse", "jooble", "nobody", "rss"])), (k + 1).cast("int")).alias("kind"), F.when(k == 0, F.col("rss")).when(k == 1, F.col("jobs")).when(k == 4, F.lit("<rss")).otherwise(F.lit("")).alias("body"))
    folder = B.scratch(s, "answers")
    answers.write.parquet(folder)
    asked.install(s)
    return s.read.format("feeds").option("path", folder).option("keys", "adzuna").load().select("source_id", "kind", "state", "title", "link", "error")
