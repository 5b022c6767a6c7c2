"""Legacy ARC archives converted to WARC, archives written by Spark, and WARC archives read back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, keep

#: Field names of the two versions of ARC record headers (fixed by the format).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Most records in one archive file; a page of more than LARGE bytes has a file of its own. So a file holds at most PER_FILE * LARGE bytes, or one page.
PER_FILE, LARGE = 1024, 1 << 18
#: Bytes of an archive that are unpacked at once.
PIECE = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    """One record: header fields by name, and the bytes of the declared length."""

    fields: dict[str, str]
    content: bytes
    opening: bool = False


class Source:
    """The bytes of an archive in order; gzipped members, one behind the other, are unpacked piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.done = memoryview(data), 0, bytearray(), 0
        self.packed, self.member = bytes(data[:2]) == b"\x1f\x8b", None

    def _more(self) -> bool:
        piece = self.data[self.at : self.at + PIECE]
        if not len(piece):
            return False
        if not self.packed:
            self.held += piece
            self.at += len(piece)
            return True
        if self.member is None:
            if bytes(piece[:2]) != b"\x1f\x8b":
                return False
            self.member = zlib.decompressobj(31)
        self.held += self.member.decompress(piece)
        self.at += len(piece) - len(self.member.unused_data)
        if self.member.eof:
            self.member = None
        return True

    def take(self, n: int) -> bytes:
        """The next n bytes, or what is left."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.done += len(out)
        return out

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the next mark, which is passed over; None at the end."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = self.take(at)
        self.take(len(mark))
        return out

    def past(self, characters: bytes) -> bool:
        """Whether anything is left once all of these characters that come next are passed over."""
        while self.held or self._more():
            if self.held and self.held[0] not in characters:
                return True
            del self.held[:1]
        return False


def arc_value(value: str | None) -> str:
    """A header field: '-' if absent; white space and control characters, which part fields and lines, are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: quote(m[0]), value or "-")


def arc_header(version: int, values: dict[str, str]) -> bytes:
    """A header line of arc_value()s."""
    return (" ".join(arc_value(values.get(f)) for f in ARC_FIELDS[version]) + "\n").encode("utf-8", "replace")


def arc_start(version: int, name: str, date: str) -> bytes:
    """The version block that opens an archive."""
    block = f"{version} 0 tidemill\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_header(version, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}) + block + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC archive, plain or gzipped, the version block first, which names the fields of the others.

    Only the first record can be the version block, whatever the URLs of others are. Header lines are split into as
    many fields as the version has; the declared length says where a record ends. A content type may hold spaces,
    so what is over the number of fields belongs to it.
    """
    source, fields, first = Source(data), ARC_FIELDS[1], True
    while source.past(b"\r\n"):
        where, line = source.done, source.until(b"\n")
        if line is None:
            raise ValueError(f"ARC header at byte {where} is cut short")
        parts = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        opening = first and parts[0].startswith("filedesc:")
        length = int(parts[-1])
        content = source.take(length)
        if len(content) < length:
            raise ValueError(f"ARC record at byte {where} is cut short")
        if opening:  # its own header has the fields of its version, which only the block itself tells
            fields = ARC_FIELDS[int(content.split(b"\n", 1)[0].split()[0])]
        over, first = len(parts) - len(fields), False
        if over < 0:
            raise ValueError(f"ARC header with {len(parts)} of {len(fields)} fields at byte {where}")
        parts[3 : 4 + over] = [" ".join(parts[3 : 4 + over])]
        yield ArcRecord(dict(zip(fields, parts, strict=True)), content, opening)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(url: str, date: str, salt: str) -> str:
    """An identifier that follows from where, when and what."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {salt}')}>"


def _http(content: bytes) -> tuple[bytes, bytes]:
    """Head of a stored HTTP message (with its blank line) and payload; no head if it does not begin like one."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    for gap in (b"\r\n\r\n", b"\n\n"):
        at = content.find(gap)
        if at >= 0:
            return content[: at + len(gap)], content[at + len(gap) :]
    return content, b""


def warc_record(headers: list[tuple[str, str]], content: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(content)}\r\n\r\n".encode() + content


def convert(record: ArcRecord, salt: str = "", revisit: tuple[str, str] | None = None) -> bytes:
    """The WARC record that stands for an ARC record.

    The version block becomes a warcinfo record, a stored HTTP message a response, anything else a resource.
    Date, identifier and digests, which ARC lacks or has in another form, are made from the header and the bytes.
    revisit names identifier and URL of a record with the same payload; the result then holds the HTTP head only.
    """
    f = record.fields
    d = f["Archive-date"].ljust(14, "0")[:14]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    url = f["URL"]
    if record.opening:
        body = f"software: tidemill\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC {record.content.split(maxsplit=1)[0].decode()}\r\n".encode()
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(url, date, "info")), ("WARC-Date", date), ("WARC-Filename", url.removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")], body)
    head, payload = _http(record.content)
    kind = "revisit" if revisit else "response" if head else "resource"
    content = head if revisit else record.content
    found = digest(payload)
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(url, date, f"{salt} {found}")), ("WARC-Date", date), ("WARC-Target-URI", url)]
    if f.get("IP-address", "-") not in ("-", "0.0.0.0"):
        headers.append(("WARC-IP-Address", f["IP-address"]))
    headers += [("WARC-Payload-Digest", f"sha1:{found}"), ("WARC-Block-Digest", f"sha1:{digest(content)}")]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", revisit[0]), ("WARC-Refers-To-Target-URI", revisit[1])]
    headers.append(("Content-Type", "application/http; msgtype=response" if head else f["Content-type"]))
    return warc_record(headers, content)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content of each record, by declared lengths, one at a time; members may be gzipped."""
    source = Source(data)
    while source.past(b"\r\n"):
        where, head = source.done, source.until(b"\r\n\r\n")
        first, *lines = (head or b"").decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {where}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        content = source.take(int(headers["content-length"]))
        if len(content) < int(headers["content-length"]):
            raise ValueError(f"WARC record at byte {where} is cut short")
        yield headers, content


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "20240101000000") -> str:
    """Convert pages, as ARC records of both versions, into WARC archives in a new shared folder; its path.

    Of pages with equal payloads of at least `least` bytes, those of the smallest key are responses and the others
    revisits of them; smaller ones are all responses. Null URLs are urn:none, null payloads empty; a null key is
    larger than any other. Files are written by Spark's text writer with the blank lines that close a record as its
    line end, and compressed; each begins with the warcinfo record of the archives that it was made from, and holds
    at most PER_FILE records, or one page of over LARGE bytes.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("id"), F.coalesce(F.col(url), F.lit("urn:none")).alias("url"), body.alias("body")).withColumn("sha", F.sha1("body"))
    many = rows.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("sha", "first")
    joined = rows.join(many, "sha", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id")) & (F.octet_length("body") >= least))
    flat = joined.select(F.col("id").cast("string").alias("id"), "url", "body", "again", F.col("first.id").cast("string").alias("first_id"), F.col("first.url").alias("first_url"))
    path = fresh_path(pages.sparkSession, "warc")

    def written(some: DataFrame, per_file: int) -> None:
        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    out = []
                    for record in _converted(batch.slice(lo, 64).to_pylist(), date):
                        if n % per_file == 0:
                            out.append(convert(next(read_arc(arc_start(1, "pages.arc", date)))))
                            n += 1
                        out.append(record)
                        n += 1
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

        text = some.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
        text.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)

    long = F.octet_length("body") > LARGE
    written(flat.where(~long), PER_FILE)
    if not pages.where(F.octet_length(F.col(html)) > LARGE).isEmpty():
        written(flat.where(long), 2)
    return path


def _converted(pages: list[dict], date: str) -> Iterator[bytes]:
    """Some pages laid down as ARC archives, one of each version, and read from there into WARC records."""
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    for version in ARC_FIELDS:
        mine = [row for row in pages if 1 + zlib.crc32(str(row["id"]).encode()) % 2 == version]
        legacy = [arc_start(version, "pages.arc", date)]
        for row in mine:
            page = "" if row["id"] is None else quote(row["id"], safe="")
            content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\n\r\n".encode() + row["body"]
            values = {"URL": row["url"], "IP-address": "192.0.2.1", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(content).hexdigest(), "Offset": str(sum(map(len, legacy))), "Filename": "pages.arc", "Archive-length": str(len(content))}
            legacy += [arc_header(version, values), content, b"\n"]
        records = read_arc(b"".join(legacy))
        next(records)  # the version block
        for row, record in zip(mine, records, strict=True):
            revisit = None
            if row["again"]:
                first = arc_value(row["first_url"])
                revisit = record_id(first, iso, f"{row['first_id']} {digest(row['body'])}"), first
            yield convert(record, str(row["id"]), revisit)


def load(spark, path: str) -> DataFrame:
    """record_id, record_type, page_id (string), refers_to_id, payload_bytes, payload_digest of each archived record.

    Digests of responses are computed from the bytes read; those of revisits are the declared ones.
    """
    schema = "record_id string, record_type string, page_id string, refers_to_id string, payload_bytes long, payload_digest string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, content in read_warc(memoryview(data.as_buffer())):
                    if h["warc-type"] == "warcinfo":
                        continue
                    head, payload = _http(content)
                    page = next((unquote(x.split(b":", 1)[1].strip().decode()) for x in head.split(b"\r\n") if x.startswith(b"X-Page-Id:")), "")
                    full = h["warc-type"] != "revisit"
                    rows.append((h["warc-record-id"], h["warc-type"], page or None, h.get("warc-refers-to"), len(payload) if full else None, digest(payload) if full else h["warc-payload-digest"].removeprefix("sha1:")))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(columns)], names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, schema)


def op6(pages: DataFrame) -> DataFrame:
    """The contract's columns, from the archives as read back; revisits are resolved by their record identifiers."""
    kind = dict(pages.dtypes)["page_id"]
    back = keep(load(pages.sparkSession, archive(pages)))
    # kept, so that the join deals both sides itself and can split a response that very many revisit
    full = keep(back.where("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("to"), F.first("payload_bytes").alias("to_bytes")))
    out = back.join(full.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    return out.select(F.col("page_id").cast(kind).alias("page_id"), F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("to").cast(kind).alias("refers_to"))


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as x from p),
b as (select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(x, (1 + 10 * (i // 8))::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31)::int + 1, 1)), '') as payload_digest from d),
f as (select payload_digest, min(page_id) as r from b group by 1)
select page_id, payload_bytes, payload_digest, case when page_id = r then 'response' else 'revisit' end as record_type,
  case when page_id <> r then r end as refers_to from b join f using (payload_digest)
"""
