"""WARC archives: writing captures, reading records, and putting transactions together again.

A capture is a request, a response (or a revisit of an earlier response with an
equal payload) and a metadata record. Requests and metadata name the response
by ``WARC-Concurrent-To``; reading joins the three kinds through that identifier
and gives one nested row per capture.

Files are gzipped text with the line end as Spark's separator, so Spark alone
writes and reads them, wherever they are, and a task holds one record at a time:
a record ends where its Content-Length says, whatever its payload looks like.
Payloads are bytes; lines that are not UTF-8 keep theirs.

Record ids are ``<urn:uuid:..>`` made of the page id, url and payload digest, so
a task that runs again writes the same. Rows equal in all three share one id and
come back as many times as they were written.

Edge cases: null html is an empty payload; a null url is left out of the headers
and comes back null; a null page id comes back null; line breaks in a url are
percent-encoded in the header; extra columns are left behind.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import Workspace, small_batches

REVISIT_FROM = 100
DATE = "2024-01-01T00:00:00Z"
SEP = "\r\n"


def _uuid(*parts: F.Column) -> F.Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: str, headers: list[tuple[str, F.Column]], block: F.Column) -> F.Column:
    """The text of a record; a header whose value is null is left out. The line end Spark adds is the record's last."""
    lines = [F.lit(f"WARC/1.1{SEP}WARC-Type: {kind}{SEP}WARC-Date: {DATE}{SEP}")]
    lines += [F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(SEP)), F.lit("")) for name, value in headers]
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(SEP * 2), block, F.lit(SEP + "\r")]
    return F.concat(*lines)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page with its payload, digest, record id and, for a revisit, the response it refers to.

    Of equal payloads of ``REVISIT_FROM`` bytes or more, that with the smallest
    page id is the response (all rows of that id and url, if it repeats).
    """
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    p = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("payload"))
    p = p.withColumn("url", url).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload"))
    first = p.select("page_id", "url", "digest", "bytes").where(F.col("bytes") >= REVISIT_FROM).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "url")).alias("f"), F.count("*").alias("c"))
    first = first.where("c > 1").select(F.col("digest").alias("fd"), F.col("f.page_id").alias("fp"), F.col("f.url").alias("fu"))
    met = p.join(first, p["digest"] == first["fd"], "left")
    again = F.col("fd").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("fp"))
    # rows of the first id under another url repeat the payload in one record type all the same
    return met.select("page_id", "url", "payload", "digest", "bytes", _uuid(F.col("page_id"), F.col("url"), F.col("digest")).alias("id"), F.when(again, _uuid(F.col("fp"), F.col("fu"), F.col("digest"))).alias("refers_to"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the pages' captures as ``*.gz`` archives below path."""
    c = captures(pages, id_col, url_col, html_col)
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#\s]*)", 1), F.lit(""))
    target = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/?#\s]*([^#\s]*)", 1), F.lit("")), F.lit("/"))
    uri = ("WARC-Target-URI", F.col("url"))
    head = F.lit(f"HTTP/1.1 200 OK{SEP}Content-Type: text/html; charset=utf-8{SEP}{SEP}")
    payload_digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    response = _record("response", [("WARC-Record-ID", F.col("id")), uri, payload_digest, ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(head, F.col("payload")))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    revisit = _record("revisit", [("WARC-Record-ID", F.col("id")), uri, payload_digest, ("WARC-Refers-To", F.col("refers_to")), ("WARC-Profile", profile), ("Content-Type", F.lit("application/http; msgtype=response"))], head)
    request = _record("request", [("WARC-Record-ID", _uuid(F.col("id"), F.lit("request"))), ("WARC-Concurrent-To", F.col("id")), uri, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{SEP}Host: "), host, F.lit(SEP * 2)))
    meta = _record("metadata", [("WARC-Record-ID", _uuid(F.col("id"), F.lit("metadata"))), ("WARC-Concurrent-To", F.col("id")), uri, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(SEP)), F.lit("")), F.lit(f"via: crawl{SEP}")))
    body = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
    c.select(F.explode(F.array(request, body, meta)).alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _parse(head: list[bytes]) -> dict[str, str]:
    """Header lines as a dictionary with lower-case names."""
    out = {}
    for x in head:
        name, colon, value = x.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class Reader:
    """Puts records together from lines; keeps at most one."""

    def __init__(self) -> None:
        self.head: list[bytes] | None = None
        self.fields: dict[str, str] = {}
        self.block: list[bytes] | None = None
        self.need = 0

    def feed(self, line: bytes):
        """One more line without its end; gives (fields, block) when a record is whole."""
        if self.block is not None:
            self.block.append(line)
            self.need -= len(line) + 1
            if self.need < 0:  # the line end that no longer belongs to the block
                return self._done()
            return None
        bare = line.rstrip(b"\r")
        if self.head is None:
            if bare.startswith(b"WARC/"):
                self.head = []
            return None
        if bare:
            self.head.append(bare)
            return None
        self.fields = _parse(self.head)
        self.head, self.block, self.need = None, [], int(self.fields.get("content-length", 0))
        return None

    def _done(self):
        raw = b"\n".join(self.block)[: int(self.fields.get("content-length", 0))]
        fields, self.block = self.fields, None
        return fields, raw


RECORD = "type string, id string, concurrent_to string, refers_to string, url string, page_id long, declared string, bytes long, digest string, block binary"


def records(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """One row per record of the archives at path. ``bytes`` and ``digest`` are those of the payload as read."""

    def rows_of(fields: dict[str, str], raw: bytes) -> tuple:
        http = fields.get("content-type", "").startswith("application/http")
        payload = raw.partition(b"\r\n\r\n")[2] if http else raw
        own = _parse(raw.splitlines()) if fields.get("content-type") == "application/warc-fields" else {}
        declared = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
        page = int(own["page-id"]) if "page-id" in own else None
        url = fields.get("warc-target-uri")
        return fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), url, page, declared, len(payload), hashlib.sha256(payload).hexdigest(), payload if with_block else None

    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")]

    def each(frames):
        reader, file = Reader(), None
        for x in frames:
            out = []
            for f, line in zip(x["file"].to_pylist(), x["line"].to_pylist(), strict=True):
                if f != file:
                    reader, file = Reader(), f
                got = reader.feed(line)
                if got:
                    out.append(rows_of(*got))
            if out:  # Arrow, not pandas: longs with nulls stay longs
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    small_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(each, RECORD)


def transactions(recs: DataFrame) -> DataFrame:
    """One nested row per capture: ``id, url, page_id, request, response, metadata``, joined on concurrent-to.

    ``response`` holds the record's type, what it refers to, and the payload's
    size, digest and bytes. A capture without a request or metadata keeps null
    there. Records that repeat (equal captures written twice) give a row each.
    """
    one = F.struct(F.col("id"), F.col("url"), F.col("bytes"), F.col("block"))
    main = recs.where(F.col("type").isin("response", "revisit")).select("id", "url", F.struct("type", "refers_to", "declared", "bytes", "digest", "block").alias("response"))
    side = recs.where(F.col("type").isin("request", "metadata")).groupBy(F.col("concurrent_to").alias("cid")).agg(F.min(F.when(F.col("type") == "request", one)).alias("request"), F.min(F.when(F.col("type") == "metadata", F.struct(F.col("page_id"), F.col("id"), F.col("block")))).alias("metadata"))
    return main.join(side, main["id"] == side["cid"], "left").select("id", "url", F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata")


def resolved(whole: DataFrame) -> DataFrame:
    """Captures with the full payload's size and digest; revisits take them, and ``refers_to`` as a page id, from their response.

    A revisit whose response is not in these archives keeps its declared digest and a null size.
    """
    r = whole.select("page_id", "id", "response.type", "response.refers_to", "response.declared", "response.bytes", "response.digest")
    to = r.where("type = 'response'").groupBy(F.col("id").alias("tid")).agg(F.min("page_id").alias("to_page"), F.min("bytes").alias("to_bytes"), F.min("digest").alias("to_digest"))
    to = Workspace(whole.sparkSession).cut(to, "responses")  # both sides of the join are plain shuffles then, which Spark splits where a response is hot
    met = r.join(to, (r["refers_to"] == to["tid"]) & (r["type"] == "revisit"), "left")
    old = F.col("type") == "revisit"
    return met.select("page_id", F.when(old, F.col("to_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(old, F.coalesce("to_digest", "declared")).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), F.when(old, F.col("to_page")).alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder, read them back, and resolve their captures."""
    ws = Workspace(pages.sparkSession)
    path = ws.path("warc")
    write(pages, path)
    recs = ws.cut(records(ws.spark, path, with_block=False), "records")
    ws._remove(path)
    return resolved(ws.cut(transactions(recs), "captures"))
