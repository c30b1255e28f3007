"""WARC derivative builder: from responses to linked metadata and plain-text conversion records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Elements that hold no readable text; elements that end a line; character references.
SILENT = ("script", "style", "head", "noscript", "template")
BLOCKS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|article|section|nav|header|footer"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
CRLF = "\r\n"
RESPONSE_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def record_id(kind: str, page_id: Column, url: Column, body: Column) -> Column:
    """``<urn:uuid:...>`` by the md5 of the record's kind and the page it stems from: the same at each run."""
    h = F.md5(F.concat_ws("|", F.lit(kind), page_id.cast("string"), url, body).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def plain_text(html: Column) -> Column:
    """Readable text: comments and silent elements go, block tags end lines, references are resolved, blanks shrink."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in SILENT:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n+", "\n"), F.lit(" \n"))


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def derivatives(pages: DataFrame) -> DataFrame:
    """Three linked records of each page: ``(page_id, record_type, record_id, refers_to, target_uri, content_type,
    content_length, block_digest, payload_digest, source_type, source_charset, block)``.

    The response record holds the HTTP message; its metadata record lists title, language and outgoing links as
    fields, its conversion record the plain text. Both refer to the response by its identifier and repeat the
    source's headers (media type, character set) and the digest of its payload. A null url or html counts as empty;
    repeated pages give the same records again, with the same identifiers; other columns aren't read; an empty
    table gives an empty result. Nothing is shuffled.
    """
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("response_id", record_id("response", F.col("page_id"), F.col("url"), F.col("html")))
    first = lambda pattern: F.regexp_extract("html", pattern, 1)
    fields = p.select(
        "*",
        F.concat(F.lit(RESPONSE_HEAD), _bytes(F.col("html")).cast("string"), F.lit(CRLF + CRLF), "html").alias("message"),
        plain_text(F.col("html")).alias("plain"),
        F.trim(first(r"(?is)<title[^>]*>(.*?)</title>")).alias("title"),
        first(r'(?i)<html[^>]*\blang="([^"]*)"').alias("lang"),
        F.lower(first(r'(?i)<meta[^>]*\bcharset="?([A-Za-z0-9_-]+)')).alias("charset"),
        F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1)).alias("links"),
        _digest(F.col("html")).alias("payload"),
    )
    outlinks = F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(" L a/@href" + CRLF))), "")
    about = F.concat(F.lit("title: "), "title", F.lit(CRLF + "language: "), "lang", F.lit(CRLF), outlinks)

    def record(kind: str, block: Column, content_type: str, linked: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("record_type"),
            (record_id(kind, F.col("page_id"), F.col("url"), F.col("html")) if linked else F.col("response_id")).alias("record_id"),
            (F.col("response_id") if linked else F.lit(None).cast("string")).alias("refers_to"),
            F.lit(content_type).alias("content_type"),
            block.alias("block"),
        )

    records = F.array(
        record("response", F.col("message"), "application/http; msgtype=response", False),
        record("metadata", about, "application/warc-fields", True),
        record("conversion", F.col("plain"), "text/plain; charset=utf-8", True),
    )
    r = fields.select("page_id", F.col("url").alias("target_uri"), F.col("payload").alias("payload_digest"), "charset", F.explode_outer(records).alias("r"))
    return r.select(
        "page_id", "r.record_type", "r.record_id", "r.refers_to", "target_uri", "r.content_type", _bytes(F.col("r.block")).alias("content_length"), _digest(F.col("r.block")).alias("block_digest"),
        "payload_digest", F.lit("text/html").alias("source_type"), F.when(F.col("charset") != "", F.col("charset")).otherwise(F.lit("utf-8")).alias("source_charset"), F.col("r.block").alias("block"),
    )


def serialised(records: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``(page_id, record_id, warc string)``: each record in the WARC 1.1 file format, headers, block and two line ends."""
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    out = F.concat(
        F.lit("WARC/1.1" + CRLF), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", F.col("record_id")), header("WARC-Refers-To", F.col("refers_to")),
        header("WARC-Date", F.lit(date)), header("WARC-Target-URI", F.col("target_uri")), header("Content-Type", F.col("content_type")), header("Content-Length", F.col("content_length").cast("string")),
        header("WARC-Block-Digest", F.col("block_digest")), header("WARC-Payload-Digest", F.col("payload_digest")), F.lit(CRLF), "block", F.lit(CRLF + CRLF),
    )
    return records.select("page_id", "record_id", out.alias("warc"))


def warc_query(spark, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages")).drop("block")


def _sql() -> str:
    """DuckDB's form of the same records."""

    def uuid(kind: str) -> str:
        return f"(SELECT '<urn:uuid:' || concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) || '>' FROM (SELECT md5(concat_ws('|', '{kind}', page_id::VARCHAR, url, html)) AS h))"

    t = r"regexp_replace(html, '<!--.*?-->', '', 'gs')"
    for tag in SILENT:
        t = rf"regexp_replace({t}, '<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'gis')"
    t = rf"regexp_replace({t}, '</?(?:{BLOCKS})\b[^>]*>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'gs')"
    for a, b in ENTITIES:
        t = f"replace({t}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    t = rf"regexp_replace({t}, '[ \t\r\f]+', ' ', 'g')"
    t = rf"trim(regexp_replace(regexp_replace({t}, ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g'), ' ' || chr(10))"
    head = RESPONSE_HEAD.replace(CRLF, "' || crlf || '")
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS crlf FROM pages),
f AS (SELECT *, {t} AS plain, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title,
  regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1, 'i') AS lang, lower(regexp_extract(html, '<meta[^>]*\bcharset="?([A-Za-z0-9_-]+)', 1, 'i')) AS charset,
  regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]*)"', 1, 'i') AS links, {uuid("response")} AS rid FROM p),
r AS (
  SELECT *, 'response' AS record_type, rid AS record_id, NULL::VARCHAR AS refers_to, 'application/http; msgtype=response' AS content_type,
    '{head}' || strlen(html)::VARCHAR || crlf || crlf || html AS block FROM f
  UNION ALL SELECT *, 'metadata', {uuid("metadata")}, rid, 'application/warc-fields',
    'title: ' || title || crlf || 'language: ' || lang || crlf || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || ' L a/@href' || crlf), ''), '') FROM f
  UNION ALL SELECT *, 'conversion', {uuid("conversion")}, rid, 'text/plain; charset=utf-8', plain FROM f)
SELECT page_id, record_type, record_id, refers_to, url AS target_uri, content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest,
  'sha256:' || sha256(html) AS payload_digest, 'text/html' AS source_type, CASE WHEN charset <> '' THEN charset ELSE 'utf-8' END AS source_charset FROM r"""


WARC_SQL = _sql()
