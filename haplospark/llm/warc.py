"""WARC derivatives: linked metadata and plain-text conversion records for responses.

A response record carries an HTTP head and a body. For each one two records are
derived: ``metadata`` (an application/warc-fields block with the title, the number of
links, the declared language and the digests) and ``conversion`` (the page's plain
text). Both keep the source's HTTP head (column http_head, and WARC-Source-HTTP-* fields of
the record's header; the metadata block has them as http-* fields), name the source in
WARC-Refers-To and carry block and payload digests of their own.

Defined cases: a null or empty body is a response with an empty payload, whose
derivatives are empty too; a null URL stays null and its header is left out; repeated
rows give repeated records (ids are derived from the row's content); an empty table
gives no records; other columns are ignored, whatever their names; a comment, tag or
element that is never closed reaches to the end, so very long pages take time in
proportion to their length.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Stand around a tag's name while tags are cut out. Unicode reserves them as no characters; pages lose them.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
#: The date of sources that have none.
EPOCH = "1970-01-01T00:00:00Z"
#: Elements whose content is not text, elements that end a line, and character references.
DROPPED = "script|style|noscript|template|svg"  # and head
BREAKING = "p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|blockquote|pre|hr"
#: The named references of HTML 4, and the numbers that HTML reads as Windows-1252; a fixed space is a space.
NAMED = {**{name: chr(n) for name, n in name2codepoint.items()}, "apos": "'", "nbsp": " "}
NUMBERED = {**{n: c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}, 160: " "}


def uuid_of(key: Column) -> Column:
    """A stable urn:uuid made of a key's md5 (so re-runs give the same ids)."""
    h = F.md5(key.cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(
        F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">")
    )


def digest_of(data: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(data.cast("binary")))


def resolved(text: Column) -> Column:
    """Text with its numeric and named character references resolved, once; what is none stays as it is."""
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    numbered = F.create_map(*[F.lit(x) for pair in NUMBERED.items() for x in pair])

    def one(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^(#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.regexp_extract(part, r"^#[xX]?([0-9A-Fa-f]+)", 1)
        number = F.when(part.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        code = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        char = F.when(ref.startswith("#"), F.when(bad, F.lit("\ufffd")).otherwise(F.coalesce(F.try_element_at(numbered, number.cast("int")), code)))
        char = char.when(ref != "", F.try_element_at(named, ref))
        return F.coalesce(F.concat(char, F.substr(part, F.length(ref) + 2)), F.concat(F.lit("&"), part))

    def whole(t: Column) -> Column:
        parts = F.split(t, "&", -1)
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)
        return F.when(F.contains(t, F.lit("&")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(t)

    return F.transform(F.array(text), whole)[0]  # a bound name, so that the text is worked out once


def plain_text(html: Column) -> Column:
    """Text of a page: comments and non-text elements go, block elements end lines, references are resolved.

    What is opened and never closed reaches to the page's end (a head: to the body), so
    every pattern passes over a page once, however many openings it has.
    """
    out = F.replace(F.replace(html, F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))
    out = F.regexp_replace(out, rf"(?is)<(?:!--.*?(?:-->|\z)|({DROPPED})(?=[\s/>]).*?(?:</\1\s*>|\z))", " ")
    out = F.regexp_replace(out, r"(?is)<head(?=[\s/>]).*?(?:</head\s*>|(?=<body[\s/>])|\z)", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:({BREAKING})(?=[\s/>])|[A-Z!])[^>]*(?:>|\z)", f"{OPEN}$1{CLOSE}")
    out = F.replace(F.regexp_replace(out, f"{OPEN}[A-Za-z0-9]+{CLOSE}", "\n"), F.lit(OPEN + CLOSE), F.lit(""))
    out = resolved(out)
    out = F.regexp_replace(out, r"[ \t\r\f\x0b]+", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def title_of(html: Column) -> Column:
    title = F.regexp_extract(html, r"(?is)<title(?=[\s/>])[^>]*(?:>|\z)(.*?)(?:</title|\z)", 1)
    return F.trim(F.regexp_replace(title, r"[ \t\r\n\f\x0b]+", " "))


def responses(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | str = EPOCH) -> DataFrame:
    """Response records of raw pages: id, record_id, target_uri, warc_date, http_head, payload, payload_digest.

    date: when the pages were fetched, as a WARC-Date or a column of them.
    """
    date = F.lit(date) if isinstance(date, str) else date
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), body.alias("payload"), F.coalesce(date, F.lit(EPOCH)).alias("warc_date"))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF),
    )
    key = F.concat_ws("|", F.lit("response"), F.col("id").cast("string"), F.coalesce("target_uri", F.lit("")), F.sha1(F.col("payload").cast("binary")))
    return rows.select(
        "id", uuid_of(key).alias("record_id"), "target_uri", "warc_date", head.alias("http_head"), "payload", digest_of(F.col("payload")).alias("payload_digest")
    )


def head_fields(head: Column, prefix: str) -> Column:
    """The lines of an HTTP head as fields: the status line under <prefix>Status, each header under its own name after the prefix."""
    lines = F.regexp_replace(head, r"(\r\n)+$", "")
    lines = F.regexp_replace(lines, r"\r\n(?![ \t])", f"{CRLF}{prefix}")
    return F.concat(F.lit(f"{prefix}Status: "), lines, F.lit(CRLF))


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response: id, warc_type, record_id, refers_to, target_uri, warc_date, http_head, content_type,
    source_digest, source_length, block, block_digest, content_length, header. WARC-Date is the source's, so that reruns agree."""
    text = records.select("id", "record_id", "target_uri", "warc_date", "http_head", "payload_digest", F.octet_length("payload").alias("source_length"),
                          plain_text(F.col("payload")).alias("text"), title_of(F.col("payload")).alias("title"),
                          F.lower(F.regexp_extract("payload", r"(?i)<html(?=\s)[^<>]*\slang=[\"']?([A-Za-z-]+)", 1)).alias("lang"),
                          F.regexp_count("payload", F.lit(r"(?i)<a\s[^<>]*href\s*=")).alias("links"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    fields = F.concat(
        line("title", F.col("title")), line("language", F.col("lang")), line("outlinks", F.col("links").cast("string")),
        line("textLength", F.octet_length("text").cast("string")), line("sourceDigest", F.col("payload_digest")),
        head_fields(F.col("http_head"), "http-"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    out = text.select("id", "record_id", "target_uri", "warc_date", "http_head", "payload_digest", "source_length", F.explode(kinds).alias("r"))
    out = out.select(
        "id", "r.warc_type", uuid_of(F.concat_ws("|", F.col("r.warc_type"), F.col("record_id"))).alias("record_id"),
        F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "http_head", "r.content_type", F.col("payload_digest").alias("source_digest"), "source_length",
        "r.block", digest_of(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").alias("content_length"),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("warc_date")),
        line("WARC-Refers-To", F.col("refers_to")),
        F.coalesce(line("WARC-Target-URI", F.col("target_uri")), F.lit("")),
        head_fields(F.col("http_head"), "WARC-Source-HTTP-"),
        line("WARC-Source-Payload-Digest", F.col("source_digest")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF),
    )
    return out.withColumn("header", head)


def as_warc(records: DataFrame) -> Column:
    """The bytes of a derived record, ready to be written one after another."""
    return F.concat(F.col("header"), F.col("block"), F.lit(CRLF * 2))
