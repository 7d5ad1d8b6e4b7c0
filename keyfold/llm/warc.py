"""Derived WARC records: from every response a metadata record and a plain-text conversion.

Records are rows. A response holds its HTTP block; its derivatives refer to it by identifier,
keep its target, date, digests and the HTTP headers that describe the source, and carry digests
of their own blocks. Identifiers come from digests, so a rerun writes the same records.
Nothing is shuffled; only the plain text is made in Python, slice by slice."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

END = "\r\n"
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head|template|noscript)\b[^>]*>.*?</\1\s*>", re.DOTALL | re.IGNORECASE)
_BREAK = re.compile(r"<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|td|th|table|section|article|nav|header|footer|aside|blockquote|pre|title|dl|dt|dd|form)\b|br\b)[^>]*>", re.IGNORECASE)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")


def plain_text(page: str | None) -> str:
    """All visible text, a line per block, blanks turned into one."""
    if not page:
        return ""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(html.unescape(line).split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _record_id(*parts: Column) -> Column:
    """A name-based identifier in UUID form."""
    h = F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)
    cut = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, date: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of fetched pages: page_id, record_id, target_uri, date, http_headers, payload.

    A null page is an empty payload; a null URL stays null; repeated rows share one identifier."""
    payload = F.coalesce(pages[html_col], F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    return pages.select(pages[id_col].alias("page_id"), _record_id(F.lit("response"), F.coalesce(pages[id_col].cast("string"), F.lit("")), F.coalesce(pages[url_col], F.lit("")), payload).alias("record_id"),
                        pages[url_col].alias("target_uri"), F.lit(date).alias("date"), http.alias("http_headers"), payload.alias("payload"))


def derivatives(records: DataFrame) -> DataFrame:
    """Two records per response: page_id, warc_type, record_id, refers_to, target_uri, date,
    content_type, source_headers, payload_digest (the response's), block_digest, content_length, block.

    The metadata block lists the source's facts in `application/warc-fields`, among them every line of
    its HTTP headers as a field `source-http-header`; the conversion block is plain text. Empty payloads give empty conversions; null targets stay null; an empty table
    gives an empty result; other columns are ignored."""
    fields = ["page_id", "record_id", "target_uri", "date", "http_headers", "payload"]
    source = records.select(*fields)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([plain_text(p) for p in batch.column("payload").to_pylist()], pa.string())], [*fields, "text"])

    done = source.mapInArrow(texts, f"{kinds}, text string").withColumns({
        "payload_digest": _digest(F.coalesce("payload", F.lit(""))), "response_digest": _digest(F.concat_ws(END, F.coalesce("http_headers", F.lit("")), F.coalesce("payload", F.lit(""))))})
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit(END))
    http = F.filter(F.split(F.coalesce("http_headers", F.lit("")), r"\r\n|\r|\n"), lambda x: x != "")
    headers = F.concat_ws("", F.transform(http, lambda x: line("source-http-header", x)))
    title = F.regexp_extract("payload", r"(?is)<title[^>]*>\s*(.*?)\s*</title", 1)
    about = F.concat(headers, line("source-block-digest", F.col("response_digest")), line("source-payload-digest", F.col("payload_digest")), line("source-payload-length", F.octet_length("payload")),
                     line("title", F.regexp_replace(title, r"\s+", " ")), line("outlinks", F.regexp_count("payload", F.lit(r"(?i)<a\s[^>]*href"))), line("text-length", F.char_length("text")))
    row = lambda kind, content, block: F.struct(F.lit(kind).alias("warc_type"), F.lit(content).alias("content_type"), block.alias("block"))
    each = done.withColumn("derived", F.explode(F.array(row("metadata", "application/warc-fields", about), row("conversion", "text/plain; charset=utf-8", F.col("text")))))
    block = F.col("derived.block")
    return each.select("page_id", F.col("derived.warc_type").alias("warc_type"), _record_id(F.col("derived.warc_type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"),
                       "target_uri", "date", F.col("derived.content_type").alias("content_type"), F.col("http_headers").alias("source_headers"), "payload_digest",
                       _digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("content_length"), block.alias("block"))


def rendered(derived: DataFrame) -> Column:
    """The text of a derived record in WARC form, with its closing blank lines."""
    line = lambda name, column: F.when(derived[column].isNotNull(), F.concat(F.lit(f"{name}: "), derived[column].cast("string"), F.lit(END)))
    headers = [line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "date"),
               line("WARC-Payload-Digest", "payload_digest"), line("WARC-Block-Digest", "block_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length")]
    return F.concat(F.lit(f"WARC/1.1{END}"), *[F.coalesce(h, F.lit("")) for h in headers], F.lit(END), derived["block"], F.lit(END * 2))


def write(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write WARC files, one per task; the line end that the text writer adds is the last of each record."""
    record = rendered(derived)
    derived.select(record.substr(F.lit(1), F.char_length(record) - 1)).write.option("compression", compression).text(path)
