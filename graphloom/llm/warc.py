"""WARC archives that store every payload once, by verified SHA-256 digest.

Writing: of equal large payloads one record, a response (smallest id), holds the bytes; the other captures
become revisit records without payload.  Captures that agree in id, URL and payload are one record with a
count.  Spark's text writer puts the records into files in the shared folder (value = header + block, line
separator = the blank lines between records), so any store that Spark reaches will do.

Reading: files come through the binaryFile source and are parsed once, by Content-Length, in mapInPandas,
one record at a time.  The parsed columns are a table; `split_records` makes of it the table of exact header
blocks, which holds no payload, and the content-addressed table of payloads by digest.  `reconstruct` joins
the two and returns the original records; payload digests are recomputed and compared.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, keep_matching, new_path, repeated, written

VERSION = "WARC/1.1"
END = "\r\n\r\n"
#: About the headers of a record.
HEADER_BYTES = 700
RECORD_SCHEMA = "page_id string, record_type string, headers string, http_headers string, payload binary, payload_digest string, refers_to string, copies long"


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """Names a record by its page, URL and payload; null differs from every value."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    h = F.md5(F.concat_ws("\n", part(page_id), part(url), part(digest)).cast("binary"))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def build_records(pages: DataFrame, min_payload: int = 100, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record): WARC records as text, without the closing blank lines.

    A null payload is empty; a null or blank URL leaves its header out; control characters in a URL are
    percent-encoded.  Of equal payloads of at least min_payload bytes the smallest page_id (null last)
    is the response.  Rows that repeat that page_id are captures of one page: equal ones are one record
    that counts its copies, those of other URLs are stored without payload; all read back as responses.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    p = p.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    # Counted in two steps, both with partial sums: (digest, id) -> digest.
    per_id = p.where(F.col("bytes") >= min_payload).groupBy("digest", "page_id").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("url").isNull(), "url")).alias("url"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("id"), "rows", "url")).alias("first")
    known = per_id.groupBy("digest").agg(F.sum("rows").alias("n"), first).where("n > 1")
    known = known.select("digest", "n", F.lit(True).alias("known"), F.col("first.id").alias("first_id"), F.col("first.rows").alias("first_rows"), F.col("first.url.url").alias("first_url"))
    p = join_counted(p, written(known, "warc-known"), "digest", "n", "left")
    own = F.col("known").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id"))
    many = own & (F.col("first_rows") > 1)
    # The captures of a repeated page: one row per URL, made where the rows lie.
    columns = ["page_id", "url", "bytes", "digest", "known", "first_id", "first_url"]
    counted = p.where(many).groupBy(*columns).agg(F.count("*").alias("copies"), F.first("payload").alias("payload"))
    p = p.where(~many).select(*columns, F.lit(1).cast("long").alias("copies"), "payload").unionByName(counted)
    same_url = F.col("url").eqNullSafe(F.col("first_url"))
    p = p.withColumn("revisit", F.col("known").isNotNull() & ~(own & same_url))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    header = F.concat(
        F.lit(VERSION + "\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.nullif(url, F.lit(""))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("first_id"), F.col("first_url"), F.col("digest"))), F.coalesce(line("X-Refers-To-Page", F.col("first_id").cast("string")), F.lit("")))).otherwise(""),
        F.coalesce(line("X-Page", F.col("page_id").cast("string")), F.lit("")),
        F.when(F.col("copies") > 1, line("X-Copies", F.col("copies").cast("string"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    return p.withColumn("block", block).select("page_id", F.concat(header, F.lit("\r\n"), F.col("block")).alias("record"))


def write_archives(records: DataFrame, path: str, file_bytes: int = 32 << 20, total_bytes: int | None = None) -> str:
    """Write records to gzip-compressed archives of about file_bytes each (before compression).

    total_bytes: about the size of all records, where it is known; else they are built once more to learn it."""
    if total_bytes is None:
        total_bytes = records.agg(F.sum(F.octet_length("record"))).first()[0] or 0
    files = max(1, -(-int(total_bytes) // file_bytes))
    records.repartition(files, F.xxhash64("record")).select("record").write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


def _parse(stream: io.BufferedIOBase) -> Iterator[tuple[bytes, bytes]]:
    """(header block with its blank line, block) of every record."""
    while True:
        head = []
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
        if not head:
            if line == b"":
                return
            continue
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head[1:])}
        block = stream.read(int(fields[b"content-length"]))
        if not head[0].startswith(b"WARC/") or len(block) != int(fields[b"content-length"]):
            raise ValueError("broken WARC record")
        yield b"".join(head) + b"\r\n", block


def read_archives(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of all archives below a path, in the columns of RECORD_SCHEMA, ids as numbers; digests as stored."""

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        rows, held = [], 0
        for frame in files:
            for content in frame["content"]:
                stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                for head, block in _parse(io.BufferedReader(stream)):
                    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = fields["warc-type"]
                    page, refers, copies = fields.get("x-page"), fields.get("x-refers-to-page"), int(fields.get("x-copies", 1))
                    rows.append((page, kind, head.decode(), (http + b"\r\n\r\n").decode(), payload if kind == "response" else None, fields["warc-payload-digest"].removeprefix("sha256:"), refers, copies))
                    held += len(block)
                    if held > batch_bytes or len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD_SCHEMA)
    return written(raw.withColumns({x: F.col(x).cast("long") for x in ("page_id", "refers_to")}), "warc-parsed", "zstd")


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers without payloads, payloads by digest) of parsed records; small payloads can stand several times."""
    return records.drop("payload"), records.where("record_type = 'response'").select("payload_digest", "payload")


def reconstruct(records: DataFrame) -> DataFrame:
    """Original records: every header block joined to the payload its digest names.

    Returns page_id, record_type, refers_to, headers, http_headers, payload, payload_digest, one row per
    capture; the digest is recomputed from the payload and must equal the stored one.  A record that
    refers to its own page is a response whose payload stands in an earlier one.  Only the payloads that
    revisits name take part in a join; its other side holds headers only, so a hot digest moves no bytes.
    """
    headers, payloads = split_records(records)
    visits = headers.where("record_type = 'revisit'")
    named = written(visits.groupBy("payload_digest").agg(F.count("*").alias("n")), "warc-named")
    stored = keep_matching(payloads, named.select("payload_digest"), ["payload_digest"]).groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    columns = ["page_id", "record_type", "refers_to", "headers", "http_headers", "payload", "payload_digest", "copies"]
    again = visits.join(written(stored, "warc-stored", "zstd"), "payload_digest", "left")
    whole = records.where("record_type = 'response'").select(columns).unionByName(again.select(columns))
    digest = F.sha2("payload", 256)
    broken = F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("payload_digest")))
    own = F.col("refers_to").eqNullSafe(F.col("page_id"))
    whole = whole.withColumns({"payload_digest": F.when(digest == F.col("payload_digest"), digest).otherwise(broken), "record_type": F.when(own, "response").otherwise(F.col("record_type")), "refers_to": F.when(~own, F.col("refers_to"))})
    return repeated(whole, "copies").drop("copies")


def archive_pages(pages: DataFrame, path: str | None = None, **names) -> DataFrame:
    """Write pages to archives and read them back: the reconstructed records, one per input row."""
    spark = pages.sparkSession
    # Records are built once: payloads and HEADER_BYTES a page bound their size from above.
    html = names.get("html_col", "html")
    total = pages.agg(F.sum(F.octet_length(F.coalesce(F.col(html), F.lit(""))) + HEADER_BYTES)).first()[0] or 0
    path = write_archives(build_records(pages, **names), path or new_path(spark, "warc"), total_bytes=total)
    return reconstruct(read_archives(spark, path))
