"""WARC archives with revisit records in place of repeated payloads."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, materialize, shared_path

MIN_PAYLOAD = 100
FILE_BYTES = 16 << 20
#: Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "page_id long, uri string, record_id string, record_type string, refers_to long, payload_digest string, "
    "payload_bytes long, payload binary"
)


def resolve_revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Headers (page_id, payload_digest, refers_to) of the pages that repeat the payload of a smaller page_id.

    Only headers are shuffled, by payload digest, counted map-side first; a payload that very many pages have is no hot
    task; payloads stay where they are. Pages alike in
    page_id and payload are one page here; a null page_id neither refers nor is referred to.
    """
    heads = pages.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_payload))
    heads = materialize(heads.select("payload_digest", "page_id").distinct(), "headers")
    firsts = heads.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n"))
    found = join_counted(heads, materialize(firsts.where("_n > 1"), "first-headers"), "payload_digest", "_n")
    return found.where("page_id > refers_to").select("page_id", "payload_digest", "refers_to")


def _record(date: str):
    """The text of a record: fresh headers, then for a response the payload."""
    uuid = lambda *c: F.regexp_replace(
        F.md5(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("-")) for x in c]).cast("binary")),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>",
    )
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    block = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("payload_bytes"))
    uri = F.coalesce(F.regexp_replace(F.trim("url"), r"\s+", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uuid(F.col("page_id"), F.col("payload_digest"))),
        F.coalesce(line("WARC-Page-ID", F.col("page_id")), F.lit("")),
        line("WARC-Target-URI", uri),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", uuid(F.col("refers_to"), F.col("payload_digest"))),
            line("WARC-Refers-To-Page-ID", F.col("refers_to")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block),
        F.lit("\r\n"),
    )
    return F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("html"), F.lit(""))))


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write page_id, url, html as WARC files under `path`: responses, and revisits of repeated payloads.

    A null html is an empty payload, a null url becomes urn:page:<page_id>; other columns are not read.
    Spark's committer writes the files, so a lost task leaves no half archive.
    """
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    full = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    total = pages.agg(F.sum(F.octet_length("html").cast("long") + 600)).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    revisits = resolve_revisits(full, min_payload)
    placed = full.repartition(files, "page_id", "payload_digest").join(revisits, ["page_id", "payload_digest"], "left")
    placed.select(_record(date).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse_records(data: bytes):
    """(headers, block) of each record of an archive, in turn; blocks are cut by Content-Length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        length = int(head["Content-Length"])
        yield head, data[stop + 4 : stop + 4 + length]
        at = stop + 8 + length


def _read(keep_payload: bool):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def read(batches):
        for batch in batches:
            for data in batch.column("content"):
                data, rows = data.as_buffer().to_pybytes(), []
                if data[:2] == b"\x1f\x8b":
                    data = zlib.decompress(data, 31)
                for head, block in parse_records(data):
                    inner, _, payload = block.partition(b"\r\n\r\n")
                    size = int(inner.rsplit(b"Content-Length: ", 1)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{head['WARC-Record-ID']}: its payload and its digest differ")
                    page, refers = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                    rows.append((page and int(page), head["WARC-Target-URI"], head["WARC-Record-ID"], head["WARC-Type"], refers and int(refers), digest, size, payload if keep_payload else None))
                    if len(rows) >= 1000:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    return read


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """The records of the archives under `path`; each response's payload is held against its digest.

    A file is read whole, so memory is bounded by the size of a file (`file_bytes` when written here).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read(keep_payload), SCHEMA)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives and return what the archives hold."""
    path = path or shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
