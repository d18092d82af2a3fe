"""WARC archives with revisit records, written and read back.

``write_archives`` writes a record per page. Of the pages with equal payloads of at least
``least_bytes`` bytes, the one with the largest id keeps its payload in a ``response`` record; the others
become ``revisit`` records without payload that refer to it. Smaller payloads are always kept. Only
headers (id, digest, size) are shuffled by digest; payloads move once, into archives of about
``ARCHIVE_BYTES`` bytes. ``read_archives`` parses the files by their content lengths, so a payload may hold
anything, and ``resolved`` joins revisit records to the records they refer to.

A null payload is an empty one. Pages with a null id are written as responses of their own, and refer to
or serve no other page. Of repeated rows with one id and one payload, one is the response and the others
revisit it. An empty table gives no archive records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.settings import materialize, scratch_path

ARCHIVE_BYTES = 16 << 20
LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # a fixed value
LINE = "\r\n"

RECORDS = (
    "page_id long, record_id string, record_type string, url string, refers_to_record string, "
    "payload_digest string, payload_bytes long, stored_bytes long"
)


def _headers(pages: DataFrame, id_column: str, url_column: str, payload: str) -> DataFrame:
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("html"),
        F.sha1(data).alias("digest"),
        F.octet_length(data).cast("long").alias("bytes"),
    )


def _originals(headers: DataFrame, least_bytes: int) -> DataFrame:
    """For each payload that occurs more than once, the page that keeps it."""
    large = headers.filter(F.col("page_id").isNotNull() & (F.col("bytes") >= least_bytes))
    kept = large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    return kept.filter("n > 1").drop("n")


def _record_id(page) -> F.Column:
    """A name made of the page's id and its payload, in the form of a UUID; without an id, the address
    takes its place."""
    named = F.coalesce(page.cast("string"), F.concat(F.lit("at "), F.coalesce("url", F.lit(""))))
    text = F.md5(F.concat_ws(" ", "digest", named))
    parts = [F.substring(text, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _clean(text) -> F.Column:
    """A header value: no line ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]", "%0A")


def _record_text(date: str) -> F.Column:
    """The whole record but its last two line ends, which the writer adds."""

    def header(name: str, value) -> F.Column:
        value = F.lit(value) if isinstance(value, str) else value
        return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(LINE + LINE),
    )
    revisit = F.col("kept").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    page = F.col("page_id")
    return F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Date", date),
        header("WARC-Target-URI", _clean(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(header("WARC-Profile", PROFILE), header("WARC-Refers-To", F.col("kept_record")))).otherwise(""),
        F.when(page.isNotNull(), header("X-Page-ID", page.cast("string"))).otherwise(""),
        header("Content-Type", "application/http; msgtype=response"),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(LINE),
        block,
    )


def write_archives(
    pages: DataFrame, path: str, *, id_column: str = "page_id", url_column: str = "url",
    payload_column: str = "html", least_bytes: int = LEAST_BYTES, date: str = "2025-01-01T00:00:00Z",
) -> None:
    """Write the pages as gzipped archives below ``path``, a folder that all executors see."""
    headers = _headers(pages, id_column, url_column, payload_column)
    small = materialize(headers.select("page_id", "digest", "bytes"), "payload-headers")
    # written, so that the join can split a digest that many pages have
    originals = materialize(_originals(small, least_bytes), "originals")
    repeated = small.filter("page_id is not null").join(originals, "digest")
    repeated = repeated.groupBy("page_id", "digest", "kept").agg(F.count("*").alias("rows"))
    total = small.agg(F.sum("bytes")).first()[0] or 0
    archives = 1 + total // ARCHIVE_BYTES
    # payloads move once: to the archive of their page, where the header rows meet them
    key = ["page_id", "digest"]
    dealt = headers.repartition(archives, *key).join(repeated.repartition(archives, *key), key, "left")
    # of repeated rows of the page that keeps the payload, the first does
    order = F.row_number().over(Window.partitionBy(*key).orderBy("url"))
    keeps = (F.col("page_id") == F.col("kept")) & ((F.col("rows") == 1) | (F.col("order") == 1))
    kept = F.when(~keeps, F.col("kept"))
    ready = dealt.withColumn("order", order).withColumn("kept", kept)
    ready = ready.withColumn("record_id", _record_id(F.col("page_id")))
    ready = ready.withColumn("kept_record", _record_id(F.col("kept")))
    text = ready.select(_record_text(date).alias("value"))
    text.write.option("lineSep", LINE + LINE).option("compression", "gzip").text(path)


def _parsed(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin = end + 4
        at = begin + int(fields["Content-Length"])
        head = data.index(b"\r\n\r\n", begin, at) + 4
        http = dict(line.split(": ", 1) for line in data[begin : head - 4].decode().split("\r\n")[1:])
        payload = data[head:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {at}")
        at += 4
        kind = fields["WARC-Type"]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not fit its digest")
        page = fields.get("X-Page-ID")
        yield (
            None if page is None else int(page), fields["WARC-Record-ID"], kind,
            fields["WARC-Target-URI"], fields.get("WARC-Refers-To"), digest,
            int(http["Content-Length"]), len(payload), payload,
        )


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives; with ``payloads`` also its stored payload.

    The payload of every response is checked against its digest. ``payload_bytes`` is the size of the
    page's full payload, ``stored_bytes`` of what the record holds.
    """
    schema = RECORDS + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.binary()][:width]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for row in _parsed(gzip.decompress(content.as_py())):
                    rows.append(row[:width])
                    if len(rows) == 1000:
                        yield _batch(rows, kinds, names)
                        rows = []
                if rows:
                    yield _batch(rows, kinds, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def resolved(records: DataFrame) -> DataFrame:
    """Each record as the page it stands for: a revisit takes id and size from what it refers to.

    A revisit whose original is missing or has another digest raises no error; it keeps its own
    digest and has a null ``refers_to``.
    """
    responses = records.filter("record_type = 'response' and page_id is not null").select(
        F.col("record_id").alias("refers_to_record"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_digest").alias("__digest"),
        F.col("payload_bytes").alias("__bytes"),
    )
    revisits = records.filter("record_type = 'revisit'")
    found = revisits.join(responses, "refers_to_record", "left")
    same = F.col("__digest") == F.col("payload_digest")
    out = ["page_id", "record_id", "record_type", "url", "payload_digest", "payload_bytes"]
    size = F.when(same, F.col("__bytes")).otherwise(F.col("payload_bytes"))
    return (
        found.withColumn("payload_bytes", size)
        .select(*out, F.when(same, F.col("refers_to")).alias("refers_to"))
        .unionByName(
            records.filter("record_type = 'response'").select(
                *out, F.lit(None).cast("long").alias("refers_to")
            )
        )
    )


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back, revisits resolved."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    return resolved(materialize(read_archives(spark, path), "records"))
