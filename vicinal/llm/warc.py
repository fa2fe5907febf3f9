"""WARC archives, index first: write offset, length, URL and digest per record, then coalesce sorted byte-range reads.

Writing: of the pages with equal payloads that are large enough, the one with the largest id is a response, the others are
revisits that refer to it and carry no payload. Every record is a gzip member of its own, so a byte range is readable
alone. A task writes files of its own, named by a random id, into a folder of any store that pyarrow reaches; the
index rows it returns are the commit record, so files of a lost or repeated task are merely never referred to.

Reading: index rows are sorted by file and offset, neighbours whose gap is small are merged into ranges of bounded
size, and each range is one read. Digest and length of every response are recomputed from the payload.

Defined results: a null payload is empty; null URLs are written as empty; of repeated rows (one id and payload) each is a response if
its id is the largest of its payload's, else a revisit, so equal rows have equal results; rows with a null id count
below all others; an empty table gives an empty index; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._held import tidy
from ._prefilter import marked
from ._session import fresh_dir, written

INDEX = "page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint, file string, offset bigint, length bigint"
#: A file is closed beyond this size; a range is read up to RANGE bytes at once, over gaps of at most GAP.
FILE_BYTES, RANGE_BYTES, GAP_BYTES = 128 << 20, 4 << 20, 64 << 10
#: Bytes of records that a reading task gets, about.
READ_BYTES = 16 << 20
#: Pages of one digest that meet one copy of its row, copies at most, and hot digests that may be broadcast.
HOT_ROWS, MOST_DEALS, MOST_HOT = 100_000, 4096, 100_000


def digest_column(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from built-in expressions: 20 bits are 5 hex digits and 4 base32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decided(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Pages with their digest, record type and referred response.

    The largest id of each digest that several pages have is a partial aggregate, written as a narrow table. Pages whose digest is surely
    alone meet nothing and stay where they are, so only payloads that several pages have are shuffled, and none if the table is small. A hot
    digest's row is copied once for every HOT_ROWS of its pages, which are dealt among the copies.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        payload.alias("payload"),
        digest_column(payload).alias("payload_digest"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
    )
    top = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    shared = written(top.where(F.col("n") > 1), "shared-digests")
    most = shared.agg(F.max("n")).first()[0] or 1
    deals = min(MOST_DEALS, -(-most // HOT_ROWS))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(deals), F.ceil(F.col("n") / HOT_ROWS)) - 1)).alias("deal")
    maybe = marked(rows, "payload_digest", shared.select("payload_digest"), "payload_digest", "__shared")
    alone = maybe.where("NOT __shared").drop("__shared").withColumn("top", F.lit(None).cast("bigint"))
    several = maybe.where("__shared").drop("__shared")
    if deals == 1:
        several = several.join(shared.select("payload_digest", "top"), "payload_digest", "left")
    else:  # which copy a page meets depends on its digest's number of pages, a narrow join beforehand
        sizes = shared.where(F.col("n") > HOT_ROWS).select("payload_digest", F.least(F.lit(deals), F.ceil(F.col("n") / HOT_ROWS)).alias("deals"))
        several = several.join(F.broadcast(sizes) if sizes.count() <= MOST_HOT else sizes, "payload_digest", "left")
        several = several.withColumn("deal", F.pmod(F.xxhash64("page_id"), F.coalesce("deals", F.lit(1)))).drop("deals")
        several = several.join(shared.select("payload_digest", "top", copies), ["payload_digest", "deal"], "left").drop("deal")
    joined = alone.unionByName(several)
    # A digest that only seemed to be shared, or is shared by pages without ids, has no top.
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (F.col("payload_bytes") >= least_bytes)
    return joined.select(
        "page_id", "url", "payload_digest", "payload_bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("top")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def record(row: dict) -> bytes:
    """One WARC/1.1 record. An id that is null is written as an empty identifier."""
    page, to = row["page_id"], row["refers_to"]
    body = row["payload"] or b""
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"), "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: text/html", f"Content-Length: {len(body)}",
    ]
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The record's own account of itself; digest and length of a response come from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(field["Content-Length"])
    body = rest[:n]
    if len(body) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    kind = field["WARC-Type"]
    name = field["WARC-Record-ID"].removeprefix("<urn:page:").rstrip(">")
    told = field["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if found != told:
            raise ValueError(f"digest of record {name} differs")
    to = field.get("WARC-Refers-To", "").removeprefix("<urn:page:").rstrip(">")
    return {
        "page_id": int(name) if name else None, "url": field["WARC-Target-URI"], "payload_digest": told,
        "payload_bytes": n if kind == "response" else int(field["X-Payload-Length"]),
        "record_type": kind, "refers_to": int(to) if to and to != "None" else None, "payload": body,
    }


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Write the archives into folder; returns the index, a written table."""

    @tidy
    def run(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, path, at = None, "", 0
        try:
            for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
                rows = []
                for row in b.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                        out, at = files.open_output_stream(path, compression=None), 0
                    data = gzip.compress(record(row), compresslevel=1, mtime=0)
                    out.write(data)
                    del row["payload"]
                    rows.append(row | {"file": path, "offset": at, "length": len(data)})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return written(decided(pages, least_bytes, **columns).mapInArrow(run, INDEX), "warc-index")


_INDEX = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
_READ = pa.schema([f for f in _INDEX if f.name not in ("file", "offset", "length")] + [pa.field("payload", pa.binary())])


def ranges(index: DataFrame) -> DataFrame:
    """Byte ranges that cover the records of an index: file, begin, end, and each record's place (offset, length).

    Within a file, records are sorted by offset; a new range begins after a gap, and where a record begins in another
    RANGE_BYTES than the one before. The windows hold one file each, which FILE_BYTES bounds.
    """
    by_file = Window.partitionBy("file").orderBy("offset")
    cell = F.floor(F.col("offset") / RANGE_BYTES)
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by_file) > GAP_BYTES
    fresh = F.coalesce((gap | (F.lag(cell).over(by_file) != cell)).cast("int"), F.lit(1))
    marked = index.select("file", "offset", "length", fresh.alias("fresh")).withColumn("range", F.sum("fresh").over(by_file))
    return marked.groupBy("file", "range").agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"),
    )


def read_archives(spark: SparkSession, folder: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of an index point to, read back from the archives."""

    @tidy
    def run(batches):
        files, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for one in b.to_pylist():
                with files.open_input_file(one["file"]) as f:
                    data = f.read_at(one["end"] - one["begin"], one["begin"])
                got = []
                for p in one["places"]:
                    a = p["offset"] - one["begin"]
                    row = parsed(zlib.decompress(data[a : a + p["length"]], wbits=31))
                    if not payloads:
                        row["payload"] = None
                    got.append(row)
                yield pa.RecordBatch.from_pylist(got, schema=_READ)

    schema = INDEX.split(", file")[0] + ", payload binary"
    # The ranges are few rows but much work each, so the number of tasks follows the bytes that they read.
    found = ranges(index)
    n_bytes = index.agg(F.sum("length")).first()[0] or 0
    return found.repartition(max(1, -(-n_bytes // READ_BYTES)), "file", "range").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Write all pages and read every record back."""
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    index = write_archives(pages, folder, least_bytes, **columns)
    return read_archives(spark, folder, index, payloads=False)


def oracle_sql(least_bytes: int = 0) -> str:
    """DuckDB: base32 from 20 bits at a time."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {a}, 5))::BIGINT >> {s}) & 31)::INTEGER, 1)"
    b32 = " || ".join(digit.format(a=5 * i + 1, s=s) for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, n, {b32} AS digest FROM p
), t AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {least_bytes} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {least_bytes} AND page_id <> top THEN top END AS refers_to
FROM t
"""
