"""A content-addressed WARC archive.

Two Parquet tables in one folder: payloads (a row per distinct payload, named by its SHA-256, as a zstandard frame) and
headers (a row per record: the exact bytes of its WARC header block, and the name of its payload). A record is rebuilt by
joining the two: header, payload (none for a revisit), CRLF CRLF. The name of a payload is verified whenever it is read.

Defined cases: a null payload is an empty one; rows without a page id come last when a group's response is chosen,
and if no row of a group has one, all its records are responses; of rows that share the largest page id of their group
the first by address is the response; CR and LF in an address are percent-encoded; an id of no characters reads back as null; an empty
table gives an empty archive; other columns are left out.

Scale: payloads are compressed before anything is shuffled, and aggregated by digest in each task, so that each task sends
a payload once. Groups of equal payloads are reduced to a row; the joins are ones that AQE splits, and what they shuffle
are headers and frames. Records are rebuilt in slices of about SLICE bytes.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.windows import numbered
from .common import CODEC, bounded, release, stash, stash_path, table

CRLF = "\r\n"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payloads that a task holds uncompressed at once (about; a larger payload stands alone).
SLICE = 16 << 20


def base32_sha1(payload):
    """The bare upper-case base32 SHA-1 of a binary column: 40 hex digits, five at a time as four digits of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _named(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn(
        "sha256", F.sha2("payload", 256)
    )


def _record_id(page_id, digest, number=None):
    """A page's name; of rows with one page id and payload the second and further ones have their number in it."""
    more = F.lit("") if number is None else F.when(number > 1, F.concat(F.lit(":"), number.cast("string"))).otherwise("")
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(":"), digest, more, F.lit(">"))


def _with_number(facts: DataFrame) -> DataFrame:
    """facts with nth: a row's number among those of its page id and payload. Only rows that repeat are shuffled for it."""
    many = facts.groupBy(F.col("page_id").alias("_id"), F.col("sha256").alias("_sha")).agg(F.count("*").alias("_n"))
    many = stash(many.where("_n > 1").select("_id", "_sha"), "warc-repeated")
    if not many.limit(1).count():
        return facts.withColumn("nth", F.lit(1).cast("long"))
    on = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha256") == F.col("_sha"))
    marked = facts.join(bounded(many), on, "left").drop("_id")
    alone = marked.where(F.col("_sha").isNull()).drop("_sha").withColumn("nth", F.lit(1).cast("long"))
    return alone.unionByName(numbered(marked.where(F.col("_sha").isNotNull()).drop("_sha"), ["sha256", "page_id"], ["url"], "nth"))


def _framed(batches):
    """sha256, payload: payloads as zstandard frames."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        frames = [pack(x.as_buffer()) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(frames, pa.binary())], names=["sha256", "payload"])


def _opened(names, frames) -> list[bytes]:
    """The payloads of frames, each verified."""
    unpack, out = zstandard.ZstdDecompressor().decompress, []
    for name, frame in zip(names, frames):
        try:
            payload = unpack(frame)
        except zstandard.ZstdError:
            payload = None
        if payload is None or hashlib.sha256(payload).hexdigest() != name:
            raise ValueError(f"payload does not match its digest {name}")
        out.append(payload)
    return out


def _slices(batch, at: int):
    """Slices of a batch with about SLICE bytes of payloads, by the sizes that the frames in column `at` state."""
    lo = held = 0
    for i, frame in enumerate(batch.column(at).to_pylist()):
        try:
            size = max(zstandard.frame_content_size(frame), 0)
        except zstandard.ZstdError:
            size = 0
        if held and held + size > SLICE:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += size
    if lo < len(batch):
        yield batch.slice(lo)


def write_archive(pages: DataFrame, path: str, least: int = 0, page_id="page_id", url="url", payload="html", date="2024-01-01T00:00:00Z") -> None:
    """Writes the archive of pages to path. Payloads of fewer than `least` bytes are never made revisits."""
    named = _named(pages, page_id, url, payload)
    facts = stash(
        named.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1")),
        "warc-facts",
    )
    frames = named.select("sha256", "payload").mapInArrow(_framed, "sha256 string, payload binary")
    frames.groupBy("sha256").agg(F.first("payload").alias("payload")).write.option("compression", CODEC).parquet(f"{path}/payloads")
    groups = stash(facts.groupBy("sha256").agg(F.max("page_id").alias("response_id")), "warc-groups")
    rows = _with_number(facts).join(groups, "sha256", "left")
    response = F.col("page_id").eqNullSafe(F.col("response_id")) & (F.col("nth") == 1)
    revisit = (F.col("bytes") >= least) & F.col("response_id").isNotNull() & ~response
    rows = rows.withColumn("revisit", revisit)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("sha1"), F.col("nth"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            F.col("revisit"),
            F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("response_id"), F.col("sha1")))),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisit"), F.lit(0).cast("long")).otherwise(F.col("bytes")).cast("string")),
        F.lit(CRLF),
    )
    rows.select("sha256", F.encode(head, "UTF-8").alias("header")).write.option("compression", CODEC).parquet(f"{path}/headers")


def _payload_frames(spark, path: str) -> DataFrame:
    return spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")


def read_payloads(spark, path: str) -> DataFrame:
    """sha256, payload; fails on a payload whose digest isn't its name."""

    def run(batches):
        for whole in batches:
            for b in _slices(whole, 1):
                payloads = _opened(b.column(0).to_pylist(), b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(payloads, pa.binary())], names=["sha256", "payload"])

    return _payload_frames(spark, path).mapInArrow(run, "sha256 string, payload binary")


def read_headers(spark, path: str, kind: str = "long") -> DataFrame:
    """sha256, header and the header's fields: page_id, url, record_type, payload_digest, refers_to, content_length.

    kind: the type of the page ids.
    """
    stored = spark.read.schema("sha256 string, header binary").parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    field = lambda name, rest="([^\\r\\n]*)": F.regexp_extract(text, f"\\r\\n{name}: {rest}\\r\\n", 1)
    page = lambda name: F.url_decode(F.nullif(field(name, "<urn:page:([^:]*):[A-Z2-7]+(?::[0-9]+)?>"), F.lit(""))).cast(kind)
    return stored.select(
        "sha256",
        "header",
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        page("WARC-Refers-To").alias("refers_to"),
        field("Content-Length").cast("long").alias("content_length"),
    )


def record_of(header: bytes, payload: bytes) -> bytes:
    """A record's exact bytes; a revisit has no block."""
    block = b"" if b"\r\nWARC-Type: revisit\r\n" in header else payload
    return header + block + b"\r\n\r\n"


def _rebuilt(spark, path: str, made: str, make, kind: str = "long") -> DataFrame:
    """The header's fields and what make(record, payload) gives, for every record rebuilt from its header and payload."""
    headers = read_headers(spark, path, kind)
    # every header names a payload, so a missing one fails as one that doesn't match
    rows = headers.join(_payload_frames(spark, path).withColumnRenamed("payload", "_frame"), "sha256", "left")
    rows = rows.withColumn("_frame", F.coalesce("_frame", F.lit(b"")))
    schema = StructType.fromDDL(made)
    k, names = len(headers.columns), [*headers.columns, *schema.names]

    def run(batches):
        types = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
        kinds = [types[f.dataType.simpleString()] for f in schema]
        for whole in batches:
            for b in _slices(whole, k):
                payloads = _opened(b.column(0).to_pylist(), b.column(k).to_pylist())
                own = [make(record_of(h, p), p) for h, p in zip(b.column(1).to_pylist(), payloads)]
                cols = list(zip(*own)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)
        release()

    return rows.select(*headers.columns, "_frame").mapInArrow(run, StructType([*headers.schema, *schema]))


def read_records(spark, path: str, kind: str = "long") -> DataFrame:
    """The records rebuilt: the header's fields, payload (the full one, for revisits too) and record, the exact bytes."""
    return _rebuilt(spark, path, "payload binary, record binary", lambda record, payload: (payload, record), kind)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and the block of a record; fails if its length or end isn't as stated."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split(CRLF)
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"not a record: {fields.get('WARC-Record-ID')}")
    return fields, rest[:n]


def _checked(record: bytes, payload: bytes) -> tuple[int, str]:
    """Length and SHA-1 of a record's full payload: its own block, or for a revisit that of the record it refers to."""
    fields, block = parse(record)
    whole = payload if fields["WARC-Type"] == "revisit" else block
    digest = base64.b32encode(hashlib.sha1(whole).digest()).decode()
    if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
        raise ValueError(f"payload does not match its digest {digest}")
    return len(whole), digest


def export_warc(spark, path: str, to: str) -> None:
    """Plain WARC files of the archive's records, as one stream of records a file, gzip-compressed."""
    rows = read_records(spark, path)
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    records = rows.select(F.concat(F.decode("header", "UTF-8"), block).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(to)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path, pages = stash_path(spark, "warc"), table(spark, sf_dir, "pages")
    write_archive(pages, path)
    rows = _rebuilt(spark, path, "payload_bytes long, digest string", _checked, pages.schema["page_id"].dataType.simpleString())
    return rows.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h,
         row_number() OVER (PARTITION BY encode(coalesce(html, '')), page_id ORDER BY url) AS nth FROM pages
), g AS (SELECT body, max(page_id) AS response_id FROM p GROUP BY body),
b AS (
  SELECT p.page_id, octet_length(p.body) AS n, p.h, g.response_id,
         coalesce(g.response_id IS NOT NULL AND (p.page_id IS DISTINCT FROM g.response_id OR p.nth > 1), false) AS revisit
  FROM p JOIN g ON p.body = g.body
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN revisit THEN response_id END AS refers_to
FROM b
"""
