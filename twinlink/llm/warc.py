"""WARC archives: transactions written from pages, records read back, captures assembled.

Writing: every page becomes a transaction of a response (or revisit), a request and a
metadata record, the latter two concurrent to the first.  Payload digests are counted in a
narrow pass; of pages with equal payloads the one with the largest id is the response,
the others are revisits, which carry the digest and no payload.  Record texts are native
expressions; tasks pack them to bundles of at most ``BUNDLE_BYTES`` (or one page), each
behind a warcinfo record, and Spark's text writer puts ``BUNDLES`` of them in a file.

Reading: files (plain or gzip, of any writer) are parsed record by record by their
Content-Length, so payloads may hold anything, record separators too.  A file is one task's;
its size is the writer's bound.

Assembly: responses and revisits, requests and metadata are joined through
WARC-Concurrent-To; one nested row comes of each capture.  A revisit's original is found by
its payload digest among the responses.

Edge cases: null payloads are empty; a null id is the smallest, and its metadata record names
no page; rows that repeat the largest id of a payload are all responses; control characters
in addresses are percent-encoded, a null address is left out; captures without a request or
metadata stay, with null in their place; of several requests or metadata records of a
capture the one with the smallest record id is nested and their number told.  An empty table gives an
archive of no captures.  Other columns are not read.  A malformed record fails the job.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinlink.session import ensure_checkpoint_dir, scratch_dir
from .frames import batch_of, small, written

BUNDLE_BYTES = 4 << 20
BUNDLES = 8

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE, GAP = "\r\n", "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

RECORD = ("type string, record_id string, concurrent_to string, target_uri string, date string, refers_to_uri string, "
          "payload_digest string, block_bytes long, payload_bytes long, sha1 string, told_bytes long, "
          "fields map<string,string>, payload binary")


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 SHA-1 of a text's bytes; five hex digits are four of base 32."""
    digest = F.sha1(text.cast("binary"))
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, _BASE32_HEX, _BASE32)


def _header(kind: str, record_id: Column, date: str, *fields: Column) -> list[Column]:
    return [F.lit(f"{VERSION}{LINE}WARC-Type: {kind}{LINE}WARC-Record-ID: <urn:uuid:"), record_id,
            F.lit(f">{LINE}WARC-Date: {date}{LINE}"), *fields]


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def _block(kind: str, block: Column) -> list[Column]:
    return [F.lit(f"Content-Type: {kind}{LINE}Content-Length: "), F.octet_length(block).cast("string"), F.lit(GAP), block]


def _address(column: Column) -> Column:
    """An address as it may stand in a header line."""
    text = column.cast("string")
    for char in "\r\n\t \x00":
        text = F.replace(text, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return text


def transactions(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                 min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """``record``: the three records of every page's transaction as one text."""
    rows = pages.select(pages[id_col].alias("id"), _address(pages[uri_col]).alias("uri"),
                        F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": sha1_base32(F.col("payload"))})
    # Payloads that occur more than once, with their last page; a narrow pass, pre-aggregated.
    shared = (rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
              .agg(F.max(F.struct("id", "uri")).alias("last"), F.count("*").alias("copies")).where("copies > 1"))
    shared = written(shared.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "last"), "warc-shared")
    rows = rows.join(small(shared), (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    revisit = F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")["id"])
    ids = {k: F.expr("uuid()") for k in ("own_id", "request_id", "metadata_id")}
    rows = rows.select("id", "uri", "payload", "bytes", "digest", "last", revisit.alias("revisit"), *[v.alias(k) for k, v in ids.items()])

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(GAP))
    about = [_field("WARC-Target-URI", F.col("uri")), F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(LINE)]
    response = F.concat(*_header("response", F.col("own_id"), date, *about),
                        *_block("application/http; msgtype=response", F.concat(http, F.col("payload"))))
    again = F.concat(*_header("revisit", F.col("own_id"), date, *about, F.lit(f"WARC-Profile: {REVISIT_PROFILE}{LINE}"),
                              _field("WARC-Refers-To-Target-URI", F.col("last")["uri"]), F.lit(f"WARC-Refers-To-Date: {date}{LINE}")),
                     *_block("application/http; msgtype=response", http))
    to = [F.lit("WARC-Concurrent-To: <urn:uuid:"), F.col("own_id"), F.lit(f">{LINE}"), _field("WARC-Target-URI", F.col("uri"))]
    request = F.concat(*_header("request", F.col("request_id"), date, *to),
                       *_block("application/http; msgtype=request",
                               F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(f" HTTP/1.1{GAP}"))))
    metadata = F.concat(*_header("metadata", F.col("metadata_id"), date, *to),
                        *_block("application/warc-fields", F.concat(_field("page-id", F.col("id").cast("string")),
                                                                    _field("payload-bytes", F.col("bytes").cast("string")))))
    return rows.select(F.concat_ws(GAP, F.when(F.col("revisit"), again).otherwise(response), request, metadata).alias("record"))


def _bundles(batches):
    """Texts joined to bundles of at most ``BUNDLE_BYTES``, or of one text."""
    about = f"format: {VERSION}{LINE}"
    info = (f"{VERSION}{LINE}WARC-Type: warcinfo{LINE}WARC-Record-ID: <urn:uuid:%s>{LINE}WARC-Date: 2000-01-01T00:00:00Z{LINE}"
            f"Content-Type: application/warc-fields{LINE}Content-Length: {len(about)}{GAP}{about}")

    def bundle(texts):
        digest = hashlib.md5("".join(t[:200] for t in texts).encode()).hexdigest()
        name = "-".join(digest[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))
        return batch_of([pa.array([GAP.join([info % name, *texts])], pa.string())], ["value"])

    held, size = [], 0
    for batch in batches:
        for scalar in batch.column(0):
            text = scalar.as_py()
            if held and size + len(text) > BUNDLE_BYTES:
                yield bundle(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
    if held:
        yield bundle(held)


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write the pages' transactions as WARC files under ``path``; ``options`` as in ``transactions``."""
    (transactions(pages, **options).mapInArrow(_bundles, "value string").write.option("lineSep", GAP)
     .option("maxRecordsPerFile", BUNDLES).text(path))


def _members(data: bytes):
    """The bytes of a file; those of a gzip file member by member."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        stream = zlib.decompressobj(31)
        yield stream.decompress(data)
        if not stream.eof:
            raise ValueError("a gzip member is cut off")
        data = stream.unused_data


def _fields(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.decode("utf-8", "replace").split(LINE):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _record(head: dict[str, str], block: memoryview, payloads: bool) -> tuple:
    kind, body, told, fields = head.get("content-type", ""), None, None, None
    if kind.startswith("application/http"):
        raw = bytes(block[:1 << 16])
        end = raw.find(GAP.encode())
        if end < 0:
            raw = bytes(block)
            end = raw.find(GAP.encode())
        http = _fields(raw[:end] if end >= 0 else raw)
        body = block[end + len(GAP):] if end >= 0 else block[len(block):]
        told = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    elif kind.startswith("application/warc-fields"):
        fields = _fields(bytes(block))
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode() if body is not None else None
    return (head.get("warc-type"), head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"),
            head.get("warc-date"), head.get("warc-refers-to-target-uri"),
            head["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in head else None,
            len(block), len(body) if body is not None else None, sha1, told, list(fields.items()) if fields is not None else None,
            bytes(body) if payloads and body is not None else None)


def parsed(data: bytes, payloads: bool = True):
    """The records of a file's bytes, as tuples of ``RECORD``."""
    gap = GAP.encode()
    for part in _members(data):
        view, at = memoryview(part), 0
        while True:
            while part[at:at + 2] == b"\r\n":
                at += 2
            if at >= len(part):
                break
            end = part.find(gap, at)
            head = _fields(part[at:end]) if end >= 0 and part[at:at + 5] == b"WARC/" else {}
            if not head.get("content-length", "").isdigit() or end + len(gap) + int(head["content-length"]) > len(part):
                raise ValueError(f"no whole WARC record at byte {at}")
            first = end + len(gap)
            at = first + int(head["content-length"])
            yield _record(head, view[first:at], payloads)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row (``RECORD``) for each record of the archives under ``path``; without ``payloads`` their bytes are
    hashed and counted only."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def rows_of(held):
        return batch_of([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    def parse(batches):
        for batch in batches:
            for scalar in batch.column(0):
                held, size = [], 0
                for row in parsed(scalar.as_py(), payloads):
                    held.append(row)
                    size += 1000 + len(row[-1] or b"")
                    if size >= BUNDLE_BYTES:
                        yield rows_of(held)
                        held, size = [], 0
                if held:
                    yield rows_of(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(parse, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, and the request and metadata concurrent to it."""
    def beside(kind, *columns):
        rows = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return rows.groupBy("concurrent_to").agg(F.min_by(F.struct("record_id", *columns), "record_id").alias(kind),
                                                 F.count("*").alias(f"n_{kind}")).withColumnRenamed("concurrent_to", f"{kind}_of")
    main = records.where(F.col("type").isin("response", "revisit"))
    payload = F.struct("payload_digest", "payload_bytes", "sha1", "told_bytes", "payload").alias("http")
    main = main.select("record_id", "type", "target_uri", "date", "refers_to_uri", payload)
    requests, metadata = beside("request", "block_bytes", "date"), beside("metadata", "fields")
    return (main.join(requests, main["record_id"] == requests["request_of"], "left")
            .join(metadata, main["record_id"] == metadata["metadata_of"], "left")
            .select(*main.columns, "request", "metadata", F.coalesce("n_request", F.lit(0)).alias("n_requests"),
                    F.coalesce("n_metadata", F.lit(0)).alias("n_metadata")))


def report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages``, read them back and tell of every page how it is stored."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_dir(spark, "warc-archives")
    write_archives(pages, path, min_bytes=min_bytes)
    records = written(read_records(spark, path, payloads=False), "warc-records")
    first = F.col("type") == "response"
    # A response's figures are those of the bytes read; a revisit holds none and tells its original's.
    rows = captures(records).select(
        F.col("metadata")["fields"]["page-id"].cast(pages.schema["page_id"].dataType).alias("page_id"),
        F.when(first, F.col("http")["payload_bytes"]).otherwise(F.col("http")["told_bytes"]).alias("payload_bytes"),
        F.when(first, F.col("http")["sha1"]).otherwise(F.col("http")["payload_digest"]).alias("payload_digest"),
        F.col("type").alias("record_type"))
    rows = written(rows, "warc-captures")
    again = rows.where("record_type = 'revisit'")
    asked = again.select(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes")).distinct()
    originals = (rows.where("record_type = 'response'").join(
        small(written(asked, "warc-asked")),
        (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("bytes")), "left_semi")
        .groupBy(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes")).agg(F.max("page_id").alias("refers_to")))
    found = again.join(small(written(originals, "warc-originals")),
                       (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("bytes")), "left").drop("digest", "bytes")
    others = rows.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    return others.unionByName(found)
