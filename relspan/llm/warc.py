"""Content-addressed WARC archive: payload bytes stored once by SHA-256, exact record headers apart, records by joins.

``write_archive`` makes three things in a folder: payloads/, WARC files whose records hold each distinct payload once under its
digest; index/, a table of where each of these stands; and headers/, a table with the exact header bytes of every record and
its payload's digest. ``records`` joins headers with the index and fetches the payloads for the original record bytes, and ``export_records`` writes these as WARC files, which ``read_records``
parses; the query's columns are what it finds there.
A record with a payload of at least MIN_BYTES that an earlier page has too is a revisit.

Defined cases: null html is an empty payload; a null url is left out of the header; equal payloads are compared by digest and
length; among rows that repeat the smallest page_id each is a response; a null page_id never is the page that others
revisit, and is a response; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.llm.common import python_ready, small_side
from relspan.llm.encoding import open_file, open_places, write_file
from relspan.sources.scratch import new_folder, staged

MIN_BYTES = 100
LEVEL = 1  # of gzip, each record a member of its own
_DATE = "1970-01-01T00:00:00Z"
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r$", re.M)


def record_id(page_id: int | None, again: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{again}')}>"


def header(page_id: int | None, url: str | None, kind: str, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """The exact header block of a record, blank line included."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else n_bytes}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_records(data: Iterator[bytes] | object) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, header block, payload) of each record of an uncompressed WARC stream; lengths decide, not blank lines."""
    while True:
        lines = []
        while line := data.readline():
            lines.append(line)
            if line == b"\r\n":
                break
        if not lines:
            return
        block = b"".join(lines)
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(block)}
        payload = data.read(int(fields["content-length"]))
        if data.read(4) != b"\r\n\r\n" or len(payload) != int(fields["content-length"]):
            raise ValueError("a record does not end where its length says")
        yield fields, block, payload


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, record_type, refers_to, stored) of every row; html is read but not shuffled.

    stored: this page's row holds the payload for all equal ones.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = staged(pages.select("page_id", "url", F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes")), "digests")
    first = own.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = own.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.coalesce((F.col("first") != F.col("page_id")) & (F.col("payload_bytes") >= MIN_BYTES), F.lit(False))
    out = out.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first")), "stored": F.coalesce(F.col("first") == F.col("page_id"), F.col("first").isNull())})
    return staged(out.drop("first"), "records")


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archive; returns its headers table (page_id, payload_digest, payload_bytes, record_type, refers_to, header, part).

    Pages that hold a payload are found by page_id, which no group of equal payloads shares; each task writes the payloads
    that it meets to one file, a gzip member a record.
    """
    spark = pages.sparkSession
    python_ready(spark)
    rows = classify(pages)
    keep = rows.where("stored").select("page_id", "payload_digest").distinct()
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    held = pages.select("page_id", body.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    twice = staged(rows.where("stored").groupBy("payload_digest").count().where("count > 1").select("payload_digest"), "twice")  # by rows that repeat, or that have no page_id
    everything = rows.where("NOT stored").isEmpty()
    held = held if everything else held.join(keep.withColumnRenamed("page_id", "__page"), (F.col("page_id").eqNullSafe(F.col("__page"))) & (held.payload_digest == keep.payload_digest), "left_semi")
    if not twice.isEmpty():
        held = held.join(twice, "payload_digest", "left_anti").unionByName(held.join(twice, "payload_digest", "left_semi").dropDuplicates(["payload_digest"])).select("page_id", "payload", "payload_digest")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        digests: list[str] = []
        offsets, sizes = array("q"), array("q")

        def members(parts: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
            nonlocal at
            for b in parts:
                for digest, payload in zip(b.column("payload_digest").to_pylist(), b.column("payload").to_pylist()):
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload does not match its digest")
                    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: {record_id(None, digest)}\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: urn:sha256:{digest}\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                    member = gzip.compress(head.encode() + payload + b"\r\n\r\n", LEVEL, mtime=0)
                    digests.append(digest)
                    offsets.append(at)
                    sizes.append(len(member))
                    at += len(member)
                    yield member

        write_file(f"{folder}/payloads/{part:06d}.warc.gz", members(batches))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array([part] * len(digests), pa.int64()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], ["payload_digest", "part", "offset", "length"])

    held.mapInArrow(store, "payload_digest string, part long, offset long, length long").write.parquet(f"{folder}/index")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"]
        for b in batches:
            h = [header(*x) for x in zip(*(b.column(c).to_pylist() for c in names))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "payload_digest")), pa.array(h, pa.binary())], ["page_id", "payload_digest", "header"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows.mapInArrow(heads, f"page_id {kind}, payload_digest string, header binary").write.parquet(f"{folder}/headers")
    spark.read.parquet(f"{folder}/index").select("part").distinct().coalesce(1).write.parquet(f"{folder}/parts")
    return spark.read.parquet(f"{folder}/headers")


def read_payloads(spark: SparkSession, folder: str, with_bytes: bool = True) -> DataFrame:
    """(payload_digest, payload_bytes[, payload]) from the WARC files, each digest verified against the bytes."""
    parts = spark.read.schema("part long").parquet(f"{folder}/parts")
    n = max(1, parts.count())
    dealt = parts.repartition(n, "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            d, s, p = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s, pa.int64()), *([pa.array(p, pa.binary())] if with_bytes else [])], ["payload_digest", "payload_bytes", "payload"][: 2 + with_bytes])

        for b in batches:
            for part in b.column("part").to_pylist():
                rows: list[tuple] = []
                with open_file(f"{folder}/payloads/{part:06d}.warc.gz") as f, gzip.GzipFile(fileobj=f) as data:
                    for fields, _, payload in parse_records(data):
                        digest = hashlib.sha256(payload).hexdigest()
                        if fields["warc-payload-digest"] != f"sha256:{digest}":
                            raise ValueError("a payload does not match its digest")
                        rows.append((digest, len(payload), payload if with_bytes else None))
                        if len(rows) == 256:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return dealt.mapInArrow(read, "payload_digest string, payload_bytes long" + ", payload binary" * with_bytes)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_digest, record_type, refers_to, header), parsed from the header bytes."""
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"(?m)^{name}: ?([^\r\n]*)", 1)
    out = spark.read.parquet(f"{folder}/headers")
    kind = out.schema["page_id"].dataType
    number = lambda name: F.when(field(name) != "", field(name).cast(kind))
    return out.select(number("Page-ID").alias("page_id"), F.substring(field("WARC-Payload-Digest"), 8, 64).alias("payload_digest"), field("WARC-Type").alias("record_type"), number("Refers-To-Page").alias("refers_to"), "header")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, record): the original records' exact bytes; a revisit has no body.

    Payloads aren't shuffled: headers meet the index by digest, are dealt in ranges of place, and each task reads the payloads of its
    range from their files, each digest verified against the bytes.
    """
    head = read_headers(spark, folder)
    place = spark.read.parquet(f"{folder}/index").groupBy("payload_digest").agg(F.min(F.struct("part", "offset", "length")).alias("p"))
    place = staged(place.select("payload_digest", "p.*"), "places")  # plain shuffles on both sides of the join, so that Spark can split it
    whole = staged(head.where("record_type = 'response'").join(place, "payload_digest", "left"), "located")
    n = max(1, spark.read.parquet(f"{folder}/parts").count())
    whole = whole.repartitionByRange(n, "part", "offset", "page_id").sortWithinPartitions("part", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file, payload = None, None, b""
        for b in batches:
            made = []
            for part, offset, length, digest, block in zip(*(b.column(c).to_pylist() for c in ("part", "offset", "length", "payload_digest", "header"))):
                if part is None:
                    raise ValueError("a record's payload is not in the archive")
                if held is None or held[0] != part:
                    if file is not None:
                        file.close()
                    file = open_places(f"{folder}/payloads/{part:06d}.warc.gz")
                if held != (part, offset):
                    file.seek(offset)
                    _, _, payload = next(parse_records(io.BytesIO(gzip.decompress(file.read(length)))))
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload does not match its digest")
                    held = (part, offset)
                made.append(block + payload + b"\r\n\r\n")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:4]), pa.array(made, pa.binary())], names)
        if file is not None:
            file.close()

    python_ready(spark)
    names = ["page_id", "record_type", "refers_to", "payload_digest", "record"]
    kind = head.schema["page_id"].dataType.simpleString()
    found = whole.mapInArrow(fetch, f"page_id {kind}, record_type string, refers_to {kind}, payload_digest string, record binary")
    return found.unionByName(head.where("record_type = 'revisit'").withColumn("record", F.concat("header", F.lit(b"\r\n\r\n"))).drop("header"))


def export_records(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """Write the original records as WARC files in ``to``, a gzip member a record; returns (part, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), [0]

        def members() -> Iterator[bytes]:
            for b in batches:
                for r in b.column("record").to_pylist():
                    n[0] += 1
                    yield gzip.compress(r, LEVEL, mtime=0)

        write_file(f"{to}/{part:06d}.warc.gz", members())
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array(n)], ["part", "records"])

    python_ready(spark)
    return staged(records(spark, folder).select("record").mapInArrow(write, "part long, records long"), "exported")


def read_records(spark: SparkSession, folder: str, parts: DataFrame, kind: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the WARC files that export_records
    wrote, each body held against its header's length and digest. A revisit has no body and no payload_bytes. kind: the type of page_id."""
    dealt = parts.where("records > 0").select("part")
    dealt = dealt.repartition(max(1, dealt.count()), "part")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(zip(*rows))], names)

        for b in batches:
            for part in b.column("part").to_pylist():
                rows: list[tuple] = []
                with open_file(f"{folder}/{part:06d}.warc.gz") as f, gzip.GzipFile(fileobj=f) as data:
                    for fields, _, payload in parse_records(data):
                        digest, again = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"] == "revisit"
                        if payload if again else hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError("a record's body does not match its header")
                        rows.append((fields.get("page-id"), None if again else len(payload), digest, fields["warc-type"], fields.get("refers-to-page")))
                        if len(rows) == 4096:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    out = dealt.mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archive of pages, rebuild every page's record from it as WARC files and read these back: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A revisit's payload_bytes are those of the record that holds its payload."""
    spark = pages.sparkSession
    folder, to = new_folder(spark, "warc"), new_folder(spark, "warc-records")
    write_archive(pages, folder)
    out = staged(read_records(spark, to, export_records(spark, folder, to), pages.schema["page_id"].dataType.simpleString()), "read-records")
    whole, again = out.where("record_type = 'response'"), out.where("record_type = 'revisit'")
    sizes = whole.select("payload_digest", "payload_bytes").join(again.select("payload_digest").distinct(), "payload_digest", "left_semi").distinct()
    again = again.drop("payload_bytes").join(small_side(staged(sizes, "sizes")), "payload_digest", "left")
    return whole.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
