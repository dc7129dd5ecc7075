"""WARC: a writer that compresses each record by itself with a shared Zstandard dictionary.

An archive starts with a skippable frame (0x184D2A5D) that embeds the dictionary; every record follows as a frame of its own, so
that any record can be read from its offset alone. The dictionary is built from a bounded sample of the records to be archived.
What is read back is measured on the stored bodies; a revisit has none, so its header's digest and length count.
Of records with equal payloads of at least `least` bytes, that with the largest page id is stored as a response and the others as
revisits that refer to it, without a body.

Defined results: a null html is an empty payload; a null url is an empty target; rows repeated with all their values are stored
as often as they occur; where every page id of a group is null, all its rows are responses. An empty table gives no archives. An
archive that is cut off or has a record whose body is not what its header says is an error, and reading it ends the job.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, filesystem, publish

#: Records below this many payload bytes are never revisits; bounds of the dictionary, of its sample and of a sampled record.
LEAST, DICT_BYTES, SAMPLE_ROWS, SAMPLE_RECORD = 1000, 64 << 10, 400, 64 << 10
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record; a revisit (refers_to is given) has no body."""
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record of an uncompressed stream."""
    reader = io.BufferedReader(stream, 1 << 16)
    while line := reader.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := reader.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        body = reader.read(n := int(head["content-length"]))
        if len(body) != n:
            raise ValueError("a record is cut off")
        yield head, body


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of at most `size` bytes; few or tiny samples, of which none can be trained, are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def archive(dictionary: bytes, records: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of an archive."""
    made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if made:
        yield SKIPPABLE + len(dictionary).to_bytes(4, "little") + dictionary
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=made)
    for r in records:
        yield pack.compress(r)


def frames(stream: io.RawIOBase, unpack: zstandard.ZstdDecompressor, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The content of each frame; a frame without its end is an error."""
    data = stream.read(chunk)
    while data:
        one, parts = unpack.decompressobj(), []
        while not one.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("the archive is cut off")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield b"".join(parts)
        data = data or stream.read(chunk)


def read_archive(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one at a time, with the dictionary from its leading frame."""
    head, made = stream.read(8), None
    if head[:4] == SKIPPABLE:
        made = zstandard.ZstdCompressionDict(stream.read(int.from_bytes(head[4:8], "little")))
    else:
        stream.seek(0)
    for frame in frames(stream, zstandard.ZstdDecompressor(dict_data=made)):
        yield from parse_records(io.BytesIO(frame))


def with_roles(pages: DataFrame, work: Workspace, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with payload_digest and, for revisits, refers_to.

    Only digests of several payloads are joined, so that pages are not shuffled where those fit a broadcast; small payloads, of which
    many are equal, get a join key of their own.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("payload_digest", F.sha1("html"))
    large = F.octet_length("html") >= least
    shared = own.where(large).groupBy(F.col("payload_digest").alias("key")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n")
    shared = work.put(shared, "shared")
    keyed = own.withColumn("key", F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    return keyed.join(shared, "key", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id", "key")


def sample_records(pages: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_RECORD) -> list[bytes]:
    """At most `rows` records of pages (page_id, url, html) with payloads of at most `most` bytes, chosen by a hash of the page id:
    bounded, whatever the table's size.

    Rows are thinned by the hash before they are ranked, so that no task ranks more than it must.
    """
    small = pages.where(F.octet_length("html").between(1, most)).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    small = small.withColumn("h", F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)))
    share = min(1.0, 1.5 * rows / max(1, pages.count()))
    chosen = small.where(F.col("h") < int(share * (1 << 30))).orderBy("h", "html", "url").limit(rows).withColumn("sha1", F.sha1("html")).collect()
    return [record(r.page_id, r.url, r.html.encode(), r.sha1, None) for r in chosen]


def write_archives(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Writes one archive for each partition of pages (page_id, url, html, payload_digest, refers_to); returns (path, records, bytes)."""

    def write(batches):
        from pyspark import TaskContext

        count = 0

        def records():
            nonlocal count
            for b in batches:
                for page_id, url, html, sha1, ref in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "payload_digest", "refers_to")), strict=True):
                    count += 1
                    yield record(page_id, url, html.encode(), sha1, ref)

        made = records()
        if (first := next(made, None)) is not None:
            path = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.zst"
            path, size = publish(path, archive(dictionary, (x for g in ([first], made) for x in g)))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(write, "path string, records long, bytes long")


def measured(head: dict[str, str], body: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record."""
    number = lambda k: int(head[k]) if head.get(k) else None
    said = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "revisit":
        return number("x-page-id"), number("x-payload-length"), said, "revisit", number("x-refers-to-page")
    digest = hashlib.sha1(body).hexdigest()
    if digest != said:
        raise ValueError(f"record {head.get('warc-record-id')} has digest {digest}, its header says {said}")
    return number("x-page-id"), len(body), digest, head["warc-type"], None


def read_archives(paths: DataFrame, batch: int = 2000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives in column `path`."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], schema=kinds)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, place = filesystem(path)
                rows = []
                with fs.open_input_file(place) as f:
                    for head, body in read_archive(f):
                        rows.append(measured(head, body))
                        if len(rows) == batch:
                            yield made(rows)
                            rows = []
                yield made(rows)

    return paths.select("path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    dictionary = train(sample_records(pages))
    written = work.put(write_archives(with_roles(pages, work), f"{work.path}/archives", dictionary), "written")
    return read_archives(written.repartition(spark.sparkContext.defaultParallelism * 2))


ORACLE = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM own),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM m
"""
