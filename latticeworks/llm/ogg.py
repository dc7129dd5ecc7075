"""Media columns: Ogg.

`mux` lays packets of logical streams into Ogg pages (RFC 3533), `demux` does the reverse: it verifies page checksums,
reassembles packets from lacing values, separates logical streams and derives times from granule positions.
`media_column` stores each text of a table as an Ogg file of two interleaved streams of 8-bit samples in a binary column,
and `media_features` reads such a column back. `packet_times` gives the start and end of every packet: a page's granule position is
the end of the last packet that ends on it, and those before it on the page end where the next one begins.

Defined results: a null text is an empty payload (192 blanks after padding); equal texts give equal bytes, whatever their row;
a page whose checksum fails is skipped and counted, and the packets that it cuts are dropped: features are then those of the samples
that are left, and the description counts the bad pages. A null file has null digests and the description `none`; one without a
readable stream has no samples. Other columns play no part and are not returned.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace
from .text import give_back

#: Unit of a payload in bytes, samples (bytes) of a packet, sample rate, lacing values of a page at most.
UNIT, PACKET, RATE, SEGMENTS = 192, 1920, 8000, 64
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
INTRO = struct.Struct("<8sIHHQ")
MAGIC = b"\x7fsample8"
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The checksum of a page whose checksum field is zero: polynomial 0x04C11DB7, most significant bit first, start 0.

    zlib's CRC has the same polynomial with bits reversed, so bytes and result are reversed around it.
    """
    raw = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_FLIP), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    blank = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + page_crc(blank).to_bytes(4, "little") + blank[26:]


def stream_pages(serial: int, packets: list[bytes], ends: list[int], segments: int = SEGMENTS) -> Iterator[bytes]:
    """The pages of one logical stream; the first packet has a page of its own. ends: the granule position after each packet."""
    number, flags, lacing, body, granule = 0, FIRST, bytearray(), [], -1
    for i, packet in enumerate(packets):
        at, last = 0, i == len(packets) - 1
        for k in range(len(packet) // 255 + 1):
            piece = packet[at : at + 255]
            at += len(piece)
            lacing.append(len(piece))
            body.append(piece)
            done = k == len(packet) // 255
            granule = ends[i] if done else granule
            if len(lacing) == segments or done and (last or not i):
                yield page(flags | LAST * (done and last), granule, serial, number, bytes(lacing), b"".join(body))
                number, flags, lacing, body, granule = number + 1, CONTINUED * (not done), bytearray(), [], -1


def mux(streams: list[tuple[int, list[bytes], list[int]]]) -> bytes:
    """The file of several logical streams: all first pages, then page by page in turn."""
    queues = [list(stream_pages(*s)) for s in streams]
    out = [q[0] for q in queues]
    for k in range(1, max(map(len, queues), default=0)):
        out += [q[k] for q in queues if k < len(q)]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _part: list[bytes] | None = None
    _next: int = 0

    def seconds(self, rate: int = RATE) -> float:
        """The time at the last granule position."""
        return max((g for g in self.granules if g >= 0), default=0) / rate

    def ends(self, length) -> list[int | None]:
        """The granule position at the end of each packet, whose duration is length(packet): as its page says, else counted back from the
        packet after it on the page. None where no page says."""
        out, after = [], None
        for packet, granule in zip(reversed(self.packets), reversed(self.granules), strict=True):
            end = granule if granule >= 0 else after
            out.append(end)
            after = None if end is None else end - length(packet)
        return out[::-1]


def demux(data: bytes) -> tuple[list[Stream], int]:
    """(logical streams by first appearance, pages with a wrong checksum or cut off)."""
    streams: dict[int, Stream] = {}
    at, bad = 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + HEAD.size > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        table = data[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(table)
        if version or end > len(data) or page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            bad, at = bad + 1, at + 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        if number != s._next or not flags & CONTINUED:
            s._part = None  # what was open before lost its end
        skip = bool(flags & CONTINUED) and s._part is None
        body, part, kept = at + HEAD.size + n, s._part or [], False
        for v in table:
            part.append(data[body : body + v])
            body += v
            if v < 255:
                if not skip:
                    s.packets.append(b"".join(part))
                    s.granules.append(-1)
                part, skip, kept = [], False, not skip
        if kept and granule >= 0:  # a page that ends nothing but a cut packet has no packet for its position
            s.granules[-1] = granule
        s._part, s._next, s.pages, s.ended = (part if n and table[-1] == 255 and not skip else None), number + 1, s.pages + 1, bool(flags & LAST)
        at = end
    return list(streams.values()), bad


def store_samples(payload: bytes) -> bytes:
    """An Ogg file of 8-bit samples whose packets go in turn to two logical streams; serials come from the payload."""
    base = zlib.crc32(payload)
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    streams = []
    for k in (0, 1):
        own, ends, total = packets[k::2], [0], 0
        for p in own:
            ends.append(total := total + len(p))
        streams.append(((base + k) & 0xFFFFFFFF, [INTRO.pack(MAGIC, RATE, k, 2, total), *own], ends))
    return mux(streams)


def is_intro(packet: bytes) -> bool:
    return len(packet) == INTRO.size and packet[:8] == MAGIC


def sample_times(media: bytes) -> list[tuple[int, int, int, float | None, float | None]]:
    """(stream, packet, samples, start and end in ms) of the packets of a file from store_samples; packets are counted from 0 among those
    that are left of the stream. A stream without its first packet has no known place or rate and is left out."""
    out = []
    for s in demux(media)[0]:
        if s.packets and is_intro(s.packets[0]):
            _, rate, place, _, _ = INTRO.unpack(s.packets[0])
            ms = lambda t: None if t is None else t * 1000 / rate  # noqa: B023, E731
            for k, (packet, end) in enumerate(zip(s.packets[1:], s.ends(lambda p: 0 if is_intro(p) else len(p))[1:], strict=True)):
                out.append((place, k, len(packet), ms(None if end is None else end - len(packet)), ms(end)))
    return sorted(out, key=lambda r: r[:2])


def load_samples(media: bytes) -> tuple[bytes, str]:
    """(samples, description) of a file from store_samples, from nothing but its bytes; of a damaged one what is left."""
    streams, bad = demux(media)
    by, rate = {}, RATE
    for s in streams:
        if s.packets and is_intro(s.packets[0]):
            _, rate, place, _, _ = INTRO.unpack(s.packets[0])
            by.setdefault(place, s)
    a, b = (by[k].packets[1:] if k in by else [] for k in (0, 1))
    packets = [x for pair in zip_longest(a, b) for x in pair if x is not None]
    last = max((s.seconds(rate) for s in by.values()), default=0.0)
    samples = b"".join(packets)
    damage = f";bad={bad}" if bad else ""
    return samples, f"streams={len(by)};pages={sum(s.pages for s in by.values())};packets={len(packets)};last_ms={round(last * 1000)};mean={sum(samples) * 1000 // max(1, len(samples))}{damage}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def media_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text stored as an Ogg file."""

    def write(batches):
        for b in batches:
            give_back()
            made = [(n, store_samples(p)) for n, p in map(payload_of, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], [key, "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(write, f"{key} long, n_bytes long, media binary")


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and a description of each stored file, from the stored bytes."""

    def read(batches):
        for b in batches:
            rows = []
            for doc, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                m = m.as_py()
                if m is None:
                    rows.append((doc, n, *[None] * 5, "none"))
                    continue
                p, feature = load_samples(m)
                rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], [key, *(f.split()[0] for f in FEATURES.split(", "))])

    TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return media.select(key, "n_bytes", "media").mapInArrow(read, f"{key} long, {FEATURES}")


def packet_times(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, stream, packet, samples, start_ms, end_ms): a row for each packet of samples in each stored file; see sample_times. Null files,
    and files without a readable stream, have no row."""
    names = [key, "stream", "packet", "samples", "start_ms", "end_ms"]

    def read(batches):
        for b in batches:
            for doc, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = sample_times(m.as_py()) if m.is_valid else []
                if rows:
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return media.select(F.col(key).cast("long").alias(key), "media").mapInArrow(read, f"{key} long, stream int, packet long, samples long, start_ms double, end_ms double")


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = Workspace(spark, "ogg").put(media_column(docs), "media")
    return media_features(stored)
