"""SimHash near-duplicates by multi-index hashing.

1. One pass makes the 64-bit fingerprint of every whole text: a bit is 1 if more than half of the hashes of its word shingles have it.
   From here on work is on the distinct fingerprints.
2. A fingerprint is cut into SEGMENTS segments. Fingerprints at most RADIUS bits apart are, in at least one of the first segments, at
   most RADIUS // SEGMENTS bits apart, or closer still in one of the others; so a table holds each segment's value, every fingerprint
   asks it for the values in a small Hamming ball around its own, and the complete distances of what it finds are verified. Of two
   fingerprints the one with the smaller segment asks.
3. A segment's value that more than CROWD fingerprints share would give all pairs of them. All fingerprints that hold or ask for such a
   value are instead put at every point at most half the radius from them: two fingerprints meet at some point exactly if they are
   within the radius, and a point has no more fingerprints than its ball has points. There the smallest is linked with the others. That
   keeps components whole with at most 65 rows for each fingerprint, however crowded a segment is.

Defined results: a null or empty text has fingerprint zero and is linked like any other; rows that share a doc_id are one document,
whose classes join; a null doc_id is linked with nothing and its component is null; other columns play no part.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import Workspace
from .text import IS_SPACE, LOWER, slices, word_spans

#: Words of a shingle, seed of its hash, differing bits of a link, segments, fingerprints of a segment's value that are compared in pairs.
WIDTH, SEED, RADIUS, SEGMENTS, CROWD = 3, 42, 2, 2, 64
#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 16


def joined_words(buf: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of lower-cased bytes with one space after each, where each starts and ends there, and the first word of each row."""
    starts, ends, rows = word_spans(buf, bounds)
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])[:-1].astype(np.int64)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    at = np.flatnonzero(~IS_SPACE[buf])
    out[at + np.repeat(to - starts, size)] = buf[at]
    return out.tobytes(), to, to + size, rows


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the 64-bit hashes have."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), AT_ONCE):
        count += np.unpackbits(hashes[k : k + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprints(column: pa.Array, width: int = WIDTH):
    """Of each text of an Arrow column its fingerprint, unsigned."""
    for _, buf, bounds in slices(column):
        text, starts, ends, rows = joined_words(LOWER[buf], bounds)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            last = min(width, b - a)
            spans = zip(starts[a : b - last + 1].tolist(), ends[a + last - 1 : b].tolist(), strict=True) if last else ()
            yield majority(np.array([xxhash.xxh64_intdigest(text[i:j], SEED) for i, j in spans], "<u8"))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a long of the same bits."""

    def make(batches):
        for b in batches:
            found = np.fromiter(text_fingerprints(b.column(1), width), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(make, "doc_id long, fp long")


def segments(radius: int, count: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius of the ball) of each segment: a count of them has the radius' share, others one less."""
    edges = [64 * k // count for k in range(count + 1)]
    share, more = divmod(radius, count)
    return [(a, b - a, share if k <= more else share - 1) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def ball(bits: int, radius: int) -> list[int]:
    """All values of so many bits with at most `radius` of them set."""
    return [sum(1 << k for k in some) for r in range(radius + 1) for some in combinations(range(bits), r)]


def segment_of(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, work: Workspace, radius: int = RADIUS, count: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(a, b) between distinct fingerprints (fp) at most radius apart: all of them, but for those in crowded segments, of which so many
    that components are the same. The radius must be even, or each crowded point would have to be an edge."""
    if radius % 2 or not 2 <= count <= 32:
        raise ValueError("the radius must be even, and segments of 2 bits at least")
    fp, parts = F.col("fp"), [(k, *s) for k, s in enumerate(segments(radius, count)) if s[2] >= 0]
    flips = lambda bits, r: F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in ball(bits, r)))
    table = reduce(DataFrame.unionAll, (prints.select("fp", F.lit(k).alias("seg"), segment_of(fp, first, bits).alias("key")) for k, first, bits, _ in parts))
    near = (prints.select("fp", F.lit(k).alias("seg"), segment_of(fp, first, bits).alias("own"), F.explode(flips(bits, r)).alias("m")) for k, first, bits, r in parts)
    asks = reduce(DataFrame.unionAll, near).withColumn("key", F.col("own").bitwiseXOR(F.col("m"))).where("own <= key").select("fp", "seg", "key")
    crowded = work.put(table.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("seg", "key"), "crowded")
    quiet, by = asks, ["seg", "key"]
    if not crowded.isEmpty():
        quiet = work.put(asks.join(crowded, by, "left_anti"), "quiet")
    found = quiet.join(table.withColumnRenamed("fp", "b"), by).withColumnRenamed("fp", "a")
    made = work.put(found.where((F.col("a") != F.col("b")) & (distance(F.col("a"), F.col("b")) <= radius)).select("a", "b").distinct(), "quiet-links")
    if crowded.isEmpty():
        return made
    hot = work.put(asks.join(crowded, by, "left_semi").select("fp").unionAll(table.join(crowded, by, "left_semi").select("fp")).distinct(), "hot")
    points = hot.select("fp", F.explode(flips(64, radius // 2)).alias("m"))
    met = points.groupBy(fp.bitwiseXOR(F.col("m")).alias("point")).agg(F.array_sort(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)
    stars = met.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", F.lit(2), F.size("all"))).alias("b")).where(distance(F.col("a"), F.col("b")) <= radius)
    return made.unionAll(work.put(stars.distinct(), "hot-links"))


def near_duplicates(docs: DataFrame, work: Workspace | None = None, radius: int = RADIUS, count: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text). The result reads tables of `work`."""
    work = work or Workspace(docs.sparkSession, "simhash")
    prints = work.put(fingerprints(docs), "prints")
    named = prints.where("doc_id IS NOT NULL")
    classes = work.put(named.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    edges = links(classes.select("fp"), work, radius, count, crowd)
    several = work.put(named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a"), "several")
    if not several.isEmpty():  # rows of one document id: their classes join
        edges = edges.unionAll(named.join(several, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b")))
    label = components(edges, work, "cc")
    parts = classes.join(label, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("part"))
    least = parts.groupBy("part").agg(F.min("rep").alias("component_id"))
    own = work.put(parts.join(least, "part").select("fp", "component_id"), "components")
    work.drop("crowded", "quiet", "hot", "quiet-links", "hot-links", "several")
    out = prints.join(own, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
