"""Packing by minimum bin slack.

Documents are tokenised, cut into pieces of at most `capacity` ids, and pieces are laid into sequences. What is left of each
document after full pieces has one of `capacity` lengths, so the plan needs only how many pieces have each length: for one window
after another a subset-sum over a bitset finds the multiset of remaining lengths that comes closest to the capacity, counts are
backtracked, and the multiset is used as often as the counts allow. Pieces then find their place by their rank among pieces of
their length, which salted groups of bounded size number without gaps.

Defined results: a null or empty text is one piece of the single end id; repeated rows are packed as often as they occur; an empty
table gives no rows. The driver sees one count per length and the plan, both bounded by the capacity and not by the table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace
from .text import give_back
from .tokens import encoder

#: Ids of a sequence, id that ends a document, rows of a group that numbers pieces; with more than GROUPS of those groups, there are as many as rows in each.
CAPACITY, END, GROUP_ROWS, GROUPS = 1024, 0, 512, 4096


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, each at most counts[length] times, with the largest sum up to capacity; longer lengths come first."""
    items, states, bits, mask = [], [], 1, (1 << capacity + 1) - 1
    for length in sorted(counts, reverse=True):
        left, step = min(counts[length], capacity // length if length else 0), 1
        while left > 0:
            take = min(step, left)
            items.append((length, take))
            states.append(bits)
            bits |= (bits << length * take) & mask
            left, step = left - take, step * 2
        if bits >> capacity & 1:
            break
    target, chosen = bits.bit_length() - 1, {}
    for (length, take), before in zip(reversed(items), reversed(states), strict=True):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + take
            target -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, copies in a sequence, first sequence, offset of the first copy) of every use of a multiset."""
    left = {k: v for k, v in counts.items() if v > 0}
    used, rows, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v > (k == longest)}
        chosen = fill(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for k in sorted(chosen, reverse=True):
            n = chosen[k]
            rows.append((k, used[k], used[k] + n * times, n, sequence, offset))
            used[k] += n * times
            offset += n * k
            left[k] -= n * times
            if not left[k]:
                del left[k]
        sequence += times
    return rows


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of the pieces of whole documents (doc_id, text)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def cut(batches):
        enc = encoder(vocabulary)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(enc.encode(text.as_py()).astype("<u4"), np.uint32(end))
                rows += [(doc, a, len(x := ids[a : a + capacity]), zlib.crc32(x.tobytes()), len(ids)) for a in range(0, len(ids), capacity)]
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], schema=kinds)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def n_groups(n: int) -> int:
    """Groups that number n pieces of a length: none large, nor so many that their running total is."""
    few = -(-n // GROUP_ROWS)
    return max(1, few if few <= GROUPS else max(GROUPS, math.isqrt(n)))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. `pieces` is read three times: pass a stored table."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = spark.createDataFrame([(k, n_groups(n)) for k, n in counts.items()], "length long, n_groups long")
    uses = spark.createDataFrame(plan(counts, capacity), "length long, lo long, hi long, copies long, sequence0 long, offset0 long")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "n_groups")).drop("n_groups")
    base = dealt.groupBy("length", "g").agg(F.count("*").alias("n"))
    base = base.select("length", "g", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    ranked = ranked.join(base, ["length", "g"]).withColumn("rank", F.col("base") + F.col("r"))
    t = F.col("rank") - F.col("u.lo")
    placed = ranked.alias("p").join(F.broadcast(uses).alias("u"), (F.col("p.length") == F.col("u.length")) & (F.col("rank") >= F.col("u.lo")) & (F.col("rank") < F.col("u.hi")))
    return placed.select(
        "doc_id", "start", "p.length", "ids_crc32", "doc_tokens",
        (F.col("sequence0") + F.floor(t / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + t % F.col("copies") * F.col("p.length")).cast("long").alias("offset"),
    )


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(Workspace(docs.sparkSession, "packing").put(pieces_of(docs, capacity), "pieces"), capacity)
