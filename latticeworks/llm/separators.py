"""Token counts: a separator scan over flat token files without an index.

`write_token_files` writes documents as flat files of little-endian ids, each document followed by the end-of-document id.
`scan_separators` finds the documents in such files again: the files are cut into blocks of equal size, each block is searched
for the id with one vectorised comparison, and boundaries are stitched across blocks by a prefix scan over what each block
reports (separators found, position of the last one). Blocks are read where they are searched; only block summaries are shuffled.

Defined results: a null or empty text is a document of 0 tokens; an empty table gives no files and no rows; tokens after the
last separator of a file are a document with closed = false; an id split by a block's edge cannot occur, as blocks hold whole ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace, filesystem, publish
from .text import give_back
from .tokens import encoder

#: End-of-document id of the vocabulary, ids of a block.
END, BLOCK = 50256, 1 << 20


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k", end: int = END) -> DataFrame:
    """Writes one file for each partition of docs (doc_id, text); returns the writer's note (doc_id, path, ordinal, bytes)."""

    def write(batches):
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        stop = np.array([end], enc.dtype).tobytes()
        path, ids = f"{folder}/part-{TaskContext.get().partitionId():05d}.bin", []

        def chunks() -> Iterator[bytes]:
            for b in batches:
                ids.append(b.column(0))
                give_back()
                for x in b.column(1):
                    yield enc.encode(x.as_py(), special=False).tobytes()  # the end id stands for nothing else
                    yield stop

        made = chunks()
        if (first := next(made, None)) is not None:
            path, size = publish(path, (x for g in ([first], made) for x in g))
            at = 0
            for column in ids:
                yield pa.RecordBatch.from_arrays([column, pa.array([path] * len(column)), pa.array(np.arange(at, at + len(column))), pa.array([size] * len(column), pa.int64())], ["doc_id", "path", "ordinal", "bytes"])
                at += len(column)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(write, "doc_id long, path string, ordinal long, bytes long")


def blocks_of(files: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """(path, block, first, ids) of the files in (path, bytes)."""
    n = F.ceil(F.col("bytes") / F.lit(width * block)).cast("long")
    cut = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    return cut.select("path", "block", (F.col("block") * block).alias("first"), F.least(F.lit(block).cast("long"), F.floor(F.col("bytes") / width) - F.col("block") * block).alias("ids"))


def search_blocks(blocks: DataFrame, width: int, end: int = END) -> DataFrame:
    """(path, block, first, ids, at): positions of the id within each block."""

    def search(batches):
        for b in batches:
            found = []
            for path, first, n in zip(*(b.column(k).to_pylist() for k in ("path", "first", "ids")), strict=True):
                fs, place = filesystem(path)
                with fs.open_input_file(place) as f:
                    ids = np.frombuffer(f.read_at(n * width, first * width), f"<u{width}")
                found.append(np.flatnonzero(ids == end))
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
            at = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in ("path", "block", "first", "ids")] + [at], ["path", "block", "first", "ids", "at"])

    return blocks.select("path", "block", "first", "ids").mapInArrow(search, "path string, block long, first long, ids long, at array<bigint>")


def scan_separators(files: DataFrame, work: Workspace, width: int, end: int = END, block: int = BLOCK) -> DataFrame:
    """(path, ordinal, start, n_tokens, closed) of every document in the files (path, bytes).

    The prefix scan runs over one row per block, in windows by file: a file of a terabyte has a million such rows at this block size.
    """
    found = work.put(search_blocks(blocks_of(files, width, block).repartition("path", "block"), width, end), "found")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("first") + F.element_at("at", -1)
    notes = found.select("path", "block", "first", "ids", F.size("at").alias("n"), F.when(F.size("at") > 0, last).alias("last"))
    whole = Window.partitionBy("path")
    notes = notes.select(
        "path", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal0"),
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("start0"),
        F.sum("n").over(whole).alias("all"), (F.coalesce(F.max("last").over(whole), F.lit(-1)) + 1).alias("tail"), F.sum("ids").over(whole).alias("size"),
    )
    docs = found.where(F.size("at") > 0).join(notes.select("path", "block", "ordinal0", "start0"), ["path", "block"])
    ends = F.transform("at", lambda x: x + F.col("first"))
    docs = docs.select("path", "ordinal0", F.posexplode(F.arrays_zip(F.concat(F.array("start0"), F.transform(F.slice(ends, 1, F.size("at") - 1), lambda x: x + 1)).alias("start"), ends.alias("end"))))
    docs = docs.select("path", (F.col("ordinal0") + F.col("pos")).alias("ordinal"), F.col("col.start").alias("start"), (F.col("col.end") - F.col("col.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = notes.where("block = 0 AND tail < size").select("path", F.col("all").alias("ordinal"), F.col("tail").alias("start"), (F.col("size") - F.col("tail")).alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.unionByName(tails)


def op1_token_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, its place in the token files and the tokens that the scan counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "tokens")
    written = work.put(write_token_files(docs, f"{work.path}/flat"), "written")
    width = encoder().dtype.itemsize
    name = F.regexp_extract("path", r"([^/]+)\.bin$", 1)
    found = scan_separators(written.groupBy("path").agg(F.max("bytes").alias("bytes")), work, width)
    own = written.select("doc_id", name.alias("file"), "ordinal")
    return own.join(found.select(name.alias("file"), "ordinal", "start", "n_tokens"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
