"""LM scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised to powers of two; a gram of level q is held as q entries (gram, 1) ... (gram, q) of a
Bloom filter, and its count is read back by probing level after level until one is missing. Filters are built in parts, one per
hash range, by tasks that each see a bounded number of grams, and grow with the number of grams, so that the error rate is the same
at every size. Both filters are tables, broadcast to the workers in slices of at most MOST_BITS, with one pass over the texts for each
slice. Where words need several slices, each pass over the texts adds the levels of its own words (a byte for each token) to the table
of texts, and pairs are scored with the finished levels; where one slice holds all words, the pass that scores looks them up itself.
The results are the same. Scores of the slices of pairs are summed by document.

    p(w | h) = (c(h w) + MU * p(w)) / (c(h) + MU),   p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)),   counts from the filter

base_score uses exact counts: those of the HEAD most frequent words are broadcast, other words are looked up by a join.

Defined results: a null or empty text is the end token alone; repeated rows count as often as they occur; with no training rows N
and V are 0 and every token is unknown. Rows with a null doc_id are training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace
from .text import hashed_words, mix

#: Words whose exact counts are broadcast at most (16 bytes each), grams of a filter part, hash functions, bits of a slice of a filter that is broadcast at once.
HEAD, PART, HASHES, MOST_BITS = 1 << 20, 1 << 19, 4, 1 << 31
#: Weight of the unigram estimate, grams that a task holds before it passes them on.
MU, HOLD = 200.0, 1_500_000
START, STOP = np.uint64(0x51A7C0DE00000001), np.uint64(0xE0D0000000000002)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * _PAIR + (w ^ (w >> np.uint64(29))))


def token_rows(column: pa.Array):
    """For slices of a column: (tokens with an end token after each text, tokens before each, row boundaries)."""
    for _, words, rows in hashed_words(column, seed=9):
        tokens = np.insert(words, rows[1:], STOP)
        rows = rows + np.arange(len(rows))
        before = np.concatenate([[START], tokens[:-1]])
        before[rows[:-1]] = START
        yield tokens, before, rows


def count_grams(docs: DataFrame, pairs: bool) -> DataFrame:
    """(h, c): counts of words or pairs in docs (text), summed within each task already."""

    def count(batches):
        held, size = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        for b in batches:
            for tokens, before, _ in token_rows(b.column(0)):
                held.append(pair(before, tokens) if pairs else tokens)
                size += len(tokens)
                if size > HOLD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "h long, c long")


def levels(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(c)).astype(np.int64) + 1


def _positions(h: np.ndarray, level: int | np.ndarray, bits: np.ndarray, k: int) -> np.ndarray:
    x = mix(h ^ (np.asarray(level, np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return ((x & np.uint64(0xFFFFFFFF)) + np.uint64(k) * (x >> np.uint64(32) | np.uint64(1))) % bits


def build_part(h: np.ndarray, c: np.ndarray, most: float = np.inf, hashes: int = HASHES) -> tuple[int, bytes]:
    """(bits, bytes) of the filter of the grams h with counts c, of at most `most` bits."""
    h, inverse = np.unique(h, return_inverse=True)
    q = levels(np.bincount(inverse, weights=c))
    entries = np.repeat(h, q)
    level = np.arange(len(entries)) - np.repeat(np.cumsum(q) - q, q) + 1
    bits = int(max(64, min(most, np.ceil(len(entries) * hashes / np.log(2)))))
    out = np.zeros(-(-bits // 8) * 8, bool)
    for k in range(hashes):
        out[_positions(entries, level, np.uint64(bits), k).astype(np.int64)] = True
    return bits, np.packbits(out, bitorder="little").tobytes()


def build_filter(grams: DataFrame, parts: int, hashes: int = HASHES) -> DataFrame:
    """(part, bits, raw) of each part that has grams."""

    def build(t: pa.Table) -> pa.Table:
        bits, raw = build_part(t.column("h").to_numpy().view(np.uint64), t.column("c").to_numpy(), hashes=hashes)
        return pa.table({"part": t.column("part")[:1], "bits": pa.array([bits]), "raw": pa.array([raw])})

    return grams.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).groupBy("part").applyInArrow(build, "part int, bits long, raw binary")


def load_filter(built: DataFrame, parts: int, span: tuple[int, int], hashes: int = HASHES) -> CountFilter:
    """The parts in span; grams of other parts count as absent."""
    made = built.where(F.col("part").between(span[0], span[1] - 1)).toArrow()
    return CountFilter.of(parts, list(zip(*(made.column(k).to_pylist() for k in ("part", "bits", "raw")), strict=True)), hashes)


def part_ranges(built: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Ranges (from, to) of all parts, each of at most MOST_BITS, or of one part."""
    ranges, at, held = [], 0, 0
    for r in sorted(built.select("part", "bits").collect()):
        if held and held + r.bits > MOST_BITS:
            ranges.append((at, r.part))
            at, held = r.part, 0
        held += r.bits
    return [*ranges, (at, parts)]


@dataclass
class CountFilter:
    """Approximate counts: never below the truth's power of two, above it at the filter's error rate."""

    parts: int
    bits: np.ndarray
    start: np.ndarray
    raw: bytes  # as bytes a worker loads it without a second copy
    hashes: int = HASHES

    @classmethod
    def of(cls, parts: int, made: list[tuple[int, int, bytes]], hashes: int = HASHES) -> CountFilter:
        bits, start, at = np.ones(parts, np.uint64), np.zeros(parts, np.int64), 1
        for part, n, raw in made:
            bits[part], start[part], at = n, at, at + len(raw)
        return cls(parts, bits, start, b"".join([b"\0", *(raw for *_, raw in made)]), hashes)

    def levels(self, h: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(self.raw, np.uint8)
        part = (h.view(np.int64) % self.parts).astype(np.int64)
        start, bits = self.start[part], self.bits[part]
        level, live = np.zeros(len(h), np.int64), np.flatnonzero(start > 0)
        while len(live):
            for k in range(self.hashes):
                p = _positions(h[live], level[live] + 1, bits[live], k).astype(np.int64)
                live = live[(raw[start[live] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1]
            level[live] += 1
            live = live[level[live] < 60]
        return level

    def count(self, h: np.ndarray) -> np.ndarray:
        return middle(self.levels(h))


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range."""
    return np.where(level > 0, np.where(level > 1, 2.0 ** (level - 0.5), 1.0), 0.0)


def word_levels(words: CountFilter, tokens: np.ndarray) -> np.ndarray:
    kinds, at = np.unique(tokens, return_inverse=True)
    return words.levels(kinds).astype(np.uint8)[at]


def score_tokens(level: np.ndarray, start: int, pairs: CountFilter, span: tuple[int, int], tokens: np.ndarray, before: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 p of each token after the one before it, from the levels of the tokens and that of a text's start; 0 where the pair is not
    of the parts in span."""
    out = np.zeros(len(tokens))
    grams = pair(before, tokens)
    own = np.flatnonzero((grams.view(np.int64) % pairs.parts >= span[0]) & (grams.view(np.int64) % pairs.parts < span[1]))
    shifted = np.concatenate([[0], level[:-1]])
    shifted[before == START] = start
    grams, cw, ch = grams[own], middle(level[own].astype(np.int64)), middle(shifted[own].astype(np.int64))
    grams, back = np.unique(grams, return_inverse=True)
    both = pairs.count(grams)[back]
    both = np.where((cw > 0) & (ch > 0), np.minimum(both, np.minimum(cw, ch)), 0)  # a pair is no more frequent than its words
    out[own] = np.log10((both + MU * (cw + 0.5) / (n + 0.5 * (v + 1))) / (ch + MU))
    return out


def leveled(words: CountFilter | None, texts: pa.Array, held: pa.Array):
    """token_rows with the level of each token: from the filter of words, or, where that came in slices, as held for each text."""
    flat, at = None if words is not None else np.frombuffer(b"".join(held.to_pylist()), np.uint8), 0
    for tokens, before, rows in token_rows(texts):
        yield tokens, before, rows, word_levels(words, tokens) if flat is None else flat[at : at + len(tokens)]
        at += len(tokens)


def add_levels(words):
    """Over (.., text, uid, level): adds the levels of the words in a broadcast slice to those of each text."""

    def run(batches):
        for b in batches:
            at, texts, held = b.schema.get_field_index("level"), b.column("text"), b.column("level").to_pylist()
            made = []
            for tokens, _, rows in token_rows(texts):
                level = word_levels(words.value, tokens)
                for i, j in zip(rows[:-1], rows[1:], strict=True):
                    old = held[len(made)]
                    made.append((level[i:j] if old is None else level[i:j] + np.frombuffer(old, np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()) if k == at else b.column(k) for k in range(b.num_columns)], b.schema.names)

    return run


def score_documents(docs: DataFrame, train: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for docs (doc_id, held_out, text), counts from train (text)."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "lm")
    words = work.put(count_grams(train, False).groupBy("h").agg(F.sum("c").alias("c")), "words")
    sizes = words.groupBy(F.floor(F.log2("c")).cast("int").alias("q")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()
    v, n = sum(r.v for r in sizes), sum(r.n for r in sizes)
    cut, held = 0, 0
    for r in sorted(sizes, key=lambda r: -r.q):
        held += r.v
        if held > HEAD:
            cut = r.q + 1
            break
    head = words.where(F.col("c") >= (1 << cut) if cut else F.lit(True)).toArrow()
    h, c = head.column("h").to_numpy(), head.column("c").to_numpy()
    order = np.argsort(h)
    word_parts, parts = max(1, -(-v // PART)), max(1, -(-n // PART))
    starts = count_starts(train)
    start = int(levels(np.array([starts]))[0]) if starts else 0
    singles = work.put(build_filter(words, word_parts, hashes), "singles", "uncompressed")
    word_spans = part_ranges(singles, word_parts)
    built = work.put(build_filter(count_grams(train, True), parts, hashes), "pairs", "uncompressed")
    spans = part_ranges(built, parts)
    single = load_filter(singles, word_parts, word_spans[0], hashes) if len(word_spans) == 1 else None
    shared = spark.sparkContext.broadcast((h[order], c[order], single))
    floor = n + 0.5 * (v + 1)
    whole = not cut

    def run(batches):
        heads, counts, single = shared.value
        pairs = first.value
        for b in batches:
            size, known, base, score, rest = [], [], [], [], []
            for tokens, before, rows, level in leveled(single, b.column(2), b.column(4)):
                at = np.minimum(np.searchsorted(heads, tokens.view(np.int64)), max(len(heads) - 1, 0))
                found = heads[at] == tokens.view(np.int64) if len(heads) else np.zeros(len(tokens), bool)
                logs = np.log10(((counts[at] if len(heads) else 0) * found + 0.5) / floor)
                model = score_tokens(level, start, pairs, spans[0], tokens, before, n, v)
                size.append(np.diff(rows))
                known.append(np.add.reduceat(found.astype(np.int64), rows[:-1]))
                base.append(np.add.reduceat(np.where(found | whole, logs, 0.0), rows[:-1]))
                score.append(np.add.reduceat(model, rows[:-1]))
                if not whole:
                    rest += [tokens[i:j][~found[i:j]].view(np.int64) for i, j in zip(rows[:-1], rows[1:], strict=True)]
            m = len(b)
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rest)]) if rest else [0] * (m + 1), pa.int32()), pa.array(np.concatenate(rest) if rest else [], pa.int64()))
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), b.column(1), cat(size, pa.int64()), cat(known, pa.int64()), cat(base, pa.float64()), cat(score, pa.float64()), flat], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"])

    def rest_of(span, pairs):
        """Pass over a further slice: (uid, score)."""

        def run(batches):
            _, _, single = shared.value
            for b in batches:
                made = [np.add.reduceat(score_tokens(level, start, pairs.value, span, tokens, before, n, v), rows[:-1]) for tokens, before, rows, level in leveled(single, b.column(1), b.column(2))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(made) if made else np.zeros(0))], ["uid", "score"])

        return run

    def slice_of(span):
        return spark.sparkContext.broadcast(load_filter(built, parts, span, hashes))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"), F.lit(None).cast("binary").alias("level"))
    if len(spans) > 1 or single is None:
        own = work.put(own, "texts0")  # the same uid in every pass
    last = "texts0"
    for k, span in enumerate(word_spans if single is None else []):
        slice_ = spark.sparkContext.broadcast(load_filter(singles, word_parts, span, hashes))
        own = work.put(own.mapInArrow(add_levels(slice_), own.schema), f"texts{k + 1}")
        slice_.destroy()
        work.drop(last)
        last = f"texts{k + 1}"
    first = slice_of(spans[0])
    done = work.put(own.mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<bigint>"), "scored")
    first.destroy()
    if len(spans) > 1:
        passes = None
        for k, span in enumerate(spans[1:]):
            pairs = slice_of(span)
            made = work.put(own.select("uid", "text", "level").mapInArrow(rest_of(span, pairs), "uid long, score double"), f"pass{k}")
            pairs.destroy()
            passes = made if passes is None else passes.unionAll(made)
        done = done.join(passes.groupBy("uid").agg(F.sum("score").alias("more")), "uid").withColumn("score", F.col("score") + F.col("more")).drop("more")
    shared.destroy()
    work.drop("pairs", "singles", last)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"]
    if whole:
        return done.select(*columns)
    rare = words.where(F.col("c") < (1 << cut))
    looked = done.select("uid", F.explode("rest").alias("h")).groupBy("uid", "h").agg(F.count("*").alias("m")).join(rare, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    added = looked.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("k"), F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / F.lit(floor))).alias("s"))
    both = done.drop("rest").join(added, "uid", "left")
    both = both.withColumn("n_known", F.col("n_known") + F.coalesce("k", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("s", F.lit(0.0)))
    return both.select(*columns)


def count_starts(train: DataFrame) -> int:
    return train.count()


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return score_documents(docs.withColumn("held_out", held_out), docs.where(~held_out))
