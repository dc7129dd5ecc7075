"""Hard negatives by rotated one-bit codes with deterministic intervals and exact integer scores.

1. Every vector becomes integers and LEVELS codes of one bit a component: it is rotated, the signs are a code, the alignment with the
   code is stored, and what the code leaves over is rotated and coded in turn. At the end the norm of the rest is stored.
2. An anchor's rotated components are cut into PLANES bit planes at each level, so its product with a code is a few popcounts. With the
   stored alignments they estimate the product with the vector. What the estimate can miss is bounded: by the anchor's norm times the
   norm of the rest (Cauchy and Schwarz), and by what the planes round off. The interval always holds.
3. A pair whose interval cannot be among the best so far is left out; all others are scored exactly on the integers. One pass finds the
   positives, a second one, which knows their scores, the negatives of each.

Rows stay where they are: anchors go to them in slabs of at most SLAB components, one pair of passes for each slab, and a task gives for
every anchor its own few best, which a window with a group limit merges. Pairs are compared in blocks and only the best leave a task.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part; of vectors of different
lengths the shorter counts as ended by zeros; a row is no positive or negative of an anchor with its id; rows that repeat an id and a
score count once; of several anchors with one id the one with the smallest label and vector counts. Scores are exact while they fit a
long: components are held within 2^62.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace

#: Codes of a vector, bit planes of an anchor, components of a slab of anchors, anchors and rows that are compared at once.
LEVELS, PLANES, SLAB, ANCHORS, ROWS = 4, 6, 1 << 20, 128, 1024
#: The contract's: scale of a component; anchors are every so many ids; positives, negatives; their scores in hundredths of the positive's.
SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
LEAST = np.iinfo(np.int64).min


@lru_cache(maxsize=2)
def rotations(size: int, levels: int = LEVELS) -> np.ndarray:
    """For each level a random rotation, the same everywhere."""
    rng = np.random.default_rng(13)
    return np.stack([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(levels)])


def packed(bits: np.ndarray) -> np.ndarray:
    """The last axis as 64-bit words, filled up with zeros."""
    words = -(-bits.shape[-1] // 64)
    full = np.zeros((*bits.shape[:-1], words * 64), bool)
    full[..., : bits.shape[-1]] = bits
    return np.packbits(full, axis=-1, bitorder="little").view("<u8")


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes by vector and level, alignments, norm of the rest) of integer vectors."""
    y, codes, align = x.astype(float), [], []
    for r in rotations(x.shape[1]):
        y = y @ r.T
        up = y > 0
        a = np.abs(y).sum(1) / np.sqrt(x.shape[1])
        codes.append(packed(up))
        align.append(a)
        y = y - np.where(up, 1, -1) * (a / np.sqrt(x.shape[1]))[:, None]
    return np.stack(codes, 1), np.stack(align, 1), np.sqrt((y * y).sum(1))


class Anchors:
    """A slab of anchors: integers and, for each level, bit planes with what turns popcounts into products."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        self.norm = np.sqrt((x.astype(float) ** 2).sum(1))
        y, planes, low, step, total, miss = x.astype(float), [], [], [], [], []
        for r in rotations(x.shape[1]):
            y = y @ r.T
            a = y.min(1)
            d = np.maximum((y.max(1) - a) / (2**PLANES - 1), 1e-300)
            u = np.rint((y - a[:, None]) / d[:, None]).astype(np.int64)
            near = a[:, None] + d[:, None] * u
            planes.append(np.stack([packed((u >> j & 1).astype(bool)) for j in range(PLANES)], 1))
            low.append(a), step.append(d), total.append(near.sum(1)), miss.append(np.abs(y - near).sum(1))
        self.planes = np.stack(planes, 1)  # anchor, level, plane, word
        self.low, self.step, self.total, self.miss = (np.stack(v, 1) for v in (low, step, total, miss))

    def interval(self, at: slice, codes: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, how far off it can be) of the products of some anchors with coded vectors."""
        root = np.sqrt(self.x.shape[1])
        planes, out = self.planes[at], np.zeros((len(self.planes[at]), len(codes)))
        ones = np.bitwise_count(codes).sum(2, dtype=np.int64)
        for k in range(LEVELS):
            count = np.zeros(out.shape, np.int32)
            for w in range(codes.shape[2]):
                word = np.ascontiguousarray(codes[:, k, w])
                for j in range(PLANES):
                    count += np.bitwise_count(planes[:, k, j, w, None] & word).astype(np.int32) << j
            # the sum of the components whose sign is up, twice, less the sum of all
            product = 2 * (self.low[at, k, None] * ones[:, k] + self.step[at, k, None] * count) - self.total[at, k, None]
            out += product * (align[:, k] / root)
        norms = np.sqrt((align * align).sum(1) + rest * rest)
        far = self.norm[at, None] * rest + (self.miss[at] / root) @ align.T + 1e-9 * self.norm[at, None] * norms + 0.01
        return out, far


def integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their integer vectors) of an array column."""
    n = len(column)
    flat = np.asarray(column.values.fill_null(float("nan")).to_numpy(zero_copy_only=False), float)
    offsets, missing = np.asarray(column.offsets), np.asarray(column.is_null())
    length = np.where(missing, 0, np.diff(offsets))
    ok = ~missing & (np.add.reduceat(np.append(~np.isfinite(flat), False), offsets[:-1]) * (length > 0) == 0)
    x = np.zeros((n, size))
    row = np.repeat(np.arange(n), length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    x[row, at] = flat[np.repeat(offsets[:-1], length) + at]
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(SCALE * np.where(np.isfinite(x), x, 0.0)), -(2.0**62), 2.0**62)
    return ok, whole.astype(np.int64)[ok]


TABLE = "vec_id long, label int, x binary, codes binary, align binary, rest double"


def coded(rows: DataFrame, size: int) -> DataFrame:
    """The rows that take part, of (vec_id, label, embedding), with integers, codes and alignments."""

    def make(batches):
        for b in batches:
            ok, x = integers(b.column(2), size)
            codes, align, rest = encode(x)
            kept = [b.column(k).filter(pa.array(ok)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, codes, align)), pa.array(rest)], ["vec_id", "label", "x", "codes", "align", "rest"])

    return rows.mapInArrow(make, TABLE)


def unpacked(b, size: int):
    """(ids, labels, integers, codes, alignments, norms of the rests) of a batch or table of coded rows."""
    raw = lambda k, kind: np.frombuffer(b"".join(b.column(k).to_pylist()), kind)
    n = b.num_rows
    return b.column(0).to_numpy(), b.column(1).to_numpy(), raw(2, "<i8").reshape(n, size), raw(3, "<u8").reshape(n, LEVELS, -(-size // 64)), raw(4, "<f8").reshape(n, LEVELS), b.column(5).to_numpy()


def first_of(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first of each group, by score downwards and id; equal rows of a group count once. In order of group and rank."""
    order = np.lexsort((ids, -scores, group))
    g, i, s = group[order], ids[order], scores[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1])
    order, g = order[fresh], g[fresh]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    return order[rank < n]


class Best:
    """The first n (id, score) of each of many groups, as rows come in."""

    def __init__(self, groups: int, n: int) -> None:
        self.n, self.group, self.ids, self.scores = n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bar = np.full(groups, LEAST)  # the n-th score of a full group: what is below cannot enter

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        joined = [np.concatenate(v) for v in ((self.group, group), (self.ids, ids), (self.scores, scores))]
        keep = first_of(*joined, self.n)
        self.group, self.ids, self.scores = (v[keep] for v in joined)
        last = np.flatnonzero(np.bincount(self.group, minlength=len(self.bar))[self.group] == self.n)
        self.bar[self.group[last]] = self.scores[last]  # in order of rank, so a group's last one stays


def exact(a: Anchors, at: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer scores of pairs."""
    return np.concatenate([np.einsum("ij,ij->i", a.x[at[k : k + 65536]], x[rows[k : k + 65536]]) for k in range(0, max(len(at), 1), 65536)])


def blocks(batches, a: Anchors, size: int):
    """Blocks of rows against blocks of anchors: (anchors, ids, labels, integers, estimates, how far off)."""
    for b in batches:
        ids, labels, x, codes, align, rest = unpacked(b, size)
        for r in range(0, len(ids), ROWS):
            row = slice(r, r + ROWS)
            for k in range(0, len(a.ids), ANCHORS):
                at = slice(k, k + ANCHORS)
                yield (at, ids[row], labels[row], x[row], *a.interval(at, codes[row], align[row], rest[row]))


def best_positives(slab, size: int):
    """(anchor_id, vec_id, score): the best rows of an anchor's label among a task's."""

    def run(batches):
        a = slab.value
        best = Best(len(a.ids), POSITIVES)
        for at, ids, labels, x, estimate, far in blocks(batches, a, size):
            may = (a.labels[at, None] == labels) & (a.ids[at, None] != ids) & (estimate + far >= best.bar[at, None])
            i, j = np.nonzero(may)
            best.add(i + at.start, ids[j], exact(a, i + at.start, x, j))
        yield pa.RecordBatch.from_arrays([pa.array(a.ids[best.group]), pa.array(best.ids), pa.array(best.scores)], ["anchor_id", "vec_id", "score"])

    return run


def best_negatives(slab, positives, size: int):
    """(anchor_id, positive_id, negative_id, positive_score, negative_score): for each positive the best rows of other labels within its bounds."""

    def run(batches):
        a, (owner, p_ids, p_scores) = slab.value, positives.value
        low, high = -(-LOW * p_scores // 100), HIGH * p_scores // 100
        best = Best(len(p_ids), NEGATIVES)
        first, last = np.searchsorted(owner, np.arange(len(a.ids))), np.searchsorted(owner, np.arange(len(a.ids)), "right")
        for at, ids, labels, x, estimate, far in blocks(batches, a, size):
            apart = (a.labels[at, None] != labels) & (a.ids[at, None] != ids)
            own = np.arange(first[at][0], last[at][-1])  # the positives of these anchors
            if not len(own):
                continue
            # an anchor's rows may matter between the least that any of its positives still takes and the most
            floor, most = np.full(len(apart), np.inf), np.full(len(apart), -np.inf)
            np.minimum.at(floor, owner[own] - at.start, np.maximum(low[own], best.bar[own]).astype(float))
            np.maximum.at(most, owner[own] - at.start, high[own].astype(float))
            i, j = np.nonzero(apart & (estimate + far >= floor[:, None]) & (estimate - far <= most[:, None]))
            score = exact(a, i + at.start, x, j)
            n = (last - first)[at][i]  # each pair once for every positive of its anchor
            pair = np.repeat(np.arange(len(i)), n)
            of = np.repeat(first[at][i], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            fits = (score[pair] >= np.maximum(low[of], best.bar[of])) & (score[pair] <= high[of])
            best.add(of[fits], ids[j[pair[fits]]], score[pair[fits]])
        g = best.group
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a.ids[owner[g]], p_ids[g], best.ids, p_scores[g], best.scores)], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def first_rows(found: DataFrame, by: list[str], score: str, other: str, n: int) -> DataFrame:
    """The n first distinct rows of each group with their rank; Spark keeps only a group's first rows of a task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), other)
    distinct = found.withColumn("_d", F.dense_rank().over(order)).where(F.col("_d") <= n)
    return distinct.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "_d").orderBy(other))).where("rank = 1").withColumn("rank", F.col("_d").cast("int")).drop("_d")


def hard_negatives(rows: DataFrame, work: Workspace | None = None, slab_values: int = SLAB) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding), whose labels are as
    they shall be compared. The result reads tables of `work`."""
    work = work or Workspace(rows.sparkSession, "hardneg")
    context = rows.sparkSession.sparkContext
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    size = max(own.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    table = work.put(coded(own, size), "coded")
    anchors = table.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("a")).select("vec_id", "a.*")
    anchors = work.put(anchors, "anchors")
    slabs = max(-(-anchors.count() * size // slab_values), 1)
    parts = []
    for k in range(slabs):
        t = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(slabs)) == k).toArrow().sort_by("vec_id")
        slab = context.broadcast(Anchors(t.column(0).to_numpy(), t.column(1).to_numpy(), np.frombuffer(b"".join(t.column(2).to_pylist()), "<i8").reshape(-1, size)))
        found = table.mapInArrow(best_positives(slab, size), "anchor_id long, vec_id long, score long")
        best = work.put(first_rows(found, ["anchor_id"], "score", "vec_id", POSITIVES), f"positives-{k}").toArrow()  # POSITIVES rows for each anchor of the slab
        best = best.sort_by([("anchor_id", "ascending"), ("rank", "ascending")])
        owner = np.searchsorted(slab.value.ids, best.column("anchor_id").to_numpy())
        positives = context.broadcast((owner, best.column("vec_id").to_numpy(), best.column("score").to_numpy()))
        found = table.mapInArrow(best_negatives(slab, positives, size), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
        # a positive's id can come with two scores, where rows repeat an id
        parts.append(work.put(first_rows(found, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", NEGATIVES), f"negatives-{k}"))
        slab.destroy(), positives.destroy()
    work.drop("coded", "anchors")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS n FROM s WHERE same) WHERE n <= 5),
c AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS n
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM c WHERE n <= 3
"""
