"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. One pass makes of every text its set of shingle hashes, a digest of the set and, from one permutation cut into BINS bins, a
   signature; an empty bin takes the value of the first filled bin in a random order of its own. BANDS bands of ROWS values
   give the bucket keys. Texts with equal sets form a class; from here on one document stands for its class.
2. In every bucket the smallest document is compared with all others (a star), which bounds the pairs by the bucket entries.
   Candidates are confirmed on the full sets, and confirmed links give components.
3. A star can miss a link between two of its ends. So in each bucket that still holds several components, every entry outside
   the bucket's main component is compared with all entries of other components, block by block inside tasks on compact
   signatures; only pairs that may be similar leave a task, and are confirmed on full sets too. A bucket too large for that is
   replaced by groups of its entries' rarest shingles, where every similar pair meets and others do not (see rare_groups). Links
   of both steps give the final components.

Similar means 100 * |intersection| >= 75 * |union|. A pair at exactly 0.75 shares none of the buckets with a chance of about
4e-6 (1 - 0.75^ROWS)^BANDS, one at 0.8 of about 4e-9; everything after the buckets is exact but for a signature bound of 0.58,
five standard deviations below 0.75.

Defined results: texts without words are linked with nothing; rows that share a doc_id are one document, whose classes join: where
their sets differ, each set becomes a node of its own for the search (see one_set_each), and the nodes of a document are linked; a
null doc_id is linked with nothing, has a null component and is kept. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .sieve import passes
from .sieve import sieve as sieve_of
from .store import Workspace
from .text import mix, shingle_sets

#: Words of a shingle, similarity in hundredths, values of a band, bands; bound on compact signatures; entries of a block.
WIDTH, PERCENT, ROWS, BANDS, MAYBE, BLOCK = 5, 75, 6, 64, 0.58, 512
BINS = ROWS * BANDS
#: Pairs of blocks of a bucket that are compared at most, ends of a block of a star.
MOST_BLOCKS, STAR = 16, 256


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """For every bin the place of each other bin in its random order."""
    return np.argsort(np.random.default_rng(20).random((BINS, BINS)), axis=1).astype(np.int16)


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty sorted set of hashes."""
    bins = (((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # hashes are sorted, so the first of a bin is its least
    filled = bins[first]
    sig = np.zeros(BINS, np.uint64)
    sig[filled] = hashes[first]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        sig[empty] = hashes[first][np.argmin(_orders()[empty][:, filled], axis=1)]
    return mix(sig)


_BAND = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ROW = (2 * np.arange(ROWS, dtype=np.uint64) + np.uint64(3)) * np.uint64(0xD6E8FEB86659FD93)


def bands(sig: np.ndarray) -> np.ndarray:
    """Bucket keys of a signature; those of different bands differ."""
    return mix((sig.reshape(BANDS, ROWS) * _ROW).sum(1, dtype=np.uint64) ^ _BAND)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, packed, compact) of docs (doc_id, text)."""

    def make(batches):
        for b in batches:
            sizes, ids, keys, compact = [], [], [], []
            for doc, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), WIDTH), strict=True):
                sizes.append(len(s))
                lone = not len(s) or doc is None
                ids.append(hashlib.blake2b(f"{doc}".encode() if lone else s.tobytes(), digest_size=16, person=b"lone" if lone else b"").digest())
                sig = None if lone else signature(s)
                keys.append(b"" if lone else bands(sig).tobytes())
                compact.append(b"" if lone else sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.binary()), pa.array(compact, pa.binary())], ["doc_id", "n_shingles", "set_id", "packed", "compact"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(make, "doc_id long, n_shingles long, set_id binary, packed binary, compact binary")


def _spread(sieve=None):
    """A row for each bucket of a document; with a sieve most buckets that no other document shares are left out."""

    def run(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            docs = np.repeat(b.column(0).to_numpy(), BANDS)
            if sieve is not None:
                on = passes(sieve.value, keys)
                docs, keys = docs[on], keys[on]
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(keys)], ["doc_id", "key"])

    return run


def put_sets(docs: DataFrame, ids: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Stores (doc_id, shingles) of the documents in ids (doc_id) and a few others: most are sieved out before their text is looked at."""
    sieve = sieve_of(ids, "doc_id")

    def make(batches):
        for b in batches:
            if sieve is not None:
                b = b.filter(pa.array(passes(sieve.value, b.column(0).to_numpy())))
            made = list(shingle_sets(b.column(1), WIDTH))
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(np.concatenate(made).view(np.int64) if made else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["doc_id", "shingles"])

    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if sieve is None:
        own = own.join(ids.select("doc_id"), "doc_id", "left_semi")
    sets = work.put(own.mapInArrow(make, "doc_id long, shingles array<bigint>"), name)
    if sieve is not None:
        sieve.destroy()
    return sets


def _maybe(batches):
    """Of pairs with both compact signatures those that may be similar."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (3, 4))
        yield b.select(["a", "b", "blocks"]).filter(pa.array((x == y).sum(1) >= MAYBE * BINS))


def _star_links(table: pa.Table) -> pa.Table:
    """Of one block of a star the ends whose full sets are similar to the centre's."""
    hub, doc, sets = table.column("hub").to_numpy(zero_copy_only=False), table.column("doc_id").to_numpy(), table.column("shingles")
    centre = int(np.flatnonzero(hub)[0])
    x, found = np.array(sets[centre].values.to_numpy()), []
    for i in np.flatnonzero(~hub):
        y = sets[int(i)].values.to_numpy()
        common = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * common >= PERCENT * (len(x) + len(y) - common):
            found.append(doc[i])
    return pa.table({"a": pa.array(np.full(len(found), doc[centre]), pa.int64()), "b": pa.array(found, pa.int64())})


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Of stars (a: centre, b, n: entries of the bucket) the links (a, b) whose full sets are similar.

    Compact signatures go first. Then the ends of a star are dealt into blocks of about STAR, and the centre's set is copied once for
    each block, not for each end.
    """
    signed = reps.select("doc_id", "compact")
    both = pairs.join(signed.select(F.col("doc_id").alias("b"), F.col("compact").alias("y")), "b").join(signed.select(F.col("doc_id").alias("a"), F.col("compact").alias("x")), "a")
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / STAR, F.lit(1.0))))).cast("int")
    near = work.put(both.select("a", "b", blocks.alias("blocks"), "x", "y").mapInArrow(_maybe, "a long, b long, blocks int"), f"{name}-near")
    sets = put_sets(docs, near.select(F.col("a").alias("doc_id")).unionAll(near.select("b")).distinct(), work, f"{name}-sets")
    ends = near.select("a", "blocks", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.col("b").alias("doc_id"), F.lit(False).alias("hub"))
    hubs = ends.select("a", "blocks", "block").distinct().select("*", F.col("a").alias("doc_id"), F.lit(True).alias("hub"))
    found = work.put(ends.unionAll(hubs).join(sets.dropDuplicates(["doc_id"]), "doc_id").groupBy("a", "blocks", "block").applyInArrow(_star_links, "a long, b long"), f"{name}-links")
    work.drop(f"{name}-sets", f"{name}-near")
    return found


class _Group:
    """The entries of one block pair of a bucket, and which of them may be similar."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table
        self.side = np.array(table.column("side").to_pylist(), bool)
        self.label = table.column("label").to_numpy()
        self.compact = np.frombuffer(b"".join(table.column("compact").to_pylist()), np.uint8).reshape(-1, BINS)
        self.keys = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.int64).reshape(-1, BANDS)
        at = np.flatnonzero(self.keys[0] == table.column("key")[0].as_py()) if len(self.keys) else []
        self.band = int(at[0]) if len(at) else None  # none: the group is that of a rare shingle

    def near(self):
        """(minor entry, entries of other components that may be similar); a pair is met in the first bucket that it shares."""
        others = np.flatnonzero(~self.side)
        for i in np.flatnonzero(self.side):
            found = others[self.label[others] != self.label[i]]
            if self.band is not None and len(found):
                found = found[(self.keys[found] == self.keys[i]).argmax(1) == self.band]
            found = found[(self.compact[found] == self.compact[i]).sum(1) >= MAYBE * BINS]
            if len(found):
                yield i, found


def _candidates(table: pa.Table) -> pa.Table:
    """The entries of a group that are in some pair that may be similar."""
    seen = [np.append(found, i) for i, found in _Group(table).near()]
    return table.select(["key", "m", "b", "side", "doc_id", "label"]).take(pa.array(np.unique(np.concatenate(seen)) if seen else [], pa.int64()))


def _links(table: pa.Table) -> pa.Table:
    group, doc, sets = _Group(table), table.column("doc_id").to_numpy(), table.column("shingles")
    full = [np.array(x.values.to_numpy()) for x in sets]
    a, b = [], []
    for i, found in group.near():
        for j in found:
            common = len(np.intersect1d(full[i], full[j], assume_unique=True))
            if 100 * common >= PERCENT * (len(full[i]) + len(full[j]) - common):
                a.append(min(doc[i], doc[j]))
                b.append(max(doc[i], doc[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def rare_groups(entries: DataFrame, docs: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(key, doc_id, label, index) from entries (doc_id, label): groups by rare shingles, in which every similar pair of entries meets.

    Shingles are ordered by how many entries have them. Two similar sets, the shorter y and the longer x, must share a shingle among the
    first |y| - ceil(2t / (1 + t) |y|) + 1 of y (index) and the first |x| - ceil(t |x|) + 1 of x, t = PERCENT / 100. What is common to
    entries that are not similar comes last in that order, so such entries do not meet, however many they are.
    """
    sets = put_sets(docs, entries.select("doc_id"), work, f"{name}-bigsets").join(entries, "doc_id").dropDuplicates(["doc_id"])
    tokens = sets.select("doc_id", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = tokens.groupBy("key").agg(F.count("*").alias("df"))
    sorted_ = tokens.join(often, "key").groupBy("doc_id", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("order"))
    long = F.col("n") - F.ceil(F.col("n") * PERCENT / 100).cast("int") + 1
    short = F.col("n") - F.ceil(F.col("n") * (2 * PERCENT) / (100 + PERCENT)).cast("int") + 1
    rare = sorted_.select("doc_id", "label", short.alias("short"), F.posexplode(F.slice("order", F.lit(1), long)).alias("pos", "x"))
    rare = work.put(rare.where("x.df > 1").select(F.col("x.key").alias("key"), "doc_id", "label", (F.col("pos") < F.col("short")).alias("index")), f"{name}-rare")
    groups = rare.groupBy("key").agg(F.max("index").alias("i"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("i AND lo <> hi").select("key")
    return work.put(rare.join(groups, "key"), f"{name}-groups")


def leftovers(entries: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, work: Workspace, name: str = "rest") -> DataFrame:
    """Links (a, b) between different components in a common bucket, which step 2 has not compared.

    Near misses can be as many as the square of a group, so pairs are compared inside tasks and only links leave them. Buckets in which
    more than MOST_BLOCKS pairs of blocks would be compared give way to the groups of their entries' rare shingles.
    """
    own = work.put(entries.select("key", "doc_id").join(labels, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label")), f"{name}-entries")
    counted = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = own.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("labels")).where("labels > 1")
    mixed = work.put(mixed.select("key", "main", counted(F.col("all")).alias("nb"), counted(F.col("all") - F.col("most")).alias("nm")), f"{name}-mixed")
    big = F.col("nb").cast("long") * F.col("nm") > MOST_BLOCKS
    dealt = own.join(mixed.where(~big), "key").select("key", "doc_id", "label", (F.col("label") != F.col("main")).alias("minor"), "nb", "nm")
    hot = work.put(own.join(mixed.where(big), "key", "left_semi").select("doc_id", "label").distinct(), f"{name}-hot")
    if not hot.isEmpty():
        rare = rare_groups(hot, docs, work, name)
        sized = rare.groupBy("key").agg(counted(F.count("*")).alias("nb"), counted(F.count_if("index")).alias("nm"))
        dealt = dealt.unionByName(rare.join(sized, "key").select("key", "doc_id", "label", F.col("index").alias("minor"), "nb", "nm"))
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    members = dealt.select("key", "doc_id", "label", F.lit(False).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"), block("nb").alias("b"))
    minors = dealt.where("minor").select("key", "doc_id", "label", F.lit(True).alias("side"), block("nm").alias("m"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
    base, signed = members.unionByName(minors), reps.select("doc_id", "packed", "compact")
    held = base.join(signed, "doc_id").groupBy("key", "m", "b").applyInArrow(_candidates, "key long, m int, b int, side boolean, doc_id long, label long")
    held = work.put(held, f"{name}-held")
    ids = work.put(held.select("doc_id").distinct(), f"{name}-ids")
    sets = put_sets(docs, ids, work, f"{name}-sets").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    found = work.put(held.join(signed.join(sets, "doc_id"), "doc_id").groupBy("key", "m", "b").applyInArrow(_links, "a long, b long").distinct(), f"{name}-links")
    work.drop(*(f"{name}-{x}" for x in ("held", "entries", "mixed", "ids", "sets", "hot", "bigsets", "rare", "groups")))
    return found


def _sets_of(batches):
    """(doc_id, set_id, text) of documents."""
    for b in batches:
        ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in shingle_sets(b.column(1), WIDTH)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), b.column(1)], ["doc_id", "set_id", "text"])


def one_set_each(docs: DataFrame, sigs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(docs, sigs, nodes): documents with several sets give way to a node for each set, whose id no document has.

    nodes (doc_id, set_id, node) names them; None where every document has one set. Nodes have ids above all others, or below them where
    ids come near the greatest long.
    """
    twice = work.put(sigs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("doc_id"), "twice")
    if twice.isEmpty():
        return docs, sigs, None
    least, most = sigs.agg(F.min("doc_id"), F.max("doc_id")).first()
    at = F.monotonically_increasing_id()
    made = sigs.join(twice, "doc_id", "left_semi").select("doc_id", "set_id").distinct()
    nodes = work.put(made.withColumn("node", F.lit(most + 1) + at if most < 1 << 62 else F.lit(least - 1) - at), "nodes")
    known = sigs.join(nodes, ["doc_id", "set_id"], "left").withColumn("doc_id", F.coalesce("node", "doc_id")).select(*sigs.columns)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = own.join(twice, "doc_id", "left_semi").mapInArrow(_sets_of, "doc_id long, set_id binary, text string").join(nodes, ["doc_id", "set_id"]).select(F.col("node").alias("doc_id"), "text")
    return own.join(twice, "doc_id", "left_anti").unionByName(work.put(parts, "parts")), work.put(known, "known"), nodes


def near_duplicates(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text). The result reads tables of `work`."""
    work = work or Workspace(docs.sparkSession, "neardup")
    sigs = work.put(signatures(docs), "signatures")
    texts, known, nodes = one_set_each(docs, sigs, work)
    classes = work.put(known.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes, (known.set_id == classes.set_id) & (known.doc_id == classes.rep), "left_semi")
    reps = work.put(reps.where("length(packed) > 0").select("doc_id", "packed", "compact"), "reps")
    centres = work.put(reps.mapInArrow(_spread(), "doc_id long, key long").groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n")).where("n > 1"), "centres")
    shared = sieve_of(centres, "key")
    entries = work.put(reps.mapInArrow(_spread(shared), "doc_id long, key long").join(centres, "key"), "entries")
    if shared is not None:
        shared.destroy()
    stars = work.put(entries.where("doc_id <> centre").groupBy(F.col("centre").alias("a"), F.col("doc_id").alias("b")).agg(F.max("n").alias("n")), "stars")
    links = confirm(stars, reps, texts, work, "star")
    if nodes is not None:  # a document's sets are one document; a class stands for its nodes
        own = nodes.join(classes, "set_id").select("doc_id", "rep")
        same = own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
        links = work.put(links.unionAll(same), "links")
    first = components(links, work, "first")
    rest = leftovers(entries, first, reps, texts, work)
    # the few links found last join whole components
    a, b = first.select(F.col("node").alias("a"), F.col("component").alias("ca")), first.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    raised = rest.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(raised, work, "last")
    last = first.select("node", F.col("component").alias("c")).unionAll(top.select("node", F.col("node").alias("c"))).join(top.select(F.col("node").alias("c"), F.col("component").alias("t")), "c", "left")
    last = last.groupBy("node").agg(F.min(F.coalesce("t", "c")).alias("component"))
    named = work.put(classes.join(last, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("component_id")), "named")
    if nodes is not None:  # a component is known by its smallest document: of a class the representative, or the documents of its nodes
        real = classes.join(nodes.select(F.col("node").alias("rep")), "rep", "left_anti").select("set_id", F.col("rep").alias("d"))
        least = real.unionAll(nodes.select("set_id", "doc_id")).join(named, "set_id").groupBy("component_id").agg(F.min("d").alias("d"))
        named = work.put(named.join(least, "component_id", "left").select("set_id", F.coalesce("d", "component_id").alias("component_id")), "renamed")
    work.drop("reps", "entries", "centres", "stars")
    out = sigs.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
k AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
