"""Benchmark decontamination by template canonicalisation.

Words lose punctuation at their ends and case, and become templates: what starts with a digit is a number, a capitalised word
inside a sentence is a name, and a word from UNITS after a number is a unit. Windows of WINDOW template words of every benchmark
item and of every document are hashed and joined. A window's placeholders bind the item's values to the document's; a question that
was only re-parameterised binds each value to one other value throughout a copy, so windows that break the majority binding of a
value, in either direction, among the windows at the same offset do not count (of values that are bound equally often the one that
sorts last wins); windows with the item's own values always do. Template windows need LITERALS words that are no placeholders.

Beside them run windows in which only numbers and units are placeholders, as a copy in other letter case has other names, and windows
of the words themselves, as an item may be all placeholders. A document holds an item if the windows of one of the kinds that count, of
all copies, are at least SHARE of the item's of that kind. Items of fewer than WINDOW words are one window of their own length, whose
placeholders must all bind: a template from SHORTEST words on, of which FEW are no placeholders, own words anywhere from ANYWHERE words
on; a shorter item is found where it is a whole line, or several, of a text.

Items that differ in values alone are one template, a class, known by its smallest item_id (class_id of a row); template_classes names
the class of every item, and each is still found by its own words. Only pairs of document and item that share one of the item's rarer windows (all but so many as SHARE needs) are compared, so that a window of many
items and many documents does not multiply them.

Defined results: null and empty texts hold nothing; rows that share a doc_id are one document; rows with a null doc_id cannot be
named and are not reported; repeated benchmark rows count once, a null item_id is an item like any other (it takes the place of the
least long, which is no id). Other columns play no part.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace
from .text import LOWER, hash_spans, mix, slices, word_spans
from .toxicity import TRIM

#: Words of a window, words of it that are no placeholders at least, the same of a short item's window, shortest template, shortest item that is found anywhere, share of an item's windows.
WINDOW, LITERALS, FEW, SHORTEST, ANYWHERE, SHARE = 8, 4, 2, 4, 4, 0.3
#: Kinds of windows: of template words, of own words, of own words that are whole lines, of words with placeholders for numbers and units.
TEMPLATE, OWN, LINE, NUMERIC = 0, 1, 2, 3
NO_ID = -(1 << 63)
#: Of the filter that keeps windows of no item inside the task: bits for each window, so many that few others pass, the least of them,
#: the least and the most bits of a filter; more windows than that take more passes.
PER_WINDOW, LEAST_PER_WINDOW, LEAST_BITS, MOST_BITS = 1024, 64, 1 << 24, 1 << 28
#: Units of measure and currency.
UNITS = "mm cm m km g mg kg t l ml s ms min h hour hours minute minutes second seconds day days week weeks month months year years inch inches foot feet yard yards mile miles ounce ounces pound pounds ton tons liter liters litre litres meter meters metre metres gram grams kilogram kilograms dollar dollars euro euros cent cents percent degree degrees kmh mph watt watts volt volts joule joules newton newtons pascal hz khz mhz ghz kb mb gb tb usd eur gbp".split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA1, 0xB2, 0xC3))
_K = (np.arange(WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"([{"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(hash_spans(raw, np.concatenate([[0], ends[:-1]]), ends, 5))


_UNITS = _unit_hashes()


def templates(column: pa.Array):
    """For slices of a column: (first row, lower-case bytes, word starts, word ends, template words, placeholder kinds (0: none), row boundaries, hashes of the words, which open a line)."""
    for row, buf, bounds in slices(column):
        low = LOWER[buf]
        starts, ends, rows = word_spans(low, bounds)
        raw_ends = ends.copy()
        for _ in range(6):
            at = np.flatnonzero((ends - starts > 1) & TRIM[low[starts]])
            starts[at] += 1
            at = np.flatnonzero((ends - starts > 1) & TRIM[low[ends - 1]])
            ends[at] -= 1
        if not len(starts):
            yield row, low, starts, ends, np.zeros(0, np.uint64), np.zeros(0, np.uint8), rows, np.zeros(0, np.uint64), np.zeros(0, bool)
            continue
        words = hash_spans(low, starts, ends, 5)
        number = _DIGIT[low[starts]]
        opening = np.ones(len(starts), bool)  # first of a text, line or sentence
        lines = np.cumsum(low == 10)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = lines[starts[1:]] != lines[starts[:-1]]
        fresh[rows[:-1][rows[:-1] < len(starts)]] = True
        opening[1:] = _STOP[buf[raw_ends[:-1] - 1]]
        opening |= fresh
        second = low[np.minimum(starts + 1, len(low) - 1)]
        name = _UPPER[buf[starts]] & ~opening & (ends - starts > 1) & (buf[np.minimum(starts + 1, len(buf) - 1)] == second)
        unit = np.zeros(len(starts), bool)
        unit[1:] = number[:-1] & (_UNITS[np.minimum(np.searchsorted(_UNITS, words[1:]), len(_UNITS) - 1)] == words[1:])
        kind = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0))).astype(np.uint8)
        yield row, low, starts, ends, np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, words))), kind, rows, words, fresh


def windows(words: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the window that starts at each word, whether it has enough literal words)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = sum((words[j : j + n] * _K[j] for j in range(width)), np.zeros(n, np.uint64))
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    return mix(total ^ np.uint64(width * 0x51ED27)), literal[width : width + n] - literal[:n] >= (LITERALS if width == WINDOW else FEW)


#: What tells the hash of a window of own words from that of a template.
SALT = [np.uint64(0), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)]
HIT = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("width", pa.int32()), ("cls", pa.int64()), ("slots", pa.list_(pa.string()))])
HIT_DDL = "id long, at long, h long, n long, kind int, width int, cls long, slots array<string>"
#: Kind and width of every window that an item may have.
EVERY = [*((kind, w) for kind in (TEMPLATE, NUMERIC) for w in range(SHORTEST, WINDOW + 1)), *((OWN, w) for w in range(ANYWHERE, WINDOW + 1)), *((LINE, w) for w in range(1, ANYWHERE))]


def _rows(batches, sorts, keep=None):
    """Windows of texts (id, text): id, first word, hash, windows of the text of that kind, kind, width, template class, and the values
    of the placeholders (kind and value). With keep those of documents, else those of items."""
    for b in batches:
        ids, out = b.column(0).to_pylist(), []
        for row, low, starts, ends, words, kind, rows, own, fresh in templates(b.column(1)):
            size, none = np.diff(rows), np.zeros(len(own), np.uint8)
            value = lambda j: f"{kind[j]}:{low[starts[j] : ends[j]].tobytes().decode('utf-8', 'replace')}"  # noqa: B023, E731
            figures = np.where(kind == 2, none, kind)
            views = {TEMPLATE: (words, kind), NUMERIC: (np.where(kind == 2, own, words) ^ SALT[NUMERIC], figures), OWN: (own ^ SALT[OWN], none), LINE: (own ^ SALT[LINE], none)}
            classes = {v: [_class(views[v][0][i:j], [value(k) for k in range(i, j) if views[v][1][k]]) for i, j in zip(rows[:-1], rows[1:], strict=True)] for v in (TEMPLATE, NUMERIC)} if keep is None else {}
            for sort, width in sorts:
                seen, slot = views[sort]
                h, good = windows(seen, slot, width)
                if not len(h):
                    continue
                at = np.arange(len(h))
                of = np.searchsorted(rows, at, side="right") - 1
                good = (good if sort in (TEMPLATE, NUMERIC) else np.ones(len(h), bool)) & (at + width <= rows[of + 1])
                if sort == LINE:
                    last = at + width == rows[of + 1]
                    last[: len(fresh) - width] |= fresh[width:][: len(last)]
                    good &= fresh[: len(h)] & last
                if keep is None:  # items: a short one has one window of its own length
                    good &= (size[of] >= width) if width == WINDOW else (size[of] == width)
                    per = np.bincount(of[good], minlength=len(rows))
                else:
                    good &= keep(h)
                for i in np.flatnonzero(good).tolist():
                    r = of[i]
                    slots = [value(j) for j in range(i, i + width) if slot[j]]
                    out.append((ids[row + r], i - int(rows[r]), int(h[i : i + 1].view(np.int64)[0]), int(per[r]) if keep is None else 0, sort, width, classes[NUMERIC if sort == NUMERIC else TEMPLATE][r] if keep is None else 0, slots))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(HIT), HIT, strict=True)], schema=HIT)


def _class(words: np.ndarray, values: list[str]) -> int:
    """The same for items of the same template words in which the same values are equal."""
    first: dict[str, int] = {}
    pattern = [first.setdefault(v, len(first)) for v in values]
    return int.from_bytes(blake2b(words.tobytes() + b"|" + np.array(pattern, np.int32).tobytes(), digest_size=8).digest(), "little", signed=True)


def template_classes(items: DataFrame) -> DataFrame:
    """(item_id, class_id) of every item (item_id, text) with words: items that differ in values alone have one class, its smallest id."""
    own = items.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text")).distinct()
    named = own.mapInArrow(_classes, "id long, cls long")
    first = named.groupBy("cls").agg(F.min("id").alias("first"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return named.join(first, "cls").select(shown("id").alias("item_id"), shown("first").alias("class_id")).distinct()


def _classes(batches):
    for b in batches:
        ids, out = b.column(0).to_pylist(), []
        for row, low, starts, ends, words, kind, rows, _, _ in templates(b.column(1)):
            for k, (i, j) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
                if j > i:
                    out.append((ids[row + k], _class(words[i:j], [f"{kind[m]}:{low[starts[m] : ends[m]].tobytes().decode('utf-8', 'replace')}" for m in range(i, j) if kind[m]])))
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.int64()) for n in (0, 1)], ["id", "cls"])


def _filter(index: DataFrame, bits: int):
    """A bitmap of the hashes in column h, as a broadcast."""
    place = f"pmod(h, {bits})"
    words = index.selectExpr(f"cast({place} div 32 AS int) AS w", f"shiftleft(1L, cast({place} % 32 AS int)) AS bit").groupBy("w").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words.column("w").to_numpy()] = words.column("bit").to_numpy().astype(np.uint32)
    return index.sparkSession.sparkContext.broadcast(out)


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, work: Workspace | None = None) -> DataFrame:
    """(doc_id, item_id, matched, windows, changed, class_id) of each document (doc_id, text) and the item (item_id, text) it holds.

    matched: distinct windows of the item that count, of the kind of which the larger share does; changed: whether the item is held
    with changed values only; class_id: the item's class (see template_classes), all of whose items the document holds with changed values.
    """
    work = work or Workspace(docs.sparkSession, "decontaminate")
    own = items.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text")).distinct()
    made = work.put(own.mapInArrow(lambda b: _rows(b, EVERY), HIT_DDL), "windows")
    slotted = F.col("kind").isin(TEMPLATE, NUMERIC)
    numeric = F.col("kind") == NUMERIC
    classes = work.put(made.groupBy("cls", numeric.alias("numeric")).agg(F.min("id").alias("id")), "classes")
    first = classes.where("NOT numeric").select("cls", F.col("id").alias("class_id"))
    member = work.put(made.where(~numeric).select("id", "cls").distinct().join(first, "cls").groupBy("id").agg(F.min("class_id").alias("class_id")), "members")
    made = made.withColumn("numeric", numeric).where(slotted).join(classes, ["cls", "numeric", "id"], "left_semi").drop("numeric").unionByName(made.where(~slotted))
    often = made.groupBy("h").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("item_id", "kind").orderBy("often", "i"))
    index = made.join(often, "h").select(F.col("id").alias("item_id"), "h", F.col("at").alias("i"), F.col("n").alias("windows"), "kind", "width", F.col("slots").alias("q"), "often")
    index = work.put(index.withColumn("rare", place <= F.col("windows") - F.greatest(F.lit(1), F.ceil(F.col("windows") * share)) + 1).drop("often"), "index")
    sorts = sorted((r.kind, r.width) for r in index.select("kind", "width").distinct().collect())
    count = index.count()
    bits = min(max(LEAST_BITS, 1 << max(PER_WINDOW * count - 1, 1).bit_length()), MOST_BITS)
    passes = max(1, -(-LEAST_PER_WINDOW * count // MOST_BITS))

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    hits = None
    for k in range(passes):
        shared = _filter(index.where(F.pmod(F.shiftrightunsigned("h", 40), F.lit(passes)) == k), bits)

        def keep(h: np.ndarray, shared=shared, k=k) -> np.ndarray:
            p = (h.view(np.int64) % bits).astype(np.int64)
            return (shared.value[p >> 5] >> (p & 31).astype(np.uint32) & 1).astype(bool) & ((h >> np.uint64(40)) % np.uint64(passes) == k)

        part = work.put(texts.mapInArrow(lambda b, keep=keep: _rows(b, sorts, keep), HIT_DDL), f"hits-{k}").select(F.col("id").alias("doc_id"), "at", "h", F.col("slots").alias("d"))
        hits = part if hits is None else hits.unionAll(part)
        shared.destroy()
    pairs = hits.select("doc_id", "h").distinct().join(index.where("rare").select("h", "item_id", "kind"), "h").select("doc_id", "item_id", "kind").distinct()
    found = pairs.join(index, ["item_id", "kind"]).join(hits, ["doc_id", "h"]).where(F.size("d") == F.size("q"))
    found = work.put(found.select("doc_id", "item_id", "kind", (F.col("at") - F.col("i")).alias("off"), "i", "windows", "q", "d"), "found")
    plain = found.where(F.col("q") == F.col("d")).select("doc_id", "item_id", "kind", "i", "windows", F.lit(False).alias("changed"))
    bound, copy = found.where(F.size("q") > 0), ["doc_id", "item_id", "off"]
    votes = bound.select(*copy, F.explode(F.arrays_zip("q", "d")).alias("p")).groupBy(*copy, F.col("p.q").alias("q"), F.col("p.d").alias("d")).agg(F.count("*").alias("m"))
    to = votes.groupBy(*copy, "q").agg(F.max_by("d", F.struct("m", "d")).alias("best"))
    back = votes.groupBy(*copy, F.col("d").alias("best")).agg(F.max_by("q", F.struct("m", "q")).alias("from"))
    binding = to.join(back, [*copy, "best"]).where(F.col("from") == F.col("q")).groupBy(*copy).agg(F.map_from_entries(F.collect_list(F.struct("q", "best"))).alias("binding"))
    fits = bound.where(F.col("q") != F.col("d")).join(binding, copy).where(F.forall(F.arrays_zip("q", "d"), lambda p: F.coalesce(F.col("binding")[p["q"]] == p["d"], F.lit(False))))
    fits = fits.select("doc_id", "item_id", "kind", "i", "windows", F.lit(True).alias("changed"))
    counted = plain.unionAll(fits).groupBy("doc_id", "item_id", "kind", "windows").agg(F.countDistinct("i").alias("matched"), F.bool_or("changed").alias("changed"))
    counted = counted.where(F.col("matched") >= share * F.col("windows"))
    best = counted.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("matched", "windows"), F.struct(F.col("matched") / F.col("windows"), -F.col("kind"))).alias("b"), F.bool_and("changed").alias("changed"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return best.join(member, best.item_id == member.id).select("doc_id", shown("item_id"), "b.matched", "b.windows", "changed", shown("class_id"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
